import struct

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.errors import PythonException
from pyspark.sql import functions as F

from tidegauge import schemas
from tidegauge.operators import canonical
from tidegauge.plans.messages import encode_readings
from tidegauge.sources.avro_messages import CORRUPT, _read_fields, decode_avro
from tidegauge.sources.json_messages import decode_json
from tidegauge.sources.readers import read_messages, read_tsv, split_quarantine, write_tsv


def varint(n):
    n = (n << 1) ^ (n >> 63)
    out = b""
    while n > 0x7F:
        out += bytes([n & 0x7F | 0x80])
        n >>= 7
    return out + bytes([n])


def reading(sensor=12345, kind=1, t=25.5, h=65.0, p=1013.25, b=85.0, status=1, ts=1704067200123):
    return varint(sensor) + varint(kind) + struct.pack("<dddd", t, h, p, b) + varint(status) + varint(ts)


def messages(spark, *values):
    return spark.createDataFrame([(i, bytearray(v) if v is not None else None) for i, v in enumerate(values)],
                                 "seq long, value binary")


def test_known_message(spark):
    row = decode_avro(messages(spark, reading()), keep=("seq",)).first()
    assert tuple(row) == (0, 12345, 1, 25.5, 65.0, 1013.25, 85.0, 1, 1704067200123)


BAD = [b"", reading()[:-2], reading()[:5], reading() + b"\x00", b"\xff" * 11, None, varint(2**40) + reading()[3:]]


def test_bad_messages_are_kept_apart(spark):
    rows = decode_avro(messages(spark, reading(), *BAD, reading(sensor=-7)), on_error="quarantine", keep=("seq",))
    good, bad = split_quarantine(rows)
    assert {(r.seq, r.sensorId) for r in good.collect()} == {(0, 12345), (len(BAD) + 1, -7)}
    kept = {r.seq: r[CORRUPT] for r in bad.collect()}
    assert sorted(kept) == list(range(1, len(BAD) + 1))
    assert all(bytes(kept[i + 1]) == (value or b"") for i, value in enumerate(BAD))
    assert bad.filter("sensorId is not null or temperature is not null").isEmpty()


def test_bad_message_fails_the_job_or_is_skipped(spark):
    df = messages(spark, reading(), b"\x01")
    assert decode_avro(df, on_error="skip").count() == 1
    with pytest.raises(PythonException, match="undecodable"):
        decode_avro(df).collect()


@settings(max_examples=60, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.tuples(
    st.text(max_size=12), st.floats(allow_nan=False), st.integers(-(2**63), 2**63 - 1), st.text(max_size=5)),
    min_size=1, max_size=20))
def test_text_layout_round_trip(rows):
    import pyarrow as pa

    encoded = [varint(len(a.encode())) + a.encode() + struct.pack("<d", v) + varint(t) + varint(len(b.encode()))
               + b.encode() for a, v, t, b in rows]
    # A slice: the offsets of the array do not start at zero.
    array = pa.array([b"xyz", *encoded, b"q"], pa.large_binary()).slice(1, len(rows))
    fields, good = _read_fields(array, ["string", "double", "long", "string"])
    assert good.all()
    assert list(zip(*[f.to_pylist() for f in fields])) == rows


@settings(max_examples=60, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.binary(max_size=60))
def test_any_bytes_are_decoded_or_refused(data):
    import pyarrow as pa

    fields, good = _read_fields(pa.array([data, reading()], pa.large_binary()),
                                [f.dataType.typeName() for f in schemas.AVRO_READING.fields])
    assert good[1] and fields[0][1].as_py() == 12345
    assert good[0] or all(f[0].as_py() is None for f in fields)


def test_encoder_and_decoder_agree_on_extremes(spark):
    rows = [(i, n, -n - 1, float(n), -0.5, 1e300, -1e-300, n % 5, n * 2**31) for i, n in
            enumerate((0, 1, 63, 64, 8191, 8192, 2**31 - 1))]
    df = spark.createDataFrame(rows, "seq long, sensorId int, sensorType int, temperature double, humidity double, "
                                     "pressure double, batteryLevel double, status int, timestamp long")
    back = decode_avro(encode_readings(df, schemas.AVRO_READING), keep=("seq",))
    assert sorted(map(tuple, back.collect())) == rows


LOCAL = ('{"sensorId":"sensor-1","sensorType":"temperature","location":"test-location","temperature":42.5,'
         '"humidity":65.0,"pressure":1013.25,"batteryLevel":88.0,"status":"active","metadata":{"manufacturer":'
         '"TestCorp","model":"Live-1","firmwareVersion":"v1.0","latitude":37.7749,"longitude":-122.4194}}')


def text(spark, *values):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], "seq long, value string")


def test_json_errors(spark):
    df = text(spark, LOCAL, "not json", '{"sensorId": "x", "temperature": "hot"}', None, LOCAL[:-9])
    assert [r.seq for r in decode_json(df, keep=("seq",)).collect()] == [0]
    good, bad = split_quarantine(decode_json(df, on_error="quarantine", keep=("seq",)))
    assert good.count() == 1 and [r.seq for r in bad.orderBy("seq").collect()] == [1, 2, 3, 4]
    with pytest.raises(Exception, match="MALFORMED_RECORD"):
        decode_json(df, on_error="fail").collect()


def test_empty_messages_are_unreadable(spark):
    df = text(spark, "", "  ", "null", None, "5", LOCAL)
    assert [r.seq for r in decode_json(df, keep=("seq",)).collect()] == [5]
    assert [r.seq for r in canonical.canonicalize_json(df, keep=("seq",)).collect()] == [5]
    rows = decode_json(df, on_error="quarantine", keep=("seq",)).orderBy("seq").collect()
    assert [r[CORRUPT] is None for r in rows] == [False] * 5 + [True]


def test_bytes_are_read_as_text(spark):
    df = text(spark, LOCAL).withColumn("value", F.encode("value", "UTF-8"))
    assert decode_json(df).first().sensorId == "sensor-1"


def test_flatten_local(spark):
    bare = '{"sensorId":"s2","temperature":1.5,"metadata":null}'
    rows = canonical.flatten_local_json(decode_json(text(spark, LOCAL, bare))).collect()
    assert rows[0].asDict() == {
        "sensor_id": "sensor-1", "sensor_type": "temperature", "location": "test-location", "temperature": 42.5,
        "humidity": 65.0, "pressure": 1013.25, "battery_level": 88.0, "status": "active",
        "manufacturer": "TestCorp", "model": "Live-1", "firmware_version": "v1.0",
        "latitude": 37.7749, "longitude": -122.4194}
    assert (rows[1].manufacturer, rows[1].model, rows[1].latitude) == ("", "", 0.0)


def test_canonical_from_json(spark):
    rows = canonical.canonicalize_json(text(
        spark,
        '{"sensorId":12345,"sensorType":1,"location":7,"temperature":25.5,"batteryLevel":85.0,"status":2}',
        '{"device_id":"dev-1","site_id":"s","location":"l","status":"Maintenance","battery_level":3,"packets_sent":9007199254740993}',
        '{"deviceId":"dev-2","deviceType":"t","customerId":"c","siteId":"z","co2Level":450.5,"motionDetected":1}',
        '{"sensorId":null,"device_id":"fallback","temperature":null,"humidity":"wet"}',
        LOCAL, "{}", "no json", '{"sensorId":"m","latitude":5.0,"metadata":{}}',
    ), keep=("seq",), with_time=True).orderBy("seq").collect()
    assert [r.seq for r in rows] == [0, 1, 2, 3, 4, 5, 7]
    a, b, c, d, e, f, g = rows
    assert (a.device_id, a.device_type, a.site_id, a.battery_level, a.status, a.customer_id, a.pressure) == (
        "12345", "1", "7", 85.0, 2, "customer_0001", 1013.25)
    assert (b.device_id, b.site_id, b.status, b.battery_level, b.packets_sent) == (
        "dev-1", "s", 3, 3.0, 9007199254740993)
    assert (c.device_id, c.device_type, c.customer_id, c.site_id, c.co2_level, c.motion_detected) == (
        "dev-2", "t", "c", "z", 450.5, 1)
    assert (d.device_id, d.temperature, d.humidity) == ("fallback", 0.0, 0.0)
    assert (e.latitude, e.status) == (37.7749, 4)
    assert (f.device_id, f.device_type, f.site_id, f.battery_level, f.status, f.light_level) == (
        "device_unknown", "unknown", "site_001", 100.0, 1, 500.0)
    assert g.latitude == 0.0


def test_only_the_fields_of_the_wanted_columns_are_parsed(spark):
    df = text(spark, '{"deviceId":"d","temperature":"hot","latitude":1.5,"metadata":{"longitude":2.5}}', "no json",
              '{"device_id":"e","humidity":3,"time":"2024-01-15T10:30:45Z"}', LOCAL)
    wanted = ("time", "temperature", "longitude", "device_id")
    whole = canonical.canonicalize_json(df, keep=("seq",), with_time=True).select("seq", *wanted)
    part = canonical.canonicalize_json(df, keep=("seq",), columns=wanted)
    assert part.columns == ["seq", *wanted]
    assert sorted(map(str, part.collect())) == sorted(map(str, whole.collect()))
    plan = canonical.canonicalize_json(df, columns=("humidity",))._jdf.queryExecution().optimizedPlan().toString()
    assert "humidity" in plan and "temperature" not in plan and "metadata" not in plan
    with pytest.raises(ValueError, match="no such columns"):
        canonical.canonicalize_json(df, columns=("speed",))


def test_message_times(spark):
    df = text(spark, '{"timestamp":1704067200123}', '{"time":"2024-01-15T10:30:45.123Z"}', '{"time":"soon"}', '{}')
    got = canonical.canonicalize_json(df, with_time=True).select(F.unix_millis("time")).collect()
    assert [r[0] for r in got] == [1704067200123, 1705314645123, None, None]


def test_canonical_from_avro_defaults(spark):
    df = spark.createDataFrame([(None, None, None, None, None, None, None, 5)], "sensorId int, sensorType int, "
                               "temperature double, humidity double, pressure double, batteryLevel double, status int, timestamp long")
    row = canonical.canonicalize_avro(df, with_time=True).first()
    assert (row.device_id, row.device_type, row.site_id, row.temperature, row.pressure, row.battery_level, row.status) == (
        "device_unknown", "temperature_sensor", "site_002", 0.0, 1013.25, 100.0, 1)
    assert tuple(canonical.canonicalize_avro(df).columns) == canonical.CANONICAL_COLUMNS and len(row) == 25


def test_tsv_binds_by_name(spark, tmp_path):
    rows = spark.sql("""select 'd1' as device_id, 2 as status, 450.5D as co2_level, timestamp'2024-01-01 00:00:00.123' as time
                        union all select null, 3, 1.25D, timestamp'2024-01-02 00:00:00'""")
    path = str(tmp_path / "tsv")
    write_tsv(rows.select("co2_level", "time", "status", "device_id"), path)
    back = read_tsv(spark, path, rows.schema)
    assert back.columns == rows.columns
    assert sorted(map(str, back.collect())) == sorted(map(str, rows.collect()))
    bare = str(tmp_path / "bare")
    write_tsv(rows.select("status", "co2_level", "time", "device_id"), bare, header=False)
    back = read_tsv(spark, bare, rows.schema, header_order=["status", "co2_level", "time", "device_id"])
    assert sorted(map(str, back.collect())) == sorted(map(str, rows.collect()))


def test_tsv_files_with_other_headers_are_refused(spark, tmp_path):
    rows = spark.sql("select 'a' as x, 'b' as y")
    path = str(tmp_path / "mixed")
    write_tsv(rows, path)
    rows.select("y", "x").write.mode("append").options(sep="\t").csv(path, header=True)
    with pytest.raises(Exception, match="header"):
        read_tsv(spark, path, rows.schema).collect()


def test_conform_by_name_with_defaults(spark):
    df = spark.sql("""select 'd' as device_id, 1 as status, 36.6D as temperature, cast(null as double) as co2_level,
                      timestamp'2024-01-01 00:00:00.123456' as time, 7 as extra""")
    row = schemas.conform(df).first()
    assert schemas.conform(df).schema.fieldNames() == schemas.SENSORS.fieldNames()
    assert (row.co2_level, row.light_level, row.humidity, row.time.microsecond) == (400.0, 500.0, None, 123000)
    assert abs(row.temperature - 36.6) < 1e-5
    assert [f.dataType for f in schemas.conform(df).schema] == [f.dataType for f in schemas.SENSORS]


def test_topic_reader_starts_at_the_beginning(spark):
    class Recorder:
        def __init__(self): self.seen = {}
        def format(self, f): self.seen["format"] = f; return self
        def options(self, **o): self.seen.update(o); return self
        def load(self): return self.seen

    class Session:
        readStream = Recorder()

    seen = read_messages(Session(), "kafka", {"subscribe": "sensors"})
    assert seen == {"format": "kafka", "startingOffsets": "earliest", "subscribe": "sensors"}
