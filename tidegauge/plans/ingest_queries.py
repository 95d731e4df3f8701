"""Sources, decoders and canonical rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegauge import schemas
from tidegauge.functions import labels
from tidegauge.operators import canonical
from tidegauge.operators.tables import Layout, read_table
from tidegauge.plans import views
from tidegauge.plans.messages import encode_readings
from tidegauge.plans.registry import over_sensors, plain_times, query
from tidegauge.session import work_dir
from tidegauge.sources.avro_messages import CORRUPT, decode_avro
from tidegauge.sources.json_messages import decode_json
from tidegauge.sources.readers import read_messages, read_tsv, split_quarantine, write_tsv
from tidegauge.streaming import jobs
from tidegauge.streaming.sinks import table_sink

SENSOR_ID = "cast(substr(device_id, 8) as int)"
MILLIS = "date_trunc('millisecond', time)"


@query("a1_stream_source", "select event_id, ts, user_id, event_type, value, props from events")
def stream_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_messages(
        spark, "parquet", {"pathGlobFilter": "events.parquet"}, schema=views.EVENTS, path=sf_dir
    )
    out = work_dir(spark, "a1")
    sink = table_sink(out, Layout("ts", ("user_id",)), writer="a1")
    jobs.start(rows, sink, jobs.Run(out, work_dir(spark, "a1-checkpoint"), None)).awaitTermination()
    return read_table(spark, out).select("event_id", "ts", "user_id", "event_type", "value", "props")


AVRO_FIELDS = f"""{SENSOR_ID} as "sensorId", cast(seq % 8 + 1 as int) as "sensorType",
  temperature, humidity, pressure, battery_level as "batteryLevel", status, epoch_us(time) // 1000 as "timestamp" """


def _avro_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_readings(views.avro_readings(views.sensors(spark, sf_dir)), schemas.AVRO_READING)


@query("a2_avro_ingest", over_sensors(f"select seq, {AVRO_FIELDS} from sensors"))
def avro_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decode_avro(_avro_messages(spark, sf_dir), keep=("seq",))


@query("a2_avro_minimal", over_sensors("""
  select seq, device_id as "sensorId", temperature as value, epoch_us(time) // 1000 as "timestamp", device_type as type
  from sensors"""))
def avro_minimal(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = views.sensors(spark, sf_dir).select(
        "seq", F.col("device_id").alias("sensorId"), F.col("temperature").alias("value"),
        F.unix_millis(F.col("time").cast("timestamp")).alias("timestamp"), F.col("device_type").alias("type"),
    )
    return decode_avro(encode_readings(rows, schemas.AVRO_MINIMAL), schemas.AVRO_MINIMAL, keep=("seq",))


def _json_integer_sql(where: str = "") -> str:
    return over_sensors(f"""select seq, {SENSOR_ID} as "sensorId", cast(seq % 8 + 1 as int) as "sensorType",
      {SENSOR_ID} % 100 + 1 as location, temperature, humidity, pressure, battery_level as "batteryLevel", status,
      {MILLIS} as "timestamp" from sensors {where}""")


@query("a3_json_typed", _json_integer_sql())
def json_typed(spark: SparkSession, sf_dir: str) -> DataFrame:
    messages = views.integer_messages(views.sensors(spark, sf_dir))
    return plain_times(decode_json(messages, schemas.JSON_INTEGER, keep=("seq",)))


@query("a3_json_nested", over_sensors(f"""
  select seq, device_id as "sensorId", device_type as "sensorType", site_id as location,
    temperature, humidity, pressure, battery_level as "batteryLevel",
    case when status = 1 then 'active' else 'inactive' end as status, {MILLIS} as "timestamp",
    case when status <> 3 then device_type end as model,
    case when status <> 3 then latitude end as latitude, case when status <> 3 then longitude end as longitude
  from sensors"""))
def json_nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = decode_json(views.local_messages(views.sensors(spark, sf_dir)), schemas.JSON_LOCAL, keep=("seq",))
    return plain_times(rows.select("*", "metadata.model", "metadata.latitude", "metadata.longitude").drop("metadata"))


def _broken_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages of sensors in error are cut off or have a word for a number."""
    rows = views.sensors(spark, sf_dir)
    broken = F.when(F.col("seq") % 2 == 0, F.expr("substring(value, 1, length(value) - 9)")).otherwise(
        F.regexp_replace("value", '"temperature":[0-9.]+', '"temperature":"hot"'))
    messages = views.integer_messages(rows).join(rows.select("seq", F.col("status").alias("state")), "seq")
    return messages.withColumn("value", F.when(F.col("state") == 4, broken).otherwise(F.col("value")))


@query("a4_json_lenient", _json_integer_sql("where status <> 4"))
def json_lenient(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plain_times(decode_json(_broken_json(spark, sf_dir), schemas.JSON_INTEGER, keep=("seq",)))


@query("a5_quarantine_json", over_sensors("select seq, 4 as state from sensors where status = 4"))
def quarantine_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    decoded = decode_json(
        _broken_json(spark, sf_dir), schemas.JSON_INTEGER, on_error="quarantine", keep=("seq", "state"))
    return split_quarantine(decoded)[1].select("seq", "state")


@query("a5_quarantine_avro", over_sensors(f"""
  select seq, status = 4 as quarantined, case when status <> 4 then {SENSOR_ID} else -1 end as "sensorId" from sensors"""))
def quarantine_avro(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages of sensors in error lose their last bytes."""
    readings = views.avro_readings(views.sensors(spark, sf_dir))
    messages = encode_readings(readings, schemas.AVRO_READING, keep=("seq", "status"))
    cut = F.expr("substring(value, 1, length(value) - 3)")
    messages = messages.select("seq", F.when(F.col("status") == 4, cut).otherwise(F.col("value")).alias("value"))
    decoded = decode_avro(messages, on_error="quarantine", keep=("seq",))
    number = F.coalesce("sensorId", F.lit(-1)).alias("sensorId")
    return decoded.select("seq", F.col(CORRUPT).isNotNull().alias("quarantined"), number)


@query("a6_tsv_by_name", over_sensors(f"""
  select device_id, device_type, customer_id, site_id, latitude, longitude, altitude, {MILLIS} as time,
    temperature, humidity, pressure, battery_level, status, co2_level, motion_detected, bytes_sent from sensors"""))
def tsv_by_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Written in another column order than the table's, read back by header."""
    table = views.sensors(spark, sf_dir).select(
        "device_id", "device_type", "customer_id", "site_id", "latitude", "longitude", "altitude", "time",
        "temperature", "humidity", "pressure", "battery_level", "status", "co2_level", "motion_detected",
        "bytes_sent",
    )
    out = work_dir(spark, "a6")
    write_tsv(table.select(sorted(table.columns)), out)
    return read_tsv(spark, out, table.schema)


# ---------------------------------------------------------------------------
# Canonical rows
# ---------------------------------------------------------------------------
CANONICAL_FROM_AVRO = """
  select seq, device_id, device_type, 'customer_0001' as customer_id, site_id,
    0.0E0 as latitude, 0.0E0 as longitude, 0.0E0 as altitude, temperature, humidity, pressure,
    400.0E0 as co2_level, 50.0E0 as noise_level, 500.0E0 as light_level, 0 as motion_detected, battery_level,
    -50.0E0 as signal_strength, 50.0E0 as memory_usage, 30.0E0 as cpu_usage, status,
    cast(0 as bigint) as error_count, cast(0 as bigint) as packets_sent, cast(0 as bigint) as packets_received,
    cast(0 as bigint) as bytes_sent, cast(0 as bigint) as bytes_received
  from sensors"""


@query("b1_canonicalize_avro", over_sensors(CANONICAL_FROM_AVRO))
def canonicalize_avro(spark: SparkSession, sf_dir: str) -> DataFrame:
    return canonical.canonicalize_avro(views.avro_readings(views.sensors(spark, sf_dir)), keep=("seq",))


@query("b2_sensor_type_label", """
  select event_id, case cast(event_id % 11 as int) when 1 then 'temperature_sensor' when 2 then 'humidity_sensor'
    when 3 then 'pressure_sensor' when 4 then 'motion_sensor' when 5 then 'light_sensor' when 6 then 'co2_sensor'
    when 7 then 'noise_sensor' when 8 then 'multisensor'
    else concat('sensor_type_', cast(event_id % 11 as varchar)) end as device_type from events""")
def sensor_type_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    code = (F.col("event_id") % 11).cast("int")
    return views.events(spark, sf_dir).select("event_id", labels.sensor_type_label(code).alias("device_type"))


@query("b3_site_of", "select event_id, printf('site_%03d', (user_id - 7) % 100 + 1) as site_id from events")
def site_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    sensor = (F.col("user_id") - 7).cast("int")
    return views.events(spark, sf_dir).select("event_id", labels.site_label(sensor).alias("site_id"))


@query("b4_canonicalize_json_wide", over_sensors(f"""
  select seq, device_id, device_type, customer_id, site_id, latitude, longitude, altitude, temperature, humidity,
    pressure, co2_level, noise_level, light_level, motion_detected, battery_level, signal_strength, memory_usage,
    cpu_usage, status, error_count, packets_sent, packets_received, bytes_sent, bytes_received, {MILLIS} as time
  from sensors"""))
def canonicalize_json_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    messages = views.wide_messages(views.sensors(spark, sf_dir).withColumn("time", F.col("time").cast("timestamp")))
    return plain_times(canonical.canonicalize_json(messages, keep=("seq",), with_time=True))


@query("b4_canonicalize_json_local", over_sensors("""
  select seq, device_id, device_type, 'customer_0001' as customer_id, site_id,
    case when status <> 3 then latitude else 0.0E0 end as latitude,
    case when status <> 3 then longitude else 0.0E0 end as longitude, 0.0E0 as altitude,
    temperature, humidity, pressure, 400.0E0 as co2_level, battery_level, 4 as status,
    cast(0 as bigint) as packets_sent
  from sensors"""))
def canonicalize_json_local(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The local messages' status words are none of the wide model's."""
    rows = canonical.canonicalize_json(views.local_messages(views.sensors(spark, sf_dir)), keep=("seq",))
    return rows.select(
        "seq", "device_id", "device_type", "customer_id", "site_id", "latitude", "longitude", "altitude",
        "temperature", "humidity", "pressure", "co2_level", "battery_level", "status", "packets_sent",
    )


STATUS_WORDS = """case when seq % 2 = 0 then {number} when status = 1 then 'Online' when status = 2 then 'offline'
  when status = 3 then 'MAINTENANCE' else 'weird' end"""


@query("b5_status_code", over_sensors("select seq, status from sensors"))
def status_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers and words for the same codes."""
    text = F.expr(STATUS_WORDS.format(number="cast(status as string)"))
    rows = views.sensors(spark, sf_dir).select("seq", text.alias("text"))
    return rows.select("seq", labels.status_code(F.col("text")).alias("status"))


FLAT_SQL = """
  select seq, device_id as sensor_id, device_type as sensor_type, site_id as location,
    temperature, humidity, pressure, battery_level,
    case when status = 1 then 'active' else 'inactive' end as status,
    case when status <> 3 then 'TestCorp' else '' end as manufacturer,
    case when status <> 3 then device_type else '' end as model,
    case when status <> 3 then 'v1.0' else '' end as firmware_version,
    case when status <> 3 then latitude else 0.0E0 end as latitude,
    case when status <> 3 then longitude else 0.0E0 end as longitude
  from sensors"""


@query("b6_flatten_local_json", over_sensors(FLAT_SQL))
def flatten_local_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    messages = views.local_messages(views.sensors(spark, sf_dir))
    return canonical.flatten_local_json(decode_json(messages, schemas.JSON_LOCAL, keep=("seq",)), keep=("seq",))


@query("b7_has_alert", over_sensors("select seq, cast(has_alert as smallint) as has_alert from sensors"))
def has_alert(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.sensors_flagged(spark, sf_dir).select("seq", "has_alert")


@query("b8_total_usage", over_sensors("select seq, hostname, usage_user + usage_system as total_usage from cpu"))
def total_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return canonical.with_total_usage(views.cpu(spark, sf_dir)).select("seq", "hostname", "total_usage")


@query("b9_column_defaults", over_sensors("""
  select seq, case when status = 4 then 0.0E0 else latitude end as latitude,
    case when status = 4 then 400.0E0 else co2_level end as co2_level,
    case when status = 4 then cast(0 as bigint) else packets_sent end as packets_sent,
    50.0E0 as memory_usage, -50.0E0 as signal_strength
  from sensors"""))
def column_defaults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows in error arrive with nulls, and two columns are not sent at all."""
    sent = F.col("status") != 4
    rows = views.sensors(spark, sf_dir).select(
        "seq", *[F.when(sent, F.col(c)).alias(c) for c in ("latitude", "co2_level", "packets_sent")]
    )
    filled = schemas.fill_defaults(rows)
    return filled.select("seq", "latitude", "co2_level", "packets_sent", "memory_usage", "signal_strength")


# The narrow types of the table, written out.
_NARROW = over_sensors(f"""
  select seq, device_id, device_type, customer_id, site_id, latitude, longitude, {MILLIS} as time,
    altitude::float as altitude, temperature::float as temperature, humidity::float as humidity, pressure::float as pressure,
    battery_level::float as battery_level, status::smallint as status, co2_level::float as co2_level,
    noise_level::float as noise_level, light_level::float as light_level, motion_detected::smallint as motion_detected,
    signal_strength::float as signal_strength, memory_usage::float as memory_usage, cpu_usage::float as cpu_usage,
    error_count::bigint as error_count, packets_sent::bigint as packets_sent, packets_received::bigint as packets_received,
    bytes_sent::bigint as bytes_sent, bytes_received::bigint as bytes_received
  from sensors""")


@query("b10_conform_types", _NARROW)
def conform_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    return schemas.conform(views.sensors(spark, sf_dir), keep=("seq",))


@query("b11_round_values", over_sensors("""
  select seq, round(temperature, 2) as temperature, round(humidity, 2) as humidity, round(pressure, 2) as pressure,
    round(battery_level, 2) as battery_level, round(latitude, 6) as latitude, round(longitude, 6) as longitude
  from sensors"""))
def round_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = canonical.round_values(views.sensors(spark, sf_dir))
    return rows.select("seq", "temperature", "humidity", "pressure", "battery_level", "latitude", "longitude")
