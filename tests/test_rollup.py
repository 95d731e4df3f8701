import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tidegauge.operators import alerting, canonical, hourly, rollup
from tidegauge.plans import views

T0 = dt.datetime(2024, 1, 1, 12, 0, 0)


def at(seconds):
    return T0 + dt.timedelta(seconds=seconds)


def rows_of(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


@pytest.mark.parametrize("motion,expected", [([1], 1), ([0], 0), ([1, 0], 0), ([1, 1], 1), ([1, 1, 0], 1), ([1, 0, 0], 0)])
def test_motion_needs_a_strict_majority(sensor_rows, motion, expected):
    df = sensor_rows([(i, "d", at(i), m) for i, m in enumerate(motion)],
                     "seq long, device_id string, time timestamp, motion_detected int")
    assert rollup.rollup_sensors(df).first().motion_detected == expected


@pytest.mark.parametrize("status,expected", [([1, 2], 1), ([4, 4, 3], 3), ([1, 4], 2), ([2], 2)])
def test_status_is_the_truncated_mean(sensor_rows, status, expected):
    df = sensor_rows([(i, "d", at(i), s) for i, s in enumerate(status)],
                     "seq long, device_id string, time timestamp, status int")
    assert rollup.rollup_sensors(df).first().status == expected


def test_first_reading_gives_the_metadata(sensor_rows):
    df = sensor_rows(
        [(5, "d", at(10), "late", 1.0), (9, "d", at(3), "second", 2.0), (2, "d", at(3), "first", 3.0)],
        "seq long, device_id string, time timestamp, device_type string, latitude double")
    row = rollup.rollup_sensors(df).first()
    assert (row.device_type, row.latitude, row.reading_count) == ("first", 3.0, 3)


def test_extremes_of_negative_values(sensor_rows):
    df = sensor_rows([(0, "d", at(0), -90.0), (1, "d", at(1), -30.0)],
                     "seq long, device_id string, time timestamp, signal_strength double")
    row = rollup.rollup_sensors(df, with_extremes=True).first()
    assert (row.min_signal_strength, row.max_signal_strength, row.signal_strength) == (-90.0, -30.0, -60.0)


def test_windows_are_half_open_and_time_is_their_end(sensor_rows):
    df = sensor_rows([(0, "d", at(0)), (1, "d", at(59.999)), (2, "d", at(60))])
    got = rows_of(rollup.rollup_sensors(df), "window_start", "window_end", "time", "reading_count")
    assert got == [(at(0), at(60), at(60), 2), (at(60), at(120), at(120), 1)]


def test_counters_do_not_overflow(sensor_rows):
    big = 2**31 - 1
    df = sensor_rows([(i, "d", at(i), big) for i in range(4)],
                     "seq long, device_id string, time timestamp, error_count int")
    assert rollup.rollup_sensors(df).first().error_count == 4 * big


def test_placeholders_or_measured_usage(sensor_rows):
    df = sensor_rows([(0, "d", at(0), 10.0), (1, "d", at(1), 20.0)],
                     "seq long, device_id string, time timestamp, cpu_usage double")
    assert rollup.rollup_sensors(df).first().cpu_usage == 30.0
    assert rollup.rollup_sensors(df, real_usage=True).first().cpu_usage == 15.0


def test_no_rows_no_windows(sensor_rows):
    df = sensor_rows([], "seq long, device_id string, time timestamp")
    assert rollup.rollup_sensors(df).count() == 0 and rollup.sensor_metrics(df).count() == 0


def test_other_key_keeps_the_first_device(sensor_rows):
    df = sensor_rows([(0, "b", at(5)), (1, "a", at(1))])
    row = rollup.rollup_sensors(df, key="site_id").first()
    assert (row.site_id, row.device_id, row.reading_count) == ("site_001", "a", 2)


def test_merging_states_equals_the_wider_rollup(spark):
    from tests.conftest import SMALL

    sensors = views.sensors(spark, SMALL)
    direct = rollup.rollup_sensors(sensors, "1 hour", with_extremes=True)
    states = rollup.rollup_states(sensors, "1 minute")
    merged = rollup.finish_rollup(rollup.merge_rollups(states, "1 hour"), with_extremes=True)
    assert merged.columns == direct.columns
    assert merged.exceptAll(direct).isEmpty() and direct.exceptAll(merged).isEmpty()
    # States of the same windows from several batches.
    parts = [rollup.rollup_states(sensors.filter(f"seq % 3 = {i}"), "1 day") for i in range(3)]
    merged = rollup.finish_rollup(rollup.merge_rollups(parts[0].unionByName(parts[1]).unionByName(parts[2])))
    direct = rollup.rollup_sensors(sensors, "1 day")
    assert merged.exceptAll(direct).isEmpty() and direct.exceptAll(merged).isEmpty()


def random_readings(spark, n=3000):
    rng = random.Random(7)
    rows = [(
        i, rng.choice([7, 7, 7, 1, 2, None]), rng.choice([1, 2, 3, 9, None]), rng.randrange(0, 320) / 8.0,
        rng.choice([None, 50.0, 81.5]), 1000.0, rng.randrange(0, 100) * 1.0, rng.choice([1, 2, 4, None]),
        1704067200000 + rng.randrange(0, 3 * 86400) * 1000,
    ) for i in range(n)]
    df = spark.createDataFrame(rows, "seq long, sensorId int, sensorType int, temperature double, humidity double, "
                                     "pressure double, batteryLevel double, status int, timestamp long")
    return df.withColumn("time", F.timestamp_millis("timestamp"))


@pytest.mark.parametrize("window", ["1 minute", "1 hour", "1 day", "2 days"])
def test_rollup_on_codes_equals_rollup_of_canonical_rows(spark, window):
    readings = random_readings(spark)
    by_code = rollup.rollup_readings(readings, window, with_extremes=True)
    canonical_rows = canonical.canonicalize_avro(readings, keep=("seq",), with_time=True)
    by_row = rollup.rollup_sensors(canonical_rows, window, with_extremes=True)
    # Null ids: the code route groups them under their shared label, as rows do.
    assert sorted(by_code.columns) == sorted(by_row.columns)
    by_row = by_row.select(by_code.columns)
    assert by_code.count() == by_row.count()
    assert by_code.exceptAll(by_row).isEmpty() and by_row.exceptAll(by_code).isEmpty()


def test_states_on_codes_merge(spark):
    readings = random_readings(spark)
    merged = rollup.finish_readings(rollup.merge_rollups(rollup.reading_states(readings, "1 minute"), "1 hour", key="sensorId"))
    direct = rollup.rollup_readings(readings, "1 hour")
    assert merged.exceptAll(direct).isEmpty() and direct.exceptAll(merged).isEmpty()


def test_rollup_on_codes_aggregates_in_hash_tables(spark):
    plan = rollup.rollup_readings(random_readings(spark, 10), "1 minute")._jdf.queryExecution().executedPlan().toString()
    assert "HashAggregate" in plan and "SortAggregate" not in plan and "ObjectHashAggregate" not in plan


def test_averages_alone_aggregate_in_hash_tables(spark, sensor_rows):
    df = rollup.rollup_sensors(sensor_rows([(0, "d", at(0))])).select("device_id", "time", "temperature", "status")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan and "min(humidity" not in plan


def test_hourly_states_average_windows_not_readings(sensor_rows):
    # Two windows with means 10 and 40; three readings in the first.
    df = sensor_rows([(0, "d", at(0), 10.0), (1, "d", at(1), 10.0), (2, "d", at(2), 10.0), (3, "d", at(60), 40.0)],
                     "seq long, device_id string, time timestamp, temperature double")
    states = hourly.hourly_states(rollup.sensor_metrics(df))
    row = hourly.finish_hourly(hourly.merge_hourly_states(states)).first()
    assert (row.temperature_avg, row.total_readings, row.hour_window) == (25.0, 4, T0)


def test_latest_status_takes_one_row(sensor_rows):
    df = sensor_rows([(0, "d", at(0), 10.0, 5.0), (1, "d", at(3600), 20.0, 70.0)],
                     "seq long, device_id string, time timestamp, temperature double, battery_level double")
    row = hourly.latest_status(rollup.sensor_metrics(df, "1 hour")).first()
    assert (row.latest_temperature, row.latest_battery, row.last_update) == (20.0, 70.0, at(7200))


def test_alert_rows(sensor_rows):
    df = sensor_rows([(0, "a", at(0), 40.0, 1), (1, "b", at(1), 40.0, 2), (2, "c", at(2), 30.0, 1)],
                     "seq long, device_id string, time timestamp, temperature double, status int")
    named = alerting.sensor_names(df)
    active = alerting.alert_rows(named, "time", active=F.col("status") == 1)
    assert tuple(active.columns) == alerting.ALERT_COLUMNS
    assert rows_of(active, "sensor_id", "alert_type", "alert_time") == [("a", "HIGH_TEMPERATURE", at(0))]
    assert rows_of(alerting.alert_rows(named, "time"), "sensor_id") == [("a",), ("b",)]
    assert rows_of(alerting.alert_counts(alerting.alert_rows(named, "time")), "alert_type", "alert_count") == [
        ("HIGH_TEMPERATURE", 2)]


def test_nulls_do_not_count_in_averages(spark, sensor_rows):
    rows = sensor_rows([(i, "d", T0 + dt.timedelta(seconds=i), None if i % 2 else float(i), None if i % 3 else 4)
                        for i in range(12)], "seq long, device_id string, time timestamp, temperature double, status int")
    got = rollup.rollup_sensors(rows, "1 minute").first()
    assert got.temperature == 5.0 and got.status == 4 and got.reading_count == 12
    none = rollup.rollup_sensors(rows.withColumns({"temperature": F.lit(None).cast("double"), "status": F.lit(None).cast("int")})).first()
    assert none.temperature is None and none.status is None


def test_first_reading_by_long_positions(spark):
    """Positions beyond 2^36 of one microsecond, and windows of any length."""
    rows = spark.createDataFrame(
        [(1, 2 if seq == 2**36 - 1 else 3, 1, 20.0, T0, seq) for seq in (2**36 - 1, 2**36, 2**62)],
        "sensorId int, sensorType int, status int, temperature double, time timestamp, seq long")
    rows = rows.withColumns({c: F.lit(1.0) for c in ("humidity", "pressure", "batteryLevel")})
    for window in ("1 minute", "7 days"):
        states = rollup.reading_states(rows, window)
        assert states.first().first_seen.first_type == 2
        plan = states._jdf.queryExecution().executedPlan().toString()
        assert "SortAggregate" not in plan
