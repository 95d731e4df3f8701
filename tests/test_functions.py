import pytest
from pyspark.sql import functions as F

from tidegauge.functions import labels, rules
from tidegauge.functions.sampling import in_sample
from tidegauge.functions.timeparts import last, on_day, time_range, with_partition_source


def values(df):
    return [tuple(r) for r in df.collect()]


def test_sensor_type_label(spark):
    df = spark.createDataFrame([(1,), (8,), (0,), (9,), (-3,), (None,)], "c int")
    got = [r[0] for r in df.select(labels.sensor_type_label(F.col("c"))).collect()]
    assert got == ["temperature_sensor", "multisensor", "sensor_type_0", "sensor_type_9", "sensor_type_-3",
                   "temperature_sensor"]


def test_site_label_keeps_sign_of_remainder(spark):
    df = spark.createDataFrame([(0,), (99,), (100,), (12345,), (-1,), (-5,), (-105,), (None,)], "c int")
    got = [r[0] for r in df.select(labels.site_label(F.col("c"))).collect()]
    assert got == ["site_001", "site_100", "site_001", "site_046", "site_000", "site_-04", "site_-04", "site_002"]


@pytest.mark.parametrize("text,code", [
    ("Online", 1), ("offline", 2), ("MAINTENANCE", 3), ("weird", 4), ("2", 2), (None, 1), ("-7", -7),
    ("99999999999", 4), ("1.0", 4),
])
def test_status_code(spark, text, code):
    df = spark.createDataFrame([(text,)], "t string")
    assert df.select(labels.status_code(F.col("t"))).first()[0] == code


@pytest.mark.parametrize("temperature,humidity,battery,first,every,flag", [
    (35.0, 80.0, 20.0, "NORMAL", [], 0),
    (35.125, 80.0, 20.0, "HIGH_TEMPERATURE", ["HIGH_TEMPERATURE"], 1),
    (35.0, 80.75, 20.0, "HIGH_HUMIDITY", ["HIGH_HUMIDITY"], 1),
    (35.0, 80.0, 19.875, "LOW_BATTERY", ["LOW_BATTERY"], 1),
    (36.0, 81.0, 1.0, "HIGH_TEMPERATURE", ["HIGH_TEMPERATURE", "HIGH_HUMIDITY", "LOW_BATTERY"], 1),
    (20.0, 81.0, 1.0, "HIGH_HUMIDITY", ["HIGH_HUMIDITY", "LOW_BATTERY"], 1),
    (20.0, 50.0, None, "NORMAL", ["LOW_BATTERY"], 0),
])
def test_rules_are_strict_and_ordered(spark, temperature, humidity, battery, first, every, flag):
    df = spark.createDataFrame([(temperature, humidity, battery)], "temperature double, humidity double, battery_level double")
    row = df.select(rules.classify_alert(), rules.alert_labels(), rules.has_alert()).first()
    assert tuple(row) == (first, every, flag)


def test_missing_values_may_stay_unknown(spark):
    df = spark.createDataFrame([(None, None, None)], "temperature double, humidity double, battery_level double")
    assert df.select(rules.alert_labels(missing_is_zero=False)).first()[0] == []


def test_rollup_labels(spark):
    df = spark.createDataFrame([(40.0, 1.0, 90.0)], "temperature double, humidity double, battery_level double")
    assert df.select(rules.classify_alert(labels=rules.ROLLUP_LABELS)).first()[0] == "HIGH_TEMP"


def test_time_range_prunes_days(spark, tmp_path):
    df = spark.sql("""select id, timestamp'2024-01-01 00:00:00' + make_interval(0,0,0,0,id) as time from range(96)""")
    df.withColumn("day", F.to_date("time")).write.partitionBy("day").parquet(str(tmp_path / "t"))
    plain = spark.read.parquet(str(tmp_path / "t"))
    # Nothing says that the day is that of the time: no pruning on a guess, and the same rows.
    unpruned = time_range(plain, "2024-01-02 06:00:00", "2024-01-03 00:00:00")
    assert "isnotnull(day" not in unpruned._jdf.queryExecution().executedPlan().toString() and unpruned.count() == 18
    table = with_partition_source(plain, "day", "time")
    picked = time_range(table, "2024-01-02 06:00:00", "2024-01-03 00:00:00")
    assert [r.id for r in picked.orderBy("id").collect()] == list(range(30, 48))
    plan = picked._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(day" in plan and "GreaterThanOrEqual(time" in plan
    assert on_day(table, "2024-01-04").count() == 24
    assert last(table, "2024-01-04 23:00:00", hours=3).count() == 4
    assert last(table, "2024-01-04 23:00:00", hours=3, after=True).count() == 3


def test_zone_free_times_are_compared_uncast(spark):
    df = spark.sql("select timestamp_ntz'2024-01-01 10:00:00' as time")
    picked = last(df, "2024-01-01 10:30:00", hours=1)
    assert picked.count() == 1
    assert "cast(time" not in picked._jdf.queryExecution().optimizedPlan().toString()


def test_sample_takes_whole_keys(spark):
    df = spark.range(20000).select((F.col("id") % 2000).alias("k"))
    picked = df.filter(in_sample(F.col("k"), 0.1)).groupBy("k").count()
    assert 140 < picked.count() < 260
    assert picked.filter("count <> 10").isEmpty()
