import datetime as dt

import pytest
from pyspark.sql import functions as F

from tests.conftest import SMALL
from tidegauge.operators import tables
from tidegauge.plans import reports, views


def same(a, b):
    b = b.select(a.columns)
    return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


@pytest.mark.parametrize("kind", list(reports.SINGLE_DAY))
def test_one_entity_many_parameters_and_all_agree(spark, kind):
    facts = views.sensors(spark, SMALL) if kind in ("temp", "humidity") else views.cpu(spark, SMALL)
    key = reports.SINGLE_DAY[kind][0]
    everything = reports.single_day(facts, kind, "2024-01-15", [2, 9, 14, 20])
    busiest = everything.orderBy(F.desc("readings"), key).first()
    one = reports.single_day(facts, kind, "2024-01-15", [2, 9, 14, 20], entity=busiest[key])
    assert tuple(one.first()) == tuple(busiest)[1:]
    params = facts.select(F.col(key).alias("entity")).distinct().select(
        F.col("entity").alias("param_id"), "entity", F.lit("2024-01-15").cast("date").alias("day"),
        # An hour named twice counts once.
        F.array(*[F.lit(h) for h in (2, 9, 14, 20, 9)]).alias("hours"))
    many = reports.single_day_many(facts, kind, params).filter("readings > 0")
    assert same(everything.withColumnRenamed(key, "entity"), many.drop("param_id", "day"))


def test_parameters_without_readings_get_a_row(spark):
    facts = views.sensors(spark, SMALL)
    params = spark.sql("""select 1 as param_id, 'nobody' as entity, date'2024-01-15' as day, array(1, 2) as hours
                          union all select 2, 'nobody', date'2024-01-15', array()""")
    rows = reports.single_day_many(facts, "temp", params).orderBy("param_id").collect()
    assert [(r.param_id, r.readings, r.avg_temp) for r in rows] == [(1, 0, None), (2, 0, None)]


def test_one_device_without_readings_gives_a_row_of_nulls(spark):
    row = reports.single_day(views.sensors(spark, SMALL), "temp", "2024-01-15", [1], entity="nobody").first()
    assert tuple(row) == (None, None, 0)


def test_newest_rows_skip_old_row_groups(spark):
    rows = reports.newest_rows(views.sensors(spark, SMALL), 5)
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(ts,ScalarSubquery" in plan and "TakeOrderedAndProject" in plan
    expected = views.sensors(spark, SMALL).orderBy(F.desc("time"), F.desc("seq")).limit(5)
    assert [r.seq for r in rows.collect()] == [r.seq for r in expected.collect()]


def test_newest_rows_open_only_the_newest_days(spark, tmp_path):
    df = views.sensors(spark, SMALL)
    tables.write_table(df, str(tmp_path / "t"), tables.LAYOUTS["sensors"])
    rows = reports.newest_rows(tables.read_table(spark, str(tmp_path / "t")), 50)
    assert "PartitionFilters: [isnotnull(day" in rows._jdf.queryExecution().executedPlan().toString()
    expected = df.orderBy(F.desc("time"), F.desc("seq")).limit(50)
    assert [r.seq for r in rows.collect()] == [r.seq for r in expected.collect()]


def test_newest_rows_with_ties_and_few_rows(spark):
    df = spark.sql("select id as seq, timestamp'2024-01-01' as time from range(10)")
    assert [r.seq for r in reports.newest_rows(df, 3).collect()] == [9, 8, 7]
    assert reports.newest_rows(df, 100).count() == 10
    assert reports.newest_rows(df.filter("seq < 0"), 3).count() == 0


def test_current_status_takes_all_values_from_the_newest_row(spark):
    df = spark.sql("""select * from values ('a', timestamp'2024-01-01 00:10:00', 1L, 1.0D, 90.0D),
      ('a', timestamp'2024-01-01 00:20:00', 2L, 5.0D, 10.0D), ('a', timestamp'2024-01-01 00:20:00', 3L, 4.0D, 20.0D),
      ('b', timestamp'2023-12-31 00:00:00', 4L, 9.0D, 9.0D) as t(device_id, time, seq, temperature, humidity)""")
    rows = reports.device_current_status(df, "2024-01-01 01:00:00").collect()
    assert [tuple(r) for r in rows] == [("a", 4.0, 20.0, dt.datetime(2024, 1, 1, 0, 20))]
    assert reports.device_current_status(df, "2024-01-01 01:00:00", device="b").count() == 0


def test_one_site_holding_most_rows(spark):
    df = spark.sql("""select 'c' as customer_id, if(id % 3 = 0, 'hot', concat('s', id % 50)) as site_id,
      concat('d', id % 700) as device_id, 1.0D as temperature, timestamp'2024-01-01' as time from range(20000)""")
    rows = reports.customer_sites(df, "2024-01-01 01:00:00", n=100)
    exact = df.groupBy("customer_id", "site_id").agg(
        F.count_distinct("device_id").alias("device_count"), F.avg("temperature").alias("avg_temp"),
        F.count("*").alias("total_readings"))
    assert same(rows, exact)


def test_approximate_count_is_close(spark):
    df = spark.range(50000).select(F.concat(F.lit("d"), F.col("id")).alias("device_id"))
    assert abs(reports.unique_devices(df, exact=False).first()[0] - 50000) < 50000 * 0.06
    assert reports.unique_devices(df).first()[0] == 50000


def test_write_rate_of_an_empty_minute(spark):
    df = spark.sql("select timestamp'2024-01-01' as time")
    assert tuple(reports.write_rate(df, "2024-02-01 00:00:00").first()) == (0, 0.0, 0.0)
    assert tuple(reports.write_rate(df, "2024-01-01 00:00:30").first()) == (1, 1 / 60, 0.02)


def test_lines_of_text(spark):
    df = spark.sql("""select 's1' as sensor_id, 42.5D as temperature, 65.0D as humidity, 88.0D as battery_level,
      'HIGH_TEMPERATURE' as alert_type, timestamp'2024-01-01' as time, timestamp'2024-01-01' as alert_time, 1 as seq""")
    assert reports.reading_lines(df).first()[0] == "s1: 42.5°C, 65.0% humidity, 88.0% battery"
    assert reports.alert_lines(df).first()[0] == "s1 - HIGH_TEMPERATURE (42.5°C)"
    assert {r[0] for r in reports.count_lines(raw=df, other=df.limit(0)).collect()} == {"raw: 1", "other: 0"}


def test_parameters_prune_partitions(spark, tmp_path):
    out = str(tmp_path / "sensors")
    tables.write_table(views.sensors(spark, SMALL), out, tables.LAYOUTS["sensors"])
    stored = tables.read_table(spark, out)
    params = spark.sql("select 1 as param_id, 'sensor_7' as entity, date'2024-01-15' as day, array(1, 2) as hours")
    rows = reports.single_day_many(stored, "temp", params)
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(day" in plan and "day#" in plan.split("PartitionFilters")[1].split("PushedFilters")[0]
    assert rows.first().readings == reports.single_day(stored, "temp", "2024-01-15", [1, 2], entity="sensor_7").first().readings


def test_stored_reports_prune_days_and_push_the_device(spark, tmp_path):
    out = str(tmp_path / "sensors")
    tables.write_table(views.sensors(spark, SMALL), out, tables.LAYOUTS["sensors"])
    rows = reports.device_current_status(tables.read_table(spark, out), views.AS_OF, device="sensor_7", days=2)
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "day#" in plan.split("PartitionFilters")[1].split("PushedFilters")[0]
    # The plan's text cuts long lists of filters.
    assert "EqualTo(device" in plan and "SortAggregate" not in plan
