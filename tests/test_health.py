import math
import random
import statistics

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidegauge.operators import health


def by_hand(values):
    ordered = sorted(values)
    n = len(ordered)
    return (n, ordered[0], ordered[-1], statistics.median(ordered), ordered[int(n * 0.95)], ordered[int(n * 0.99)])


def summary(df, by=()):
    return df.select(*by, "total", "min", "max", "p50", "p95", "p99")


@settings(max_examples=12, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.one_of(
    st.floats(-1e9, 1e9, allow_nan=False), st.sampled_from([0.0, 1.5, 1.5001, -2.0])), min_size=1, max_size=80))
def test_latency_summary_equals_sorting(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "ms double")
    row = health.latency_summary(df, "ms")
    assert tuple(summary(row).first()) == by_hand(values)
    assert math.isclose(row.first()["mean"], statistics.fmean(values), rel_tol=1e-9, abs_tol=1e-3)


def test_latency_summary_per_group_with_a_hot_group_and_a_null_group(spark):
    rng = random.Random(3)
    groups = {"hot": 5000, None: 400, "one": 1, "two": 2}
    rows = [(g, rng.choice([rng.expovariate(0.1), 7.0])) for g, n in groups.items() for _ in range(n)]
    df = spark.createDataFrame(rows + [("hot", None)], "g string, ms double")
    got = {r.g: tuple(r)[1:] for r in summary(health.latency_summary(df, "ms", ["g"]), ["g"]).collect()}
    assert got == {g: by_hand([v for k, v in rows if k == g]) for g in groups}


def test_latency_summary_of_nothing(spark):
    assert health.latency_summary(spark.createDataFrame([], "ms double"), "ms").count() == 0


def test_latency_summary_collects_no_group(spark):
    df = spark.range(10).select(F.col("id").cast("double").alias("ms"))
    plan = health.latency_summary(df, "ms")._jdf.queryExecution().executedPlan().toString()
    assert "collect_list" not in plan and "CartesianProduct" not in plan and "BroadcastNestedLoop" not in plan


@pytest.mark.parametrize("percent,band", [(49.9, "red"), (50.0, "yellow"), (95.0, "yellow"), (95.1, "green"), (99.97, "green")])
def test_reduction_bands(spark, percent, band):
    assert spark.range(1).select(health.reduction_band(F.lit(percent))).first()[0] == band


@pytest.mark.parametrize("rate,band,alarm", [(8.0, "green", False), (100.5, "green", True), (500.0, "yellow", True),
                                             (1000.0, "yellow", True), (1001.0, "red", True)])
def test_write_rate_bands(spark, rate, band, alarm):
    df = spark.createDataFrame([(rate,)], "rows_per_second double")
    row = health.write_rate_status(df).first()
    assert (row.band, row.alarm) == (band, alarm)


def test_observed_reduction(spark):
    # 600,090 rows in, 432,657 rows out.
    df = spark.sql("""select 1L as reading_count from range(432656)
                      union all select 167434L as reading_count""")
    row = health.rollup_reduction(df).first()
    assert (row.rows_in, row.rows_out, row.band, row.alarm) == (600090, 432657, "red", True)
    assert round(row.reduction_percent) == 28


def test_reduction_of_nothing(spark):
    row = health.rollup_reduction(spark.createDataFrame([], "reading_count long")).first()
    assert (row.rows_in, row.rows_out, row.reduction_percent) == (0, 0, None)


def test_success_rate(spark):
    df = spark.sql("""select * from values (timestamp'2024-01-01 00:00:00', true), (timestamp'2024-01-01 00:00:04', false),
      (timestamp'2024-01-01 00:00:01', true), (timestamp'2024-01-01 00:00:02', true) as t(at, ok)""")
    assert tuple(health.success_rate(df, F.col("ok"), "at").first()) == (4, 3, 75.0, 1.0)


def test_latency_of_seconds_and_nan(spark):
    """Small values spread over many buckets; NaN ranks last, as Spark sorts it."""
    df = spark.range(20000).selectExpr("0.004 + id / 1e8 as s")
    assert df.select(health._bucket(F.col("s")).alias("b")).distinct().count() > 40
    row = health.latency_summary(df, "s").first()
    assert row.p95 == 0.004 + 19000 / 1e8
    mixed = spark.createDataFrame([(float(i),) for i in range(1, 101)] + [(float("nan"),)], "ms double")
    row = health.latency_summary(mixed, "ms").first()
    assert (row.total, row.p50, row.p95) == (101, 51.0, 96.0)
