"""Stored states that stand for readings: sketches, hour states, clustered samples."""

import glob

from pyspark.sql import functions as F

from tests.conftest import SMALL
from tidegauge.functions.sampling import in_sample
from tidegauge.operators import sketches, tables
from tidegauge.plans import report_queries, reports, views


def test_merged_latency_sketches(spark):
    """Whatever the buckets and batches, ranks are within the stated error; sums and extremes are exact."""
    rows = spark.range(200_000).select(
        F.timestamp_seconds(F.col("id") % 86_400 + 1_704_067_200).alias("t"), F.when(F.col("id") % 3 == 0, "a").otherwise("b").alias("q"),
        F.when(F.col("id") % 1000 != 7, F.pmod(F.xxhash64("id"), F.lit(1_000_003)).cast("double")).alias("v"))
    states = sketches.latency_states(rows, "v", "t", ["q"])
    again = sketches.merge_latency_states(states.withColumn("part", F.minute("bucket_start")), ["q", "part"])
    for found in (sketches.latency_quantiles(states, ["q"]), sketches.latency_quantiles(again, ["q"])):
        for r in found.collect():
            own = sorted(x.v for x in rows.filter((F.col("q") == r.q) & F.col("v").isNotNull()).select("v").collect())
            assert (r.total, r.min, r.max) == (len(own), own[0], own[-1]) and abs(r.mean - sum(own) / len(own)) < 1e-6 * r.mean
            for value, p in ((r.p50, 0.5), (r.p95, 0.95), (r.p99, 0.99)):
                assert abs(sum(x <= value for x in own) / len(own) - p) <= sketches.RANK_ERROR
    assert sketches.latency_quantiles(states.limit(0)).count() == 0


def test_united_device_sketches(spark):
    rows = spark.range(300_000).selectExpr("concat('d', id % 50000) as device_id", "timestamp_seconds(id) as time")
    states = sketches.device_states(rows)
    value = sketches.distinct_devices(states).first().value
    assert abs(value - 50_000) <= 0.02 * 50_000
    first = sketches.distinct_devices(states.filter(F.col("bucket_start") < F.timestamp_seconds(F.lit(3600)))).first().value
    assert abs(first - 3600) <= 0.02 * 3600
    assert sketches.distinct_devices(states.limit(0)).first().value == 0


def test_hour_states_of_many_batches(spark, tmp_path):
    sensors, kind = views.sensors(spark, SMALL), "temp"
    params = report_queries._parameters(sensors, "device_id")
    path = str(tmp_path / "t")
    from tidegauge.streaming.jobs import ENTITY_HOURS

    for i in range(3):
        tables.write_batch(reports.hour_states(sensors.filter(F.col("seq") % 3 == i), kind), i, path, ENTITY_HOURS, "w")
    got = reports.single_day_from_states(tables.read_table(spark, path), kind, params)
    want = reports.single_day_many(sensors, kind, params)
    assert got.select(want.columns).exceptAll(want).isEmpty() and got.count() == want.count()
    few = params.filter("day = '2024-01-05'")
    plan = reports.single_day_from_states(tables.read_table(spark, path), kind, few)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(day" in plan


def test_a_sample_opens_its_share_of_the_files(spark, tmp_path):
    rows = spark.range(100_000).selectExpr("id as seq", "concat('d', id % 5000) as device_id", "uuid() as payload")
    path, key = str(tmp_path / "t"), "spark.sql.shuffle.partitions"
    before = spark.conf.get(key)
    spark.conf.set(key, "40")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        tables.write_clustered_sample(rows, path, "device_id")
    finally:
        spark.conf.set(key, before)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert len(glob.glob(f"{path}/*.parquet")) >= 30
    picked = tables.read_sample(spark, path, 0.1)
    stored = spark.read.parquet(path)
    want = stored.filter(in_sample(F.col("device_id"), 0.1))
    assert picked.select("seq").exceptAll(want.select("seq")).isEmpty() and picked.count() == want.count() > 5000
    assert "PushedFilters: [IsNotNull(sample_hash), LessThan(sample_hash," in picked._jdf.queryExecution().executedPlan().toString()
    # The scan itself gives out the rows of the row groups that it opens: about a tenth, not all.
    plan = picked._jdf.queryExecution().executedPlan()
    picked._jdf.queryExecution().toRdd().count()
    scans = [n for n in _nodes(plan) if n.nodeName().startswith("Scan parquet")]
    opened = scans[0].metrics().apply("numOutputRows").value()
    assert picked.count() <= opened <= 0.2 * 100_000


def _nodes(plan):
    yield plan
    children = plan.children()
    for i in range(children.size()):
        yield from _nodes(children.apply(i))
