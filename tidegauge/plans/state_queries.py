"""Reports answered from stored, mergeable states instead of readings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegauge.operators import health, sketches, tables
from tidegauge.plans import alert_queries, report_queries, reports, views  # noqa: F401  (registers what is asked again here)
from tidegauge.plans.health_queries import LATENCY
from tidegauge.plans.registry import QUERIES, over_sensors, query
from tidegauge.plans.stream_queries import run_of
from tidegauge.session import work_dir
from tidegauge.streaming import jobs

LATENCY_BUCKETS = tables.Layout("bucket_start", ("event_type",))


def hour_table(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    """Hour states as a stream keeps them, compacted: what the reports find stored."""
    of_sensors = report_queries.SINGLE_DAY_SQL[kind][0] == "sensors"
    events = views.stream_events(spark, sf_dir)
    run, compact = run_of(spark, f"hours-{kind}"), work_dir(spark, f"hours-{kind}-compact")
    jobs.start_hour_states(views.to_sensors(events) if of_sensors else views.to_cpu(events), run, kind).awaitTermination()
    tables.compact_batches(spark, run.output, compact, jobs.ENTITY_HOURS, merge=lambda df: reports.merge_hour_states(df, kind))
    return tables.read_compacted(spark, run.output, compact)


def _register(number: int, kind: str) -> None:
    table, key, _ = report_queries.SINGLE_DAY_SQL[kind]

    @query(f"g{number}_single_day_{kind}_parameters_states", QUERIES[f"g{number}_single_day_{kind}_parameters"].sql)
    def many(spark: SparkSession, sf_dir: str) -> DataFrame:
        facts = views.sensors if table == "sensors" else views.cpu
        params = report_queries._parameters(facts(spark, sf_dir), key)
        answers = reports.single_day_from_states(hour_table(spark, sf_dir, kind), kind, params)
        return answers.withColumn("day", F.col("day").cast("string"))


for _number, _kind in enumerate(report_queries.SINGLE_DAY_SQL, 1):
    _register(_number, _kind)


def _latency_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.events(spark, sf_dir).select(
        "event_type", F.col("ts").cast("timestamp").alias("ts"), F.expr(LATENCY.replace("8.0", "8.0D")).alias("ms"))


@query("k4_latency_sketches", """
  select event_type, count(*) as total, avg(floor(value * 8) / 8.0E0) as mean, min(floor(value * 8) / 8.0E0) as min,
    max(floor(value * 8) / 8.0E0) as max, true as within from events group by event_type""")
def latency_sketches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quantiles from sketches stored per hour: the values' ranks are within the stated error of the wanted ones."""
    rows = _latency_rows(spark, sf_dir)
    out = work_dir(spark, "k4-sketches")
    tables.write_table(sketches.latency_states(rows, "ms", "ts", ["event_type"], "1 hour"), out, LATENCY_BUCKETS)
    found = sketches.latency_quantiles(tables.read_table(spark, out), ["event_type"])
    at = lambda q, op: F.avg(F.expr(f"cast(ms {op} {q} as int)"))
    off = F.lit(True)
    ranks = []
    for q, p in (("p50", 0.5), ("p95", 0.95), ("p99", 0.99)):
        ranks += [at(q, "<").alias(f"{q}_below"), at(q, "<=").alias(f"{q}_upto")]
        off &= (F.col(f"{q}_below") <= p + sketches.RANK_ERROR) & (F.col(f"{q}_upto") >= p - sketches.RANK_ERROR)
    held = rows.join(found.select("event_type", "p50", "p95", "p99"), "event_type").groupBy("event_type").agg(*ranks)
    return found.join(held, "event_type").select("event_type", "total", "mean", "min", "max", off.alias("within"))


@query("k4_latency_sketches_near_exact", "select event_type, count(*) as total, true as within from events group by event_type")
def latency_sketches_near_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Beside the exact summary: the median and the tails are within 5 percent in value."""
    rows = _latency_rows(spark, sf_dir)
    found = sketches.latency_quantiles(sketches.latency_states(rows, "ms", "ts", ["event_type"], "1 day"), ["event_type"])
    exact = health.latency_summary(rows, "ms", ["event_type"]).select("event_type", *[F.col(q).alias(f"exact_{q}") for q in ("p50", "p95")])
    near = lambda q: F.abs(F.col(q) - F.col(f"exact_{q}")) <= 0.05 * F.col(f"exact_{q}") + 0.125
    return found.join(exact, "event_type").select("event_type", "total", (near("p50") & near("p95")).alias("within"))


@query("g15_unique_devices_states", over_sensors("select count(distinct device_id) as value, true as within from sensors"))
def unique_devices_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct devices from sketches stored per hour, united: within 2 percent of the exact number."""
    out = work_dir(spark, "g15-sketches")
    tables.write_table(sketches.device_states(views.sensors(spark, sf_dir)), out, tables.Layout("bucket_start", ()))
    estimate = sketches.distinct_devices(tables.read_table(spark, out)).scalar()
    exact = reports.unique_devices(views.sensors(spark, sf_dir))
    return exact.select("value", (F.abs(estimate - F.col("value")) <= 0.02 * F.col("value") + 0.5).alias("within"))


@query("c10_sample_by_key_clustered", QUERIES["c10_sample_by_key"].sql)
def sample_by_key_clustered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same tenth of the keys from a table in the order of their hash."""
    out = work_dir(spark, "c10-clustered")
    tables.write_clustered_sample(views.sensors(spark, sf_dir), out, "device_id")
    return tables.read_sample(spark, out, 0.1).select("seq", "device_id")
