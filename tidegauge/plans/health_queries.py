"""Pipeline health."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegauge.operators import health, rollup
from tidegauge.plans import reports, views
from tidegauge.plans.registry import over_sensors, query

AS_OF = views.AS_OF


def _reduction_sql(unit: str) -> str:
    return over_sensors(f""", w as (select count(*) as n from sensors group by device_id, date_trunc('{unit}', time)),
      t as (select cast(sum(n) as bigint) as rows_in, count(*) as rows_out from w),
      p as (select *, (1 - cast(rows_out as double) / rows_in) * 100 as reduction_percent from t)
      select rows_in, rows_out, cast(rows_in as double) / rows_out as readings_per_window, reduction_percent,
        case when reduction_percent < 50 then 'red' when reduction_percent <= 95 then 'yellow' else 'green' end as band,
        reduction_percent < 95 as alarm from p""")


for _unit in ("minute", "day"):
    @query(f"k1_rollup_reduction_{_unit}", _reduction_sql(_unit))
    def rollup_reduction(spark: SparkSession, sf_dir: str, unit: str = _unit) -> DataFrame:
        return health.rollup_reduction(rollup.rollup_states(views.sensors(spark, sf_dir), f"1 {unit}"))


@query("k3_write_rate_status", over_sensors(f"""
  , r as (select count(*) as rows_written, count(*) / 86400.0E0 as rows_per_second from sensors
    where time >= timestamp '{AS_OF}' - interval 1 day)
  select rows_written, rows_per_second, round(rows_per_second, 2) as rounded_rate,
    case when rows_per_second < 500 then 'green' when rows_per_second <= 1000 then 'yellow' else 'red' end as band,
    rows_per_second > 100 as alarm from r"""))
def write_rate_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return health.write_rate_status(reports.write_rate(views.sensors(spark, sf_dir), AS_OF, 86400))


# The events serve as a log of requests: value is the latency.
LATENCY = "floor(value * 8) / 8.0"


def _latency_sql(by: str = "") -> str:
    key, group = (f"{by}, ", f"group by {by}") if by else ("", "")
    return f"""
      with l as (select event_type, floor(value * 8) / 8.0E0 as ms from events),
      s as (select {key} count(*) as total, avg(ms) as mean, min(ms) as min, max(ms) as max,
        list_sort(list(ms)) as v from l {group})
      select {key} total, mean, min, max, (v[(total - 1) // 2 + 1] + v[total // 2 + 1]) / 2 as p50,
        v[cast(floor(total * 0.95E0) as bigint) + 1] as p95, v[cast(floor(total * 0.99E0) as bigint) + 1] as p99
      from s"""


def _latencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.events(spark, sf_dir).select("event_type", F.expr("floor(value * 8) / 8.0D").alias("ms"))


@query("k4_latency_summary", _latency_sql())
def latency_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return health.latency_summary(_latencies(spark, sf_dir), "ms")


@query("k4_latency_summary_by_query", _latency_sql("event_type"))
def latency_summary_by_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return health.latency_summary(_latencies(spark, sf_dir), "ms", ["event_type"])


@query("k5_success_rate", """
  select count(*) as total, cast(sum(case when event_type <> 'error' then 1 else 0 end) as bigint) as succeeded,
    cast(sum(case when event_type <> 'error' then 1 else 0 end) as double) / count(*) * 100 as success_percent,
    count(*) / ((epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6) as per_second from events""")
def success_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return health.success_rate(views.events(spark, sf_dir), F.col("event_type") != "error", "ts")
