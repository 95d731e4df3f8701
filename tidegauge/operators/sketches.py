"""Mergeable sketches: quantiles of latencies, distinct devices.

A sketch is a state of bounded size that a batch writes per minute or hour and that any
range of them merges into, without the rows.  ``health.latency_summary`` and
``reports.unique_devices`` are the exact twins.

A quantile sketch (KLL) answers with a value whose rank is off by ``RANK_ERROR`` of the
rows at most (with 99 percent confidence, for k = ``K``; a merged sketch no more than a
single one).  A distinct-count sketch (HyperLogLog, ``LG_K``) is off by about 1.04 / 2 **
(``LG_K`` / 2), less than one percent, in one standard deviation.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

K = 800
RANK_ERROR = 0.004
LG_K = 14


def latency_states(df: DataFrame, value: str, time: str, by: Sequence[str] = (), width: str = "1 minute") -> DataFrame:
    """Count, sum, extremes and a quantile sketch of ``value`` per ``width`` and group; nulls are left out."""
    rows = df.filter(F.col(value).isNotNull()).withColumn("bucket_start", F.window(time, width).getField("start"))
    number = F.col(value).cast("double")
    return rows.groupBy("bucket_start", *by).agg(
        F.count("*").alias("total"), F.sum(number).alias("sum"), F.min(number).alias("min"), F.max(number).alias("max"),
        F.kll_sketch_agg_double(number, F.lit(K)).alias("sketch"))


def merge_latency_states(states: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """States of many buckets or batches, brought to one a group."""
    return states.groupBy(*by).agg(
        F.sum("total").alias("total"), F.sum("sum").alias("sum"), F.min("min").alias("min"), F.max("max").alias("max"),
        F.kll_merge_agg_double("sketch").alias("sketch"))


def latency_quantiles(states: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Mean and extremes exactly, median, p95 and p99 within ``RANK_ERROR``, of all states together."""
    merged = merge_latency_states(states, by).filter("total is not null")
    quantile = lambda p: F.kll_sketch_get_quantile_double("sketch", F.lit(p))
    return merged.select(
        *by, "total", (F.col("sum") / F.col("total")).alias("mean"), "min", "max",
        quantile(0.5).alias("p50"), quantile(0.95).alias("p95"), quantile(0.99).alias("p99"))


def device_states(df: DataFrame, key: str = "device_id", time: str = "time", width: str = "1 hour") -> DataFrame:
    """A distinct-count sketch of ``key`` per ``width``."""
    rows = df.withColumn("bucket_start", F.window(time, width).getField("start"))
    return rows.groupBy("bucket_start").agg(F.count("*").alias("total"), F.hll_sketch_agg(key, LG_K).alias("sketch"))


def distinct_devices(states: DataFrame) -> DataFrame:
    """The distinct keys of all states together, estimated."""
    return states.agg(F.coalesce(F.hll_sketch_estimate(F.hll_union_agg("sketch")), F.lit(0)).alias("value"))
