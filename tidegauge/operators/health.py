"""Numbers about the pipeline itself, computed as ordinary queries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def reduction_band(percent: Column) -> Column:
    """Below 50 red, up to 95 yellow, above green."""
    return F.when(percent < 50, "red").when(percent <= 95, "yellow").otherwise("green")


def write_rate_band(per_second: Column) -> Column:
    """Below 500 rows/s green, up to 1000 yellow, above red."""
    return F.when(per_second < 500, "green").when(per_second <= 1000, "yellow").otherwise("red")


def rollup_reduction(rollups: DataFrame) -> DataFrame:
    """How much a roll-up shrank its input, from the roll-up alone: its reading
    counts add up to the rows that went in."""
    totals = rollups.agg(
        F.coalesce(F.sum("reading_count"), F.lit(0)).alias("rows_in"), F.count("*").alias("rows_out")
    )
    percent = (1 - F.try_divide(F.col("rows_out"), F.col("rows_in"))) * 100
    return totals.select(
        "rows_in", "rows_out",
        F.try_divide(F.col("rows_in"), F.col("rows_out")).alias("readings_per_window"),
        percent.alias("reduction_percent"),
        reduction_band(percent).alias("band"),
        (percent < 95).alias("alarm"),
    )


def write_rate_status(rate: DataFrame, column: str = "rows_per_second") -> DataFrame:
    """Add the colour band and the alarm (more than 100 rows/s) to a write rate."""
    return rate.withColumns({
        "band": write_rate_band(F.col(column)), "alarm": F.col(column) > 100,
    })


def success_rate(log: DataFrame, ok: Column, start: str, by: Sequence[str] = ()) -> DataFrame:
    """Requests, share that succeeded, and rate over the span of the log."""
    elapsed = F.unix_micros(F.max(start).cast("timestamp")) - F.unix_micros(F.min(start).cast("timestamp"))
    totals = log.groupBy(*by).agg(
        F.count("*").alias("total"),
        F.sum(ok.cast("long")).alias("succeeded"),
        (elapsed / 1e6).alias("elapsed_seconds"),
    )
    return totals.select(
        *by, "total", "succeeded",
        (F.col("succeeded") / F.col("total") * 100).alias("success_percent"),
        F.try_divide(F.col("total"), F.col("elapsed_seconds")).alias("per_second"),
    )


# Steps per doubling of the value: a bucket spans values within 0.07 percent.
_STEPS = 1024


def _bucket(value: Column) -> Column:
    """A coarse number that never falls as the value rises; zero is apart, NaN is last."""
    double = value.cast("double")
    # 1100 lifts the exponents of the smallest numbers above zero.
    size = F.floor((F.log2(F.abs(double)) + 1100) * _STEPS)
    return (F.when(F.isnan(double), F.lit(1 << 62)).when(double == 0, F.lit(0).cast("long"))
            .when(double < 0, -size).otherwise(size))


def latency_summary(df: DataFrame, value: str, by: Sequence[str] = ()) -> DataFrame:
    """Mean, extremes, median, p95 and p99 of ``value`` per group, exactly.

    p95 and p99 are the value at rank ``floor(n * p)`` of the sorted values, the
    median is the mean of the middle one or two.

    No list of values is built.  Equal values are counted first, buckets of
    neighbouring values are ranked by their counts, and only the values of the
    buckets that hold a wanted rank are ranked one by one.  A task sees the
    buckets of one group or the distinct values of one bucket, never a group.
    """
    counts = df.filter(F.col(value).isNotNull()).groupBy(
        *[F.col(c).alias(f"key_{i}") for i, c in enumerate(by)], F.col(value).alias("v")
    ).agg(F.count("*").alias("n")).withColumn("bucket", _bucket(F.col("v")))
    keys = [f"key_{i}" for i in range(len(by))]
    buckets = counts.groupBy(*keys, "bucket").agg(
        F.sum("n").alias("bucket_n"), F.sum(F.col("v") * F.col("n")).alias("bucket_sum"),
        F.min("v").alias("low"), F.max("v").alias("high"),
    )
    group = Window.partitionBy(*(keys or [F.lit(0)]))
    ranked = buckets.withColumns({
        "upto": F.sum("bucket_n").over(group.orderBy("bucket")),
        "total": F.sum("bucket_n").over(group),
        "all_sum": F.sum("bucket_sum").over(group),
        "min": F.min("low").over(group),
        "max": F.max("high").over(group),
    }).withColumn("before", F.col("upto") - F.col("bucket_n"))

    wanted = {
        "mid_low": F.expr("(total - 1) div 2"),
        "mid_high": F.expr("total div 2"),
        "p95": F.floor(F.col("total") * 0.95),
        "p99": F.floor(F.col("total") * 0.99),
    }
    inside = {
        f"rank_{name}": F.when((rank >= F.col("before")) & (rank < F.col("upto")), rank)
        for name, rank in wanted.items()
    }
    targets = ranked.withColumns(inside).filter(F.coalesce(*inside).isNotNull())
    targets = targets.select(
        *[F.col(k).alias(f"t_{k}") for k in keys], F.col("bucket").alias("t_bucket"),
        "before", "total", "all_sum", "min", "max", *inside,
    )

    same = F.col("bucket") == F.col("t_bucket")
    for k in keys:
        same &= F.col(k).eqNullSafe(F.col(f"t_{k}"))
    end = F.sum("n").over(Window.partitionBy(*keys, "bucket").orderBy("v"))
    placed = counts.join(targets, same).withColumn("end", F.col("before") + end)
    found = {
        name: F.max(F.when(
            (F.col(f"rank_{name}") >= F.col("end") - F.col("n")) & (F.col(f"rank_{name}") < F.col("end")), F.col("v")
        ))
        for name in wanted
    }
    summary = placed.groupBy(*keys).agg(
        F.max("total").alias("total"), (F.max("all_sum") / F.max("total")).alias("mean"),
        F.max("min").alias("min"), F.max("max").alias("max"),
        *[column.alias(name) for name, column in found.items()],
    )
    return summary.filter("total is not null").select(
        *[F.col(k).alias(c) for k, c in zip(keys, by)],
        "total", "mean", "min", "max",
        ((F.col("mid_low") + F.col("mid_high")) / 2).alias("p50"), "p95", "p99",
    )
