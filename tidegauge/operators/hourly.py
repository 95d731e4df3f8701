"""Hourly partial states over the metrics table, and the latest-status view."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegauge.operators.rollup import time_order

HOUR_KEYS = ("sensor_id", "sensor_type", "location", "hour_window")


def hourly_states(metrics: DataFrame) -> DataFrame:
    """Mergeable hourly states: an average is stored as its sum and count."""
    hours = metrics.withColumn("hour_window", F.window("window_start", "1 hour").getField("start"))
    return hours.groupBy(*HOUR_KEYS).agg(
        F.sum("avg_temperature").alias("temperature_sum"),
        F.sum("avg_humidity").alias("humidity_sum"),
        F.sum("avg_pressure").alias("pressure_sum"),
        F.count("*").alias("window_count"),
        F.min("min_battery").alias("battery_min"),
        F.max("max_battery").alias("battery_max"),
        F.sum("reading_count").alias("total_readings"),
    )


def merge_hourly_states(states: DataFrame) -> DataFrame:
    """Bring states written by many batches to one row per key."""
    summed = ("temperature_sum", "humidity_sum", "pressure_sum", "window_count", "total_readings")
    return states.groupBy(*HOUR_KEYS).agg(
        *[F.sum(c).alias(c) for c in summed],
        F.min("battery_min").alias("battery_min"),
        F.max("battery_max").alias("battery_max"),
    )


def finish_hourly(states: DataFrame) -> DataFrame:
    """Stored sums and counts to averages."""
    return states.select(
        *HOUR_KEYS,
        *[(F.col(f"{n}_sum") / F.col("window_count")).alias(f"{n}_avg")
          for n in ("temperature", "humidity", "pressure")],
        "battery_min", "battery_max", "total_readings",
    )


def latest_hours(states: DataFrame, hours: int = 24) -> DataFrame:
    """The newest ``hours`` rows, finished; ties go by key."""
    return finish_hourly(
        states.orderBy(F.desc("hour_window"), "sensor_id", "sensor_type", "location").limit(hours)
    )


def latest_status(metrics: DataFrame) -> DataFrame:
    """Newest window per (sensor, type, location).

    One number for (window end, position) picks all four values, so they come from
    the same row; without positions, windows that end together are one order.
    """
    below = F.col("seq").cast("long") if "seq" in metrics.columns else F.lit(0)
    values = {"avg_temperature": "latest_temperature", "avg_humidity": "latest_humidity",
              "avg_pressure": "latest_pressure", "min_battery": "latest_battery"}
    return metrics.withColumn("order", time_order("window_end", below)).groupBy("sensor_id", "sensor_type", "location").agg(
        *[F.max_by(c, "order").alias(name) for c, name in values.items()], F.max("window_end").alias("last_update"))
