"""Tumbling-window roll-ups.

A roll-up has two halves.  ``rollup_states`` aggregates readings into mergeable
states (sums, counts, extremes, first reading); ``finish_rollup`` is a plain
projection that turns states into averages and votes.  Spark pre-aggregates the
states on the map side, so a device holding a third of all rows reaches the
shuffle as one row per window and task.  Stored states can be merged again into
wider windows with ``merge_rollups``.

First-seen metadata is one ``min`` over a struct led by (time, seq): the whole
record is compared once per row instead of once per metadata column, and the
result does not depend on the order in which tasks finish.
"""

from __future__ import annotations

from collections.abc import Sequence
from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegauge.functions import labels
from tidegauge.functions.labels import ONLINE
from tidegauge.operators.canonical import COUNTER_DEFAULTS, DEFAULT_CUSTOMER, READING_DEFAULTS

AVERAGED = (
    "temperature", "humidity", "pressure", "co2_level",
    "noise_level", "light_level", "battery_level", "signal_strength",
)
USAGE = ("memory_usage", "cpu_usage")
COUNTERS = ("error_count", "packets_sent", "packets_received", "bytes_sent", "bytes_received")
COUNTED = (*AVERAGED, *USAGE, "status", "motion_detected")
FIRST_SEEN = ("device_id", "device_type", "customer_id", "site_id", "latitude", "longitude", "altitude")

# What a rolled-up row reports instead of measured usage.
USAGE_PLACEHOLDERS = {"memory_usage": 50.0, "cpu_usage": 30.0}


def rollup_states(
    df: DataFrame,
    window: str = "1 minute",
    key: str = "device_id",
    time: str = "time",
    seq: str = "seq",
) -> DataFrame:
    """One row of mergeable states per (key, window)."""
    order = [time, seq] if seq in df.columns else [time]
    metadata = [name for name in FIRST_SEEN if name != key]
    states = [F.count("*").alias("reading_count")]
    for name in AVERAGED:
        states += [
            F.sum(name).alias(f"sum_{name}"),
            F.min(name).alias(f"min_{name}"),
            F.max(name).alias(f"max_{name}"),
        ]
    states += [F.sum(name).alias(f"sum_{name}") for name in USAGE + COUNTERS]
    # An average is over the readings that have a value.
    states += [F.count(name).alias(f"n_{name}") for name in COUNTED]
    states += [
        F.sum("status").alias("sum_status"),
        F.sum((F.col("motion_detected") == 1).cast("long")).alias("motion_count"),
        F.min(F.struct(*[F.col(c).alias(f"order_{i}") for i, c in enumerate(order)], *metadata)).alias("first_seen"),
    ]
    grouped = df.groupBy(F.window(time, window).alias("window"), key).agg(*states)
    return grouped.select(
        key, F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"),
        *[c for c in grouped.columns if c not in ("window", key)],
    )


def merge_rollups(
    states: DataFrame, window: str | None = None, key: str = "device_id", also: Sequence[str] = (),
) -> DataFrame:
    """Merge stored states, per window or into wider windows that contain them.

    ``also`` names columns that follow from the window, such as its day, to group by as well.
    """
    def merged(name: str) -> Column:
        how = F.max if name.startswith("max_") else F.sum
        if name.startswith("min_") or name == "first_seen":
            how = F.min
        return how(name).alias(name)

    payload = [c for c in states.columns if c not in (key, "window_start", "window_end", *also)]
    if window is None:
        grouped = states.groupBy(key, "window_start", "window_end", *also).agg(*[merged(c) for c in payload])
        return grouped.select(states.columns)
    grouped = states.groupBy(F.window("window_start", window).alias("window"), key)
    grouped = grouped.agg(*[merged(c) for c in payload])
    return grouped.select(
        key, F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), *payload
    )


def finish_rollup(
    states: DataFrame,
    key: str = "device_id",
    with_extremes: bool = False,
    real_usage: bool = False,
    also: Sequence[str] = (),
) -> DataFrame:
    """States to sensor rows: ``time`` is the end of the window."""
    count = F.col("reading_count")
    columns = [F.col(key), *map(F.col, also)]
    columns += [F.col(f"first_seen.{name}").alias(name) for name in FIRST_SEEN if name != key]
    columns += ["window_start", "window_end", F.col("window_end").alias("time")]
    mean = lambda name: F.try_divide(F.col(f"sum_{name}"), F.col(f"n_{name}"))
    columns += [mean(name).alias(name) for name in AVERAGED]
    columns += [(F.col("motion_count") * 2 > F.col("n_motion_detected")).cast("short").alias("motion_detected")]
    columns += [(mean(name) if real_usage else F.lit(USAGE_PLACEHOLDERS[name])).alias(name) for name in USAGE]
    columns += [F.expr("cast(sum_status div nullif(n_status, 0) as int)").alias("status")]
    columns += [F.col(f"sum_{name}").cast("long").alias(name) for name in COUNTERS]
    columns += [count]
    if with_extremes:
        for name in AVERAGED:
            columns += [F.col(f"min_{name}"), F.col(f"max_{name}")]
    return states.select(*columns)


def rollup_sensors(
    df: DataFrame,
    window: str = "1 minute",
    key: str = "device_id",
    time: str = "time",
    seq: str = "seq",
    with_extremes: bool = False,
    real_usage: bool = False,
) -> DataFrame:
    """Averages, votes, counters and first-seen metadata per (key, window)."""
    states = rollup_states(df, window, key, time, seq)
    return finish_rollup(states, key, with_extremes, real_usage)


def reading_states(
    df: DataFrame, window: str = "1 minute", time: str = "time", seq: str = "seq",
) -> DataFrame:
    """States of decoded binary readings per (sensorId, window), before labelling.

    A binary reading has four measurements, a status and a type code; all else
    in its sensor row is a constant or follows from the sensor id.  So the codes
    are aggregated and ``finish_readings`` adds labels and constants to the few
    rows that remain.  Every state is a number of fixed width, which keeps the
    aggregation in hash tables without sorting the readings.
    """
    measured = {"temperature": "temperature", "humidity": "humidity",
                "pressure": "pressure", "batteryLevel": "battery_level"}
    rows = df.withColumn("window", F.window(time, window))
    rows = rows.select(
        "window", "sensorId", F.coalesce("sensorType", F.lit(1)).alias("type"),
        F.coalesce("status", F.lit(ONLINE)).alias("status"),
        *[F.coalesce(sent, F.lit(READING_DEFAULTS[name])).alias(name) for sent, name in measured.items()],
        _order(df, time, seq).alias("order"),
    )
    states = [F.count("*").alias("reading_count")]
    for name in measured.values():
        states += [
            F.sum(name).alias(f"sum_{name}"), F.min(name).alias(f"min_{name}"), F.max(name).alias(f"max_{name}"),
        ]
    states += [
        F.sum("status").alias("sum_status"),
        F.min("order").alias("first_order"), F.min_by("type", "order").alias("first_type"),
    ]
    grouped = rows.groupBy("window", "sensorId").agg(*states)
    return grouped.select(
        "sensorId", F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"),
        *[c for c in grouped.columns if c not in ("window", "sensorId", "first_order", "first_type")],
        F.struct("first_order", "first_type").alias("first_seen"),
    )


def time_order(time: str, below: Column) -> Column:
    """One number that orders rows by (time, ``below``, a long that is not negative).

    A decimal of fixed width holds both whole, and aggregates in hash tables.
    """
    micros = F.unix_micros(F.col(time).cast("timestamp")).cast("decimal(17,0)")
    scale = F.lit(Decimal(1 << 64)).cast("decimal(20,0)")
    return (micros * scale + F.coalesce(below, F.lit(0)).cast("decimal(19,0)")).cast("decimal(38,0)")


def _order(df: DataFrame, time: str, seq: str) -> Column:
    """Readings by (time, position in the topic); without positions the lower type code comes first."""
    return time_order(time, F.col(seq).cast("long") if seq in df.columns else F.coalesce("sensorType", F.lit(1)).cast("long"))


def finish_readings(states: DataFrame, with_extremes: bool = False, also: Sequence[str] = ()) -> DataFrame:
    """States of binary readings to the same rows as ``finish_rollup``."""
    sensor, constants = F.col("sensorId"), {**READING_DEFAULTS, **COUNTER_DEFAULTS}
    columns = {
        "device_id": labels.device_label(sensor),
        "device_type": labels.sensor_type_label(F.col("first_seen.first_type")),
        "customer_id": F.lit(DEFAULT_CUSTOMER),
        "site_id": labels.site_label(sensor),
        **dict.fromkeys(("latitude", "longitude", "altitude"), F.lit(0.0)),
        "window_start": F.col("window_start"),
        "window_end": F.col("window_end"),
        "time": F.col("window_end"),
    }
    for name in AVERAGED:
        summed = f"sum_{name}"
        columns[name] = F.col(summed) / F.col("reading_count") if summed in states.columns else F.lit(constants[name])
    columns["motion_detected"] = F.lit(0).cast("short")
    columns |= {name: F.lit(value) for name, value in USAGE_PLACEHOLDERS.items()}
    columns["status"] = F.expr("cast(sum_status div reading_count as int)")
    columns |= {name: F.lit(0).cast("long") for name in COUNTERS}
    columns["reading_count"] = F.col("reading_count")
    if with_extremes:
        for name in AVERAGED:
            for end in ("min", "max"):
                known = f"{end}_{name}"
                columns[known] = F.col(known) if known in states.columns else F.lit(constants[name])
    return states.select(*also, *[column.alias(name) for name, column in columns.items()])


def rollup_readings(
    df: DataFrame, window: str = "1 minute", time: str = "time", seq: str = "seq", with_extremes: bool = False,
) -> DataFrame:
    """Decoded binary readings straight to roll-up rows."""
    return finish_readings(reading_states(df, window, time, seq), with_extremes)


def sensor_metrics(
    df: DataFrame,
    window: str = "1 minute",
    processing_time: Column | None = None,
    seq: str = "seq",
) -> DataFrame:
    """The metrics table: one row per (sensor, type, location, window).

    ``max_temperature`` is there for the reports that read it.  Where the input
    carries ``seq`` the smallest one of the window is kept as a tie-break.
    """
    extra = [F.min(seq).alias("seq")] if seq in df.columns else []
    grouped = df.groupBy(
        F.col("device_id").alias("sensor_id"), F.col("device_type").alias("sensor_type"),
        F.col("site_id").alias("location"), F.window("time", window).alias("window"),
    ).agg(
        F.avg("temperature").alias("avg_temperature"),
        F.avg("humidity").alias("avg_humidity"),
        F.avg("pressure").alias("avg_pressure"),
        F.max("temperature").alias("max_temperature"),
        F.min("battery_level").alias("min_battery"),
        F.max("battery_level").alias("max_battery"),
        F.count("*").alias("reading_count"),
        *extra,
    )
    processed = F.col("window.end") if processing_time is None else processing_time
    return grouped.select(
        "sensor_id", "sensor_type", "location",
        F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"),
        "avg_temperature", "avg_humidity", "avg_pressure", "max_temperature",
        "min_battery", "max_battery", "reading_count",
        processed.alias("processing_time"), *[c for c in ("seq",) if extra],
    )
