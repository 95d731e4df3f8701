"""The analytic reports over the sensors, cpu, alerts and metrics tables.

Each report is a function of DataFrames and parameters; ``as_of`` stands for
"now".  Top-n reports order by a unique tie-break after the reported value, and
compile to a per-partition top-n followed by one merge of n rows per partition.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidegauge.operators.rollup import time_order
from tidegauge.functions.timeparts import Moment, between, bucketed, in_hours, last, on_day, time_range

USAGE = "usage_user + usage_system"

# Name of the result, aggregate, expression it is taken over.
SINGLE_DAY = {
    "temp": ("device_id", (
        ("avg_temp", "avg", "temperature"), ("max_temp", "max", "temperature"))),
    "humidity": ("device_id", (
        ("avg_humidity", "avg", "humidity"), ("max_humidity", "max", "humidity"))),
    "cpu": ("hostname", (
        ("avg_user_cpu", "avg", "usage_user"), ("avg_system_cpu", "avg", "usage_system"),
        ("max_cpu", "max", USAGE))),
    "load": ("hostname", (
        ("avg_load1", "avg", "load1"), ("avg_load5", "avg", "load5"), ("max_load1", "max", "load1"))),
}


def _top(df: DataFrame, n: int, *order: Column | str) -> DataFrame:
    return df.orderBy(*order).limit(n)


# ---------------------------------------------------------------------------
# One day, some hours: for one device, for all, or for a table of parameters
# ---------------------------------------------------------------------------
def single_day(
    df: DataFrame, kind: str, day: str, hours: Iterable[int], entity: str | None = None,
) -> DataFrame:
    """Figures of one day and hours.  With ``entity`` one total row for that
    device or host (also when it has no readings), else one row per entity."""
    key, figures = SINGLE_DAY[kind]
    rows = on_day(df, day).filter(in_hours(hours))
    aggregates = [getattr(F, how)(F.expr(of)).alias(name) for name, how, of in figures]
    aggregates.append(F.count("*").alias("readings"))
    if entity is not None:
        return rows.filter(F.col(key) == entity).agg(*aggregates)
    return rows.groupBy(key).agg(*aggregates)


def _hour_figures(kind: str) -> tuple[list[Column], list[Column], list[Column]]:
    """Aggregates of readings to hour states, of states to states, and of states to figures."""
    partial, merged = [F.count("*").alias("hour_readings")], [F.sum("hour_readings").alias("hour_readings")]
    final = []
    for name, how, of in SINGLE_DAY[kind][1]:
        if how == "avg":
            partial += [F.sum(F.expr(of)).alias(f"{name}_sum")]
            merged += [F.sum(f"{name}_sum").alias(f"{name}_sum")]
            final += [F.try_divide(F.sum(f"{name}_sum"), F.sum("hour_readings")).alias(name)]
        else:
            partial += [F.max(F.expr(of)).alias(f"{name}_max")]
            merged += [F.max(f"{name}_max").alias(f"{name}_max")]
            final += [F.max(f"{name}_max").alias(name)]
    return partial, merged, final


def hour_states(df: DataFrame, kind: str) -> DataFrame:
    """Mergeable states per entity and hour (``hour_start``) that the single-day reports can be answered from.

    Pre-aggregated on the map side: a device with a third of all readings has one row an hour and task.
    """
    return df.groupBy(F.col(SINGLE_DAY[kind][0]).alias("entity"), F.date_trunc("hour", "time").alias("hour_start")).agg(*_hour_figures(kind)[0])


def merge_hour_states(states: DataFrame, kind: str) -> DataFrame:
    return states.groupBy("entity", "hour_start").agg(*_hour_figures(kind)[1])


def single_day_from_states(states: DataFrame, kind: str, params: DataFrame) -> DataFrame:
    """``single_day_many`` from stored hour states, which may come from many batches.

    Only the days between the first and the last parameter's are read, and no reading is.
    """
    bounds = params.agg(F.min("day").alias("first"), F.date_add(F.max("day"), 1).alias("end"))
    states = between(states, bounds, "hour_start")
    # Summed by hour again: the table may have several states of one.
    hourly = merge_hour_states(states, kind).withColumns({"day": F.to_date("hour_start"), "hour": F.hour("hour_start")}).drop("hour_start")
    wanted = params.withColumn("hour", F.explode_outer(F.array_distinct("hours"))).drop("hours")
    joined = wanted.join(hourly, ["entity", "day", "hour"], "left")
    return joined.groupBy("param_id", "entity", "day").agg(
        *_hour_figures(kind)[2], F.coalesce(F.sum("hour_readings"), F.lit(0)).alias("readings")
    )


def single_day_many(df: DataFrame, kind: str, params: DataFrame) -> DataFrame:
    """Answer a whole table of (param_id, entity, day, hours array) in one job.

    Readings are first brought to one row per entity, day and hour, which is
    pre-aggregated on the map side; only these rows meet the parameters.  A
    device with a third of all readings has at most 24 rows a day in the join,
    and nothing is broadcast unless the planner measures it as small.  Every
    parameter gets a row, with null figures where nothing matches.  Only the
    days, and partitions, between the first and the last parameter's are read.
    Where a stream keeps hour states use ``single_day_from_states``.
    """
    key = SINGLE_DAY[kind][0]
    partial, _, final = _hour_figures(kind)
    bounds = params.agg(F.min("day").alias("first"), F.date_add(F.max("day"), 1).alias("end"))
    hourly = between(df, bounds).groupBy(
        F.col(key).alias("entity"), F.to_date("time").alias("day"), F.hour("time").alias("hour")
    ).agg(*partial)
    wanted = params.withColumn("hour", F.explode_outer(F.array_distinct("hours"))).drop("hours")
    joined = wanted.join(hourly, ["entity", "day", "hour"], "left")
    return joined.groupBy("param_id", "entity", "day").agg(
        *final, F.coalesce(F.sum("hour_readings"), F.lit(0)).alias("readings")
    )


# ---------------------------------------------------------------------------
# Current values
# ---------------------------------------------------------------------------
def _newest(df: DataFrame, key: str, values: dict[str, str], seen: str, tie: str) -> DataFrame:
    """Values of the newest row per key, by one number for (time, tie): all states are of fixed width."""
    rows = df.withColumn("order", time_order("time", F.col(tie).cast("long") if tie in df.columns else F.lit(0)))
    return rows.groupBy(key).agg(
        *[F.max_by(F.expr(of), "order").alias(name) for name, of in values.items()], F.max("time").alias(seen))


def device_current_status(
    sensors: DataFrame, as_of: Moment, device: str | None = None, tie: str = "seq", **span: float,
) -> DataFrame:
    rows = last(sensors, as_of, **(span or {"hours": 1}))
    if device is not None:
        rows = rows.filter(F.col("device_id") == device)
    values = {"current_temp": "temperature", "current_humidity": "humidity"}
    return _newest(rows, "device_id", values, "last_seen", tie)


def host_current_status(
    cpu: DataFrame, as_of: Moment, host: str | None = None, tie: str = "seq", **span: float,
) -> DataFrame:
    rows = last(cpu, as_of, **(span or {"minutes": 30}))
    if host is not None:
        rows = rows.filter(F.col("hostname") == host)
    return _newest(rows, "hostname", {"current_cpu": USAGE, "current_load1": "load1"}, "last_metric", tie)


def newest_rows(df: DataFrame, n: int, time: str = "time", tie: Sequence[str] = ("seq",)) -> DataFrame:
    """The newest ``n`` rows with all their columns.

    On a table with a ``day`` partition only the newest days are opened.  The
    n-th newest time is found from the time column alone and handed to the
    wide scan as a filter, so row groups older than it are skipped instead of
    reading every column of the whole table.
    """
    if "day" in df.columns:
        df = _newest_days(df, n)
    edge = df.select(time).orderBy(F.desc(time)).limit(n).agg(F.min(time).alias("edge"))
    recent = df.filter(F.col(time) >= edge.scalar())
    return _top(recent, n, F.desc(time), *[F.desc(c) for c in tie])


def _newest_days(df: DataFrame, n: int) -> DataFrame:
    """The fewest newest day partitions that hold ``n`` rows.

    Rows per day come from the file footers.  One task orders the days: there
    are as many as the retention of the table.
    """
    days = df.groupBy("day").agg(F.count("*").alias("rows"))
    newer = F.sum("rows").over(Window.orderBy(F.desc("day"))) - F.col("rows")
    oldest = days.withColumn("newer", newer).filter(F.col("newer") < n).agg(F.min("day").alias("day"))
    return df.filter(F.col("day") >= oldest.scalar())


# ---------------------------------------------------------------------------
# Grouped reports
# ---------------------------------------------------------------------------
def device_aggregation(sensors: DataFrame, as_of: Moment, n: int = 50, **span: float) -> DataFrame:
    rows = last(sensors, as_of, **(span or {"hours": 1})).groupBy("device_id", "device_type").agg(
        F.avg("temperature").alias("avg_temp"), F.avg("humidity").alias("avg_humidity"),
        F.count("*").alias("record_count"),
    )
    return _top(rows, n, F.desc("record_count"), "device_id", "device_type")


def alert_detection(sensors: DataFrame, as_of: Moment, **span: float) -> DataFrame:
    """Devices with readings that break a rule; ``sensors`` has ``has_alert``."""
    return last(sensors, as_of, **(span or {"hours": 1})).filter("has_alert = 1").groupBy(
        "device_id", "device_type"
    ).agg(
        F.max("temperature").alias("max_temp"), F.min("battery_level").alias("min_battery"),
        F.count("*").alias("alert_count"),
    )


def customer_sites(sensors: DataFrame, as_of: Moment, n: int = 100, **span: float) -> DataFrame:
    """Distinct devices, mean and readings per customer and site.

    Two group-bys instead of one distinct count: first per device, where the
    map side already shrinks a hot site, then per site over the device rows.
    """
    devices = last(sensors, as_of, **(span or {"hours": 24})).groupBy(
        "customer_id", "site_id", "device_id"
    ).agg(F.sum("temperature").alias("temp_sum"), F.count("*").alias("n"))
    sites = devices.groupBy("customer_id", "site_id").agg(
        F.count("device_id").alias("device_count"),
        (F.sum("temp_sum") / F.sum("n")).alias("avg_temp"),
        F.sum("n").alias("total_readings"),
    )
    return _top(sites, n, F.desc("total_readings"), "customer_id", "site_id")


def network_totals(
    sensors: DataFrame, as_of: Moment, n: int = 50, more_than: int = 1000, **span: float,
) -> DataFrame:
    counters = ("packets_sent", "packets_received", "bytes_sent", "bytes_received")
    rows = last(sensors, as_of, **(span or {"hours": 1})).groupBy("device_id").agg(
        *[F.sum(c).alias(f"total_{c}") for c in counters]
    ).filter(F.col("total_packets_sent") > more_than)
    return _top(rows, n, F.desc("total_bytes_sent"), "device_id")


def prefix_alerts(
    sensors: DataFrame, as_of: Moment, pattern: str = "sensor_1%", n: int = 100, **span: float,
) -> DataFrame:
    """In the pattern ``_`` is a one-character wildcard, as in any LIKE."""
    rows = last(sensors, as_of, **(span or {"hours": 1})).filter(
        F.col("device_id").like(pattern) & (F.col("has_alert") == 1)
    ).groupBy("device_id").agg(F.avg("temperature").alias("avg_temp"), F.count("*").alias("cnt"))
    return _top(rows, n, F.desc("cnt"), "device_id")


def total_rows(df: DataFrame) -> DataFrame:
    return df.agg(F.count("*").alias("value"))


def unique_devices(sensors: DataFrame, exact: bool = True, error: float = 0.02) -> DataFrame:
    if exact:
        return sensors.agg(F.count_distinct("device_id").alias("value"))
    return sensors.agg(F.approx_count_distinct("device_id", error).alias("value"))


def ingestion_rate(sensors: DataFrame, as_of: Moment, width: str = "1 minute", **span: float) -> DataFrame:
    rows = bucketed(last(sensors, as_of, **(span or {"minutes": 15})), width)
    return rows.groupBy("t").agg(F.count("*").alias("records"))


def temperature_series(sensors: DataFrame, as_of: Moment, width: str = "1 minute", **span: float) -> DataFrame:
    rows = bucketed(last(sensors, as_of, **(span or {"minutes": 15})), width)
    return rows.groupBy("t").agg(
        F.avg("temperature").alias("avg_temp"), F.max("temperature").alias("max_temp"),
        F.min("temperature").alias("min_temp"),
    )


def humidity_battery_series(sensors: DataFrame, as_of: Moment, width: str = "1 minute", **span: float) -> DataFrame:
    rows = bucketed(last(sensors, as_of, **(span or {"minutes": 15})), width)
    return rows.groupBy("t").agg(
        F.avg("humidity").alias("avg_humidity"), F.avg("battery_level").alias("avg_battery")
    )


def records_by_type(sensors: DataFrame, n: int = 10) -> DataFrame:
    return _top(sensors.groupBy("device_type").agg(F.count("*").alias("count")), n, F.desc("count"), "device_type")


def busiest_devices(sensors: DataFrame, n: int = 10) -> DataFrame:
    rows = sensors.groupBy("device_id").agg(
        F.count("*").alias("records"), F.round(F.avg("temperature"), 2).alias("avg_temp"),
        F.round(F.avg("battery_level"), 2).alias("avg_battery"),
    )
    return _top(rows, n, F.desc("records"), "device_id")


def bucket_series(
    sensors: DataFrame, start: Moment | None, end: Moment | None, width: str = "1 hour",
) -> DataFrame:
    """Records, mean temperature and alerts per bucket of any width."""
    return bucketed(time_range(sensors, start, end), width).groupBy("t").agg(
        F.count("*").alias("records"), F.avg("temperature").alias("avg_temp"),
        F.sum("has_alert").cast("long").alias("alerts"),
    )


def hottest_devices(sensors: DataFrame, as_of: Moment, n: int = 10, **span: float) -> DataFrame:
    rows = last(sensors, as_of, **(span or {"hours": 1})).groupBy("device_id").agg(
        F.avg("temperature").alias("avg_temp"), F.count("*").alias("data_points")
    )
    return _top(rows, n, F.desc("avg_temp"), "device_id")


def low_battery_devices(sensors: DataFrame, as_of: Moment, below: float = 20.0, **span: float) -> DataFrame:
    rows = last(sensors, as_of, **(span or {"days": 1})).groupBy("device_id").agg(
        F.avg("battery_level").alias("avg_battery")
    )
    return rows.filter(F.col("avg_battery") < below)


def customer_errors(sensors: DataFrame, as_of: Moment, **span: float) -> DataFrame:
    return last(sensors, as_of, **(span or {"days": 1})).groupBy("customer_id").agg(
        F.sum("error_count").alias("total_errors")
    )


def device_quality(sensors: DataFrame, as_of: Moment, device: str | None = None, **span: float) -> DataFrame:
    """Rows, means and errors per device, or for one."""
    rows = last(sensors, as_of, **(span or {"hours": 1}))
    if device is not None:
        rows = rows.filter(F.col("device_id") == device)
    return rows.groupBy("device_id").agg(
        F.count("*").alias("aggregated_records"), F.avg("temperature").alias("avg_temp"),
        F.avg("humidity").alias("avg_humidity"), F.sum("error_count").alias("total_errors"),
    )


def window_counts(rollups: DataFrame, as_of: Moment, **span: float) -> DataFrame:
    """Roll-up rows per device: one a minute is expected."""
    return last(rollups, as_of, **(span or {"minutes": 5})).groupBy("device_id").agg(
        F.count("*").alias("windows"), F.avg("temperature").alias("avg_temp"),
        F.sum("error_count").alias("total_errors"),
    )


def write_rate(df: DataFrame, as_of: Moment, seconds: int = 60) -> DataFrame:
    written = last(df, as_of, seconds=seconds).agg(F.count("*").alias("rows_written"))
    rate = F.col("rows_written") / float(seconds)
    return written.select("rows_written", rate.alias("rows_per_second"), F.round(rate, 2).alias("rounded_rate"))


# ---------------------------------------------------------------------------
# Alerts and metrics tables
# ---------------------------------------------------------------------------
def recent_metrics(metrics: DataFrame, n: int = 20, tie: Sequence[str] = ("sensor_id", "sensor_type", "location")) -> DataFrame:
    return _top(metrics, n, F.desc("window_start"), *tie)


def recent_alerts(
    alerts: DataFrame, n: int | None = 20, as_of: Moment | None = None, tie: Sequence[str] = ("seq",), **span: float,
) -> DataFrame:
    rows = alerts.filter("alert_type != 'NORMAL'")
    if as_of is not None:
        rows = last(rows, as_of, column="alert_time", **(span or {"hours": 1}))
    return rows if n is None else _top(rows, n, F.desc("alert_time"), *[F.desc(c) for c in tie])


def table_counts(**tables: DataFrame) -> DataFrame:
    counts = [
        df.agg(F.count("*").alias("count")).select(F.lit(name).alias("table_name"), "count")
        for name, df in tables.items()
    ]
    result = counts[0]
    for other in counts[1:]:
        result = result.unionByName(other)
    return result


def stats_by_type(metrics: DataFrame, as_of: Moment, **span: float) -> DataFrame:
    return last(metrics, as_of, column="window_start", **(span or {"hours": 1})).groupBy("sensor_type").agg(
        F.count("*").alias("total_readings"), F.avg("avg_temperature").alias("avg_temp"),
        F.max("max_temperature").alias("max_temp"),
    )


def panel_series(metrics: DataFrame, name: str, value: str, as_of: Moment, **span: float) -> DataFrame:
    """(time, name, value) rows of a dashboard panel."""
    rows = last(metrics, as_of, column="window_start", after=True, **(span or {"hours": 1}))
    return rows.select(F.col("window_start").alias("time"), name, value)


def active_sensors(metrics: DataFrame, as_of: Moment, **span: float) -> DataFrame:
    rows = last(metrics, as_of, column="window_start", after=True, **(span or {"minutes": 5}))
    return rows.agg(F.count_distinct("sensor_id").alias("active_sensors"))


def reading_lines(raw: DataFrame, n: int | None = 3, time: str = "time", tie: str = "seq") -> DataFrame:
    """Newest readings as one line of text each."""
    rows = raw if n is None else _top(raw, n, F.desc(time), F.desc(tie))
    return rows.select(F.concat(
        "sensor_id", F.lit(": "), F.col("temperature").cast("string"), F.lit("°C, "),
        F.col("humidity").cast("string"), F.lit("% humidity, "),
        F.col("battery_level").cast("string"), F.lit("% battery"),
    ).alias("line"))


def alert_lines(alerts: DataFrame, n: int | None = 3, tie: str = "seq") -> DataFrame:
    rows = alerts if n is None else _top(alerts, n, F.desc("alert_time"), F.desc(tie))
    return rows.select(F.concat(
        "sensor_id", F.lit(" - "), "alert_type", F.lit(" ("), F.col("temperature").cast("string"), F.lit("°C)"),
    ).alias("line"))


def count_lines(**tables: DataFrame) -> DataFrame:
    """'label: rows' per table."""
    counts = table_counts(**tables)
    return counts.select(F.concat("table_name", F.lit(": "), F.col("count").cast("string")).alias("summary"))


def freshness(df: DataFrame, time: str = "time") -> DataFrame:
    return df.agg(F.max(time).alias("latest_time"), F.count("*").alias("count"))
