"""Reports over stored, laid-out tables, and inputs with nulls, NaN and long positions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegauge.functions.timeparts import last
from tidegauge.operators import health, rollup, tables
from tidegauge.plans import alert_queries, report_queries, reports, views
from tidegauge.plans.registry import QUERIES, over_sensors, plain_times, query
from tidegauge.plans.rollup_queries import avro_rollup_sql, rollup_sql
from tidegauge.plans.stream_queries import run_of, stream_avro
from tidegauge.session import work_dir
from tidegauge.streaming import jobs

AS_OF = views.AS_OF


def _stored(spark: SparkSession, rows: DataFrame, name: str, layout: tables.Layout) -> DataFrame:
    out = work_dir(spark, name)
    tables.write_table(rows, out, layout)
    return tables.read_table(spark, out)


def _stored_sensors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _stored(spark, views.sensors_flagged(spark, sf_dir), "stored-sensors", tables.LAYOUTS["sensors"])


def _stored_cpu(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _stored(spark, views.cpu(spark, sf_dir), "stored-cpu", tables.LAYOUTS["cpu"])


# ---------------------------------------------------------------------------
# Time ranges over partitions
# ---------------------------------------------------------------------------
@query("c5_stored_rollup", f"""select device_id, window_start, time, temperature, reading_count
  from ({rollup_sql("day")}) where time >= timestamp '{AS_OF}' - interval 7 day""")
def stored_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table is partitioned by the start of a window, the range is over its end."""
    rolled = rollup.rollup_sensors(views.sensors(spark, sf_dir), "1 day")
    table = _stored(spark, rolled, "c5-rollup", jobs.ROLLUPS)
    return last(table, AS_OF, days=7).select("device_id", "window_start", "time", "temperature", "reading_count")


@query("c5_stored_projection", f"""select device_id, time, temperature
  from ({rollup_sql("day")}) where time >= timestamp '{AS_OF}' - interval 7 day""")
def stored_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same where the window's start is projected away before the range: nothing is pruned on a guess."""
    rolled = rollup.rollup_sensors(views.sensors(spark, sf_dir), "1 day")
    table = _stored(spark, rolled, "c5-projection", jobs.ROLLUPS).select("device_id", "time", "temperature", "day")
    return last(table, AS_OF, days=7).drop("day")


@query("c5_stored_month_table", over_sensors(f"""
  select seq, hostname, time from cpu where time >= timestamp '{AS_OF}' - interval 7 day"""))
def stored_month_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return last(_stored_cpu(spark, sf_dir), AS_OF, days=7).select("seq", "hostname", "time")


@query("g24_window_counts_stored", f"""
  select device_id, count(*) as windows, round(avg(temperature), 6) as avg_temp,
    cast(sum(error_count) as bigint) as total_errors
  from ({rollup_sql("day")}) where time >= timestamp '{AS_OF}' - interval 7 day group by device_id""")
def window_counts_stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows per device of a stored daily roll-up; rounded, as means of means depend on the order of adding."""
    rolled = rollup.rollup_sensors(views.sensors(spark, sf_dir), "1 day")
    counts = reports.window_counts(_stored(spark, rolled, "g24-rollup", jobs.ROLLUPS), AS_OF, days=7)
    return counts.withColumn("avg_temp", F.round("avg_temp", 6))


# Reports over the laid-out tables; each must equal the report over the plain rows.
_OVER_STORED = {
    "g1_single_day_temp": lambda s, d: reports.single_day(
        _stored_sensors(s, d), "temp", report_queries.DAY, report_queries.HOURS),
    "g2_single_day_humidity": lambda s, d: reports.single_day(
        _stored_sensors(s, d), "humidity", report_queries.DAY, report_queries.HOURS),
    "g3_single_day_cpu": lambda s, d: reports.single_day(
        _stored_cpu(s, d), "cpu", report_queries.DAY, report_queries.HOURS),
    "g4_single_day_load": lambda s, d: reports.single_day(
        _stored_cpu(s, d), "load", report_queries.DAY, report_queries.HOURS),
    "g5_device_current_status_week": lambda s, d: reports.device_current_status(_stored_sensors(s, d), AS_OF, days=7),
    "g6_host_current_status_week": lambda s, d: reports.host_current_status(_stored_cpu(s, d), AS_OF, days=7),
    "g7_newest_100": lambda s, d: reports.newest_rows(_stored_sensors(s, d), 100).select(
        *report_queries.NEWEST.split(", ")),
    "g8_device_aggregation": lambda s, d: reports.device_aggregation(_stored_sensors(s, d), AS_OF),
    "g9_alert_detection": lambda s, d: reports.alert_detection(_stored_sensors(s, d), AS_OF),
    "g10_customer_sites": lambda s, d: reports.customer_sites(_stored_sensors(s, d), AS_OF),
    "g11_network_totals": lambda s, d: reports.network_totals(_stored_sensors(s, d), AS_OF),
    "g12_prefix_alerts": lambda s, d: reports.prefix_alerts(_stored_sensors(s, d), AS_OF),
}


def _few_parameters(rows: DataFrame, key: str) -> DataFrame:
    """Every entity on one day, as a table of parameters."""
    entities = rows.select(F.col(key).alias("entity")).distinct()
    return entities.select(
        F.col("entity").alias("param_id"), "entity", F.lit(report_queries.DAY).cast("date").alias("day"),
        F.array(*[F.lit(h) for h in report_queries.HOURS]).alias("hours"))


def _register_parameters(number: int, kind: str) -> None:
    table, key, figures = report_queries.SINGLE_DAY_SQL[kind]
    stored = _stored_sensors if table == "sensors" else _stored_cpu

    @query(f"g{number}_single_day_{kind}_parameters_stored", over_sensors(f"""
      , hits as (select * from {table} where cast(time as date) = date '{report_queries.DAY}'
        and extract(hour from time) in {report_queries.HOURS}),
      entities as (select distinct {key} from {table})
      select p.{key} as entity, {figures}, count(h.seq) as readings
      from entities p left join hits h on h.{key} = p.{key} group by p.{key}"""))
    def many(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = stored(spark, sf_dir)
        return reports.single_day_many(rows, kind, _few_parameters(rows, key)).drop("param_id", "day")


for _number, _kind in enumerate(report_queries.SINGLE_DAY_SQL, 1):
    _register_parameters(_number, _kind)

for _name, _run in _OVER_STORED.items():
    query(f"{_name}_stored", QUERIES[_name].sql)(_run)


# ---------------------------------------------------------------------------
# The deployed job, down to the sensors table
# ---------------------------------------------------------------------------
# The columns of the sensors table that are narrower than the roll-up's, with their SQL types.
_NARROW = {
    "altitude": "float", "temperature": "float", "humidity": "float", "pressure": "float", "battery_level": "float",
    "co2_level": "float", "noise_level": "float", "light_level": "float", "signal_strength": "float",
    "memory_usage": "float", "cpu_usage": "float", "status": "smallint", "motion_detected": "smallint",
}
_WIDE = (
    "device_id", "device_type", "customer_id", "site_id", "latitude", "longitude", "time", "error_count",
    "packets_sent", "packets_received", "bytes_sent", "bytes_received",
)
_SENSORS_TABLE = f"""
  select *, cast(temperature > 35 or humidity > 80 or battery_level < 20 as smallint) as has_alert from (
    select {", ".join(_WIDE)}, {", ".join(f"cast({c} as {kind}) as {c}" for c, kind in _NARROW.items())}
    from ({avro_rollup_sql("minute")}))"""


def _sensors_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Binary messages through the roll-up job into a stored sensors table."""
    run = run_of(spark, "h8-sensors")
    jobs.start_rollup_job(stream_avro(spark, sf_dir), run, keep=("seq",)).awaitTermination()
    rows = jobs.sensors_table(jobs.read_rollups(tables.read_table(spark, run.output)))
    return _stored(spark, rows, "h8-sensors-table", tables.LAYOUTS["sensors"])


@query("h8_sensors_table", _SENSORS_TABLE)
def sensors_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plain_times(_sensors_table(spark, sf_dir).drop("day"))


@query("g9_alert_detection_job", f"""
  select device_id, device_type, max(temperature) as max_temp, min(battery_level) as min_battery,
    count(*) as alert_count
  from ({_SENSORS_TABLE}) where has_alert = 1 and time >= timestamp '{AS_OF}' - interval 7 day
  group by device_id, device_type""")
def alert_detection_job(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A report over the table that the deployed job ends in."""
    return reports.alert_detection(_sensors_table(spark, sf_dir), AS_OF, days=7)


# ---------------------------------------------------------------------------
# Nulls, long positions, NaN
# ---------------------------------------------------------------------------
@query("e2_averages_with_nulls", over_sensors("""
  , gaps as (select * replace (
      case when seq % 2 = 0 then temperature end as temperature, case when seq % 3 = 0 then status end as status,
      case when seq % 5 < 3 then motion_detected end as motion_detected) from sensors)
  select device_id, date_trunc('day', time) as window_start, avg(temperature) as temperature,
    cast(sum(status) // nullif(count(status), 0) as int) as status, avg(humidity) as humidity,
    cast(sum(cast(motion_detected = 1 as int)) * 2 > count(motion_detected) as smallint) as motion_detected,
    count(*) as reading_count
  from gaps group by 1, 2"""))
def averages_with_nulls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An average, a mean status or a vote is over the readings that have a value, and null without any."""
    gaps = views.sensors(spark, sf_dir).withColumns({
        "temperature": F.expr("case when seq % 2 = 0 then temperature end"),
        "status": F.expr("case when seq % 3 = 0 then status end"),
        "motion_detected": F.expr("case when seq % 5 < 3 then motion_detected end"),
    })
    names = ("device_id", "window_start", "temperature", "status", "humidity", "motion_detected", "reading_count")
    return rollup.rollup_sensors(gaps, "1 day").select(*names)


# Readings of one instant, whose positions are beyond 2^36 and fall as the ids rise.
_LONG = "(100000000 - seq) * 8589934592"


@query("e4_first_seen_long_positions", over_sensors(f"""
  , r as (select device_id, device_type, site_id, altitude, date_trunc('day', time) as window_start, {_LONG} as place from sensors)
  select 'canonical' as route, device_id, window_start, min_by(device_type, place) as device_type,
    min_by(altitude, place) as altitude from r group by 2, 3
  union all
  select 'binary', device_id, window_start, min_by(device_type, place), 0.0E0 from r group by 2, 3"""))
def first_seen_long_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = views.sensors(spark, sf_dir).withColumns({
        "time": F.date_trunc("day", "time"), "seq": F.expr(_LONG.replace("100000000", "100000000L"))})
    names = ("device_id", "window_start", "device_type", "altitude")
    readings = views.avro_readings(views.sensors(spark, sf_dir)).withColumns({
        "time": F.date_trunc("day", F.timestamp_millis("timestamp")),
        "seq": F.expr(_LONG.replace("100000000", "100000000L"))})
    routes = {"canonical": rollup.rollup_sensors(rows, "1 day"), "binary": rollup.rollup_readings(readings, "1 day")}
    canonical, binary = [plain_times(df.select(F.lit(name).alias("route"), *names)) for name, df in routes.items()]
    return canonical.unionByName(binary)


@query("k4_latency_summary_nan", """
  with l as (select event_type, case when event_id % 50 = 0 then cast('NaN' as double)
      else floor(value * 8) / 8000.0E0 end as s from events),
  v as (select event_type, count(*) as total, min(s) as min, list_sort(list(s)) as v from l group by event_type)
  select event_type, total, min, (v[(total - 1) // 2 + 1] + v[total // 2 + 1]) / 2 as p50,
    v[cast(floor(total * 0.95E0) as bigint) + 1] as p95 from v""")
def latency_summary_nan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Latencies in seconds, some of them NaN, which ranks last."""
    rows = views.events(spark, sf_dir).select("event_type", F.expr(
        "case when event_id % 50 = 0 then cast('NaN' as double) else floor(value * 8) / 8000.0D end").alias("s"))
    return health.latency_summary(rows, "s", ["event_type"]).select("event_type", "total", "min", "p50", "p95")


# ---------------------------------------------------------------------------
# Sampled and approximate results, within their bounds
# ---------------------------------------------------------------------------
@query("c10_sample_rows_share", "select count(*) as rows, true as within from events")
def sample_rows_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tenth of the rows, give or take five standard deviations."""
    total = views.sensors(spark, sf_dir).agg(F.count("*").alias("rows"))
    sampled = alert_queries.sample_rows(spark, sf_dir).agg(F.count("*").alias("sampled"))
    off = F.abs(F.col("sampled") - F.col("rows") * 0.1)
    return total.withColumn("sampled", sampled.scalar()).select(
        "rows", (off <= 5 * F.sqrt(F.col("rows") * 0.09)).alias("within"))


@query("g15_unique_devices_approx_share", over_sensors(
    "select count(distinct device_id) as value, true as within from sensors"))
def unique_devices_approx_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sketch is within five times its stated error of 0.02."""
    rows = views.sensors(spark, sf_dir)
    sketch = reports.unique_devices(rows, exact=False).scalar()
    off = F.abs(sketch - F.col("value"))
    return reports.unique_devices(rows).select("value", (off <= 0.1 * F.col("value")).alias("within"))
