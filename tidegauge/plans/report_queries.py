"""The analytic reports."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegauge.operators import alerting
from tidegauge.plans import reports, views
from tidegauge.plans.registry import over_metrics, over_sensors, query

AS_OF = views.AS_OF
DAY, HOURS = "2024-01-15", (2, 9, 14, 20)


# No event is of the month's last hour, so the panels of an hour are asked for half a day earlier.
PANEL_AS_OF = "2024-01-30 12:30:00"


def _since(span: str, column: str = "time", op: str = ">=", now: str = AS_OF) -> str:
    return f"where {column} {op} timestamp '{now}' - interval {span}"


def _register(name: str, sql: str, run: Callable[[SparkSession, str], DataFrame]) -> None:
    query(name, sql)(run)


# ---------------------------------------------------------------------------
# Load-test queries: one day, some hours
# ---------------------------------------------------------------------------
SINGLE_DAY_SQL = {
    "temp": ("sensors", "device_id", "avg(temperature) as avg_temp, max(temperature) as max_temp"),
    "humidity": ("sensors", "device_id", "avg(humidity) as avg_humidity, max(humidity) as max_humidity"),
    "cpu": ("cpu", "hostname", """avg(usage_user) as avg_user_cpu, avg(usage_system) as avg_system_cpu,
      max(usage_user + usage_system) as max_cpu"""),
    "load": ("cpu", "hostname", "avg(load1) as avg_load1, avg(load5) as avg_load5, max(load1) as max_load1"),
}

# A parameter for every entity on every day; which hours follows from the day.
HOURS_OF_DAY = "array(day(d) % 24, (day(d) + 7) % 24, (day(d) + 13) % 24)"


def _parameters(facts: DataFrame, key: str) -> DataFrame:
    pairs = facts.select(F.col(key).alias("entity"), F.to_date("time").alias("d")).distinct()
    return pairs.select(
        F.concat_ws("/", "entity", "d").alias("param_id"), "entity", F.col("d").alias("day"),
        F.expr(HOURS_OF_DAY).alias("hours"),
    )


def _register_single_day(number: int, kind: str) -> None:
    table, key, figures = SINGLE_DAY_SQL[kind]
    facts = views.sensors if table == "sensors" else views.cpu

    @query(f"g{number}_single_day_{kind}", over_sensors(f"""
      select {key}, {figures}, count(*) as readings from {table}
      where cast(time as date) = date '{DAY}' and extract(hour from time) in {HOURS} group by {key}"""))
    def one_day(spark: SparkSession, sf_dir: str) -> DataFrame:
        return reports.single_day(facts(spark, sf_dir), kind, DAY, HOURS)

    @query(f"g{number}_single_day_{kind}_parameters", over_sensors(f""", params as (
        select distinct {key}, cast(time as date) as d from {table}),
      hits as (
        select {table}.*, cast(time as date) as d from {table}
        where extract(hour from time) in (day(time) % 24, (day(time) + 7) % 24, (day(time) + 13) % 24))
      select concat_ws('/', p.{key}, cast(p.d as varchar)) as param_id, p.{key} as entity,
        cast(p.d as varchar) as day, {figures}, count(h.seq) as readings
      from params p left join hits h on h.{key} = p.{key} and h.d = p.d group by p.{key}, p.d"""))
    def many(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = facts(spark, sf_dir)
        answers = reports.single_day_many(rows, kind, _parameters(rows, key))
        return answers.withColumn("day", F.col("day").cast("string"))


for _number, _kind in enumerate(SINGLE_DAY_SQL, 1):
    _register_single_day(_number, _kind)


# ---------------------------------------------------------------------------
# Current values and newest rows
# ---------------------------------------------------------------------------
def _device_status_sql(span: str) -> str:
    return over_sensors(f"""
      select device_id, max_by(temperature, row(time, seq)) as current_temp,
        max_by(humidity, row(time, seq)) as current_humidity, max(time) as last_seen
      from sensors {_since(span)} group by device_id""")


def _host_status_sql(span: str) -> str:
    return over_sensors(f"""
      select hostname, max_by(usage_user + usage_system, row(time, seq)) as current_cpu,
        max_by(load1, row(time, seq)) as current_load1, max(time) as last_metric
      from cpu {_since(span)} group by hostname""")


_register("g5_device_current_status", _device_status_sql("1 hour"),
          lambda s, d: reports.device_current_status(views.sensors(s, d), AS_OF))
_register("g5_device_current_status_week", _device_status_sql("7 day"),
          lambda s, d: reports.device_current_status(views.sensors(s, d), AS_OF, days=7))
_register("g6_host_current_status", _host_status_sql("30 minute"),
          lambda s, d: reports.host_current_status(views.cpu(s, d), AS_OF))
_register("g6_host_current_status_week", _host_status_sql("7 day"),
          lambda s, d: reports.host_current_status(views.cpu(s, d), AS_OF, days=7))

NEWEST = "seq, device_id, device_type, temperature, humidity, battery_level, status, bytes_sent, time"
for _n in (100, 10):
    _register(f"g7_newest_{_n}", over_sensors(
        f"select {NEWEST} from sensors order by time desc, seq desc limit {_n}"),
        lambda s, d, n=_n: reports.newest_rows(views.sensors(s, d), n).select(*NEWEST.split(", ")))


# ---------------------------------------------------------------------------
# Grouped reports: the literal time span, and a wider one with more rows
# ---------------------------------------------------------------------------
def _spans(name: str, sql: Callable[[str], str], run, literal: tuple[str, dict], wide: tuple[str, dict]) -> None:
    """``sql(where)`` and ``run(sensors, **span)`` over two spans; ``{}`` is the report's own."""
    _register(name, over_sensors(sql(_since(literal[0]))),
              lambda s, d: run(views.sensors_flagged(s, d), **literal[1]))
    _register(f"{name}_wide", over_sensors(sql(_since(wide[0]))),
              lambda s, d: run(views.sensors_flagged(s, d), **wide[1]))


HOUR, WEEK = ("1 hour", {}), ("7 day", {"days": 7})
ONE_DAY, MONTH = ("1 day", {}), ("30 day", {"days": 30})
QUARTER_HOUR = ("15 minute", {})

_spans("g8_device_aggregation", lambda where: f"""
  select device_id, device_type, avg(temperature) as avg_temp, avg(humidity) as avg_humidity,
    count(*) as record_count from sensors {where} group by 1, 2
  order by record_count desc, device_id, device_type limit 50""",
       lambda df, **span: reports.device_aggregation(df, AS_OF, **span), HOUR, WEEK)

_spans("g9_alert_detection", lambda where: f"""
  select device_id, device_type, max(temperature) as max_temp, min(battery_level) as min_battery,
    count(*) as alert_count from sensors {where} and has_alert = 1 group by 1, 2""",
       lambda df, **span: reports.alert_detection(df, AS_OF, **span), HOUR, WEEK)

_spans("g10_customer_sites", lambda where: f"""
  select customer_id, site_id, count(distinct device_id) as device_count, avg(temperature) as avg_temp,
    count(*) as total_readings from sensors {where} group by 1, 2
  order by total_readings desc, customer_id, site_id limit 100""",
       lambda df, **span: reports.customer_sites(df, AS_OF, **span), ONE_DAY, MONTH)

_spans("g11_network_totals", lambda where: f"""
  select device_id, cast(sum(packets_sent) as bigint) as total_packets_sent,
    cast(sum(packets_received) as bigint) as total_packets_received,
    cast(sum(bytes_sent) as bigint) as total_bytes_sent, cast(sum(bytes_received) as bigint) as total_bytes_received
  from sensors {where} group by device_id having sum(packets_sent) > 1000
  order by total_bytes_sent desc, device_id limit 50""",
       lambda df, **span: reports.network_totals(df, AS_OF, **span), HOUR, WEEK)

_spans("g12_prefix_alerts", lambda where: f"""
  select device_id, avg(temperature) as avg_temp, count(*) as cnt from sensors {where}
    and device_id like 'sensor_1%' and has_alert = 1 group by device_id order by cnt desc, device_id limit 100""",
       lambda df, **span: reports.prefix_alerts(df, AS_OF, **span), HOUR, WEEK)

_spans("g14_ingestion_rate", lambda where: f"""
  select date_trunc('minute', time) as t, count(*) as records from sensors {where} group by 1""",
       lambda df, **span: reports.ingestion_rate(df, AS_OF, **span), QUARTER_HOUR, WEEK)

_spans("g16_temperature_series", lambda where: f"""
  select date_trunc('minute', time) as t, avg(temperature) as avg_temp, max(temperature) as max_temp,
    min(temperature) as min_temp from sensors {where} group by 1""",
       lambda df, **span: reports.temperature_series(df, AS_OF, **span), QUARTER_HOUR, WEEK)

_spans("g17_humidity_battery_series", lambda where: f"""
  select date_trunc('minute', time) as t, avg(humidity) as avg_humidity, avg(battery_level) as avg_battery
  from sensors {where} group by 1""",
       lambda df, **span: reports.humidity_battery_series(df, AS_OF, **span), QUARTER_HOUR, WEEK)

_spans("g21_hottest_devices", lambda where: f"""
  select device_id, avg(temperature) as avg_temp, count(*) as data_points from sensors {where}
  group by device_id order by avg_temp desc, device_id limit 10""",
       lambda df, **span: reports.hottest_devices(df, AS_OF, **span), HOUR, WEEK)

_spans("g22_low_battery_devices", lambda where: f"""
  select device_id, avg(battery_level) as avg_battery from sensors {where}
  group by device_id having avg(battery_level) < 20""",
       lambda df, **span: reports.low_battery_devices(df, AS_OF, **span), ONE_DAY, ("3 day", {"days": 3}))

_spans("g23_customer_errors", lambda where: f"""
  select customer_id, cast(sum(error_count) as bigint) as total_errors from sensors {where} group by customer_id""",
       lambda df, **span: reports.customer_errors(df, AS_OF, **span), ONE_DAY, MONTH)

_spans("g24_device_quality", lambda where: f"""
  select device_id, count(*) as aggregated_records, avg(temperature) as avg_temp, avg(humidity) as avg_humidity,
    cast(sum(error_count) as bigint) as total_errors from sensors {where} group by device_id""",
       lambda df, **span: reports.device_quality(df, AS_OF, **span), HOUR, MONTH)

_spans("g24_window_counts", lambda where: f"""
  select device_id, count(*) as windows, avg(temperature) as avg_temp,
    cast(sum(error_count) as bigint) as total_errors from sensors {where} group by device_id""",
       lambda df, **span: reports.window_counts(df, AS_OF, **span), ("5 minute", {}), ("1 day", {"days": 1}))

_register("g14_ingestion_rate_newest", over_sensors(f"""
  select date_trunc('minute', time) as t, count(*) as records from sensors {_since('10 minute')} group by 1"""),
          lambda s, d: reports.ingestion_rate(views.sensors(s, d), AS_OF, minutes=10).orderBy(F.desc("t")))

_register("g13_total_rows", over_sensors("select count(*) as value from sensors"),
          lambda s, d: reports.total_rows(views.sensors(s, d)))
_register("g15_unique_devices", over_sensors("select count(distinct device_id) as value from sensors"),
          lambda s, d: reports.unique_devices(views.sensors(s, d)))
query("g15_unique_devices_approx")(lambda s, d: reports.unique_devices(views.sensors(s, d), exact=False))

_register("g18_records_by_type", over_sensors("""
  select device_type, count(*) as count from sensors group by 1 order by count desc, device_type limit 10"""),
          lambda s, d: reports.records_by_type(views.sensors(s, d)))
_register("g19_busiest_devices", over_sensors("""
  select device_id, count(*) as records, round(avg(temperature), 2) as avg_temp,
    round(avg(battery_level), 2) as avg_battery
  from sensors group by 1 order by records desc, device_id limit 10"""),
          lambda s, d: reports.busiest_devices(views.sensors(s, d)))

for _width, _bucket in (("1 hour", "date_trunc('hour', time)"), ("15 minutes", "time_bucket(interval 15 minutes, time)")):
    _register(f"g20_bucket_series_{_width.replace(' ', '_')}", over_sensors(f"""
      select {_bucket} as t, count(*) as records, avg(temperature) as avg_temp,
        cast(sum(has_alert) as bigint) as alerts
      from sensors where time >= timestamp '2024-01-08' and time < timestamp '2024-01-22' group by 1"""),
        lambda s, d, w=_width: reports.bucket_series(
            views.sensors_flagged(s, d), "2024-01-08 00:00:00", "2024-01-22 00:00:00", w))

for _seconds in (60, 86400):
    _register(f"g25_write_rate_{_seconds}s", over_sensors(f"""
      select count(*) as rows_written, count(*) / {_seconds}.0E0 as rows_per_second,
        round(count(*) / {_seconds}.0E0, 2) as rounded_rate from sensors {_since(f'{_seconds} second')}"""),
        lambda s, d, n=_seconds: reports.write_rate(views.sensors(s, d), AS_OF, n))


# ---------------------------------------------------------------------------
# Alerts and metrics tables
# ---------------------------------------------------------------------------
METRICS = """sensor_id, sensor_type, location, window_start, avg_temperature, avg_humidity, max_temperature, min_battery"""
_register("g26_recent_metrics", over_metrics(f"""
  select {METRICS} from metrics order by window_start desc, sensor_id, sensor_type, location limit 20"""),
          lambda s, d: reports.recent_metrics(views.metrics(s, d)).select(*METRICS.split(", ")))

_register("g27_recent_alerts_20", over_sensors("select * from alerts order by alert_time desc, seq desc limit 20"),
          lambda s, d: reports.recent_alerts(views.alerts(s, d)))
_register("g27_recent_alerts_hour", over_sensors(f"select * from alerts {_since('1 hour', 'alert_time')}"),
          lambda s, d: reports.recent_alerts(views.alerts(s, d), None, AS_OF))
_register("g27_recent_alerts_50", over_sensors(f"""
  select * from alerts {_since('7 day', 'alert_time', '>')} order by alert_time desc, seq desc limit 50"""),
          lambda s, d: reports.recent_alerts(views.alerts(s, d), 50, AS_OF, after=True, days=7))

_register("g28_table_counts", over_metrics("""
  select 'sensor_metrics' as table_name, count(*) as count from metrics
  union all select 'sensor_alerts', count(*) from alerts
  union all select 'sensors', count(*) from sensors
  union all select 'cpu', count(*) from cpu"""),
          lambda s, d: reports.table_counts(
              sensor_metrics=views.metrics(s, d), sensor_alerts=views.alerts(s, d),
              sensors=views.sensors(s, d), cpu=views.cpu(s, d)))

for _name, _span, _kw in (("", "1 hour", {}), ("_wide", "7 day", {"days": 7})):
    _register(f"g29_stats_by_type{_name}", over_metrics(f"""
      select sensor_type, count(*) as total_readings, avg(avg_temperature) as avg_temp,
        max(max_temperature) as max_temp from metrics {_since(_span, 'window_start')} group by 1""", "minute"),
        lambda s, d, kw=_kw: reports.stats_by_type(views.metrics(s, d, "1 minute"), AS_OF, **kw))
    for _key, _value in (("sensor_id", "avg_temperature"), ("location", "avg_humidity"), ("sensor_id", "min_battery")):
        _register(f"g30_panel_{_value}{_name}", over_metrics(f"""
          select window_start as time, {_key}, {_value} from metrics
          {_since(_span, 'window_start', '>', AS_OF if _kw else PANEL_AS_OF)}"""),
            lambda s, d, k=_key, v=_value, kw=_kw: reports.panel_series(
                views.metrics(s, d), k, v, AS_OF if kw else PANEL_AS_OF, **kw))
    _register(f"g31_active_sensors{_name}", over_metrics(f"""
      select count(distinct sensor_id) as active_sensors
      from metrics {_since('5 minute' if not _kw else _span, 'window_start', '>')}"""),
        lambda s, d, kw=_kw: reports.active_sensors(views.metrics(s, d), AS_OF, **kw))

_register("g32_reading_lines", over_sensors("""
  select device_id || ': ' || cast(temperature as varchar) || '°C, ' || cast(humidity as varchar) || '% humidity, '
    || cast(battery_level as varchar) || '% battery' as line from sensors order by time desc, seq desc limit 3"""),
          lambda s, d: reports.reading_lines(alerting.sensor_names(views.sensors(s, d))))
_register("g32_reading_lines_all", over_sensors("""
  select device_id || ': ' || cast(temperature as varchar) || '°C, ' || cast(humidity as varchar) || '% humidity, '
    || cast(battery_level as varchar) || '% battery' as line from sensors"""),
          lambda s, d: reports.reading_lines(alerting.sensor_names(views.sensors(s, d)), None))
_register("g32_alert_lines", over_sensors("""
  select sensor_id || ' - ' || alert_type || ' (' || cast(temperature as varchar) || '°C)' as line
  from alerts order by alert_time desc, seq desc limit 3"""),
          lambda s, d: reports.alert_lines(views.alerts(s, d)))
_register("g32_alert_lines_all", over_sensors("""
  select sensor_id || ' - ' || alert_type || ' (' || cast(temperature as varchar) || '°C)' as line from alerts"""),
          lambda s, d: reports.alert_lines(views.alerts(s, d), None))
_register("g32_count_lines", over_sensors("""
  select 'Raw sensor records: ' || cast(count(*) as varchar) as summary from sensors
  union all select 'Alert records: ' || cast(count(*) as varchar) from alerts"""),
          lambda s, d: reports.count_lines(
              **{"Raw sensor records": views.sensors(s, d), "Alert records": views.alerts(s, d)}))

_register("g33_freshness_sensors", over_sensors("select max(time) as latest_time, count(*) as count from sensors"),
          lambda s, d: reports.freshness(views.sensors(s, d)))
_register("g33_freshness_cpu", over_sensors("select max(time) as latest_time, count(*) as count from cpu"),
          lambda s, d: reports.freshness(views.cpu(s, d)))
