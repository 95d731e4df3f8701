"""Roll-ups, metrics, hourly states and tables at rest."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegauge import schemas
from tidegauge.functions.timeparts import day_key, month_key
from tidegauge.operators import hourly, rollup, tables
from tidegauge.plans import views
from tidegauge.plans.registry import over_metrics, over_sensors, plain_times, query
from tidegauge.session import work_dir

AS_OF = views.AS_OF

# The columns of a roll-up by how they are rolled up, and the usage it
# reports instead of a measured one.  Written out, not taken from the operators, so that
# the SQL notices an error there.
FIRST_SEEN = ("device_id", "device_type", "customer_id", "site_id", "latitude", "longitude", "altitude")
AVERAGED = (
    "temperature", "humidity", "pressure", "co2_level", "noise_level", "light_level", "battery_level", "signal_strength")
SUMMED = ("error_count", "packets_sent", "packets_received", "bytes_sent", "bytes_received")
USAGE = {"memory_usage": "50.0", "cpu_usage": "30.0"}


def rollup_sql(
    unit: str = "minute", key: str = "device_id", start: str | None = None, length: str | None = None,
    extremes: bool = False, real_usage: bool = False, select: str = "*", source: str = "sensors",
) -> str:
    """The roll-up as SQL; ``select`` picks columns of its result."""
    start = start or f"date_trunc('{unit}', time)"
    length = length or f"interval 1 {unit}"
    first = ", ".join(
        f"min_by({c}, row(time, seq)) as {c}" for c in FIRST_SEEN if c != key)
    averages = ", ".join(f"avg({c}) as {c}" for c in AVERAGED)
    usage = ", ".join(
        f"avg({c}) as {c}" if real_usage else f"{value}E0 as {c}"
        for c, value in USAGE.items())
    sums = ", ".join(f"cast(sum({c}) as bigint) as {c}" for c in SUMMED)
    more = "".join(
        f", min({c}) as min_{c}, max({c}) as max_{c}" for c in AVERAGED) if extremes else ""
    return over_sensors(f""", rolled as (
      select {key}, {first}, {start} as window_start, {start} + {length} as window_end,
        {start} + {length} as time, {averages},
        cast(sum(case when motion_detected = 1 then 1 else 0 end) * 2 > count(*) as smallint) as motion_detected,
        {usage}, cast(sum(status) // count(*) as int) as status, {sums}, count(*) as reading_count {more}
      from {source} group by {key}, {start})
    select {select} from rolled""")


def _register_rollup(name: str, window: str, **sql) -> None:
    options = {"key": sql.get("key", "device_id"), "with_extremes": sql.get("extremes", False),
               "real_usage": sql.get("real_usage", False)}

    @query(name, rollup_sql(**sql))
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return rollup.rollup_sensors(views.sensors(spark, sf_dir), window, **options)


_register_rollup("e1_rollup_device_minute", "1 minute", unit="minute")
_register_rollup("e1_rollup_device_hour", "1 hour", unit="hour")
_register_rollup("e1_rollup_device_day", "1 day", unit="day")
_register_rollup("e3_rollup_extremes", "1 day", unit="day", extremes=True)
_register_rollup("e8_rollup_real_usage", "1 day", unit="day", real_usage=True)
_register_rollup(
    "e10_rollup_five_minutes", "5 minutes",
    start="time_bucket(interval 5 minutes, time)", length="interval 5 minutes")
_register_rollup("e11_rollup_site_hour", "1 hour", unit="hour", key="site_id")
_register_rollup("e11_rollup_customer_day", "1 day", unit="day", key="customer_id")


AVRO_ROWS = """, avro as (
  select seq, device_id, device_type, 'customer_0001' as customer_id, site_id, 0.0E0 as latitude, 0.0E0 as longitude,
    0.0E0 as altitude, date_trunc('millisecond', time) as time, temperature, humidity, pressure,
    400.0E0 as co2_level, 50.0E0 as noise_level, 500.0E0 as light_level, 0 as motion_detected, battery_level,
    -50.0E0 as signal_strength, 50.0E0 as memory_usage, 30.0E0 as cpu_usage, status, 0 as error_count,
    0 as packets_sent, 0 as packets_received, 0 as bytes_sent, 0 as bytes_received from sensors)"""


def avro_rollup_sql(unit: str, extremes: bool = False) -> str:
    """The roll-up of canonical rows made from binary readings."""
    rolled = rollup_sql(unit, source="avro", extremes=extremes)
    return over_sensors(AVRO_ROWS) + rolled.removeprefix(over_sensors(""))


@query("e1_rollup_readings_minute", avro_rollup_sql("minute"))
def rollup_readings_minute(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rollup_readings(spark, sf_dir, "1 minute")


@query("e1_rollup_readings_day", avro_rollup_sql("day", extremes=True))
def rollup_readings_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rollup_readings(spark, sf_dir, "1 day", with_extremes=True)


def _rollup_readings(spark: SparkSession, sf_dir: str, window: str, **options) -> DataFrame:
    readings = views.avro_readings(views.sensors(spark, sf_dir))
    rows = readings.withColumn("time", F.timestamp_millis("timestamp"))
    return plain_times(rollup.rollup_readings(rows, window, **options))


def _daily(*columns: str):
    """A query of single columns of the daily roll-up; the rest is pruned."""
    names = ("device_id", "window_start", *columns)

    def register(name: str) -> None:
        @query(name, rollup_sql("day", select=", ".join(names)))
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return rollup.rollup_sensors(views.sensors(spark, sf_dir), "1 day").select(*names)

    return register


_daily(*AVERAGED)("e2_averages")
_daily("device_type", "customer_id", "site_id", "latitude", "longitude", "altitude")("e4_first_seen")
_daily("motion_detected")("e5_motion_majority")
_daily("status")("e6_status_mean")
_daily(*SUMMED)("e7_counter_sums")
_daily("reading_count")("e13_reading_count")


@query("e9_merge_rollups", rollup_sql("hour"))
def merge_rollups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Minute states, stored, merged into hours."""
    out = work_dir(spark, "e9")
    rollup.rollup_states(views.sensors(spark, sf_dir), "1 minute").write.parquet(out)
    return rollup.finish_rollup(rollup.merge_rollups(spark.read.parquet(out), "1 hour"))


METRIC_COLUMNS = """sensor_id, sensor_type, location, window_start, window_end, avg_temperature, avg_humidity,
  avg_pressure, max_temperature, min_battery, max_battery, reading_count, window_end as processing_time, seq"""


@query("e12_sensor_metrics_hour", over_metrics(f"select {METRIC_COLUMNS} from metrics"))
def sensor_metrics_hour(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.metrics(spark, sf_dir)


@query("e12_sensor_metrics_minute", over_metrics(f"select {METRIC_COLUMNS} from metrics", "minute"))
def sensor_metrics_minute(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.metrics(spark, sf_dir, "1 minute")


# ---------------------------------------------------------------------------
# Hourly states and the latest status
# ---------------------------------------------------------------------------
HOURLY_SQL = """select sensor_id, sensor_type, location, date_trunc('hour', window_start) as hour_window,
    sum(avg_temperature) as temperature_sum, sum(avg_humidity) as humidity_sum, sum(avg_pressure) as pressure_sum,
    count(*) as window_count, min(min_battery) as battery_min, max(max_battery) as battery_max,
    cast(sum(reading_count) as bigint) as total_readings
  from metrics group by 1, 2, 3, 4"""

FINISHED_SQL = f"""select sensor_id, sensor_type, location, hour_window,
    temperature_sum / window_count as temperature_avg, humidity_sum / window_count as humidity_avg,
    pressure_sum / window_count as pressure_avg, battery_min, battery_max, total_readings
  from ({HOURLY_SQL})"""


@query("f1_hourly_states", over_metrics(HOURLY_SQL, "minute"))
def hourly_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hourly.hourly_states(views.metrics(spark, sf_dir, "1 minute"))


@query("f2_hourly_finished", over_metrics(FINISHED_SQL, "minute"))
def hourly_finished(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hourly.finish_hourly(hourly.hourly_states(views.metrics(spark, sf_dir, "1 minute")))


@query("f2_latest_hours", over_metrics(
    f"{FINISHED_SQL} order by hour_window desc, sensor_id, sensor_type, location limit 24", "minute"))
def latest_hours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hourly.latest_hours(hourly.hourly_states(views.metrics(spark, sf_dir, "1 minute")))


LATEST_SQL = """select sensor_id, sensor_type, location,
    max_by(avg_temperature, row(window_end, seq)) as latest_temperature,
    max_by(avg_humidity, row(window_end, seq)) as latest_humidity,
    max_by(avg_pressure, row(window_end, seq)) as latest_pressure,
    max_by(min_battery, row(window_end, seq)) as latest_battery,
    max(window_end) as last_update
  from metrics group by 1, 2, 3"""


@query("f3_latest_status", over_metrics(LATEST_SQL))
def latest_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hourly.latest_status(views.metrics(spark, sf_dir))


@query("f3_latest_status_top", over_metrics(
    f"{LATEST_SQL} order by last_update desc, sensor_id, sensor_type, location limit 20"))
def latest_status_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = hourly.latest_status(views.metrics(spark, sf_dir))
    return status.orderBy(F.desc("last_update"), "sensor_id", "sensor_type", "location").limit(20)


# ---------------------------------------------------------------------------
# Retention and layout
# ---------------------------------------------------------------------------
# The events span a month, so the longer retentions are asked for at a later day: one that
# some rows have reached and others not.
ALERTS_AS_OF = "2024-02-15 00:00:00"
METRICS_AS_OF = "2024-04-15 00:00:00"


def _kept(table: str, time: str, columns: str, days: int, as_of: str = AS_OF) -> str:
    return f"select {columns} from {table} where {time} > timestamp '{as_of}' - interval {days} day"


@query("f4_retention_raw", over_sensors(_kept("sensors", "time", "seq, device_id, time", 7)))
def retention_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = views.sensors(spark, sf_dir).select("seq", "device_id", "time")
    return tables.apply_retention(rows, "time", schemas.RETENTION_DAYS["sensor_raw_data"], AS_OF)


@query("f4_retention_alerts", over_sensors(_kept("alerts", "alert_time", "seq, sensor_id, alert_time", 30, ALERTS_AS_OF)))
def retention_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = views.alerts(spark, sf_dir).select("seq", "sensor_id", "alert_time")
    return tables.apply_retention(rows, "alert_time", schemas.RETENTION_DAYS["sensor_alerts"], ALERTS_AS_OF)


@query("f4_retention_metrics", over_metrics(_kept("metrics", "window_start", "sensor_id, window_start, seq", 90, METRICS_AS_OF)))
def retention_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = views.metrics(spark, sf_dir).select("sensor_id", "window_start", "seq")
    return tables.apply_retention(rows, "window_start", schemas.RETENTION_DAYS["sensor_metrics"], METRICS_AS_OF)


@query("f4_drop_expired_days", over_sensors(_kept("sensors", "time", "seq, device_id, time", 7)))
def drop_expired_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """On a stored table: old day folders go, the filter hides the rest."""
    out = work_dir(spark, "f4")
    tables.write_table(views.sensors(spark, sf_dir), out, tables.LAYOUTS["sensors"])
    tables.drop_expired(spark, out, 7, AS_OF)
    kept = tables.apply_retention(tables.read_table(spark, out), "time", 7, AS_OF)
    return kept.select("seq", "device_id", "time")


SENSOR_COLUMNS = """seq, device_id, device_type, customer_id, site_id, latitude, longitude, altitude, time, temperature,
  humidity, pressure, battery_level, status, error_count, packets_sent, bytes_received"""


@query("f5_table_layout", over_sensors(f"select {SENSOR_COLUMNS} from sensors"))
def table_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = work_dir(spark, "f5")
    tables.write_table(views.sensors(spark, sf_dir), out, tables.LAYOUTS["sensors"])
    return tables.read_table(spark, out).select(*[c.strip() for c in SENSOR_COLUMNS.split(",")])


@query("f5_cpu_layout", over_sensors("select seq, hostname, service, time, usage_user, load1 from cpu"))
def cpu_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = work_dir(spark, "f5-cpu")
    tables.write_table(views.cpu(spark, sf_dir), out, tables.LAYOUTS["cpu"])
    return tables.read_table(spark, out).select("seq", "hostname", "service", "time", "usage_user", "load1")


@query("f5_partition_keys", over_sensors("""
  select cast(strftime(time, '%Y%m') as int) as month, cast(strftime(time, '%Y%m%d') as int) as day,
    count(*) as records from sensors group by 1, 2"""))
def partition_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.sensors(spark, sf_dir).groupBy(
        month_key(F.col("time")).alias("month"), day_key(F.col("time")).alias("day")
    ).agg(F.count("*").alias("records"))
