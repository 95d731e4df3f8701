"""The telemetry tables of the checks, derived from the ``events`` table.

Fractional values are multiples of 1/8, so sums are exact in any order and
averages can be compared bit by bit.  The same mapping is written once more as
SQL in ``SENSORS_SQL`` for the engine the results are compared with.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidegauge.functions import labels
from tidegauge.operators import alerting, canonical, rollup

AS_OF = "2024-01-31 00:00:00"

# Stated so that opening the table needs no job to infer it.
EVENTS = (
    T.StructType()
    .add("event_id", "long").add("ts", "timestamp_ntz").add("user_id", "long")
    .add("event_type", "string").add("value", "double").add("props", "string")
)

SERVICES = (
    "web-server", "api-gateway", "database", "cache", "queue-worker", "auth-service", "data-processor",
)


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.schema(EVENTS).parquet(f"{sf_dir}/events.parquet")


def stream_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as a file stream, with a zoned timestamp for watermarks."""
    rows = spark.readStream.schema(EVENTS).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    return rows.withColumn("ts", F.col("ts").cast("timestamp"))


def to_sensors(rows: DataFrame) -> DataFrame:
    """events -> sensors (26 columns: the table plus ``seq`` as tie-break)."""
    base = rows.selectExpr(
        "event_id", "user_id", "ts", "value", "cast(get_json_object(props, '$.k') as bigint) as k"
    )
    types = ", ".join(f"'{name}'" for name in labels.SENSOR_TYPES)
    return base.selectExpr(
        "*", "case when k < 85 then 1 when k < 90 then 2 when k < 95 then 3 else 4 end as status"
    ).selectExpr(
        "event_id as seq",
        "concat('sensor_', user_id) as device_id",
        f"get(array({types}), cast(event_id % 8 as int)) as device_type",
        "concat('customer_', lpad(cast(user_id % 10 + 1 as string), 4, '0')) as customer_id",
        "concat('site_', lpad(cast(user_id % 100 + 1 as string), 3, '0')) as site_id",
        "25.0D + (event_id % 193) / 8.0D as latitude",
        "-125.0D + (event_id % 465) / 8.0D as longitude",
        "cast(event_id % 3001 as double) as altitude",
        "ts as time",
        "10.0D + (cast(floor(value * 8) as bigint) % 241) / 8.0D as temperature",
        "20.0D + k * 0.75D as humidity",
        "cast(980 + event_id % 51 as double) as pressure",
        "cast(400 + event_id % 1601 as double) as co2_level",
        "cast(30 + event_id % 61 as double) as noise_level",
        "cast(event_id % 1001 as double) as light_level",
        "case when event_id % 10 < 2 then 1 else 0 end as motion_detected",
        "cast(100 - event_id % 97 as double) as battery_level",
        "cast(-90 + event_id % 51 as double) as signal_strength",
        "cast(10 + event_id % 86 as double) as memory_usage",
        "cast(event_id % 101 as double) as cpu_usage",
        "status",
        "case when status = 4 then 1 + event_id % 20 when status = 2 then event_id % 5 else 0 end as error_count",
        "event_id % 10000 + user_id as packets_sent",
        "event_id % 10000 as packets_received",
        "(event_id % 10000 + user_id) * (200 + event_id % 1000) as bytes_sent",
        "(event_id % 10000) * (200 + event_id % 1000) as bytes_received",
    )


def sensors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return to_sensors(events(spark, sf_dir))


def sensors_flagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return canonical.with_has_alert(sensors(spark, sf_dir))


def cpu(spark: SparkSession, sf_dir: str) -> DataFrame:
    return to_cpu(events(spark, sf_dir))


def to_cpu(rows: DataFrame) -> DataFrame:
    """events -> cpu."""
    names = ", ".join(f"'{name}'" for name in SERVICES)
    return rows.selectExpr(
        "event_id as seq",
        "concat('server_', lpad(cast(user_id % 50 + 1 as string), 4, '0')) as hostname",
        f"get(array({names}), cast(user_id % 7 as int)) as service",
        "ts as time",
        "5.0D + (cast(floor(value * 8) as bigint) % 601) / 8.0D as usage_user",
        "1.0D + event_id % 20 as usage_system",
        "(event_id % 65) / 8.0D as load1",
        "(event_id % 49) / 8.0D as load5",
        "(event_id % 33) / 8.0D as load15",
    )


def alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = alerting.sensor_names(sensors(spark, sf_dir))
    return alerting.alert_rows(rows, "time", active=F.col("status") == 1, keep=("seq",))


def metrics(spark: SparkSession, sf_dir: str, window: str = "1 hour") -> DataFrame:
    return rollup.sensor_metrics(sensors(spark, sf_dir), window)


def avro_readings(sensor_rows: DataFrame) -> DataFrame:
    """The eight fields of the binary message, and ``seq``."""
    return sensor_rows.select(
        "seq",
        F.substring_index("device_id", "_", -1).cast("int").alias("sensorId"),
        (F.col("seq") % 8 + 1).cast("int").alias("sensorType"),
        "temperature", "humidity", "pressure",
        F.col("battery_level").alias("batteryLevel"),
        F.col("status").cast("int").alias("status"),
        F.unix_millis(F.col("time").cast("timestamp")).alias("timestamp"),
    )


def local_messages(sensor_rows: DataFrame) -> DataFrame:
    """(seq, value): nested local JSON; readings of status 3 carry no metadata."""
    message = F.struct(
        F.col("device_id").alias("sensorId"), F.col("device_type").alias("sensorType"),
        F.col("site_id").alias("location"), "temperature", "humidity", "pressure",
        F.col("battery_level").alias("batteryLevel"),
        F.when(F.col("status") == 1, "active").otherwise("inactive").alias("status"),
        F.date_format("time", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'").alias("timestamp"),
        F.when(F.col("status") != 3, F.struct(
            F.lit("TestCorp").alias("manufacturer"), F.col("device_type").alias("model"),
            F.lit("v1.0").alias("firmwareVersion"), "latitude", "longitude",
        )).alias("metadata"),
    )
    return sensor_rows.select("seq", F.to_json(message).alias("value"))


def integer_messages(sensor_rows: DataFrame) -> DataFrame:
    """(seq, value): JSON messages of the integer model."""
    number = F.substring_index("device_id", "_", -1).cast("int")
    message = F.struct(
        number.alias("sensorId"), (F.col("seq") % 8 + 1).cast("int").alias("sensorType"),
        (number % 100 + 1).alias("location"), "temperature", "humidity", "pressure",
        F.col("battery_level").alias("batteryLevel"), "status",
        F.date_format("time", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'").alias("timestamp"),
    )
    return sensor_rows.select("seq", F.to_json(message).alias("value"))


def wide_messages(sensor_rows: DataFrame) -> DataFrame:
    """(seq, value): the wide row as JSON, as the snake_case producer sends it."""
    names = [c for c in sensor_rows.columns if c not in ("seq", "has_alert")]
    return sensor_rows.select("seq", F.to_json(F.struct(*names)).alias("value"))


# ---------------------------------------------------------------------------
# The same tables as SQL
# ---------------------------------------------------------------------------
# Fixed values, written out so that the SQL notices an error in the library's own list.
_TYPE_CASES = """
  when 1 then 'temperature_sensor' when 2 then 'humidity_sensor' when 3 then 'pressure_sensor' when 4 then 'motion_sensor'
  when 5 then 'light_sensor' when 6 then 'co2_sensor' when 7 then 'noise_sensor' when 8 then 'multisensor'"""
_SERVICE_CASES = " ".join(f"when {i} then '{name}'" for i, name in enumerate(SERVICES))

SENSORS_SQL = f"""
with e as (
  select event_id, user_id, ts, value, cast(json_extract_string(props, '$.k') as bigint) as k from events),
b as (
  select *, case when k < 85 then 1 when k < 90 then 2 when k < 95 then 3 else 4 end as status from e),
sensors as (
  select event_id as seq,
    concat('sensor_', cast(user_id as varchar)) as device_id,
    case cast(event_id % 8 + 1 as int) {_TYPE_CASES} end as device_type,
    concat('customer_', lpad(cast(user_id % 10 + 1 as varchar), 4, '0')) as customer_id,
    concat('site_', lpad(cast(user_id % 100 + 1 as varchar), 3, '0')) as site_id,
    25.0E0 + (event_id % 193) / 8.0E0 as latitude,
    -125.0E0 + (event_id % 465) / 8.0E0 as longitude,
    cast(event_id % 3001 as double) as altitude,
    ts as time,
    10.0E0 + (cast(floor(value * 8) as bigint) % 241) / 8.0E0 as temperature,
    20.0E0 + k * 0.75E0 as humidity,
    cast(980 + event_id % 51 as double) as pressure,
    cast(400 + event_id % 1601 as double) as co2_level,
    cast(30 + event_id % 61 as double) as noise_level,
    cast(event_id % 1001 as double) as light_level,
    case when event_id % 10 < 2 then 1 else 0 end as motion_detected,
    cast(100 - event_id % 97 as double) as battery_level,
    cast(-90 + event_id % 51 as double) as signal_strength,
    cast(10 + event_id % 86 as double) as memory_usage,
    cast(event_id % 101 as double) as cpu_usage,
    status,
    case when status = 4 then 1 + event_id % 20 when status = 2 then event_id % 5 else 0 end as error_count,
    event_id % 10000 + user_id as packets_sent,
    event_id % 10000 as packets_received,
    (event_id % 10000 + user_id) * (200 + event_id % 1000) as bytes_sent,
    (event_id % 10000) * (200 + event_id % 1000) as bytes_received,
    case when 10.0E0 + (cast(floor(value * 8) as bigint) % 241) / 8.0E0 > 35 or 20.0E0 + k * 0.75E0 > 80
      or 100 - event_id % 97 < 20 then 1 else 0 end as has_alert
  from b),
cpu as (
  select event_id as seq,
    concat('server_', lpad(cast(user_id % 50 + 1 as varchar), 4, '0')) as hostname,
    case cast(user_id % 7 as int) {_SERVICE_CASES} end as service,
    ts as time,
    5.0E0 + (cast(floor(value * 8) as bigint) % 601) / 8.0E0 as usage_user,
    1.0E0 + event_id % 20 as usage_system,
    (event_id % 65) / 8.0E0 as load1, (event_id % 49) / 8.0E0 as load5, (event_id % 33) / 8.0E0 as load15
  from e),
alerts as (
  select device_id as sensor_id, device_type as sensor_type, site_id as location,
    temperature, humidity, battery_level,
    case when temperature > 35 then 'HIGH_TEMPERATURE' when humidity > 80 then 'HIGH_HUMIDITY'
      else 'LOW_BATTERY' end as alert_type,
    time as alert_time, seq
  from sensors where status = 1 and (temperature > 35 or humidity > 80 or battery_level < 20))
"""


def metrics_sql(unit: str = "hour", name: str = "metrics") -> str:
    """The metrics table over windows of one ``unit``, as a further named query."""
    return f""", {name} as (
  select device_id as sensor_id, device_type as sensor_type, site_id as location,
    date_trunc('{unit}', time) as window_start, date_trunc('{unit}', time) + interval 1 {unit} as window_end,
    avg(temperature) as avg_temperature, avg(humidity) as avg_humidity, avg(pressure) as avg_pressure,
    max(temperature) as max_temperature, min(battery_level) as min_battery, max(battery_level) as max_battery,
    count(*) as reading_count, min(seq) as seq
  from sensors group by 1, 2, 3, 4, 5)
"""
