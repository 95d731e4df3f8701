"""Filters and alerts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegauge.functions import labels, rules
from tidegauge.functions.sampling import in_sample
from tidegauge.functions.timeparts import in_hours, last, on_day
from tidegauge.operators import alerting, rollup
from tidegauge.plans import views
from tidegauge.plans.registry import over_sensors, query
from tidegauge.plans.rollup_queries import rollup_sql

AS_OF = views.AS_OF


@query("c1_active_integer", over_sensors("select seq, device_id, status from sensors where status = 1"))
def active_integer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alerting.active_only(views.sensors(spark, sf_dir)).select("seq", "device_id", "status")


@query("c2_active_text", over_sensors("select seq, device_id, 'active' as status from sensors where status = 1"))
def active_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    word = F.when(F.col("status") == 1, "active").otherwise("inactive")
    rows = views.sensors(spark, sf_dir).withColumn("status", word)
    return alerting.active_only(rows, value="active").select("seq", "device_id", "status")


@query("c3_status_helpers", over_sensors("""
  select status, count(*) as n from sensors where status in (2, 3, 4) group by status"""))
def status_helpers(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = views.sensors(spark, sf_dir)
    parts = [alerting.with_status(rows, c) for c in (labels.OFFLINE, labels.MAINTENANCE, labels.ERROR)]
    every = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return every.groupBy("status").agg(F.count("*").alias("n"))


@query("c4_drop_normal", over_sensors("select seq, device_id from sensors where has_alert = 1"))
def drop_normal(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = alerting.with_alert_type(views.sensors(spark, sf_dir))
    return alerting.drop_normal(rows).select("seq", "device_id")


@query("c5_last_day", over_sensors(f"""
  select seq, device_id, time from sensors where time >= timestamp '{AS_OF}' - interval 1 day"""))
def last_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    return last(views.sensors(spark, sf_dir), AS_OF, days=1).select("seq", "device_id", "time")


@query("c6_on_day", over_sensors("""
  select seq, device_id, time from sensors where cast(time as date) = date '2024-01-15'"""))
def one_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    return on_day(views.sensors(spark, sf_dir), "2024-01-15").select("seq", "device_id", "time")


@query("c7_hours_of_day", over_sensors("""
  select seq, device_id, time from sensors where extract(hour from time) in (2, 9, 14, 20)"""))
def hours_of_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.sensors(spark, sf_dir).filter(in_hours((2, 9, 14, 20))).select("seq", "device_id", "time")


@query("c8_like_prefix", over_sensors("""
  select seq, device_id from sensors where device_id like 'sensor_1%'"""))
def like_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.sensors(spark, sf_dir).filter(F.col("device_id").like("sensor_1%")).select("seq", "device_id")


@query("c9_having", over_sensors("""
  select device_id, avg(battery_level) as avg_battery, cast(sum(packets_sent) as bigint) as total_packets_sent
  from sensors group by device_id having avg(battery_level) < 50 and sum(packets_sent) > 1000"""))
def having(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.sensors(spark, sf_dir).groupBy("device_id").agg(
        F.avg("battery_level").alias("avg_battery"), F.sum("packets_sent").alias("total_packets_sent"),
    ).filter("avg_battery < 50 and total_packets_sent > 1000")


@query("c10_sample_rows")
def sample_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.sensors(spark, sf_dir).sample(0.1, seed=42).select("seq", "device_id")


@query("c10_sample_by_key", over_sensors("""
  select seq, device_id from sensors where substr(md5(device_id), 1, 8) < '19999999'"""))
def sample_by_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.sensors(spark, sf_dir).filter(in_sample(F.col("device_id"), 0.1)).select("seq", "device_id")


CLASSIFY = """case when temperature > 35 then '{hot}' when humidity > 80 then 'HIGH_HUMIDITY'
  when battery_level < 20 then 'LOW_BATTERY' else 'NORMAL' end"""


@query("d1_classify_alert", over_sensors(f"""
  select seq, device_id, {CLASSIFY.format(hot='HIGH_TEMPERATURE')} as alert_type from sensors"""))
def classify_alert(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alerting.with_alert_type(views.sensors(spark, sf_dir)).select("seq", "device_id", "alert_type")


@query("d2_rollup_alert_labels", rollup_sql("day", select=f"""
  device_id, window_start, temperature, {CLASSIFY.format(hot='HIGH_TEMP')} as alert_type"""))
def rollup_alert_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = alerting.label_rollups(rollup.rollup_sensors(views.sensors(spark, sf_dir), "1 day"))
    return rows.select("device_id", "window_start", "temperature", "alert_type")


@query("d3_alert_labels", over_sensors("""
  select seq, concat_ws(',', case when temperature > 35 then 'HIGH_TEMPERATURE' end,
    case when humidity > 80 then 'HIGH_HUMIDITY' end,
    case when status = 3 or battery_level < 20 then 'LOW_BATTERY' end) as labels from sensors"""))
def alert_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sensors in maintenance send no battery level, which counts as 0."""
    rows = views.sensors(spark, sf_dir).withColumn(
        "battery_level", F.when(F.col("status") != 3, F.col("battery_level")))
    return rows.select("seq", F.array_join(rules.alert_labels(), ",").alias("labels"))


@query("d4_alert_rows", over_sensors("select * from alerts"))
def alert_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.alerts(spark, sf_dir)


@query("d7_alert_counts", over_sensors("""
  select alert_type, count(*) as alert_count from alerts group by alert_type"""))
def alert_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alerting.alert_counts(views.alerts(spark, sf_dir))
