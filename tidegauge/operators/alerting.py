"""Alert rows and alert reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegauge.functions import rules as R
from tidegauge.functions.labels import ONLINE

ALERT_COLUMNS = (
    "sensor_id", "sensor_type", "location", "temperature", "humidity",
    "battery_level", "alert_type", "alert_time",
)


def active_only(df: DataFrame, column: str = "status", value: int | str = ONLINE) -> DataFrame:
    """Online rows: status 1 in the integer model, 'active' in the text model."""
    return df.filter(F.col(column) == value)


def with_status(df: DataFrame, code: int, column: str = "status") -> DataFrame:
    return df.filter(F.col(column) == code)


def with_alert_type(df: DataFrame, rules: Sequence[R.Rule] = R.ALERT_RULES) -> DataFrame:
    return df.withColumn("alert_type", R.classify_alert(rules))


def drop_normal(df: DataFrame) -> DataFrame:
    return df.filter(F.col("alert_type") != R.NORMAL)


def label_rollups(rollups: DataFrame) -> DataFrame:
    """The same rules on averaged rows, with the shorter temperature label."""
    return rollups.withColumn("alert_type", R.classify_alert(labels=R.ROLLUP_LABELS))


def alert_rows(
    df: DataFrame,
    time: str,
    active: Column | None = None,
    rules: Sequence[R.Rule] = R.ALERT_RULES,
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """Readings that break a rule, as rows of the alerts table.

    ``alert_time`` is the event time.  ``active`` restricts the rows first;
    the raw fan-out jobs leave it out.
    """
    if active is not None:
        df = df.filter(active)
    alerts = drop_normal(with_alert_type(df, rules))
    return alerts.select(*ALERT_COLUMNS[:-1], F.col(time).alias("alert_time"), *keep)


def sensor_names(df: DataFrame) -> DataFrame:
    """Sensor-table columns under the names the raw and alert tables use."""
    return df.withColumnsRenamed({
        "device_id": "sensor_id", "device_type": "sensor_type", "site_id": "location",
        "sensorId": "sensor_id", "sensorType": "sensor_type", "batteryLevel": "battery_level",
    })


def alert_counts(alerts: DataFrame) -> DataFrame:
    return alerts.groupBy("alert_type").agg(F.count("*").alias("alert_count"))
