"""The named queries.  Each module of queries registers its own."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidegauge.plans import views

Runner = Callable[[SparkSession, str], DataFrame]


class Query(NamedTuple):
    run: Runner
    sql: str | None


QUERIES: dict[str, Query] = {}


def query(name: str, sql: str | None = None):
    """Register a function (spark, sf_dir) -> DataFrame, with the SQL it must equal."""
    def register(run: Runner) -> Runner:
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")

        @wraps(run)
        def in_utc(spark: SparkSession, sf_dir: str) -> DataFrame:
            # The tables hold UTC wall clock, and so does the SQL.
            spark.conf.set("spark.sql.session.timeZone", "UTC")
            return run(spark, sf_dir)

        QUERIES[name] = Query(in_utc, sql)
        return run

    return register


def over_sensors(select: str) -> str:
    """SQL over the sensors, cpu and alerts tables."""
    return views.SENSORS_SQL + select


def over_metrics(select: str, unit: str = "hour") -> str:
    """SQL over these and the metrics table with windows of one ``unit``."""
    return views.SENSORS_SQL + views.metrics_sql(unit) + select


def plain_times(df: DataFrame) -> DataFrame:
    """Zoned timestamps (of streams) as the zone-free ones of the batch tables."""
    zoned = [f.name for f in df.schema.fields if isinstance(f.dataType, T.TimestampType)]
    return df.withColumns({name: F.col(name).cast("timestamp_ntz") for name in zoned})
