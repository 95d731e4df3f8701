"""Message and table schemas, and ``conform`` which shapes any frame to one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _schema(**columns: str) -> T.StructType:
    schema = T.StructType()
    for name, kind in columns.items():
        schema.add(name, kind)
    return schema


# ---------------------------------------------------------------------------
# Field names, order and types of the messages in flight.
# ---------------------------------------------------------------------------
AVRO_READING = _schema(
    sensorId="integer",
    sensorType="integer",
    temperature="double",
    humidity="double",
    pressure="double",
    batteryLevel="double",
    status="integer",
    timestamp="long",
)

AVRO_MINIMAL = _schema(
    sensorId="string",
    value="double",
    timestamp="long",
    type="string",
)

JSON_INTEGER = _schema(
    sensorId="integer",
    sensorType="integer",
    location="integer",
    temperature="double",
    humidity="double",
    pressure="double",
    batteryLevel="double",
    status="integer",
    timestamp="timestamp",
)

JSON_LOCAL = _schema(
    sensorId="string",
    sensorType="string",
    location="string",
    temperature="double",
    humidity="double",
    pressure="double",
    batteryLevel="double",
    status="string",
    timestamp="timestamp",
)
JSON_LOCAL.add(
    "metadata",
    _schema(
        manufacturer="string",
        model="string",
        firmwareVersion="string",
        latitude="double",
        longitude="double",
    ),
)

# ---------------------------------------------------------------------------
# Columns of the tables at rest.  Unsigned types become the next
# wider signed type.
# ---------------------------------------------------------------------------
SENSORS = _schema(
    device_id="string",
    device_type="string",
    customer_id="string",
    site_id="string",
    latitude="double",
    longitude="double",
    altitude="float",
    time="timestamp",
    temperature="float",
    humidity="float",
    pressure="float",
    battery_level="float",
    status="short",
    co2_level="float",
    noise_level="float",
    light_level="float",
    motion_detected="short",
    signal_strength="float",
    memory_usage="float",
    cpu_usage="float",
    error_count="long",
    packets_sent="long",
    packets_received="long",
    bytes_sent="long",
    bytes_received="long",
)

SENSOR_DEFAULTS = {
    "latitude": 0.0,
    "longitude": 0.0,
    "altitude": 0.0,
    "co2_level": 400.0,
    "noise_level": 50.0,
    "light_level": 500.0,
    "motion_detected": 0,
    "signal_strength": -50.0,
    "memory_usage": 50.0,
    "cpu_usage": 30.0,
    "error_count": 0,
    "packets_sent": 0,
    "packets_received": 0,
    "bytes_sent": 0,
    "bytes_received": 0,
}

# Days a table keeps its rows.
RETENTION_DAYS = {
    "sensor_raw_data": 7,
    "sensor_alerts": 30,
    "sensors": 30,
    "sensor_metrics": 90,
    "cpu": 90,
}


def to_millis(column: Column, kind: T.DataType) -> Column:
    """Cut a timestamp to milliseconds, keeping zoned or zone-free as it was."""
    return F.date_trunc("millisecond", column).cast(kind)


def fill_defaults(df: DataFrame, defaults: dict = SENSOR_DEFAULTS) -> DataFrame:
    """Add the columns an insert left out and replace nulls by the defaults."""
    present = set(df.columns)
    return df.withColumns({
        name: F.coalesce(F.col(name), F.lit(value)) if name in present else F.lit(value)
        for name, value in defaults.items()
    })


def conform(
    df: DataFrame,
    schema: T.StructType = SENSORS,
    defaults: dict | None = None,
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """Project ``df`` onto ``schema`` by column name, narrowing the types.

    Columns are never matched by position.  Missing columns take their default,
    or null.  Timestamps are cut to milliseconds; a zone-free timestamp stays
    zone-free.  ``keep`` names extra columns to pass through unchanged.
    """
    if defaults is None:
        defaults = SENSOR_DEFAULTS if schema is SENSORS else {}
    kinds = {field.name: field.dataType for field in df.schema.fields}

    def shaped(field: T.StructField) -> Column:
        if field.name not in kinds:
            return F.lit(defaults.get(field.name)).cast(field.dataType).alias(field.name)
        column = F.col(field.name)
        if isinstance(field.dataType, T.TimestampType):
            kind = kinds[field.name]
            kind = kind if isinstance(kind, T.TimestampNTZType) else field.dataType
            return to_millis(column, kind).alias(field.name)
        if field.name in defaults:
            column = F.coalesce(column, F.lit(defaults[field.name]))
        return column.cast(field.dataType).alias(field.name)

    return df.select(*[shaped(f) for f in schema.fields], *keep)
