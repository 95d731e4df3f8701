"""Messages of every dialect to the one wide sensor row."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidegauge.functions import labels
from tidegauge.functions.rules import has_alert
from tidegauge.sources.json_messages import CORRUPT, fits, parse_json, parse_once

# What a reading is taken to be where the message lacks it.
READING_DEFAULTS = {
    "temperature": 0.0,
    "humidity": 0.0,
    "pressure": 1013.25,
    "co2_level": 400.0,
    "noise_level": 50.0,
    "light_level": 500.0,
    "motion_detected": 0,
    "battery_level": 100.0,
    "signal_strength": -50.0,
    "memory_usage": 50.0,
    "cpu_usage": 30.0,
}
COUNTER_DEFAULTS = {
    "error_count": 0,
    "packets_sent": 0,
    "packets_received": 0,
    "bytes_sent": 0,
    "bytes_received": 0,
}
DEFAULT_CUSTOMER = "customer_0001"
DEFAULT_SITE = "site_001"
UNKNOWN_DEVICE = "device_unknown"
UNKNOWN_TYPE = "unknown"

# Column order of the canonical row (the sensors table without time).
CANONICAL_COLUMNS = (
    "device_id", "device_type", "customer_id", "site_id", "latitude", "longitude", "altitude",
    "temperature", "humidity", "pressure", "co2_level", "noise_level", "light_level",
    "motion_detected", "battery_level", "signal_strength", "memory_usage", "cpu_usage",
    "status", "error_count", "packets_sent", "packets_received", "bytes_sent", "bytes_received",
)

_WHOLE = {"motion_detected": "int", **dict.fromkeys(COUNTER_DEFAULTS, "long")}
_WHOLE_IN_JSON = {name: {"int": "integer"}.get(kind, kind) for name, kind in _WHOLE.items()}

# Other names a field may have in a message, in order of preference.
_FALLBACK_NAMES = {
    "device_id": ("sensorId", "device_id", "deviceId"),
    "device_type": ("sensorType", "device_type", "deviceType"),
    "customer_id": ("customer_id", "customerId"),
    "site_id": ("site_id", "location", "siteId"),
    "co2_level": ("co2_level", "co2Level"),
    "noise_level": ("noise_level", "noiseLevel"),
    "light_level": ("light_level", "lightLevel"),
    "motion_detected": ("motion_detected", "motionDetected"),
    "battery_level": ("batteryLevel", "battery_level"),
    "signal_strength": ("signal_strength", "signalStrength"),
    "memory_usage": ("memory_usage", "memoryUsage"),
    "cpu_usage": ("cpu_usage", "cpuUsage"),
    "error_count": ("error_count", "errorCount"),
    "packets_sent": ("packets_sent", "packetsSent"),
    "packets_received": ("packets_received", "packetsReceived"),
    "bytes_sent": ("bytes_sent", "bytesSent"),
    "bytes_received": ("bytes_received", "bytesReceived"),
}


def canonicalize_avro(df: DataFrame, keep: tuple[str, ...] = (), with_time: bool = False) -> DataFrame:
    """Decoded integer messages to the 24-column row; ``with_time`` adds the event time."""
    constants = {**READING_DEFAULTS, **COUNTER_DEFAULTS}
    given = {
        "device_id": labels.device_label(F.col("sensorId")),
        "device_type": labels.sensor_type_label(F.col("sensorType")),
        "customer_id": F.lit(DEFAULT_CUSTOMER),
        "site_id": labels.site_label(F.col("sensorId")),
        "latitude": F.lit(0.0),
        "longitude": F.lit(0.0),
        "altitude": F.lit(0.0),
        "temperature": F.coalesce("temperature", F.lit(constants["temperature"])),
        "humidity": F.coalesce("humidity", F.lit(constants["humidity"])),
        "pressure": F.coalesce("pressure", F.lit(constants["pressure"])),
        "battery_level": F.coalesce("batteryLevel", F.lit(constants["battery_level"])),
        "status": F.coalesce("status", F.lit(labels.ONLINE)),
    }

    def column(name: str) -> Column:
        value = given[name] if name in given else F.lit(constants[name])
        return (value.cast(_WHOLE[name]) if name in _WHOLE else value).alias(name)

    extra = [F.timestamp_millis("timestamp").alias("time")] if with_time else []
    return df.select(*keep, *[column(name) for name in CANONICAL_COLUMNS], *extra)


_TEXT_FIELDS = ("device_id", "device_type", "customer_id", "site_id", "status")


def _message_schema(typed: bool, columns: Sequence[str]) -> T.StructType:
    """The known fields of ``columns``; ``typed`` readings are numbers, otherwise all is text."""
    schema = T.StructType()
    for column in (c for c in CANONICAL_COLUMNS if c in columns):
        kind = "string" if column in _TEXT_FIELDS or not typed else _WHOLE_IN_JSON.get(column, "double")
        for name in _FALLBACK_NAMES.get(column, (column,)):
            schema.add(name, kind)
    for name in ("time", "timestamp") if "time" in columns else ():
        schema.add(name, "string")
    place = T.StructType()
    for name in (c for c in ("latitude", "longitude") if c in columns):
        place.add(name, "double" if typed else "string")
    return schema.add("metadata", place) if place.fields else schema


def canonicalize_json(
    df: DataFrame, column: str = "value", keep: tuple[str, ...] = (), with_time: bool = False,
    columns: Sequence[str] | None = None,
) -> DataFrame:
    """Text messages of any dialect to the 24-column row.

    ``columns`` names those wanted (``time`` included), in their order; only the
    fields they come from are parsed, and a message is dropped for these only.  By
    default all are.

    A field is taken from the first of its known names that is present; an
    explicit null counts as absent.  A field that is present but not a number
    reads as 0, an absent one as its default.  Text that is not JSON is dropped.

    Messages whose numbers are numbers are parsed into numbers directly.  Only a
    message that does not fit is parsed again as text, field by field.
    """
    names = list(columns) if columns is not None else [*CANONICAL_COLUMNS, *(["time"] if with_time else [])]
    if unknown := set(names) - {*CANONICAL_COLUMNS, "time"}:
        raise ValueError(f"no such columns: {sorted(unknown)}")
    typed, as_text = _message_schema(True, names), _message_schema(False, names)
    messages = df.select(*keep, F.col(column).cast("string").alias("_text"))
    messages = messages.select(*keep, "_text", parse_once(F.col("_text"), typed).alias("m"))
    again = F.get(F.transform(F.array(parse_json(F.col("_text"), as_text)), lambda t: _lenient(t, typed)), F.lit(0))
    messages = messages.select(*keep, "_text", F.when(F.col(f"m.{CORRUPT}").isNull(), F.col("m")).otherwise(again).alias("m"))
    messages = messages.filter(fits(F.col("m")))

    def first(name: str, default) -> Column:
        known = [F.col(f"m.{n}") for n in _FALLBACK_NAMES.get(name, (name,))]
        return F.coalesce(*known, F.lit(default).cast(_WHOLE.get(name, "double")) if name not in _TEXT_FIELDS else F.lit(default))

    def coordinate(name: str) -> Column:
        inside = F.when(F.col("m.metadata").isNotNull(), F.col(f"m.metadata.{name}")).otherwise(F.col(f"m.{name}"))
        return F.coalesce(inside, F.lit(0.0))

    defaults = {
        "device_id": UNKNOWN_DEVICE, "device_type": UNKNOWN_TYPE, "customer_id": DEFAULT_CUSTOMER, "site_id": DEFAULT_SITE,
        "altitude": 0.0, **READING_DEFAULTS, **COUNTER_DEFAULTS,
    }

    def value(name: str) -> Column:
        if name in ("latitude", "longitude"):
            return coordinate(name)
        if name == "status":
            return labels.status_code(F.col("m.status"))
        if name == "time":
            return message_time(F.coalesce(F.col("m.time"), F.col("m.timestamp")))
        return first(name, defaults[name])

    return messages.select(*keep, *[value(n).alias(n) for n in names])


def _lenient(text: Column, typed: T.StructType) -> Column:
    """A message of text fields as the typed message: what is no number reads as 0."""
    def field(value: Column, kind: T.DataType) -> Column:
        if isinstance(kind, T.StructType):
            inner = F.struct(*[field(value.getField(f.name), f.dataType).alias(f.name) for f in kind.fields])
            return F.when(value.isNotNull(), inner)
        if isinstance(kind, T.StringType):
            return value
        number = F.coalesce(value.try_cast("double"), F.lit(0.0))
        if not isinstance(kind, T.DoubleType):
            # Whole numbers directly: a large counter would lose digits as a double.
            number = F.coalesce(value.try_cast(kind), number.try_cast(kind), F.lit(0).cast(kind))
        return F.when(value.isNotNull(), number)

    fields = [*typed.fields, T.StructField(CORRUPT, T.StringType())]
    return F.struct(*[field(text.getField(f.name), f.dataType).alias(f.name) for f in fields])


def message_time(text: Column) -> Column:
    """Event time of a text message: epoch milliseconds or an ISO timestamp."""
    millis = F.when(text.rlike(r"^-?\d+$"), F.timestamp_millis(text.try_cast("long")))
    return F.coalesce(millis, text.try_cast("timestamp"))


def flatten_local_json(df: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Nested local messages to flat columns; no metadata reads as '' and 0.0."""
    return df.select(
        *keep,
        F.col("sensorId").alias("sensor_id"),
        F.col("sensorType").alias("sensor_type"),
        "location", "temperature", "humidity", "pressure",
        F.col("batteryLevel").alias("battery_level"),
        "status",
        F.coalesce("metadata.manufacturer", F.lit("")).alias("manufacturer"),
        F.coalesce("metadata.model", F.lit("")).alias("model"),
        F.coalesce("metadata.firmwareVersion", F.lit("")).alias("firmware_version"),
        F.coalesce("metadata.latitude", F.lit(0.0)).alias("latitude"),
        F.coalesce("metadata.longitude", F.lit(0.0)).alias("longitude"),
    )


def with_has_alert(df: DataFrame) -> DataFrame:
    return df.withColumn("has_alert", has_alert())


def with_total_usage(df: DataFrame) -> DataFrame:
    return df.withColumn("total_usage", labels.total_usage(F.col("usage_user"), F.col("usage_system")))


def round_values(
    df: DataFrame,
    readings: tuple[str, ...] = ("temperature", "humidity", "pressure", "battery_level"),
    places: tuple[str, ...] = ("latitude", "longitude"),
) -> DataFrame:
    """Readings to two decimals and coordinates to six, as the text sink writes them."""
    digits = {**dict.fromkeys(readings, 2), **dict.fromkeys(places, 6)}
    return df.withColumns({c: F.round(c, n) for c, n in digits.items() if c in df.columns})
