"""Codes to labels, and the computed columns of the tables."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Sensor type codes 1 to 8, in order.
SENSOR_TYPES = (
    "temperature_sensor",
    "humidity_sensor",
    "pressure_sensor",
    "motion_sensor",
    "light_sensor",
    "co2_sensor",
    "noise_sensor",
    "multisensor",
)

# Status codes.
ONLINE, OFFLINE, MAINTENANCE, ERROR = 1, 2, 3, 4
STATUS_CODES = {"online": ONLINE, "offline": OFFLINE, "maintenance": MAINTENANCE}


def sensor_type_label(code: Column) -> Column:
    """Name of a sensor type; unknown codes keep their number, null counts as 1."""
    code = F.coalesce(code, F.lit(1))
    names = F.array(*[F.lit(name) for name in SENSOR_TYPES])
    return F.coalesce(F.get(names, code - 1), F.concat(F.lit("sensor_type_"), code.cast("string")))


def device_label(sensor_id: Column) -> Column:
    return F.coalesce(F.concat(F.lit("sensor_"), sensor_id.cast("string")), F.lit("device_unknown"))


def site_label(sensor_id: Column) -> Column:
    """Site number 1 to 100 from the sensor id, three digits; null counts as id 1."""
    number = F.coalesce(sensor_id, F.lit(1)) % 100 + 1
    padded = F.concat(F.lit("site_"), F.lpad(number.cast("string"), 3, "0"))
    # lpad would pad in front of a minus sign; only such ids pay for a formatter.
    return F.when(number >= 0, padded).otherwise(F.format_string("site_%03d", number))


def status_code(text: Column) -> Column:
    """Status number of a message field that holds a number or a word."""
    named = F.lit(ERROR)
    for word, code in STATUS_CODES.items():
        named = F.when(F.lower(text) == word, code).otherwise(named)
    return (
        F.when(text.isNull(), ONLINE)
        .when(text.rlike(r"^-?\d+$"), F.coalesce(text.try_cast("int"), F.lit(ERROR)))
        .otherwise(named)
    )


def total_usage(user: Column, system: Column) -> Column:
    return user + system
