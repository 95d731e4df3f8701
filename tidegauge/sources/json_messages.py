"""JSON messages to columns, with the message kept where it cannot be read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidegauge import schemas

CORRUPT = "_corrupt"


def decode_json(
    df: DataFrame,
    schema: T.StructType = schemas.JSON_LOCAL,
    column: str = "value",
    on_error: str = "skip",
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """Parse ``column`` (text or bytes) into the fields of ``schema``.

    ``on_error``: ``skip`` drops a message that is not JSON or has a field of
    the wrong type; ``quarantine`` keeps it with its text in ``_corrupt``;
    ``fail`` stops the job.
    """
    if on_error not in ("skip", "quarantine", "fail"):
        raise ValueError(f"on_error: {on_error}")
    text = F.col(column).cast("string")
    names = schema.fieldNames()
    if on_error == "fail":
        parsed = df.select(*keep, parse_once(text, schema, "FAILFAST").alias("m"))
        return parsed.select(*keep, *[F.col(f"m.{n}").alias(n) for n in names])
    texts = df.select(*keep, text.alias("_text"))
    parsed = texts.select(*keep, "_text", parse_once(F.col("_text"), schema).alias("m"))
    fields = [F.col(f"m.{n}").alias(n) for n in names]
    if on_error == "skip":
        return parsed.filter(fits(F.col("m"))).select(*keep, *fields)
    # A null or empty message has no parse at all.
    corrupt = F.when(F.col("m").isNull(), F.coalesce("_text", F.lit(""))).otherwise(F.col(f"m.{CORRUPT}"))
    return parsed.select(*keep, *fields, corrupt.alias(CORRUPT))


def fits(parsed: Column) -> Column:
    """True for a message that was read whole; null and empty ones are not."""
    return parsed.isNotNull() & parsed.getField(CORRUPT).isNull()


def parse_json(text: Column, schema: T.StructType, mode: str = "PERMISSIVE") -> Column:
    """A struct of the fields and, unless ``mode`` is FAILFAST, the text of a
    message that does not fit in ``_corrupt``."""
    if mode == "FAILFAST":
        return F.from_json(text, schema, {"mode": mode})
    with_flag = T.StructType([*schema.fields, T.StructField(CORRUPT, T.StringType())])
    return F.from_json(text, with_flag, {"mode": mode, "columnNameOfCorruptRecord": CORRUPT})


def parse_once(text: Column, schema: T.StructType, mode: str = "PERMISSIVE") -> Column:
    """``parse_json`` as the output of a generator: a filter on it is not
    rewritten into a second parse of the text."""
    return F.explode_outer(F.array(parse_json(text, schema, mode)))
