"""Binary Avro messages to columns.

With the spark-avro module on the class path its JVM decoder is used.  Without
it the two fixed message layouts are decoded from the Arrow buffers of whole
batches with numpy, a field at a time, inside the tasks.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidegauge import schemas

CORRUPT = "_corrupt"

_AVRO_TYPES = {"integer": "int", "long": "long", "double": "double", "string": "string"}


def avro_schema(layout: T.StructType, name: str = "Reading") -> str:
    """The Avro record of a flat layout; no field is a union."""
    fields = [{"name": f.name, "type": _AVRO_TYPES[f.dataType.typeName()]} for f in layout.fields]
    return json.dumps({"type": "record", "name": name, "fields": fields})


def avro_module_loaded(spark: SparkSession) -> bool:
    from pyspark.sql.avro.functions import from_avro

    try:
        probe = spark.range(0).select(from_avro(F.lit(b""), '"int"').alias("x"))
        return bool(probe.schema)
    except AnalysisException:
        return False


def decode_avro(
    df: DataFrame,
    layout: T.StructType = schemas.AVRO_READING,
    column: str = "value",
    on_error: str = "fail",
    keep: tuple[str, ...] = (),
    use_module: bool | None = None,
) -> DataFrame:
    """Decode binary ``column`` into the fields of ``layout``.

    ``on_error``: ``fail`` stops the job at a bad message, ``skip`` drops it,
    ``quarantine`` keeps its bytes in ``_corrupt`` beside null fields.
    """
    if on_error not in ("skip", "quarantine", "fail"):
        raise ValueError(f"on_error: {on_error}")
    if use_module is None:
        use_module = avro_module_loaded(df.sparkSession)
    names = layout.fieldNames()
    if use_module:
        from pyspark.sql.avro.functions import from_avro

        mode = "FAILFAST" if on_error == "fail" else "PERMISSIVE"
        sent = F.col(column)
        if on_error == "fail":  # the module gives null for a null message
            sent = F.when(sent.isNull(), F.raise_error(F.lit("a null message")).cast("binary")).otherwise(sent)
        message = from_avro(sent, avro_schema(layout), {"mode": mode})
        decoded = df.select(*keep, F.col(column).alias(CORRUPT), message.alias("m"))
        bad = F.col("m").isNull() | F.col(f"m.{names[0]}").isNull()
        decoded = decoded.select(
            *keep, *[F.col(f"m.{n}").alias(n) for n in names],
            F.when(bad, F.coalesce(F.col(CORRUPT), F.lit(b""))).alias(CORRUPT),
        )
    else:
        source = df.select(*keep, F.col(column).alias(CORRUPT))
        kept = [source.schema[name] for name in keep]
        out = T.StructType([*kept, *layout.fields, T.StructField(CORRUPT, T.BinaryType())])
        kinds = [f.dataType.typeName() for f in layout.fields]
        decoded = source.mapInArrow(_decoder(names, kinds, list(keep), on_error == "fail"), out)
    if on_error == "quarantine":
        return decoded
    return decoded.filter(F.col(CORRUPT).isNull()).drop(CORRUPT)


def _decoder(names: list[str], kinds: list[str], keep: list[str], strict: bool):
    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            messages = batch.column(len(keep)).cast(pa.large_binary())
            fields, good = _read_fields(messages, kinds)
            if strict and not good.all():
                raise ValueError(f"{int((~good).sum())} undecodable messages in a batch of {len(good)}")
            bad = pa.array(~good)
            corrupt = pa.compute.if_else(bad, pa.compute.fill_null(messages, b""), None)
            arrays = [*batch.columns[: len(keep)], *fields, corrupt.cast(pa.binary())]
            yield pa.RecordBatch.from_arrays(arrays, [*keep, *names, CORRUPT])

    return decode


def _read_fields(messages: pa.LargeBinaryArray, kinds: list[str]) -> tuple[list[pa.Array], np.ndarray]:
    """Read one field after the other for all messages of a batch at once."""
    rows = len(messages)
    offsets = np.frombuffer(messages.buffers()[1], np.int64)[messages.offset: messages.offset + rows + 1]
    body = messages.buffers()[2]
    data = np.frombuffer(body, np.uint8) if body is not None else np.empty(0, np.uint8)
    # Eight spare bytes let a short message be read over its end; it is marked
    # bad by the position check.
    data = np.concatenate([data, np.zeros(8, np.uint8)])
    position, end = offsets[:-1].copy(), offsets[1:]
    good = np.ones(rows, bool)
    if messages.null_count:
        good &= ~messages.is_null().to_numpy(zero_copy_only=False)

    def varint(limit: int) -> np.ndarray:
        nonlocal position, good
        value = np.zeros(rows, np.uint64)
        open_ = good.copy()
        for step in range(limit):
            open_ &= position < end
            byte = data[np.where(open_, position, 0)].astype(np.uint64)
            value |= np.where(open_, (byte & np.uint64(0x7F)) << np.uint64(7 * step), np.uint64(0))
            position = position + open_
            closed = open_ & (byte < 0x80)
            open_ &= ~closed
            if step == 0:
                done = closed
            else:
                done |= closed
            if not open_.any():
                break
        good &= done
        return (value >> np.uint64(1)).astype(np.int64) ^ -(value & np.uint64(1)).astype(np.int64)

    fields: list[pa.Array] = []
    for kind in kinds:
        if kind == "double":
            good &= position + 8 <= end
            at = np.where(good, position, 0)
            raw = data[at[:, None] + np.arange(8)]
            values = np.ascontiguousarray(raw).view("<f8").reshape(rows)
            position = position + 8
            fields.append((values, pa.float64()))
        elif kind == "string":
            length = varint(10)
            good &= (length >= 0) & (length <= end - position)
            size = np.where(good, length, 0)
            fields.append(((position.copy(), size), pa.string()))
            position = position + size
        else:
            value = varint(5 if kind == "integer" else 10)
            if kind == "integer":
                good &= (value >= -(2**31)) & (value < 2**31)
                value = np.where(good, value, 0).astype(np.int32)
            fields.append((value, pa.int32() if kind == "integer" else pa.int64()))
    good &= position == end
    return [_to_arrow(values, kind, good, data) for values, kind in fields], good


def _to_arrow(values, kind: pa.DataType, good: np.ndarray, data: np.ndarray) -> pa.Array:
    if kind != pa.string():
        return pa.array(values, type=kind, mask=~good)
    start, size = values
    size = np.where(good, size, 0)
    bounds = np.concatenate([[0], np.cumsum(size)]).astype(np.int32)
    # Gather the bytes of all strings: for each output byte its source position.
    source = np.repeat(start - bounds[:-1], size) + np.arange(bounds[-1])
    text = pa.StringArray.from_buffers(
        len(good), pa.py_buffer(bounds.tobytes()), pa.py_buffer(data[source].tobytes())
    )
    return pa.compute.if_else(pa.array(good), text, pa.scalar(None, pa.string()))
