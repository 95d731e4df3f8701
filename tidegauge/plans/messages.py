"""Binary messages made from rows, so that the decoder has whole tables to read."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T


def encode_readings(df: DataFrame, layout: T.StructType, keep: tuple[str, ...] = ("seq",)) -> DataFrame:
    """(keep..., value): the fields of ``layout`` as one binary Avro message a row."""
    fields = [(f.name, f.dataType.typeName()) for f in layout.fields]
    source = df.select(*keep, *[name for name, _ in fields])
    out = T.StructType([source.schema[k] for k in keep]).add("value", "binary")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [_encode(batch.column(len(keep) + i), kind) for i, (_, kind) in enumerate(fields)]
            messages = [b"".join(parts) for parts in zip(*columns)]
            values = pa.array(messages, pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], values], [*keep, "value"])

    return source.mapInArrow(encode, out)


def _encode(column: pa.Array, kind: str) -> list[bytes]:
    if kind == "double":
        raw = column.to_numpy(zero_copy_only=False).astype("<f8").tobytes()
        return [raw[i: i + 8] for i in range(0, len(raw), 8)]
    if kind == "string":
        texts = [text.encode() for text in column.to_pylist()]
        sizes = _varints(np.array([len(t) for t in texts], np.int64))
        return [size + text for size, text in zip(sizes, texts)]
    return _varints(column.to_numpy(zero_copy_only=False).astype(np.int64))


def _varints(values: np.ndarray) -> list[bytes]:
    out = []
    for value in ((values << 1) ^ (values >> 63)).astype(np.uint64).tolist():
        parts = bytearray()
        while value > 0x7F:
            parts.append(value & 0x7F | 0x80)
            value >>= 7
        parts.append(value)
        out.append(bytes(parts))
    return out
