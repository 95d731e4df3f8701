"""Row batches as flat byte buffers, and the frames that carry them.

The text operators work on a whole Arrow batch at once: one byte buffer, the row
offsets, and numpy over both.  Batches are cut to ``PIECE_BYTES`` so that the
temporaries of a task stay bounded whatever the texts' lengths; one longer text is
a piece of its own.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PIECE_BYTES = 4 << 20
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def buffer_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all rows end to end, and the n+1 row offsets; null is empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = texts.fill_null("")
    texts = texts.cast(pa.large_string())
    n = len(texts)
    offsets = np.frombuffer(texts.buffers()[1], np.int64, n + 1, texts.offset * 8) if n else np.zeros(1, np.int64)
    data = texts.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0]:offsets[-1]], offsets - offsets[0]


def pieces(
    batches: Iterator[pa.RecordBatch], text: Callable[[pa.RecordBatch], pa.Array] = lambda b: b.column("text"),
) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about ``PIECE_BYTES`` of text, none empty."""
    for batch in batches:
        _, offsets = buffer_of(text(batch))
        at = 0
        while at < batch.num_rows:
            end = int(np.searchsorted(offsets, offsets[at] + PIECE_BYTES, "right")) - 1
            end = min(max(end, at + 1), batch.num_rows)
            yield batch.slice(at, end - at)
            at = end


def annotate(
    docs: DataFrame, text: str, make: Callable[[], Callable[[pa.Array], list]], fields: str,
    keep: list[str] | None = None,
) -> DataFrame:
    """Columns ``row`` (a struct of the columns kept; default all) and ``out``.

    ``make`` is called once per task and gives the function from an array of texts
    to one array per field.  Both sides are structs, so no name of the input can
    clash with a result's.
    """
    columns = docs.columns if keep is None else keep
    kept = F.struct(*[docs[c] for c in columns]).alias("row")
    names = [f.strip().split()[0] for f in fields.split(",")]
    row_type = docs.select(kept).schema["row"].dataType.simpleString()
    # A text that is kept anyway is sent once.
    inside = columns.index(text) if text in columns and docs.schema[text].dataType.simpleString() == "string" else None

    def texts_of(batch: pa.RecordBatch) -> pa.Array:
        return batch.column("text") if inside is None else batch.column("row").flatten()[inside]

    def run(batches):
        work = make()
        for piece in pieces(batches, texts_of):
            out = pa.StructArray.from_arrays([pa.array(a) if not isinstance(a, pa.Array) else a
                                              for a in work(texts_of(piece))], names)
            yield pa.RecordBatch.from_arrays([piece.column("row"), out], ["row", "out"])

    out_type = "struct<" + ",".join(":".join(f.split()) for f in fields.split(",")) + ">"
    sent = docs.select(kept) if inside is not None else docs.select(docs[text].cast("string").alias("text"), kept)
    return sent.mapInArrow(run, f"row {row_type}, out {out_type}")


def word_spans(raw: np.ndarray, offsets: np.ndarray, is_gap: np.ndarray = _SPACE):
    """Starts and ends of the words (runs of bytes that are no gap) and the n+1 word offsets of the rows."""
    gap = is_gap[raw]
    n = len(raw)
    inner = offsets[(offsets > 0) & (offsets < n)]
    before = np.empty(n, bool)  # whether the byte before is a gap or in another row
    if n:
        before[0] = True
        before[1:] = gap[:-1]
        before[inner] = True
    starts = np.flatnonzero(~gap & before)
    after = np.empty(n, bool)
    if n:
        after[-1] = True
        after[:-1] = gap[1:]
        after[inner - 1] = True
    ends = np.flatnonzero(~gap & after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def encode(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, pa.Array]:
    """Codes of byte spans, equal exactly where their bytes are, and the distinct spans."""
    n = len(starts)
    if not n:
        return np.zeros(0, np.int32), pa.array([], pa.binary())
    if np.array_equal(starts[1:], ends[:-1]):
        cuts = np.append(starts, ends[-1])
    else:
        edge = np.zeros(len(raw) + 1, np.int8)
        edge[starts] += 1
        edge[ends] -= 1
        raw = raw[np.cumsum(edge[:-1], dtype=np.int8).astype(bool)]
        cuts = np.concatenate(([0], np.cumsum(ends - starts)))
    kind, width = (pa.binary(), np.int32) if cuts[-1] < 2**31 else (pa.large_binary(), np.int64)
    spans = pa.Array.from_buffers(kind, n, [None, pa.py_buffer(cuts.astype(width)), pa.py_buffer(np.ascontiguousarray(raw))])
    coded = spans.dictionary_encode()
    return coded.indices.to_numpy(), coded.dictionary


def lower(raw: np.ndarray) -> np.ndarray:
    """A-Z lower-cased."""
    out = raw.copy()
    out[(raw >= 65) & (raw <= 90)] += 32
    return out


def gather(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices of many ranges, one after the other."""
    total = int(lengths.sum())
    shift = np.repeat(starts - np.concatenate(([0], np.cumsum(lengths)[:-1])), lengths) if total else np.zeros(0, np.int64)
    return shift + np.arange(total)


def row_sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sums of ``values`` per row."""
    kind = np.float64 if values.dtype.kind == "f" else np.int32 if values.dtype == bool and len(values) < 2**31 else np.int64
    total = np.zeros(len(values) + 1, kind)
    np.cumsum(values, dtype=kind, out=total[1:])
    return (total[offsets[1:]] - total[offsets[:-1]]).astype(np.float64 if kind is np.float64 else np.int64)
