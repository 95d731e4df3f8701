"""Fill-in-the-middle documents, cut with a Fenwick tree over fixed blocks of each text.

A text is a row of units (white space and the word after it; white space at its end is a
unit of its own).  It is laid out in blocks of ``BLOCK`` bytes.  A block counts the units
that end in it and the code points that begin in it, and one Fenwick tree a text holds
both counts.  The block of the k-th unit is found by binary-lifting descent, which sums up
the code points before it on the way; the boundary itself is then looked for in that block
only.  Trees of all texts of a batch are built and descended together, level by level.

Every row is by itself: no shuffle, and a lost executor costs the repetition of its tasks.

Cuts and form come from the sha256 of a seed and the document's id, so equal rows have
equal results and a repeated task repeats them.  A null text counts as empty and is
plain.  A null id is hashed as no digits.  Columns kept are in a struct, so no name can
clash.  A text that holds a marker is plain, so every output can be undone (``restored``).
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegauge.llm.batches import _SPACE, buffer_of, pieces

#: Bytes of a block.
BLOCK = 1024
# Fixed values of the output's form.
PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"


class Fenwick:
    """Trees of unit and code-point counts over the blocks of each text of a batch."""

    def __init__(self, raw: np.ndarray, offsets: np.ndarray, block: int = BLOCK):
        self.raw, self.offsets, self.block = raw, offsets, block
        self.blocks = -(-np.diff(offsets) // block)
        # Slot 0 of each tree is empty; slots of a text are 1 to its number of blocks.
        self.base = np.concatenate(([0], np.cumsum(self.blocks + 1)))
        text = np.repeat(np.arange(len(self.blocks)), self.blocks + 1)
        index = np.arange(self.base[-1]) - self.base[text]
        slots = np.flatnonzero(index)
        self.unit_end = self._unit_ends()
        self.units, self.points = (np.zeros(len(index), np.int64) for _ in range(2))
        if len(slots):
            starts = offsets[text[slots]] + (index[slots] - 1) * block
            self.units[slots] = np.add.reduceat(self.unit_end, starts, dtype=np.int64)
            self.points[slots] = np.add.reduceat(raw & 0xC0 != 0x80, starts, dtype=np.int64)
        step = 1
        while step < index.max(initial=0):
            up = np.flatnonzero((index > 0) & (index % (2 * step) == 0))
            self.units[up] += self.units[up - step]
            self.points[up] += self.points[up - step]
            step *= 2

    def _unit_ends(self) -> np.ndarray:
        """Whether a byte is the last of a unit."""
        gap = _SPACE[self.raw]
        last = np.zeros(len(gap), bool)
        last[self.offsets[1:][np.diff(self.offsets) > 0] - 1] = True
        after = np.append(gap[1:], True)
        return last | (~gap & after)

    def totals(self) -> np.ndarray:
        """Units of each text: the sums on the way from its last block down."""
        at, out = self.blocks.copy(), np.zeros(len(self.blocks), np.int64)
        while at.any():
            out += self.units[self.base[:-1] + at]
            at &= at - 1
        return out

    def cut(self, text: np.ndarray, k: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Byte and code points of the end of the k-th unit of each text given (0: its start)."""
        left, block, points = k.copy(), np.zeros(len(k), np.int64), np.zeros(len(k), np.int64)
        step = 1 << int(self.blocks.max(initial=0)).bit_length()
        while step := step >> 1:
            there = block + step <= self.blocks[text]
            slot = self.base[text] + np.where(there, block + step, 0)
            go = there & (self.units[slot] < left)
            left -= np.where(go, self.units[slot], 0)
            points += np.where(go, self.points[slot], 0)
            block += np.where(go, step, 0)
        byte = self.offsets[text].copy()
        for i in np.flatnonzero(k > 0).tolist():
            a = int(self.offsets[text[i]] + block[i] * self.block)
            b = min(a + self.block, int(self.offsets[text[i] + 1]))
            end = a + int(np.flatnonzero(self.unit_end[a:b])[left[i] - 1]) + 1
            byte[i] = end
            points[i] += int((self.raw[a:end] & 0xC0 != 0x80).sum())
        points[k == 0] = 0
        return byte, points


def _marked(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Whether each text holds a marker."""
    names = np.array([m[1] for m in (PREFIX, SUFFIX, MIDDLE)], np.uint8)
    if len(raw) < 3:
        return np.zeros(len(offsets) - 1, bool)
    at = np.flatnonzero((raw[:-2] == PREFIX[0]) & np.isin(raw[1:-1], names) & (raw[2:] == PREFIX[2]))
    text = np.searchsorted(offsets, at, "right") - 1
    out = np.zeros(len(offsets) - 1, bool)
    out[text[at + 3 <= offsets[text + 1]]] = True
    return out


def arrange(ids: list[str | None], texts: pa.Array, seed: int, percent: int, spm_percent: int) -> list[pa.Array]:
    """Per row: n units, form, code points of prefix and middle (null if plain), output."""
    raw, offsets = buffer_of(texts)
    tree = Fenwick(raw, offsets)
    n = tree.totals()
    rows = np.arange(len(n))
    digests = b"".join(hashlib.sha256(f"{seed}:{i or ''}".encode()).digest()[:16] for i in ids)
    h1, h2, h3, h4 = np.frombuffer(digests, ">u4").reshape(-1, 4).astype(np.int64).T
    a, b = h1 % (n + 1), h2 % (n + 1)
    plain = (np.diff(offsets) == 0) | _marked(raw, offsets) | (h3 % 100 >= percent)
    form = np.where(plain, "plain", np.where(h4 % 100 < spm_percent, "spm", "psm"))
    (one, before), (two, upto) = tree.cut(rows, np.minimum(a, b)), tree.cut(rows, np.maximum(a, b))
    data, out = raw.tobytes(), []
    for kind, start, p, q, end in zip(form.tolist(), offsets[:-1].tolist(), one.tolist(), two.tolist(), offsets[1:].tolist(), strict=True):
        prefix, middle, suffix = data[start:p], data[p:q], data[q:end]
        out.append(data[start:end] if kind == "plain" else
                   PREFIX + prefix + SUFFIX + suffix + MIDDLE + middle if kind == "psm" else
                   SUFFIX + suffix + PREFIX + prefix + MIDDLE + middle)
    return [pa.array(n), pa.array(form.tolist(), pa.string()), pa.array(before, mask=plain), pa.array(upto - before, mask=plain),
            pa.array(out, pa.binary()).cast(pa.string())]


def fill_in_middle(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", keep: list[str] | None = None,
                   seed: int = 42, percent: int = 50, spm_percent: int = 80) -> DataFrame:
    """Columns ``row`` (a struct of the columns kept; default all) and ``out``: n, form, prefix_chars, middle_chars, output.

    Of all documents ``percent`` in a hundred are rearranged, of those ``spm_percent`` with the suffix first.
    """
    kept = F.struct(*[docs[c] for c in (docs.columns if keep is None else keep)]).alias("row")
    row_type = docs.select(kept).schema["row"].dataType.simpleString()
    names = ["n", "form", "prefix_chars", "middle_chars", "output"]

    def run(batches):
        for piece in pieces(batches):
            out = arrange(piece.column("id").to_pylist(), piece.column("text"), seed, percent, spm_percent)
            yield pa.RecordBatch.from_arrays([piece.column("row"), pa.StructArray.from_arrays(out, names)], ["row", "out"])

    sent = docs.select(docs[doc_id].cast("string").alias("id"), docs[text].cast("string").alias("text"), kept)
    return sent.mapInArrow(run, f"row {row_type}, out struct<n:bigint,form:string,prefix_chars:bigint,middle_chars:bigint,output:string>")


def restored(output: Column, form: Column) -> Column:
    """The text that an output was made of."""
    part = F.split(output, "<[PSM]>", -1)
    return (F.when(form == "psm", F.concat(part[1], part[3], part[2]))
            .when(form == "spm", F.concat(part[2], part[3], part[1])).otherwise(output))
