"""Texts in segments that a tokenizer can encode one by one.

A cut is made only where both kinds of tokenizer used here always end a piece and
where what follows does not depend on what came before: before a run of white
space, between a letter and punctuation, and between punctuation (not an
apostrophe, which may begin a contraction) and a letter.  Encoding the segments and
joining the ids is therefore the same as encoding the text, and each distinct
segment has to be encoded only once.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import chain, compress, repeat

import numpy as np
import pyarrow as pa

from tidegauge.llm.batches import buffer_of, encode, gather

_LETTER, _PUNCT, _SPACE = 1, 2, 3
_CLASS = np.zeros(256, np.uint8)
_CLASS[[*range(65, 91), *range(97, 123)]] = _LETTER
_CLASS[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = _PUNCT
_CLASS[[9, 10, 11, 12, 13, 32]] = _SPACE


def _wide_space_before(raw: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Whether the character that ends before ``at`` is white space outside ASCII."""
    a, b, c = raw[at - 1].astype(int), raw[np.maximum(at - 2, 0)].astype(int), raw[np.maximum(at - 3, 0)].astype(int)
    three = (c << 16) | (b << 8) | a
    return ((b == 0xC2) & ((a == 0x85) | (a == 0xA0))) | np.isin(three, (0xE19A80, 0xE280A8, 0xE280A9, 0xE280AF, 0xE2819F, 0xE38080)) | (
        (three >= 0xE28080) & (three <= 0xE2808A))


def fold(raw: np.ndarray) -> np.ndarray:
    """ASCII letters lower-cased and white space blank.

    A letter before a byte outside ASCII stays: a mark may join it to another character.
    """
    alone = np.append(raw[1:] < 0x80, True)
    out = raw.copy()
    out[(raw >= 65) & (raw <= 90) & alone] += 32
    out[(raw >= 9) & (raw <= 13)] = 32
    return out


def segment(texts: pa.Array, folded: bool = False) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """Codes of the segments (``folded``: after ``fold``) of all rows, the distinct segments, and the n+1 offsets of the rows."""
    raw, offsets = buffer_of(texts)
    if not len(raw):
        return np.zeros(0, np.int32), pa.array([], pa.binary()), np.zeros(len(offsets), np.int64)
    if folded:
        raw = fold(raw)
    kind = _CLASS[raw]
    left, right = kind[:-1], kind[1:]
    cut = np.zeros(len(raw) + 1, bool)
    space = (right == _SPACE) & (left != _SPACE)
    cut[1:-1] = space | ((left == _LETTER) & (right == _PUNCT)) | (
        (left == _PUNCT) & (right == _LETTER) & (raw[:-1] != ord("'")))
    doubtful = np.flatnonzero(space & (raw[:-1] >= 0x80)) + 1
    cut[doubtful[_wide_space_before(raw, doubtful)]] = False
    cut[offsets] = True
    at = np.flatnonzero(cut)
    codes, distinct = encode(raw, at[:-1], at[1:])
    return codes, distinct, np.searchsorted(at, offsets)


class SegmentCache:
    """Encoded segments, kept from batch to batch in a worker.

    ``encode_many`` maps a list of segments to a list of tuples of numpy arrays or lists,
    one per column.  A cache that would hold more than ``limit`` segments keeps those that
    were found again since the last time, or none if they are more than half of the limit.
    """

    def __init__(self, encode_many: Callable[[list[bytes]], list[tuple]], types: tuple, limit: int = 700_000):
        self.encode_many, self.types, self.limit = encode_many, types, limit
        self._clear()

    def _clear(self) -> None:
        self.index: dict[bytes, int] = {}  # in the order of the numbers
        self.again = np.zeros(0, bool)
        self.starts = [np.zeros(0, np.int64) for _ in self.types]
        self.lengths = [np.zeros(0, np.int64) for _ in self.types]
        self.values = [np.zeros(0, t) for t in self.types]

    def _trim(self) -> None:
        kept = np.flatnonzero(self.again)
        if 2 * len(kept) > self.limit:
            return self._clear()
        self.index = {k: n for n, k in enumerate(compress(self.index, self.again.tolist()))}
        self.again = np.zeros(len(kept), bool)
        for c in range(len(self.types)):
            lengths = self.lengths[c][kept]
            self.values[c] = self.values[c][gather(self.starts[c][kept], lengths)]
            self.starts[c], self.lengths[c] = np.cumsum(lengths) - lengths, lengths

    def find(self, distinct: pa.Array) -> np.ndarray:
        """The number of each distinct segment."""
        if len(self.index) + len(distinct) > self.limit:
            self._trim()
        keys = distinct.to_numpy(zero_copy_only=False).tolist()  # ``to_pylist`` makes a scalar of each first
        found = np.fromiter(map(self.index.get, keys, repeat(-1)), np.int64, len(keys))
        missing = np.flatnonzero(found < 0)
        self.again[found[found >= 0]] = True
        if len(missing):
            names = [keys[i] for i in missing.tolist()]
            new = self.encode_many(names)
            found[missing] = np.arange(len(self.index), len(self.index) + len(names))
            self.index.update(zip(names, found[missing].tolist(), strict=True))
            self.again = np.append(self.again, np.zeros(len(names), bool))
            for c, t in enumerate(self.types):
                column = [x[c] for x in new]
                lengths = np.fromiter(map(len, column), np.int64, len(column))
                base = len(self.values[c])
                self.starts[c] = np.append(self.starts[c], base + np.cumsum(lengths) - lengths)
                self.lengths[c] = np.append(self.lengths[c], lengths)
                flat = np.fromiter(chain.from_iterable(column), t, int(lengths.sum())) if isinstance(column[0], list) else np.concatenate(column)
                self.values[c] = np.append(self.values[c], flat.astype(t))
        return found

    def join(self, column: int, numbers: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Values of a sequence of segments end to end, and the n+1 value offsets of the rows."""
        lengths = self.lengths[column][numbers]
        ends = np.concatenate(([0], np.cumsum(lengths)))
        return self.values[column][gather(self.starts[column][numbers], lengths)], ends[rows]
