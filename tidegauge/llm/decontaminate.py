"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

Patterns are the windows of consecutive words of the benchmark items.  A table over
blocks (pairs of neighbouring words) says how far a search position may jump: a block
that stands in no pattern lets it jump almost a window.  Where a block ends a
pattern, the bucket of that suffix gives the patterns to compare word by word.

Words are codes of the benchmark's vocabulary, 0 for any other, so the direct
comparison is exact.  All documents of a batch are searched at once: a batch is cut
into lanes of ``LANE`` words, each with its own search position.

The benchmark is a stated query set.  Its items are dealt over blocks of about
``BLOCK_WORDS`` words, each compiled in a task of its own and written to the shared
folder.  A worker opens one block at a time, and searches every batch of documents for
every block.  Items without a word, and null texts, have no windows and no words.
Documents in repeated rows are searched each; columns kept are in a struct, so no name
can clash.
"""

from __future__ import annotations

import hashlib
import math
import pickle
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegauge.llm import hash_arrays
from tidegauge.llm.batches import annotate, buffer_of, encode, lower, row_sums, word_spans
from tidegauge.session import work_dir

LANE = 256
BLOCK_WORDS = 1_000_000
# Words are runs of letters (after lower-casing), digits and bytes outside ASCII.
_GAP = np.zeros(256, bool)
_GAP[[*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]] = True


class Patterns(NamedTuple):
    """Windows of one length, ready to search."""

    words: np.ndarray       # patterns x length, codes
    keys: np.ndarray        # sorted distinct blocks in the patterns
    shifts: np.ndarray      # per key: how far the search may move; 0 where a pattern may end
    jump: int               # shift of any block that is not in ``keys``
    suffixes: np.ndarray    # sorted blocks that end patterns
    bucket: np.ndarray      # per suffix: first of its patterns in ``members``, and one more at the end
    members: np.ndarray     # pattern numbers by suffix


class Block(NamedTuple):
    """A part of the benchmark: vocabulary, patterns by length, items of each window."""

    vocabulary: pa.Array
    groups: list[Patterns]
    items: list[list[list[str]]]


def _spans(texts: pa.Array):
    raw, offsets = buffer_of(texts)
    raw = lower(raw)
    starts, ends, rows = word_spans(raw, offsets, _GAP)
    codes, distinct = encode(raw, starts, ends)
    return codes, distinct, rows


def _blocks_of(words: np.ndarray, end: np.ndarray | int, size: int, v: int) -> np.ndarray:
    """Blocks of ``size`` words that end at ``end`` (last axis)."""
    last = words[..., end].astype(np.int64)
    return last if size == 1 else words[..., end - 1].astype(np.int64) * v + last


def compile_patterns(windows: np.ndarray, v: int) -> Patterns:
    """Shift and suffix tables of distinct windows of one length."""
    count, length = windows.shape
    size = min(2, length)
    keys, shifts = [], []
    for end in range(size - 1, length):
        keys.append(_blocks_of(windows, end, size, v))
        shifts.append(np.full(count, length - 1 - end))
    keys, shifts = np.concatenate(keys), np.concatenate(shifts)
    order = np.lexsort((shifts, keys))
    keys, shifts = keys[order], shifts[order]
    first = np.append(True, keys[1:] != keys[:-1])
    suffix = _blocks_of(windows, length - 1, size, v)
    members = np.argsort(suffix, kind="stable")
    suffixes, bucket = np.unique(suffix[members], return_index=True)
    return Patterns(windows, keys[first], shifts[first], length - size + 1, suffixes, np.append(bucket, count), members)


def compile_block(items: list[tuple[str, str]], window: int) -> Block:
    """Compile items (id, text)."""
    codes, vocabulary, rows = _spans(pa.array([t for _, t in items], pa.string()))
    codes = codes.astype(np.int32) + 1
    by_length: dict[int, dict[bytes, list[str]]] = {}
    for i, (name, _) in enumerate(items):
        own = codes[rows[i]:rows[i + 1]]
        size = min(window, len(own))
        if not size:
            continue
        windows = by_length.setdefault(size, {})
        for w in {own[k:k + size].tobytes() for k in range(len(own) - size + 1)}:
            windows.setdefault(w, []).append(name)
    groups, names = [], []
    for size, windows in sorted(by_length.items()):
        groups.append(compile_patterns(np.frombuffer(b"".join(windows), np.int32).reshape(-1, size), len(vocabulary) + 1))
        names.append(list(windows.values()))
    return Block(vocabulary.cast(pa.binary()), groups, names)


def search(codes: np.ndarray, rows: np.ndarray, p: Patterns, v: int) -> tuple[np.ndarray, np.ndarray]:
    """Every occurrence: position of its last word, and pattern number."""
    length = p.words.shape[1]
    size = min(2, length)
    # A lane searches windows that end in it; it begins no earlier than a whole window of its document.
    first, last = rows[:-1] + length - 1, rows[1:]
    lanes = np.maximum(0, -(-(last - first) // LANE))
    start = np.repeat(first, lanes) + LANE * (np.arange(int(lanes.sum())) - np.repeat(np.cumsum(lanes) - lanes, lanes))
    stop = np.minimum(start + LANE, np.repeat(last, lanes))
    ends, numbers = [], []
    at = start
    while len(at):
        block = _blocks_of(codes, at, size, v)
        k = np.searchsorted(p.keys, block)
        k[k == len(p.keys)] = 0
        shift = np.where(p.keys[k] == block, p.shifts[k], p.jump)
        hits = at[shift == 0]
        if len(hits):
            s = np.searchsorted(p.suffixes, _blocks_of(codes, hits, size, v))
            many = p.bucket[s + 1] - p.bucket[s]
            where = np.repeat(hits, many)
            member = np.repeat(p.bucket[s] - np.cumsum(many) + many, many) + np.arange(int(many.sum()))
            number = p.members[member]
            for k in range(length):  # word by word; few candidates are left after the first
                same = codes[where - length + 1 + k] == p.words[number, k]
                where, number = where[same], number[same]
            ends.append(where)
            numbers.append(number)
        at = at + np.maximum(shift, 1)
        going = at < stop
        at, stop = at[going], stop[going]
    empty = np.zeros(0, np.int64)
    return np.concatenate([empty, *ends]), np.concatenate([empty, *numbers]).astype(np.int64)


def find_hits(texts: pa.Array, blocks) -> tuple[np.ndarray, np.ndarray, list[set[str]]]:
    """Per row: words, words inside an occurrence, ids of the items that occur."""
    codes, distinct, rows = _spans(texts)
    n = len(rows) - 1
    edges = np.zeros(len(codes) + 1, np.int64)
    items: list[set[str]] = [set() for _ in range(n)]
    for block in blocks:
        known = pc.index_in(distinct.cast(pa.binary()), value_set=block.vocabulary).fill_null(-1).to_numpy()
        own = (known.astype(np.int32) + 1)[codes] if len(codes) else codes
        for p, names in zip(block.groups, block.items, strict=True):
            ends, numbers = search(own, rows, p, len(block.vocabulary) + 1)
            np.add.at(edges, ends + 1 - p.words.shape[1], 1)
            np.add.at(edges, ends + 1, -1)
            row = np.searchsorted(rows, ends, "right") - 1
            for r, x in {*zip(row.tolist(), numbers.tolist(), strict=True)}:
                items[r].update(names[x])
    hit = (np.cumsum(edges[:-1]) > 0).astype(np.int64)
    return np.diff(rows), row_sums(hit, rows), items


class Compiled(NamedTuple):
    """Where the compiled blocks are, and their numbers."""

    uri: str
    numbers: list[int]

    def blocks(self):
        return (open_block(self.uri, k) for k in self.numbers)


@lru_cache(maxsize=1)
def open_block(uri: str, number: int) -> Block:
    filesystem, base = pafs.FileSystem.from_uri(uri)
    with filesystem.open_input_file(f"{base}/{number}.block") as f:
        vocabulary, groups, items = pickle.loads(f.read())
    return Block(vocabulary, [Patterns(*g) for g in groups], items)


def compile_benchmark(benchmark: DataFrame, window: int, item_id: str, text: str, block_words: int = BLOCK_WORDS) -> Compiled:
    """Blocks of the benchmark; a null item id is the text ``null``.  Only their numbers come to the driver."""
    spark = benchmark.sparkSession
    uri = hash_arrays.make_folder(work_dir(spark, "benchmark"))
    items = benchmark.select(F.coalesce(benchmark[item_id].cast("string"), F.lit("null")).alias("i"),
                             benchmark[text].cast("string").alias("t")).where("t is not null")
    words = items.agg(F.sum(F.length("t") / 4 + 1)).first()[0]
    count = math.ceil((words or 0) / block_words)
    if not count:
        return Compiled(uri, [])

    def run(batches):
        held: dict[int, list] = {}
        for b in batches:
            for k, *item in zip(*(b.column(c).to_pylist() for c in ("block", "i", "t")), strict=True):
                held.setdefault(k, []).append(tuple(item))
        for k, own in held.items():
            vocabulary, groups, items = compile_block(own, window)
            hash_arrays.save(uri, f"{k}.block", np.frombuffer(pickle.dumps((vocabulary, list(map(tuple, groups)), items)), np.uint8))
        yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int32())], ["block"])

    dealt = items.withColumn("block", F.pmod(F.xxhash64("i", "t"), F.lit(count)).cast("int"))
    done = dealt.repartitionById(count, F.col("block")).mapInArrow(run, "block int")
    return Compiled(uri, sorted(r.block for r in done.collect()))


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = 10, text: str = "text", item_id: str = "item_id",
                  item_text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Columns ``row`` and ``out``: n_words, n_hit, n_items, items_sha256, contaminated.

    items_sha256 is over the ids of the items that occur, sorted as strings and joined
    by commas; an empty set digests the empty string.
    """
    compiled = compile_benchmark(benchmark, window, item_id, item_text)

    def make():
        def work(texts: pa.Array) -> list:
            n_words, n_hit, items = find_hits(texts, compiled.blocks())
            digest = [hashlib.sha256(",".join(sorted(x)).encode()).hexdigest() for x in items]
            return [n_words, n_hit, np.array([len(x) for x in items], np.int64), pa.array(digest, pa.string()), n_hit > 0]
        return work

    return annotate(docs, text, make, "n_words bigint, n_hit bigint, n_items bigint, items_sha256 string, contaminated boolean", keep)
