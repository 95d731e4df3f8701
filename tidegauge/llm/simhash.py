"""SimHash near-duplicates by tiled exact comparison.

Documents with one fingerprint are one class.  Fingerprints are put in cells by the
population counts of their parts; if two differ in at most ``radius`` bits, so do
the counts of their parts, summed.  A cell is cut into tiles of at most ``TILE``
fingerprints.  Tiles whose cells' counts differ beyond the radius are never brought
together; those left are compared exactly, tile by tile, with numpy exclusive-or and
bit counts.  A comparison gives a spanning forest of its links, not all pairs, so a
large group of near copies gives about as many rows as it has members.

A null text, like one without words, has fingerprint zero.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegauge.llm.batches import annotate, buffer_of, lower, word_spans
from tidegauge.llm.components import components, written

TILE = 2048
#: Parts of a fingerprint whose bits are counted apart.
PARTS = 4
RADIUS = 2
SEED = 42


def _signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def fingerprints(texts: pa.Array, shingle: int = 3) -> np.ndarray:
    """64-bit SimHash of the shingles of words, repeats included; a bit is set where over half the hashes have it."""
    raw, offsets = buffer_of(texts)
    raw = lower(raw)
    starts, ends, rows = word_spans(raw, offsets)
    # Words joined by one space: every word is followed by one.
    lengths = ends - starts + 1
    place = np.concatenate(([0], np.cumsum(lengths)))
    text = np.full(int(place[-1]), 32, np.uint8)
    if len(starts):
        inside = np.zeros(len(raw) + 1, np.int8)
        inside[starts] += 1
        inside[ends] -= 1
        body = np.ones(len(text), bool)
        body[place[1:] - 1] = False
        text[body] = raw[np.cumsum(inside[:-1], dtype=np.int8).astype(bool)]
    n_words = np.diff(rows)
    n_hash = np.where(n_words >= shingle, n_words - shingle + 1, np.minimum(n_words, 1))
    width = np.minimum(n_words, shingle)
    cuts = np.concatenate(([0], np.cumsum(n_hash)))
    first = np.repeat(rows[:-1] - cuts[:-1], n_hash) + np.arange(int(cuts[-1]))
    a = place[first].tolist()
    b = (place[first + np.repeat(width, n_hash)] - 1).tolist()
    data, digest = text.tobytes(), xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(data[x:y], SEED) for x, y in zip(a, b, strict=True)), np.uint64, len(a))
    out = np.zeros(len(n_words), np.uint64)
    filled = np.flatnonzero(n_hash)
    if not len(filled):
        return out
    half = n_hash[filled] // 2
    starts_of = cuts[:-1][filled]
    for bit in range(64):
        ones = np.add.reduceat(((hashes >> np.uint64(bit)) & np.uint64(1)).astype(np.int32), starts_of)
        out[filled] |= (ones > half).astype(np.uint64) << np.uint64(bit)
    return out


def with_fingerprint(docs: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Columns ``row`` and ``out.fingerprint`` (the 64 bits as a signed long)."""
    return annotate(docs, text, lambda: lambda t: [_signed(fingerprints(t))], "fingerprint bigint", keep)


def _forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Least member of each node's component, by hooking and pointer jumping."""
    label = np.arange(n)
    while True:
        before = label.copy()
        low = np.minimum(label[a], label[b])
        np.minimum.at(label, a, low)
        np.minimum.at(label, b, low)
        np.minimum.at(label, before[a], low)
        np.minimum.at(label, before[b], low)
        while True:
            up = label[label]
            if np.array_equal(up, label):
                break
            label = up
        if np.array_equal(before, label):
            return label


def tile_links(x: np.ndarray, y: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links within and between two tiles of distinct fingerprints."""
    both = np.concatenate((x, y))
    label = np.arange(len(both))
    step = max(1, (1 << 20) // max(1, len(y)))
    for at in range(0, len(x), step):
        close = np.bitwise_count(x[at:at + step, None] ^ y[None, :]) <= radius
        i, j = np.nonzero(close)
        if len(i):
            label = _forest(len(both), np.concatenate((label[i + at], np.arange(len(both)))), np.concatenate((label[j + len(x)], label)))
    linked = np.flatnonzero(label != np.arange(len(both)))
    return both[linked], both[label[linked]]


def _neighbours(parts: int, radius: int) -> list[tuple[int, ...]]:
    """Half of the offsets of cells within the radius: the cell itself, and one of each opposite pair."""
    near = [d for d in itertools.product(range(-radius, radius + 1), repeat=parts) if sum(map(abs, d)) <= radius]
    return [d for d in near if d >= (0,) * parts]


def links(distinct: DataFrame, radius: int = RADIUS, parts: int = PARTS, tile: int = TILE) -> DataFrame:
    """(a, b): links that connect all fingerprints (column ``fingerprint``, distinct) within the radius."""
    if 64 % parts:
        raise ValueError("parts must divide 64")
    bits = 64 // parts
    mask = (1 << bits) - 1
    count = lambda i: F.bit_count(F.shiftrightunsigned("fingerprint", i * bits).bitwiseAND(F.lit(mask)))
    base = bits + 2 * radius + 1
    cell = sum(((count(i) + radius) * base**i for i in range(parts)), F.lit(0)).cast("long")
    # A cell's fingerprints are dealt over enough tiles by their hash, sized by the cell's count.
    celled = distinct.select("fingerprint", cell.alias("cell"))
    sizes = celled.groupBy("cell").agg(F.count("*").alias("n"))
    tiles = (celled.join(sizes, "cell")
             .withColumn("part", F.pmod(F.xxhash64("fingerprint"), F.ceil(F.col("n") / (tile // 2))).cast("int"))
             .groupBy("cell", "part").agg(F.array_sort(F.collect_list("fingerprint")).alias("members")))
    tiles = written(tiles, "tiles")
    shifts = [sum(d[i] * base**i for i in range(parts)) for d in _neighbours(parts, radius)]
    visitors = tiles.select("cell", F.col("part").alias("other"), F.col("members").alias("visitors"),
                            F.explode(F.array(*[F.lit(s).cast("long") for s in shifts])).alias("shift"))
    visitors = visitors.withColumn("target", F.col("cell") + F.col("shift")).drop("cell")
    home = tiles.select(F.col("cell").alias("target"), "part", "members")
    pairs = home.join(visitors, "target").where("shift <> 0 or other >= part").select("members", "visitors")

    def run(batches):
        for batch in batches:
            a, b = [], []
            for i in range(batch.num_rows):
                x, y = (batch.column(c).slice(i, 1).flatten().to_numpy().view(np.uint64) for c in (0, 1))
                p, q = tile_links(x, y, radius)
                a.append(p)
                b.append(q)
            a, b = (_signed(np.concatenate(z)) for z in (a, b))
            keep = a != b
            yield pa.RecordBatch.from_arrays([pa.array(a[keep]), pa.array(b[keep])], ["a", "b"])

    return pairs.mapInArrow(run, "a long, b long")


def groups(prints: DataFrame, doc_id: str = "doc_id", fingerprint: str = "fingerprint", radius: int = RADIUS,
           parts: int = PARTS, tile: int = TILE) -> DataFrame:
    """(fingerprint, component_id): the least id reachable from each fingerprint.

    Null ids have no part in the least; a component of null ids only has a null id.
    """
    distinct = written(prints.groupBy(F.col(fingerprint).alias("fingerprint")).agg(F.min(doc_id).alias("least")), "fingerprints")
    stars = components(links(distinct.select("fingerprint"), radius, parts, tile))
    member = distinct.join(stars, distinct["fingerprint"] == stars["a"], "left").select(
        "fingerprint", "least", F.coalesce("b", "fingerprint").alias("root"))
    roots = member.groupBy("root").agg(F.min("least").alias("component_id"))
    return member.join(roots, "root").select("fingerprint", "component_id")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", radius: int = RADIUS) -> DataFrame:
    """doc_id, fingerprint (16 hexadecimal digits) and component_id of every row."""
    prints = written(with_fingerprint(docs, text, [doc_id]).select(
        F.col(f"row.{doc_id}").alias("doc_id"), F.col("out.fingerprint").alias("fingerprint")), "prints")
    found = groups(prints, radius=radius)
    return prints.join(found, "fingerprint").select(
        "doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")
