"""Repeated passages by sparse suffix arrays.

A passage is ``PASSAGE`` words or more that stand in two documents.  Suffixes are kept
only at content-selected positions: where the hash of a ``SEED``-word group is the
least of its neighbours, so that every passage keeps at least one suffix, the same
one wherever it stands.

1. Copies of a whole text are repeats as they are; one of them represents the others.
2. Seeds are counted over all documents.  Those in two documents or more are stored
   as sorted hash arrays.
3. A second scan emits, for each suffix whose seed is among them, the words after and
   before the seed that a passage around it could reach.
4. The suffixes of a seed are sorted by their words; neighbours are compared, which
   gives for each length the runs of suffixes that agree so far to the right, and
   within a run those that agree far enough to the left are found.

Step 4 is exact.  A seed of more than ``GROUP`` suffixes is not sorted in one task:
its passages of ``PASSAGE`` words are hashed and counted by Spark instead.

A document is an id with its text (null ids by the text alone); equal rows are one
document.  Repeats within one document only do not count.  Null texts have no words.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegauge.llm import hash_arrays
from tidegauge.llm.batches import buffer_of, encode, gather, pieces, word_spans
from tidegauge.llm.components import written
from tidegauge.session import work_dir

PASSAGE = 50
SEED = 26
#: Words that a passage can reach beyond a seed, on both sides together.
REACH = PASSAGE - SEED
GROUP = 65_536
_P = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_P), -1, 1 << 64))


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def _words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of each word (never 0) and the n+1 word offsets of the rows."""
    raw, offsets = buffer_of(texts)
    starts, ends, rows = word_spans(raw, offsets)
    codes, distinct = encode(raw, starts, ends)
    hashes = np.fromiter((xxhash.xxh3_64_intdigest(w) or 1 for w in distinct.to_pylist()), np.uint64, len(distinct))
    return hashes[codes] if len(codes) else np.zeros(0, np.uint64), rows


def _groups(words: np.ndarray, size: int) -> np.ndarray:
    """Hashes of every ``size`` consecutive words."""
    n = len(words)
    power = np.multiply.accumulate(np.full(n, _P))
    inverse = np.multiply.accumulate(np.full(n, _INVERSE))
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(words * power, dtype=np.uint64)))
    return _mix((total[size:] - total[:-size]) * inverse[:n - size + 1])


def select(words: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the kept suffixes and the hashes of their seeds.

    Each window of ``PASSAGE`` words keeps the first of its least seeds.
    """
    if len(words) < PASSAGE:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    seeds = _groups(words, SEED)
    width = REACH + 1
    least = np.arange(len(seeds))
    span = 1
    while span < width:  # the least of ever longer runs
        step = min(span, width - span)
        a, b = least[:len(least) - step], least[step:]
        least = np.where(seeds[b] < seeds[a], b, a)
        span += step
    inside = np.zeros(len(least), bool)  # windows that lie in one row
    n = np.diff(rows)
    long_ = n >= PASSAGE
    inside[gather(rows[:-1][long_], n[long_] - PASSAGE + 1)] = True
    at = np.unique(least[inside])
    return at, seeds[at]


def _sums(words: np.ndarray) -> np.ndarray:
    """Hashes of the first 0, 1, ... words of each row."""
    out = np.zeros((len(words), words.shape[1] + 1), np.uint64)
    for k in range(words.shape[1]):
        out[:, k + 1] = (out[:, k] + words[:, k].astype(np.uint64)) * _P
    return out


def repeated_windows(seed: np.ndarray, doc: np.ndarray, right: np.ndarray, left: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest reach to the left (-1: none) of the passages of each suffix that stand in two documents.

    Suffixes are sorted by seed and ``right``; ``right`` and ``left`` hold the words away
    from the seed, 0 beyond the document.
    """
    n = len(seed)
    low, high = np.full(n, REACH + 1, np.int64), np.full(n, -1, np.int64)
    if not n:
        return low, high
    new = np.append(True, seed[1:] != seed[:-1])
    same = np.logical_and.accumulate(right[1:] == right[:-1], axis=1).sum(1)  # common words of neighbours
    have_right, have_left = (right != 0).sum(1), (left != 0).sum(1)
    sums = _sums(left)
    for reach in range(REACH + 1):
        rest = REACH - reach  # words to the right
        run = np.cumsum(new | np.append(True, same < rest))
        able = np.flatnonzero((have_right >= rest) & (have_left >= reach))
        if len(able) < 2:
            continue
        run, key, own = run[able], sums[able, reach], doc[able]
        order = np.lexsort((key, run))
        run, key, own = run[order], key[order], own[order]
        at = np.flatnonzero(np.append(True, (run[1:] != run[:-1]) | (key[1:] != key[:-1])))
        many = np.minimum.reduceat(own, at) != np.maximum.reduceat(own, at)
        hit = able[order[np.repeat(many, np.diff(np.append(at, len(order))))]]
        low[hit] = np.minimum(low[hit], reach)
        high[hit] = reach
    return low, high


def _keyed(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    t = docs[text].cast("string")
    return docs.select(docs[doc_id].alias("doc_id"), t.alias("text"), F.xxhash64(t, F.octet_length(t)).alias("whole")).withColumn(
        "doc", F.xxhash64("doc_id", "whole"))


def _copies(keyed: DataFrame, folder: str, bits: int) -> str:
    """Texts that stand in two documents, with the document that represents them."""
    copies = (keyed.where("text is not null").groupBy(F.col("whole").alias("key"))
              .agg(F.min("doc").alias("value"), F.max("doc").alias("other")).where("value <> other"))
    return hash_arrays.save_table(copies.select("key", "value"), folder, bits)


def passages(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", group: int = GROUP) -> DataFrame:
    """One row per document with a repeated passage: doc_id, n_words, n_repeated, spans.

    ``spans`` are its maximal repeated stretches as start:end in words, comma-joined;
    ``n_repeated`` counts their words.
    """
    spark = docs.sparkSession
    bits = max(2, (int(spark.conf.get("spark.sql.shuffle.partitions")) - 1).bit_length())
    keyed = _keyed(docs, doc_id, text)
    copies = _copies(keyed, work_dir(spark, "copies"), bits)

    def scanned(batches):
        """(batch, words, row offsets, whether the text has a copy, whether it is represented by another)."""
        for b in pieces(batches):
            words, rows = _words(b.column("text"))
            there, value = hash_arrays.find(copies, bits, b.column("whole").to_numpy().view(np.uint64))
            yield b, words, rows, there, there & (value != b.column("doc").to_numpy())

    def seeds(batches):
        for _, words, rows, _, stands_back in scanned(batches):
            at, seed = select(words, rows)
            row = np.searchsorted(rows, at, "right") - 1
            use = ~stands_back[row]
            row, seed = row[use], seed[use]
            order = np.lexsort((seed, row))
            row, seed = row[order], seed[order]
            first = np.flatnonzero(np.append(True, (row[1:] != row[:-1]) | (seed[1:] != seed[:-1]))[:len(row)])
            yield pa.RecordBatch.from_arrays(
                [pa.array(seed[first].view(np.int64)), pa.array(np.diff(np.append(first, len(row))))], ["key", "n"])

    counted = (keyed.mapInArrow(seeds, "key long, n long").groupBy("key")
               .agg(F.sum("n").alias("value"), F.count("*").alias("docs")).where("docs > 1").select("key", "value"))
    # Equal rows count twice here and are told apart in the comparison.
    repeated = hash_arrays.save_table(counted, work_dir(spark, "seeds"), bits)

    def suffixes(batches):
        for b, words, rows, there, stands_back in scanned(batches):
            doc, n = b.column("doc").to_numpy(), np.diff(rows)
            whole = np.flatnonzero(there & (n >= PASSAGE))
            at, seed = select(words, rows)
            row = np.searchsorted(rows, at, "right") - 1
            known, many = hash_arrays.find(repeated, bits, seed)
            keep = np.flatnonzero(known & ~there[row])
            mates = np.flatnonzero(known & there[row] & ~stands_back[row])
            keep = np.sort(np.concatenate((keep, mates)))
            at, seed, row, many = at[keep], seed[keep], row[keep], many[keep]
            small = np.where(words >> np.uint64(32), words >> np.uint64(32), np.uint64(1)).astype(">u4")
            step = np.arange(REACH)
            after, before = at[:, None] + SEED + step, at[:, None] - 1 - step
            ok_after, ok_before = after < rows[row + 1][:, None], before >= rows[row][:, None]
            right = np.where(ok_after, small[np.minimum(after, max(len(small) - 1, 0))] if len(small) else 0, 0).astype(">u4")
            left = np.where(ok_before, small[np.maximum(before, 0)] if len(small) else 0, 0).astype(">u4")
            # Suffixes that follow each other and have all words in common (a repeated word or line) are one row,
            # where they are near enough for their passages to touch; suffixes between them may have been left out.
            new = np.ones(len(at), bool)
            new[1:] = ((row[1:] != row[:-1]) | (seed[1:] != seed[:-1]) | (at[1:] - at[:-1] > PASSAGE)
                       | (right[1:] != right[:-1]).any(1) | (left[1:] != left[:-1]).any(1))
            first = np.flatnonzero(new)
            final = at[np.append(first[1:], len(at))[:len(first)] - 1]
            at, seed, row, many, right, left = (x[first] for x in (at, seed, row, many, right, left))
            packed = lambda x: pa.array([r.tobytes() for r in x], pa.binary())
            # First the whole copies, which have no suffix, then the suffixes.
            k = len(whole)
            yield pa.RecordBatch.from_arrays([
                pa.concat_arrays([b.column("doc_id").take(pa.array(whole)), b.column("doc_id").take(pa.array(row))]).cast(pa.int64()),
                pa.array(np.concatenate((doc[whole], doc[row]))), pa.array(np.concatenate((n[whole], n[row]))),
                pa.array(np.concatenate((np.zeros(k, np.int64), seed.view(np.int64)))),
                pa.array(np.concatenate((np.zeros(k, np.int64), many))),
                pa.array(np.concatenate((np.full(k, -1), at - rows[row]))),
                pa.array(np.concatenate((np.full(k, -1), final - rows[row]))),
                pa.concat_arrays([pa.nulls(k, pa.binary()), packed(right)]), pa.concat_arrays([pa.nulls(k, pa.binary()), packed(left)]),
            ], ["doc_id", "doc", "n_words", "seed", "many", "at", "final", "right", "left"])

    kept = written(keyed.mapInArrow(
        suffixes, "doc_id long, doc long, n_words long, seed long, many long, at long, final long, right binary, left binary"), "suffixes")

    def compare(batches):
        """Suffixes of whole seeds at a time; found stretches of each."""
        rest = None
        for b in batches:
            table = pa.Table.from_batches([b]) if rest is None else pa.concat_tables([rest, pa.Table.from_batches([b])])
            seed = table["seed"].to_numpy()
            cut = int(np.searchsorted(seed, seed[-1])) if len(seed) else 0
            rest = table.slice(cut)
            if cut:
                yield from found(table.slice(0, cut))
        if rest is not None and rest.num_rows:
            yield from found(rest)

    def found(table):
        table = table.combine_chunks()
        block = lambda c: np.frombuffer(b"".join(table[c].to_pylist()), ">u4").reshape(-1, REACH)
        low, high = repeated_windows(table["seed"].to_numpy(), table["doc"].to_numpy(), block("right"), block("left"))
        hit = np.flatnonzero(high >= 0)
        part = table.take(pa.array(hit))
        at = part["at"].to_numpy()
        yield from pa.table({"doc_id": part["doc_id"], "doc": part["doc"], "n_words": part["n_words"],
                             "start": pa.array(at - high[hit]), "stop": pa.array(part["final"].to_numpy() - low[hit] + PASSAGE)}).combine_chunks().to_batches()

    stretch = "doc_id long, doc long, n_words long, start long, stop long"
    sorted_ = (kept.where((F.col("at") >= 0) & (F.col("many") <= group)).repartition("seed").sortWithinPartitions("seed", "right"))
    stretches = sorted_.mapInArrow(compare, stretch)

    def hashed(batches):
        """The passages around the suffixes of very common seeds."""
        for b in batches:
            if not b.num_rows:
                continue
            right, left = (np.frombuffer(b"".join(b.column(c).to_pylist()), ">u4").reshape(-1, REACH) for c in ("right", "left"))
            rs, ls = _sums(right), _sums(left)
            have_right, have_left = (right != 0).sum(1), (left != 0).sum(1)
            for reach in range(REACH + 1):
                able = np.flatnonzero((have_right >= REACH - reach) & (have_left >= reach))
                key = _mix(b.column("seed").to_numpy().view(np.uint64)[able] ^ _mix(
                    rs[able, REACH - reach] + np.uint64(reach)) * _P ^ _mix(ls[able, reach]))
                part = pa.Table.from_batches([b]).take(pa.array(able))
                at = part["at"].to_numpy()
                yield from pa.table({"doc_id": part["doc_id"], "doc": part["doc"], "n_words": part["n_words"],
                                     "start": pa.array(at - reach), "stop": pa.array(part["final"].to_numpy() - reach + PASSAGE),
                                     "key": pa.array(key.view(np.int64))}).combine_chunks().to_batches()

    common = kept.where((F.col("at") >= 0) & (F.col("many") > group)).mapInArrow(hashed, stretch + ", key long")
    twice = common.groupBy("key").agg(F.min("doc").alias("a"), F.max("doc").alias("b")).where("a <> b").select("key")
    common = common.join(twice, "key", "left_semi").select("doc_id", "doc", "n_words", "start", "stop")
    whole = kept.where("at < 0").select("doc_id", "doc", "n_words", F.lit(0).cast("long").alias("start"), F.col("n_words").alias("stop"))
    every = stretches.unionAll(common).unionAll(whole)
    joined = F.aggregate(
        F.array_sort(F.collect_set(F.struct("start", "stop"))), F.array().cast("array<struct<start:bigint,stop:bigint>>"),
        lambda a, x: F.when((F.size(a) > 0) & (F.element_at(a, F.lit(-1))["stop"] >= x["start"]), F.concat(
            F.slice(a, F.lit(1), F.size(a) - 1), F.array(F.struct(
                F.element_at(a, F.lit(-1))["start"].alias("start"), F.greatest(F.element_at(a, F.lit(-1))["stop"], x["stop"]).alias("stop")))))
        .otherwise(F.concat(a, F.array(x))))
    # A document has few stretches for its words; documents are the groups.
    return (every.groupBy("doc_id", "doc", "n_words").agg(joined.alias("s")).select(
        "doc_id", "n_words",
        F.aggregate("s", F.lit(0).cast("long"), lambda a, x: a + x["stop"] - x["start"]).alias("n_repeated"),
        F.array_join(F.transform("s", lambda x: F.concat_ws(":", x["start"].cast("string"), x["stop"].cast("string"))), ",").alias("spans")))
