"""Phrase collocations by SON partitioning.

Words are per language; a phrase is ``LENGTHS`` words that follow each other within a
piece of a text (up to a punctuation mark or a line's end).

1. The input's partitions are dealt over ``SHARDS`` shards.  A shard is no task: its
   partitions count all their phrases, pre-aggregated and packed, and buckets of the
   phrase's hash add them up per shard.  A phrase is locally frequent if a shard with a
   share of n_i of a language's n words holds it at least support * n_i / n times.  A
   phrase with the support overall reaches that in one shard at least, so the union of
   the locally frequent ones loses nothing.  Each task sends its word counts along with
   its phrases to every bucket, so thresholds need no pass of their own.  The number of
   shards is fixed, so that the local support stays a few (support / ``SHARDS``): with a
   shard a task it would fall below one and let every phrase through.
2. The candidates, as sorted arrays in the shared folder, are counted over all texts,
   exactly, again pre-aggregated per task.  A position is looked at for k words only if
   its first k - 1 are a candidate.
3. Frequent phrases are a table; their parts' counts, the cuts, what longer phrases
   cover and the ranks are joins and aggregates of it.  The best of each language are
   found in rounds over ever fewer parts, so no task holds all phrases of a language.

Local counts are by 48 bits of a hash: phrases that fall together there can only add
candidates.  Global counts are by 64 bits, of the language and all words (N*N/2**65 pairs
of N distinct phrases are expected to fall together).  Scores are computed in decimals.

Null and empty texts have no words; a null language is ``und``.  Repeated rows count each
time.  Only the text and the language are read, so no other column can clash.
"""

from __future__ import annotations

import json
import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegauge.llm import hash_arrays
from tidegauge.llm.batches import buffer_of, encode, lower, pieces, word_spans
from tidegauge.llm.components import written
from tidegauge.llm.jaccard_join import _pack, _steps, _unpack
from tidegauge.session import work_dir

LENGTHS = 4
SUPPORT = 30
SHARDS = 10
#: Phrases that a task holds before it sends them on.
FLUSH = 3_000_000
#: Of 64-bit hashes, the bits left out of local counts.
_LOCAL = np.uint64(16)
_SHARD = np.uint64(0xFFFF)
_BREAK = np.zeros(256, bool)
_BREAK[[ord(c) for c in ".,;:!?\n\x0b\x0c\r"]] = True
_GAP = _BREAK.copy()
_GAP[[9, 32]] = True


def _mix(before: np.ndarray, word: np.ndarray) -> np.ndarray:
    """The hash of a phrase from that of all but its last word, and the last word's."""
    x = (before ^ word) * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(29)
    x = (x + word) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def _hash(data: bytes) -> int:
    return xxhash.xxh3_64_intdigest(data)


class _Words:
    """The words of a batch: hash, language, and how many words of its piece follow."""

    def __init__(self, texts: pa.Array, langs: pa.Array):
        raw, offsets = buffer_of(texts)
        raw = lower(raw)
        starts, ends, rows = word_spans(raw, offsets, _GAP)
        self.codes, self.distinct = encode(raw, starts, ends)
        self.hashes = np.fromiter(map(_hash, self.distinct.to_pylist()), np.uint64, len(self.distinct))
        self.word = self.hashes[self.codes] if len(self.codes) else np.zeros(0, np.uint64)
        named = langs.dictionary_encode()
        self.langs = named.dictionary.to_pylist()
        self.lang = np.repeat(named.indices.to_numpy(), np.diff(rows))
        n = len(starts)
        cut = np.ones(n + 1, bool)  # whether a word begins a piece
        if n:
            breaks = np.zeros(len(raw) + 1, np.int32 if len(raw) < 2**31 else np.int64)
            np.cumsum(_BREAK[raw], dtype=breaks.dtype, out=breaks[1:])
            cut[1:n] = breaks[starts[1:]] > breaks[ends[:-1]]
            cut[rows[:-1][rows[:-1] < n]] = True
        at = np.flatnonzero(cut)
        self.left = np.repeat(at[1:], np.diff(at)) - np.arange(n)

    def totals(self) -> dict:
        return dict(zip(self.langs, np.bincount(self.lang, minlength=len(self.langs)).tolist(), strict=True))

    def grams(self, keep=None):
        """For 1 to ``LENGTHS`` words: positions and hashes of the phrases; ``keep`` says which to go on from."""
        seed = np.array([_hash(name.encode()) for name in self.langs], np.uint64)
        at = np.arange(len(self.word))
        key = seed[self.lang] if len(at) else np.zeros(0, np.uint64)
        for k in range(LENGTHS):
            there = self.left[at] > k
            at, key = at[there], key[there]
            key = _mix(key, self.word[at + k])
            if keep is not None:
                there = keep(key)
                at, key = at[there], key[there]
            yield k + 1, at, key


def _merge(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys)
    keys, n = keys[order], n[order]
    at = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
    return keys[at], np.add.reduceat(n, at, dtype=np.int64) if len(at) else n


def _end_to_end(parts: list[np.ndarray]) -> np.ndarray:
    """The arrays of a list as one; the list is empty then."""
    whole = np.concatenate(parts)
    parts.clear()
    return whole


MINED = "bucket int, shard int, langs string, block binary"


def _mine(bits: int, shards: int):
    """Task: all phrases with their counts, by bucket, and the words of each language to every bucket."""
    def run(batches):
        shard = TaskContext.get().partitionId() % shards
        total: dict = {}
        held: dict = {}
        size = 0

        def flush():
            names = sorted(held)
            merged = {x: _merge(*map(np.concatenate, zip(*held.pop(x), strict=True))) for x in names}
            cuts = {x: np.searchsorted(k >> np.uint64(48 - bits), np.arange((1 << bits) + 1)) for x, (k, _) in merged.items()}
            out = []
            for b in range(1 << bits):
                own = [x for x in names if cuts[x][b] < cuts[x][b + 1]]
                if own:
                    slices = [(merged[x][0][cuts[x][b]:cuts[x][b + 1]], merged[x][1][cuts[x][b]:cuts[x][b + 1]]) for x in own]
                    out.append((b, json.dumps([own, None]), _pack(
                        np.array([len(k) for k, _ in slices]), np.concatenate([_steps(k) for k, _ in slices]), np.concatenate([n for _, n in slices]))))
            return out

        def batch(items):
            return pa.RecordBatch.from_arrays(
                [pa.array([i[0] for i in items], pa.int32()), pa.array([shard] * len(items), pa.int32()),
                 pa.array([i[1] for i in items], pa.string()), pa.array([i[2] for i in items], pa.binary())], ["bucket", "shard", "langs", "block"])

        for piece in pieces(batches):
            words = _Words(piece.column("text"), piece.column("lang"))
            for x, n in words.totals().items():
                total[x] = total.get(x, 0) + n
            # One language at a time, and counts in few bytes: what a task holds at once is bounded by this.
            found = [(words.lang[at], key >> _LOCAL) for _, at, key in words.grams()]
            for i, x in enumerate(words.langs):
                own, n = np.unique(np.concatenate([key[lang == i] for lang, key in found]), return_counts=True)
                if len(own):
                    held.setdefault(x, []).append((own, n.astype(np.min_scalar_type(int(n.max())))))
                    size += len(own)
            del words, found
            if size > FLUSH:
                yield batch(flush())
                held, size = {}, 0
        if held:
            yield batch(flush())
        if total:
            none = np.zeros(0, np.uint64)
            yield batch([(b, json.dumps([[], total]), _pack(none, none, none)) for b in range(1 << bits)])

    return run


def _frequent_somewhere(uri: str, bits: int, support: int):
    """Task: writes the hashes that are locally frequent in a shard, per bucket, as arrays of the shared folder."""
    from tidegauge.llm.jaccard_join import _runs

    def run(batches):
        for (bucket,), held in _runs(batches, ("bucket",)):
            names: dict = {}
            total: dict = {}
            keys, counts, langs = [], [], []
            for b in held:
                for shard, head, block in zip(*(b.column(c).to_pylist() for c in ("shard", "langs", "block")), strict=True):
                    own, words = json.loads(head)
                    for x, n in (words or {}).items():
                        names.setdefault(x, len(names))
                        total[names[x], shard] = total.get((names[x], shard), 0) + n
                    if own:
                        lengths, steps, n = _unpack(block)
                        lengths = lengths.astype(np.int64)
                        key = np.cumsum(steps, dtype=np.uint64)
                        # Differences begin anew with each language.
                        starts = np.concatenate(([0], np.cumsum(lengths)[:-1]))
                        before = np.where(starts > 0, key[np.maximum(starts - 1, 0)], np.uint64(0))
                        # The hash, and the shard in the bits that local counts leave out.
                        keys.append((key - np.repeat(before, lengths)) << _LOCAL | np.uint64(shard))
                        counts.append(n.astype(np.min_scalar_type(int(n.max()))))
                        langs.append(np.repeat(np.array([names.setdefault(x, len(names)) for x in own], np.int32), lengths))
            if not keys:
                continue
            whole = [sum(v for (x, _), v in total.items() if x == i) for i in range(len(names))]
            least = np.zeros((len(names), 1 + max(s for _, s in total)), np.int64)
            for (i, s), v in total.items():
                least[i, s] = -(-support * v // max(whole[i], 1))
            least = least.astype(np.min_scalar_type(int(least.max())))
            # A bucket's rows are many: columns are narrow, and gone when they are done with.
            key = _end_to_end(keys)
            limit = least[_end_to_end(langs), (key & _SHARD).astype(np.uint16)]
            n = _end_to_end(counts)
            order = np.argsort(key)
            key, n, limit = key[order], n[order], limit[order]
            del order
            at = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
            # Where phrases of two languages fall together the lesser threshold holds.
            frequent = np.add.reduceat(n, at, dtype=np.int64) >= np.minimum.reduceat(limit, at)
            found = np.unique(key[at[frequent]] >> _LOCAL)
            hash_arrays.save(uri, f"{bucket}.keys", found.astype("<u8"))
            yield pa.RecordBatch.from_arrays([pa.array([len(found)])], ["n"])

    return run


def _known(uri: str, bits: int, keys: np.ndarray) -> np.ndarray:
    """Which hashes (of 64 bits) are candidates."""
    own, inverse = np.unique(keys >> _LOCAL, return_inverse=True)
    there = np.zeros(len(own), bool)
    cuts = np.searchsorted(own >> np.uint64(48 - bits), np.arange((1 << bits) + 1))
    for b in np.flatnonzero(np.diff(cuts)).tolist():
        array = hash_arrays.load(uri, f"{b}.keys", "<u8")
        if len(array):
            x = own[cuts[b]:cuts[b + 1]]
            there[cuts[b]:cuts[b + 1]] = array[np.minimum(np.searchsorted(array, x), len(array) - 1)] == x
    return there[inverse]


COUNTED = "bucket int, lang string, k int, block binary, total long, word binary, hash long"


def _count(uri: str, bits: int):
    """Task: candidates with their counts and words, each language's number of words, and the words' texts."""
    def run(batches):
        total: dict = {}
        held: dict = {}
        texts: dict = {}
        size = 0

        def rows(bucket, lang, k, block, total_, word, hash_):
            return pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip((bucket, lang, k, block, total_, word, hash_), (
                    pa.int32(), pa.string(), pa.int32(), pa.binary(), pa.int64(), pa.binary(), pa.int64()), strict=True)],
                ["bucket", "lang", "k", "block", "total", "word", "hash"])

        def flush():
            out = []
            for (lang, k), parts in held.items():
                key, n, *words = (np.concatenate(c) for c in zip(*parts, strict=True))
                order = np.argsort(key)
                key, n = key[order], n[order]
                at = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
                n, words, bucket = np.add.reduceat(n, at), [w[order][at] for w in words], (key[at] >> np.uint64(64 - bits)).astype(np.int64)
                # In the order of their words, these compress well.
                order = np.lexsort((*words[::-1], bucket))
                n, words, bucket = n[order], [w[order] for w in words], bucket[order]
                cuts = np.searchsorted(bucket, np.arange((1 << bits) + 1))
                for b in np.flatnonzero(np.diff(cuts)).tolist():
                    p, q = cuts[b], cuts[b + 1]
                    out.append((b, lang, k, _pack(n[p:q], *(w[p:q] for w in words))))
            none = [None] * len(out)
            return rows(*(zip(*out, strict=True) if out else ((),) * 4), none, none, none)

        for piece in pieces(batches):
            words = _Words(piece.column("text"), piece.column("lang"))
            for x, n in words.totals().items():
                total[x] = total.get(x, 0) + n
            used = np.zeros(len(words.hashes), bool)
            for k, at, key in words.grams(lambda key: _known(uri, bits, key)):
                used[words.codes[at + k - 1]] = True
                own, first, n = np.unique(key, return_index=True, return_counts=True)
                first = at[first]
                lang = words.lang[first]
                for i, x in enumerate(words.langs):
                    of = np.flatnonzero(lang == i)
                    if len(of):
                        held.setdefault((x, k), []).append((own[of], n[of], *(words.word[first[of] + j] for j in range(k))))
                        size += len(of)
            for h, w in zip(words.hashes[used].tolist(), words.distinct.filter(pa.array(used)).to_pylist(), strict=True):
                texts[h] = w
            if size > FLUSH:
                yield flush()
                held, size = {}, 0
        if held:
            yield flush()
        none = [None] * len(total)
        yield rows(none, list(total), none, none, list(total.values()), none, none)
        none = [None] * len(texts)
        yield rows(none, none, none, none, none, list(texts.values()), np.array(list(texts), np.uint64).view(np.int64))

    return run


def _add_up(support: int):
    """Task: phrases of the support, with their words' hashes."""
    from tidegauge.llm.jaccard_join import _runs

    def run(batches):
        for (_, lang, k), held in _runs(batches, ("bucket", "lang", "k")):
            n, *words = (np.concatenate(c) for c in zip(*(_unpack(x) for b in held for x in b.column("block").to_pylist()), strict=True))
            order = np.lexsort(words[::-1])
            n, words = n[order].astype(np.int64), np.stack([w[order] for w in words], 1)
            at = np.flatnonzero(np.append(True, (words[1:] != words[:-1]).any(1)))
            a = np.add.reduceat(n, at)
            words, a = words[at][a >= support], a[a >= support]
            w = pa.ListArray.from_arrays(pa.array(np.arange(len(a) + 1, dtype=np.int32) * k), pa.array(words.reshape(-1).view(np.int64)))
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(a), pa.string()), w, pa.array(a)], ["lang", "w", "a"])

    return run


def frequent_phrases(docs: DataFrame, text: str = "text", lang: str = "lang", support: int = SUPPORT,
                     shards: int = SHARDS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Phrases (lang, w: hashes of 1 to ``LENGTHS`` words, a), word totals (lang, n) and words (hash, word)."""
    if shards > 1 << 16:
        raise ValueError("a shard's number has 16 bits")
    spark = docs.sparkSession
    bits = max(2, (int(spark.conf.get("spark.sql.shuffle.partitions")) - 1).bit_length())
    sent = docs.select(docs[text].cast("string").alias("text"), F.coalesce(docs[lang].cast("string"), F.lit("und")).alias("lang"))
    uri = hash_arrays.make_folder(work_dir(spark, "candidates"))
    mined = sent.mapInArrow(_mine(bits, shards), MINED)
    mined.repartitionById(1 << bits, F.col("bucket")).sortWithinPartitions("bucket").mapInArrow(
        _frequent_somewhere(uri, bits, support), "n long").agg(F.sum("n")).collect()
    counted = written(sent.mapInArrow(_count(uri, bits), COUNTED), "counts")
    blocks = counted.where("block is not null").select("bucket", "lang", "k", "block")
    phrases = written(blocks.repartitionById(1 << bits, F.col("bucket")).sortWithinPartitions("bucket", "lang", "k").mapInArrow(
        _add_up(support), "lang string, w array<long>, a long"), "phrases")
    totals = counted.where("total is not null").groupBy("lang").agg(F.sum("total").alias("n"))
    words = counted.where("word is not null").groupBy("hash").agg(F.min("word").cast("string").alias("word"))
    return phrases, totals, words


def score(a: Column, l: Column, r: Column) -> Column:  # noqa: E741
    """floor(2000000 * a / (l + r)), exactly."""
    exact = lambda c: c.cast("decimal(20,0)")
    return F.call_function("div", exact(a) * F.lit(2_000_000).cast("decimal(7,0)"), exact(l) + exact(r))


def collocations(docs: DataFrame, text: str = "text", lang: str = "lang", support: int = SUPPORT, best: int = 2000,
                 covered: int = 80, shards: int = SHARDS) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the best phrases of two or more words of each language.

    A phrase is cut into two parts that count l and r where its score is lowest.  One of
    which ``covered`` in a hundred occurrences lie in a longer phrase is left out.
    """
    phrases, totals, words = frequent_phrases(docs, text, lang, support, shards)
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    longer = phrases.where("size(w) > 1")
    cuts = longer.select("lang", "w", "a", F.explode(F.sequence(F.lit(1), F.size("w") - 1)).alias("k")).select(
        "*", F.slice("w", F.lit(1), F.col("k")).alias("head"), F.slice("w", F.col("k") + 1, F.size("w") - F.col("k")).alias("tail"))
    for side, count in (("head", "l"), ("tail", "r")):
        cuts = cuts.join(phrases.select("lang", F.col("w").alias(side), F.col("a").alias(count)), ["lang", side])
    cut = F.struct(score(F.col("a"), F.col("l"), F.col("r")).alias("score"), "k", "l", "r")
    scored = cuts.groupBy("lang", "w", "a").agg(F.min(cut).alias("cut"))
    # Parts of two words and more of longer phrases, each with the most frequent phrase that holds it.
    inside = longer.where("size(w) > 2").select("lang", "a", "w", F.explode(F.sequence(F.lit(2), F.size("w") - 1)).alias("k"))
    inside = inside.select("lang", "a", "w", "k", F.explode(F.sequence(F.lit(1), F.size("w") - F.col("k") + 1)).alias("p")).select(
        "lang", "a", F.slice("w", F.col("p"), F.col("k")).alias("w"))
    most = inside.groupBy("lang", "w").agg(F.max("a").alias("most"))
    exact = lambda c, x: F.col(c).cast("decimal(20,0)") * F.lit(x).cast("decimal(3,0)")
    kept = scored.join(most, ["lang", "w"], "left").where(F.col("most").isNull() | (exact("most", 100) < exact("a", covered)))
    kept = kept.select("lang", "w", "a", "cut.score", "cut.l", "cut.r", F.pmod(F.xxhash64("w"), F.lit(parts)).alias("part"))
    order = [F.desc("score"), F.desc("a")]
    # Before texts are known all that tie with the last one stay.
    kept = kept.withColumn("rank", F.rank().over(Window.partitionBy("lang", "part").orderBy(*order))).where(F.col("rank") <= best).drop("rank")
    kept = written(kept, "scored")
    spelled = kept.select("lang", "w", F.posexplode("w").alias("p", "hash")).join(words, "hash").groupBy("lang", "w").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("p", "word"))), lambda x: x["word"]), " ").alias("phrase"))
    top = kept.join(spelled, ["lang", "w"])
    for groups in (parts, math.isqrt(parts) + 1, 1):
        of = Window.partitionBy("lang", "part").orderBy(*order, "phrase")
        top = top.withColumn("part", F.col("part") % groups).withColumn("rank", F.row_number().over(of)).where(F.col("rank") <= best)
    return top.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
