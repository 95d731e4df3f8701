"""Language identification by prediction by partial matching over bytes.

Each language has a tree of byte contexts up to ``ORDER`` bytes.  A byte is coded in
the longest context that was seen in training: if the context knows the byte, its
share of the counts is the probability; if not, the context's escape probability is
paid and the next shorter context is asked, down to a uniform byte.  Escapes are by
the number of different bytes seen (method C).  The statistics are frozen, so the
code length of a text is a sum of terms that depend on four bytes at most, and a
batch is scored by its distinct grams.

The trees are fitted to a bounded sample: of each language the ``SAMPLE`` labelled
rows of least hash, of which all bytes are counted.  A tree is a few sorted arrays in the
shared folder, built in a task of its own and mapped by the workers; names of languages
are all that is sent around.  Scoring covers every byte of every text.

Rows without a text or a language teach nothing; repeated rows count as rows of one hash.
Columns kept are in a struct, so no name can clash.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidegauge.llm import hash_arrays
from tidegauge.llm.batches import annotate, buffer_of, row_sums
from tidegauge.llm.components import written
from tidegauge.llm.jaccard_join import _runs
from tidegauge.session import work_dir

ORDER = 3
#: Labelled rows of each language to learn from.
SAMPLE = 400


class Tree:
    """The context tree of one language, as sorted arrays: for k = 0 to ``ORDER`` the grams of
    k+1 bytes, packed into an integer, with the bits to code their last byte in the context of
    the others, and the contexts of k bytes with the bits to escape from them."""

    def __init__(self, arrays: list[np.ndarray]):
        self.levels = [arrays[4 * k:4 * k + 4] for k in range(ORDER + 1)]

    @classmethod
    def fit(cls, grams: np.ndarray, counts: np.ndarray) -> Tree:
        """``grams``: distinct grams of ``ORDER`` + 1 bytes."""
        arrays: list[np.ndarray] = []
        for k in range(ORDER, -1, -1):
            keys, where = np.unique(grams & ((1 << (8 * (k + 1))) - 1), return_inverse=True)
            counts = np.bincount(where, counts, len(keys))
            contexts, where = np.unique(keys >> 8, return_inverse=True)
            total, kinds = np.bincount(where, counts), np.bincount(where)
            arrays = [keys.astype("<u4"), -np.log2(counts / (total + kinds)[where]).astype("<f4"),
                      contexts.astype("<u4"), -np.log2(kinds / (total + kinds)).astype("<f4"), *arrays]
            grams = keys
        return cls(arrays)

    def save(self, uri: str, number: int) -> None:
        for k, level in enumerate(self.levels):
            for i, array in enumerate(level):
                hash_arrays.save(uri, f"{number}.{k}.{i}", array)

    @classmethod
    def open(cls, uri: str, number: int) -> Tree:
        return cls([hash_arrays.load(uri, f"{number}.{k}.{i}", "<f4" if i % 2 else "<u4") for k in range(ORDER + 1) for i in range(4)])

    @staticmethod
    def _at(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        i = np.minimum(np.searchsorted(keys, wanted.astype(np.uint32)), len(keys) - 1)
        return i, keys[i] == wanted

    def bits(self, grams: np.ndarray, order: int = ORDER) -> np.ndarray:
        """Exact code lengths of the last byte of each gram of order+1 bytes."""
        out, open_ = np.zeros(len(grams)), np.arange(len(grams))
        for k in range(order, -1, -1):
            keys, cost, contexts, escape = self.levels[k]
            own = grams[open_] & ((1 << (8 * (k + 1))) - 1)
            i, found = self._at(keys, own)
            out[open_[found]] += cost[i[found]]
            open_, own = open_[~found], own[~found]
            i, found = self._at(contexts, own >> 8)  # one never seen costs nothing to leave
            out[open_[found]] += escape[i[found]]
        out[open_] += 8.0
        return out


def score(trees: list[Tree], raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Bits of each row in each language."""
    n = len(raw)
    out = np.zeros((len(offsets) - 1, len(trees)))
    if not n:
        return out
    within = np.arange(n) - np.repeat(offsets[:-1], np.diff(offsets))
    packed = raw.astype(np.uint32)
    for j in range(1, ORDER + 1):
        packed[j:] |= raw[:-j].astype(np.uint32) << np.uint32(8 * j)
    starts = [np.flatnonzero(within == k) for k in range(ORDER)]  # the first bytes of a text have shorter contexts
    grams, where = np.unique(packed, return_inverse=True)
    heads = [np.unique(packed[at] & np.uint32((1 << (8 * (k + 1))) - 1), return_inverse=True) for k, at in enumerate(starts)]
    for c, tree in enumerate(trees):
        cost = tree.bits(grams.astype(np.int64))[where]
        for k, (at, (head, of)) in enumerate(zip(starts, heads, strict=True)):
            cost[at] = tree.bits(head.astype(np.int64), k)[of]
        out[:, c] = row_sums(cost, offsets)
    return out


class Model(NamedTuple):
    """Where the trees are, and their languages in the order of their numbers."""

    uri: str
    languages: list[str]


def _sample(docs: DataFrame, lang: str, text: str, doc_id: str, size: int, keep_key: bool = False) -> DataFrame:
    """At most ``size`` rows of each language: those of least hash of their id, then of their text.

    The least hashes are found in rounds over ever fewer parts of a language, so that no
    task sees more of one than ``size`` rows of each of eight parts.
    """
    keyed = docs.where(docs[lang].isNotNull() & docs[text].isNotNull()).select(
        docs[lang].cast("string").alias("lang"), docs[text].cast("string").alias("text"),
        F.xxhash64(docs[doc_id].cast("string")).alias("key"))
    least = keyed.select("lang", "key").withColumn("part", F.pmod(F.hash("key"), F.lit(64)))
    for parts in (64, 8, 1):
        least = least.withColumn("part", F.col("part") % parts)
        rank = F.row_number().over(Window.partitionBy("lang", "part").orderBy("key"))
        least = least.withColumn("rank", rank).where(F.col("rank") <= size).drop("rank")
    # One number a language, whose names come to the driver anyway; a join could deal all texts by language.
    most = {r.lang: r.most for r in least.groupBy("lang").agg(F.max("key").alias("most")).collect()}
    if not most:
        return keyed.limit(0).select("lang", "text", *["key"] * keep_key)
    limit = F.create_map(*[F.lit(x) for pair in sorted(most.items()) for x in pair])
    chosen = keyed.where(F.col("key") <= F.element_at(limit, F.col("lang"))).withColumn(
        "part", F.pmod(F.hash("key", "text", F.monotonically_increasing_id()), F.lit(64)))
    # Rows of one id, should they be many, are cut here.
    for parts in (64, 8, 1):
        chosen = chosen.withColumn("part", F.col("part") % parts)
        rank = F.row_number().over(Window.partitionBy("lang", "part").orderBy("key", F.xxhash64("text")))
        chosen = chosen.withColumn("rank", rank).where(F.col("rank") <= size).drop("rank")
    return chosen.select("lang", "text", *["key"] * keep_key)


def train(docs: DataFrame, lang: str = "lang", text: str = "text", doc_id: str = "doc_id", sample: int = SAMPLE) -> Model | None:
    """Fit the trees; None where no row has both a text and a language.

    Grams are counted in Spark, and a tree is built by the task that has a language's; the
    names of the languages come to the driver.
    """
    def run(batches):
        for b in batches:
            for name in sorted(set(b.column("lang").to_pylist())):
                own = b.filter(pc.equal(b.column("lang"), name))
                raw, offsets = buffer_of(own.column("text"))
                if len(raw) <= ORDER:
                    continue
                n = len(raw) - ORDER
                gram = sum(raw[j:j + n].astype(np.int64) << (8 * (ORDER - j)) for j in range(ORDER + 1))
                inside = np.ones(n, bool)
                for j in range(1, ORDER + 1):  # no gram spans two texts
                    at = offsets[1:-1] - j
                    inside[at[(at >= 0) & (at < n)]] = False
                keys, counts = np.unique(gram[inside], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(keys)), pa.array(keys), pa.array(counts)],
                                                 ["lang", "gram", "n"])

    spark = docs.sparkSession
    uri = hash_arrays.make_folder(work_dir(spark, "trees"))
    counted = written(_sample(docs, lang, text, doc_id, sample).mapInArrow(run, "lang string, gram long, n long")
                      .groupBy("lang", "gram").agg(F.sum("n").alias("n")), "language-grams")
    names = sorted(r.lang for r in counted.select("lang").distinct().collect())
    if not names:
        return None
    number = {name: i for i, name in enumerate(names)}

    def build(batches):
        for (name,), held in _runs(batches, ("lang",)):
            own = pa.Table.from_batches(held)
            Tree.fit(own.column("gram").to_numpy(), own.column("n").to_numpy()).save(uri, number[name])
        yield pa.RecordBatch.from_arrays([pa.array([], pa.string())], ["lang"])

    counted.repartition("lang").sortWithinPartitions("lang").mapInArrow(build, "lang string").count()
    return Model(uri, names)


def identify(docs: DataFrame, model: Model | None, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Columns ``row`` and ``out``: lang_pred and score.

    ``score`` is the posterior of the language per 16 bytes of code, so that it does
    not saturate on long texts.  Null texts, texts without a letter, and all texts if
    nothing was learned, are ``und`` with score 0.  Ties go to the first name.
    """
    def make():
        trees = [Tree.open(model.uri, i) for i in range(len(model.languages))] if model else []

        def work(texts: pa.Array) -> list:
            raw, offsets = buffer_of(texts)
            lettered = pc.fill_null(pc.match_substring_regex(texts, r"\p{L}"), False).to_numpy(zero_copy_only=False)
            if model is None:
                return [pa.array(["und"] * len(texts), pa.string()), np.zeros(len(texts))]
            bits = score(trees, raw, offsets)
            best = bits.argmin(1)
            per = np.maximum(np.diff(offsets) / 16, 1)[:, None]
            share = np.exp2(-(bits - bits.min(1, keepdims=True)) / per)
            posterior = np.where(lettered, 1 / share.sum(1), 0.0)
            names = np.array([*model.languages, "und"], object)
            return [pa.array(names[np.where(lettered, best, len(model.languages))], pa.string()), posterior]
        return work

    return annotate(docs, text, make, "lang_pred string, score double", keep)
