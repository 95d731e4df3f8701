"""Collocations against a plain version."""

import json
import random
import re
import tracemalloc
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tests.llm import brute
from tidegauge.llm import phrases


def plain(rows, support, best, covered=80):
    """lang, rank, phrase, a, l, r, n, score of (lang, text) rows, with dictionaries."""
    f, n = {}, Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(brute.LOWER)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, 5):
                f.setdefault(lang, Counter()).update(tuple(w[i:i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, count in f.items():
        frequent = {p: a for p, a in count.items() if a >= support}
        gone = {p[i:i + k] for p, a in frequent.items() for k in range(2, len(p)) for i in range(len(p) - k + 1)
                if 100 * a >= covered * frequent[p[i:i + k]]}
        found = []
        for p, a in frequent.items():
            if len(p) > 1 and p not in gone:
                s, k = min((2_000_000 * a // (count[p[:k]] + count[p[k:]]), k) for k in range(1, len(p)))
                found.append((-s, -a, " ".join(p).encode(), count[p[:k]], count[p[k:]]))
        for rank, (s, a, p, left, right) in enumerate(sorted(found)[:best], 1):
            out.append((lang, rank, p.decode(), -a, left, right, n[lang], -s))
    return sorted(out)


def some(n, seed):
    rng = random.Random(seed)
    words = ["Of", "the", "a", "é", "日本", "x-y", "it's", "New", "york", "city", "　"]
    out = []
    for _ in range(n):
        parts = [rng.choice(["new york city hall", rng.choice(words), rng.choice(words), "NEW York"]) + rng.choice([" ", " ", "\t ", ". ", "\n", ",", "! "])
                 for _ in range(rng.randrange(60))]
        out.append((rng.choice(["en", "en", "en", "fr", None, "und"]), "".join(parts)))
    return out


@pytest.mark.parametrize("shards, best, partitions", [(4, 2000, 6), (1, 5, 3), (10, 40, 2)])
def test_against_plain(spark, shards, best, partitions):
    rows = some(150, shards) + [("de", None), (None, ""), ("en", " . "), ("fr", "the")]
    docs = spark.createDataFrame(rows, "lang string, text string").repartition(partitions).withColumns(
        {c: F.lit(1) for c in ("w", "a", "n", "k", "hash", "bucket", "phrase", "rank")})
    got = sorted(tuple(r) for r in phrases.collocations(docs, support=5, best=best, shards=shards).collect())
    assert got == plain(rows, 5, best)


def test_hard_rows_and_long_texts(docs, rows, spark):
    long = " ".join(random.Random(1).choice(["of", "the", "x", "y.", "z"]) for _ in range(1_500_000))
    more = spark.createDataFrame([(1, long), (2, "no space" * 700_000)], "doc_id long, text string").withColumn("lang", F.lit("xx"))
    both = docs.select("doc_id", "text", "lang").unionAll(more)
    want = plain([("en", t) for _, t in rows] + [("xx", long), ("xx", "no space" * 700_000)], 30, 2000)
    assert sorted(tuple(r) for r in phrases.collocations(both).collect()) == want


def test_locally_frequent_loses_nothing(spark):
    """A phrase of just the support, spread thinly over all shards, in languages of unequal shards."""
    rows = [("en", f"rare pair {i}" if i % 4 == 0 else f"filler{i} words{i % 7} here") for i in range(48)] + [("fr", "rare pair")] * 3
    docs = spark.createDataFrame(rows, "lang string, text string").repartitionByRange(12, "text")
    got = sorted(tuple(r) for r in phrases.collocations(docs, support=12, shards=12).collect())
    assert got == plain(rows, 12, 2000) and got[0][2] == "rare pair"


def test_score_is_exact(spark):
    big = 2**62 + 1
    rows = [(big, big, big), (big, 2**63 - 1, 2**63 - 1), (1, 3, 4), (30, 31, 2**63 - 1)]
    frame = spark.createDataFrame(rows, "a long, l long, r long").select("*", phrases.score(F.col("a"), F.col("l"), F.col("r")).alias("s"))
    assert [r.s for r in frame.collect()] == [2_000_000 * a // (x + y) for a, x, y in rows]


def test_no_documents(empty):
    assert phrases.collocations(empty).count() == 0


def mined(shard, langs, key, n, total):
    """A row of ``_mine``: sorted hashes of each language with their counts."""
    steps = np.concatenate([phrases._steps(k) for k in key])
    block = phrases._pack(np.array([len(k) for k in key]), steps, np.concatenate(n))
    return pa.RecordBatch.from_arrays(
        [pa.array([0], pa.int32()), pa.array([shard], pa.int32()), pa.array([json.dumps([langs, total])]), pa.array([block], pa.binary())],
        ["bucket", "shard", "langs", "block"])


def locally_frequent(folder, batches, support):
    list(phrases._frequent_somewhere(phrases.hash_arrays.make_folder(str(folder)), 0, support)(iter(batches)))
    return np.fromfile(folder / "0.keys", "<u8").tolist()


def test_a_bucket_is_added_up_in_narrow_columns(tmp_path):
    batches, sums = [], Counter()
    for shard in range(20):
        key = np.unique(np.random.default_rng(shard).integers(0, 400_000, 100_000).astype(np.uint64))
        n = np.random.default_rng(shard + 99).integers(1, 4, len(key)).astype(np.uint64)
        batches.append(mined(shard % 10, ["a"], [key], [n], {"a": 1000}))
        for k, c in zip(key.tolist(), n.tolist(), strict=True):
            sums[k, shard % 10] += c
    rows = sum(phrases._unpack(b.column("block")[0].as_py())[0][0] for b in batches)
    tracemalloc.start()
    try:
        found = locally_frequent(tmp_path, batches, 30)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert found == sorted({k for (k, _), c in sums.items() if c >= 3})
    assert peak < 50 * int(rows)


def test_languages_that_fall_together_lose_nothing(tmp_path):
    one, key = np.array([1], np.uint64), np.array([7], np.uint64)
    # Of "a" a shard needs 5 of 10; of "b" it has a tenth and needs 1.
    batches = [mined(0, ["a"], [key], [one], {"a": 50, "b": 10}), mined(0, ["b"], [key], [one], None),
               mined(1, ["a"], [np.array([9], np.uint64)], [one], {"a": 50, "b": 90})]
    assert locally_frequent(tmp_path, batches, 10) == [7]


def test_a_task_holds_little_while_it_counts(monkeypatch):
    monkeypatch.setattr(phrases.TaskContext, "get", staticmethod(lambda: type("Task", (), {"partitionId": lambda self: 3})()))
    pick = random.Random(5)
    texts = [" ".join(f"w{pick.randrange(3000)}" for _ in range(1000)) for _ in range(700)]
    batch = pa.record_batch([pa.array(texts), pa.array(["a", "b"] * 350)], ["text", "lang"])
    tracemalloc.start()
    try:
        rows = list(phrases._mine(2, 10)(iter([batch])))
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    counted = sum(int(phrases._unpack(block)[2].sum()) for r in rows for block in r.column("block").to_pylist())
    assert counted == 700 * (1000 + 999 + 998 + 997)
    assert peak < 60 * counted
