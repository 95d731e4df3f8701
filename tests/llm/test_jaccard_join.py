"""The vertical Jaccard join against a plain version."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm import brute
from tidegauge.llm import jaccard_join
from tests.llm.conftest import SMALL


def shingles(text, size):
    w = brute.words((text or "").translate(brute.LOWER))
    return {tuple(w[i:i + size]) for i in range(max(len(w) - size + 1, 1))} if w else set()


def plain(rows, size, percent):
    """(id, set size, least id reachable) of each row; null ids have no part in the least."""
    sets = [shingles(t, size) for _, t in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, j in itertools.combinations(range(len(rows)), 2):
        c = len(sets[i] & sets[j])
        if c and 100 * c >= percent * (len(sets[i]) + len(sets[j]) - c):
            parent[root(j)] = root(i)
    out = []
    for i, (d, _) in enumerate(rows):
        ids = [e for j, (e, _) in enumerate(rows) if e is not None and root(j) == root(i)]
        out.append((d, len(sets[i]), min(ids) if ids else None))
    return out


def edited(n, seed, words=120, most=4):
    """Texts that are edits of one, and a few of others."""
    rng = random.Random(seed)
    base = [f"b{rng.randrange(400)}" for _ in range(words)]
    out = []
    for k in range(n):
        own = list(base) if k % 5 else [f"o{k % 10}x{i}" for i in range(rng.randrange(1, words))]
        for _ in range(rng.randrange(most)):
            own[rng.randrange(len(own))] = f"e{rng.randrange(30)}"
        out.append(" ".join(own))
    return out


ORDER = lambda r: tuple((x is not None, x) for x in r)


def found(spark_rows, **options):
    return sorted((tuple(r) for r in jaccard_join.similar_documents(spark_rows, **options).collect()), key=ORDER)


def test_hard_rows(docs, rows):
    assert found(docs) == sorted(plain(rows, 4, 85), key=ORDER)
    assert jaccard_join.similar_documents(docs).columns == ["doc_id", "n_shingles", "component_id"]


@pytest.mark.parametrize("options", [{}, {"dense": 2}, {"tile": 7}, {"dense": 5, "tile": 3}, {"size": 5, "percent": 80, "tile": 16}])
def test_group_of_near_copies(spark, options):
    rows = list(enumerate(edited(120, 1)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert found(docs, **options) == sorted(plain(rows, options.get("size", 4), options.get("percent", 85)), key=ORDER)


def test_threshold_is_exact(spark):
    # 4-word sets of 17 and 20 grams with 17 in common: 17 of 20 is 85 percent; then one less.
    words = [f"w{i}" for i in range(23)]
    rows = [(1, " ".join(words)), (2, " ".join(words[:20])), (3, " ".join(f"v{i}" for i in range(23))), (4, " ".join(f"v{i}" for i in range(19)))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert found(docs) == [(1, 20, 1), (2, 17, 1), (3, 20, 3), (4, 16, 4)]


def test_long_texts_and_copies(spark):
    rng = np.random.default_rng(2)
    long = " ".join(f"w{x}" for x in rng.integers(0, 10**6, 700_000))  # over one piece of bytes
    rows = [(5, long), (3, long + " more"), (9, None), (8, ""), (7, "One two"), (6, "one  TWO"), (None, "one two"), (7, "one two")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = found(docs)
    size = len(shingles(long, 4))
    assert got == sorted([(5, size, 3), (3, size + 1, 3), (9, 0, 9), (8, 0, 8), (7, 1, 6), (6, 1, 6), (None, 1, 6), (7, 1, 6)], key=ORDER)


def test_links_are_few(spark):
    """A group of m near copies gives about m links, not m squared."""
    docs = spark.createDataFrame(list(enumerate(edited(300, 4, most=2))), "doc_id long, text string")
    _, links = jaccard_join.jaccard_links(docs, 4, 85, ["doc_id"])
    assert links.count() < 3 * 300


def test_partial_overlaps():
    rng = np.random.default_rng(3)
    for rows, grams in ((1, 5), (30, 40), (60, 9), (60, 3000)):
        a, b = (rng.random((rows, grams)) < 0.3 for _ in range(2))
        names = rng.permutation(10**6)[:grams].astype(np.uint64)
        (i, x), (j, y) = (np.nonzero(m) for m in (a, b))
        got = jaccard_join.partial_overlaps(i, names[x], j, names[y], (rows, rows), columns=16)
        assert (got == a.astype(int) @ b.T.astype(int)).all()


def test_no_documents(empty):
    assert jaccard_join.similar_documents(empty).count() == 0


def test_clashing_columns(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").limit(20).withColumns({c: F.lit(1) for c in ("node", "n", "bucket", "block", "kind", "a", "b", "hub")})
    assert jaccard_join.similar_documents(docs).count() == 20
