"""The pipeline's stages against plain versions, each on its own input."""

import hashlib
import itertools
import random

from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm import brute
from tests.llm.conftest import SMALL
from tests.llm.test_jaccard_join import shingles
from tidegauge.llm import quality
from tidegauge.llm.components import written
from tidegauge.llm.queries import ORACLE_SQL, QUERIES


def groups(rows):
    """Least id of each group: fingerprints within two bits or 5-word sets of a similarity of 0.8, and whatever they connect."""
    parent = {d: d for d, _ in rows}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    def link(a, b):
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)

    for d, _, g in brute.simhash_groups(rows):
        link(d, g)
    sets = [(d, shingles(t, 5)) for d, t in rows]
    for (d, x), (e, y) in itertools.combinations(sets, 2):
        if x and len(x & y) >= 0.8 * len(x | y):
            link(d, e)
    return sorted({root(d) for d, _ in rows})


def texts_of(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


def test_stages(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    first = docs.first().text
    long = " ".join(f"{first} {i}" for i in range(-(-5_000_000 // len(first))))  # over one piece of bytes
    extra = spark.createDataFrame(
        [(None, first, "en", "s", 1), (None, first, "en", "s", 1), (990_000, None, None, None, None), (990_001, "", "en", "s", 0),
         (990_002, long, "en", "s", len(long))], docs.schema)
    # Names of the operators' own columns must not matter.
    clash = {c: F.lit(1) for c in ("row", "out", "own", "a", "b", "node", "of", "spans", "kept", "first")}
    docs = docs.unionAll(extra).withColumns(clash)
    stage = dict(corpus_pipeline.STAGES)
    kept = written(stage["quality_rules"](spark, docs, SMALL), "t")
    assert kept.columns == docs.columns
    measured = quality.measure(docs, keep=["doc_id"])
    judged = quality.judge(measured, quality.fit_votes(measured))
    assert kept.count() == judged.where("kept").count() < docs.count()
    assert not any(brute.quality(t)[5] for _, t in texts_of(kept))

    # Each stage takes the long text too, whatever the rules say of it, and rows without text or id.
    kept = kept.unionAll(docs.where("doc_id >= 990000 or doc_id is null")).dropDuplicates(["doc_id", "text"])
    kept = written(kept.unionAll(kept.where("doc_id = 990002")), "t")
    left = written(stage["near_duplicates"](spark, kept, SMALL), "t")
    assert left.columns == docs.columns
    rows = [(2**62 if d is None else d, t) for d, t in dict.fromkeys(texts_of(kept))]
    assert sorted(2**62 if d is None else d for d, _ in texts_of(left)) == groups(rows)

    left = written(left.unionAll(kept.where("text is null or doc_id = 990002")), "t")
    clean = written(stage["decontamination"](spark, left, SMALL), "t")
    assert clean.columns == docs.columns
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    texts = texts_of(left)
    hits = brute.contamination([t for _, t in texts], items)
    assert sorted(d or -1 for d, _ in texts_of(clean)) == sorted(d or -1 for (d, _), h in zip(texts, hits) if not h[1])

    safe = written(stage["secrets"](spark, clean, SMALL), "t")
    assert safe.columns == docs.columns and safe.count() == clean.count()
    before = dict(texts_of(clean))
    for r in safe.collect():
        assert not brute.base_secrets(r.text)
        assert r.text == before[r.doc_id] or ("[SECRET]" in r.text and r.n_chars == len(r.text))

    out = stage["tokens"](spark, safe, SMALL).collect()
    want = sorted(((d or -1, n, i, h) for d, n, i, h in brute.bpe_rows(texts_of(safe))))
    assert sorted((r.doc_id or -1, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in out) == want
    assert all(hashlib.sha256(b"".join(i.to_bytes(4, "little") for i in r.ids)).hexdigest() == r.ids_sha256 for r in out)


def test_rows_without_ids_and_equal_rows(spark):
    text = " ".join(f"word{i}" for i in range(80))
    other = " ".join(f"term{i}" for i in range(80))
    docs = spark.createDataFrame(
        [(None, text), (None, text), (None, other), (7, other), (7, other), (9, None)], "doc_id long, text string").withColumns(
        {"lang": F.lit("en"), "source": F.lit("s"), "n_chars": F.lit(1).cast("long"), "own": F.lit(1), "row": F.lit(2)})
    got = corpus_pipeline.near_duplicates(spark, docs, SMALL)
    assert got.columns == docs.columns
    assert sorted((r.doc_id or 0, r.text or "") for r in got.collect()) == sorted([(0, text), (7, other), (9, "")])


def test_near_copies_go(spark):
    """Of texts and copies with words changed down to a similarity of 0.8 the texts stay, and clean ones do."""
    rng = random.Random(5)
    texts, copies = [], 0
    for k in range(40):
        own = [f"w{rng.randrange(3000)}" for _ in range(rng.randrange(60, 400))]
        copy = list(own)
        while True:
            at = rng.randrange(len(copy))
            changed = [*copy[:at], f"new{k}x{at}", *copy[at + 1:]]
            x, y = shingles(" ".join(own), 5), shingles(" ".join(changed), 5)
            if len(x & y) < 0.8 * len(x | y):
                break
            copy = changed
        texts += [" ".join(own), " ".join(copy)]
        copies += copy != own
    texts += [" ".join(f"t{k}x{i}" for i in range(80)) for k in range(20)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)],
                                 "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    got = sorted(d for d, _ in texts_of(corpus_pipeline.near_duplicates(spark, docs, SMALL)))
    assert got == groups(list(enumerate(texts))) and copies == 40 and len(got) == 60


def test_run(spark):
    out = corpus_pipeline.run(spark, SMALL)
    assert 0 < out.count() < spark.read.parquet(f"{SMALL}/documents.parquet").count()


def test_no_documents(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SMALL)
    assert docs.count() == 0


def test_sql(spark):
    import duckdb

    db = duckdb.connect()
    for t in ("documents", "benchmark"):
        db.execute(f"create view {t} as select * from '{SMALL}/{t}.parquet'")
    for name, sql in ORACLE_SQL.items():
        found = QUERIES[name](spark, SMALL)
        got = db.sql(sql)
        columns = sorted(found.columns)
        assert columns == sorted(got.columns)
        at = [got.columns.index(c) for c in columns]
        assert sorted(tuple(r[c] for c in columns) for r in found.collect()) == sorted(tuple(r[i] for i in at) for r in got.fetchall())
