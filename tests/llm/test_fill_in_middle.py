"""Fill-in-the-middle documents against a plain version."""

import hashlib
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tests.llm.conftest import by_id
from tidegauge.llm import fill_in_middle
from tidegauge.llm.batches import buffer_of

UNITS = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def plain(doc_id, text):
    text = text or ""
    units = UNITS.findall(text)
    n = len(units)
    digest = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[8 * i:8 * i + 8], 16) for i in range(4))
    lo, hi = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = "".join(units[:lo]), "".join(units[lo:hi]), "".join(units[hi:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h3 % 100 >= 50:
        return (doc_id, n, "plain", None, None, text)
    if h4 % 100 < 80:
        return (doc_id, n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}")
    return (doc_id, n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}")


LONG = [("日本語 " * 3 + "x" * 5000 + "\n") * 400, " " * 9000, "é" * 3_000_000, "a b\t" * 1_200_000]
MARKED = ["x <P> y", "<P", "<M>", "a<S>b", "< P>", "<p> <s>", "<P", ">", "x<", "S>"]


@pytest.fixture(scope="module")
def many(spark, rows):
    more = [(30_000 + i, t) for i, t in enumerate(MARKED * 3 + LONG + LONG)]
    return rows + more


def test_against_plain(spark, many):
    docs = spark.createDataFrame(many, "doc_id long, text string").repartition(5).withColumns({"row": F.lit(1), "out": F.lit(2), "id": F.lit(3)})
    made = fill_in_middle.fill_in_middle(docs)
    got = by_id([tuple(r) for r in made.select("row.doc_id", "out.n", "out.form", "out.prefix_chars", "out.middle_chars", "out.output").collect()])
    want = by_id([plain(*r) for r in many])
    assert got == want
    assert {r[2] for r in want} == {"plain", "spm", "psm"}
    wrong = made.where(fill_in_middle.restored(F.col("out.output"), F.col("out.form")) != F.coalesce("row.text", F.lit("")))
    assert wrong.count() == 0 and made.select("row.*").columns == docs.columns


@pytest.mark.parametrize("block", [1, 2, 3, 7, 64, 10_000])
def test_every_cut(block):
    texts = ["", "a", " ", "a b", "  日本 語x \n", "one two  three\t", "x" * 20, " é ß " * 9]
    raw, offsets = buffer_of(pa.array(texts))
    tree = fill_in_middle.Fenwick(raw, offsets, block)
    units = [UNITS.findall(t) for t in texts]
    assert tree.totals().tolist() == [len(u) for u in units]
    for i, own in enumerate(units):
        k = np.arange(len(own) + 1)
        byte, points = tree.cut(np.full(len(k), i), k)
        heads = ["".join(own[:x]) for x in k]
        assert points.tolist() == [len(h) for h in heads]
        assert (byte - offsets[i]).tolist() == [len(h.encode()) for h in heads]


def test_no_documents(empty):
    assert fill_in_middle.fill_in_middle(empty).count() == 0


def test_shares(spark):
    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("a b c d").alias("text"))
    made = fill_in_middle.fill_in_middle(docs, percent=30, spm_percent=50)
    share = {r.form: r["count"] / 4000 for r in made.groupBy("out.form").count().collect()}
    assert abs(share["plain"] - 0.7) < 0.03 and abs(share["spm"] - 0.15) < 0.03
