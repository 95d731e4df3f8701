"""The randomness tests against a plain version, their thresholds, and redaction of many spans."""

import math
import random
import re
import time

import pytest
from pyspark.sql import functions as F

from tidegauge.llm import secret_scan


def plain_p(token):
    """Encoding and p of a candidate, from the definitions of the three tests."""
    for name, form, alphabet in secret_scan.ENCODINGS:
        if re.fullmatch(form, token):
            break
    else:
        return None
    if alphabet == alphabet.lower() and re.search("[A-Z]", token):
        alphabet = alphabet.upper()
    body = re.sub("=+$", "", token)
    v = [alphabet.index(c) for c in body]
    n, k = len(v), len(alphabet)
    tail = lambda z: math.erfc(z / math.sqrt(2)) / 2
    chi, df = sum((v.count(i) - n / k) ** 2 / (n / k) for i in range(k)), k - 1
    z_chi = ((chi / df) ** (1 / 3) - (1 - 2 / (9 * df))) / math.sqrt(2 / (9 * df))
    high = [x >= k / 2 for x in v]
    ups = sum(high)
    runs = 1 + sum(a != b for a, b in zip(high, high[1:]))
    product = 2 * ups * (n - ups)
    spread = product * (product - n) / (n * n * (n - 1))
    z_runs = (runs - 1 - product / n) / math.sqrt(spread) if spread > 0 else 9.0
    mean = sum(v) / n
    square = sum((x - mean) ** 2 for x in v)
    lag = sum((a - mean) * (b - mean) for a, b in zip(v, v[1:]))
    z_lag = (lag / square + 1 / n) * math.sqrt(n) if square else 9.0
    log = lambda p: math.log(max(p, 1e-12))
    h = max(-(log(tail(z_chi)) + log(2 * tail(abs(z_runs))) + log(2 * tail(abs(z_lag)))), 0)
    return name, math.exp(-h) * (1 + h + h * h / 2)


def test_p_values(spark):
    rng = random.Random(1)
    tokens = ["".join(rng.choices(alphabet, k=rng.randrange(20, 90))) for _, _, alphabet in secret_scan.ENCODINGS for _ in range(12)]
    tokens += ["20240117093055112345", "a1" * 15, "abcdefghijklmnopqrstuvwxyz012345", "0" * 30 + "1"]
    rows = spark.createDataFrame([(i, f"see {t} here") for i, t in enumerate(tokens)], "i int, text string")
    got = rows.select("i", F.explode(secret_scan._tests(F.col("text"))).alias("c")).select("i", "c.encoding", "c.p").collect()
    assert len(got) > 90
    for r in got:
        name, p = plain_p(tokens[r.i])
        assert r.encoding == name and r.p == pytest.approx(p, abs=1e-4)


def documents(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)


def test_few_candidates_accept_nothing(spark):
    one = documents(spark, ["order 20240117093055112345 shipped"])
    assert secret_scan.thresholds(one) == {}
    found = secret_scan.scan(one, secret_scan.thresholds(one)).select(secret_scan.span_text(F.col("spans")).alias("s")).collect()
    assert [r.s for r in found] == [""]


def test_random_strings_are_found_among_ordinary_ones(spark):
    rng = random.Random(2)
    letters = secret_scan.ENCODINGS[5][2]
    secret = ["".join(rng.choices(letters, k=40)) for _ in range(60)]
    ordinary = [f"section{i:04}Paragraph{i % 7}OfTheOrdinaryKind" for i in range(200)]
    docs = documents(spark, [f"x {t} y" for t in secret + ordinary])
    found = secret_scan.scan(docs, secret_scan.thresholds(docs)).select("row.doc_id", F.size("spans").alias("n")).collect()
    hit = {r.doc_id for r in found if r.n}
    assert len([i for i in hit if i < 60]) >= 50 and len([i for i in hit if i >= 60]) <= 6


@pytest.mark.parametrize("block", [secret_scan.BLOCK])
def test_redaction(spark, block):
    rng = random.Random(3)
    rows = []
    for i in range(30):
        text = "".join(rng.choices("ab é😀日\n", k=rng.choice([0, 1, 50, block - 1, block, block + 1, 3 * block + 5])))
        spans = sorted({(a, min(a + rng.randrange(1, 60), len(text))) for a in rng.sample(range(len(text)), min(len(text), 12))} if text else ())
        rows.append((i, text, [(a, 0, b) for a, b in spans if b > a]))
    frame = spark.createDataFrame(rows, f"i int, text string, spans {secret_scan.SPAN}")
    got = {r.i: r.t for r in frame.select("i", secret_scan.redact(F.col("text"), F.col("spans")).alias("t")).collect()}
    for i, text, spans in rows:
        out, at = "", 0
        for a, _, b in spans:
            if a >= at:
                out += text[at:a] + "[SECRET]"
                at = b
            else:
                at = max(at, b)
        assert got[i] == out + text[at:]


def test_many_spans_in_a_long_text(spark):
    """Redaction is a small part of the scan's time."""
    rng = random.Random(4)
    parts = [f"password={''.join(rng.choices('abcdef', k=12))}{i} some é words between them" for i in range(8000)]
    docs = documents(spark, [" ".join(parts)])
    scanned = secret_scan.scan(docs, {}, keep=["text"]).cache()
    start = time.time()
    assert scanned.select(F.size("spans").alias("n")).first().n == 8000
    middle = time.time()
    clean = scanned.select(secret_scan.redact(F.col("row.text"), F.col("spans")).alias("t")).first().t
    end = time.time()
    scanned.unpersist()
    assert clean.count("[SECRET]") == 8000 and "password" not in clean
    assert end - middle < max(0.5 * (middle - start), 3)
