"""From raw documents to clean token ids, stage by stage.

Each stage takes all documents its predecessor kept and returns them with the columns
of ``documents``; the last returns token ids.  ``run`` writes each result as Parquet in
the shared folder and reads it again, so that a lost executor repeats one stage at most.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegauge.llm import bpe, decontaminate, jaccard_join, quality, secret_scan, simhash
from tidegauge.llm.components import components, written
from tidegauge.session import scratch, work_dir


def _rows(df: DataFrame) -> DataFrame:
    return df.select("row.*")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go.  A null or empty text has no words and is rejected; equal rows go or stay together."""
    model = quality.fit_votes(quality.measure(docs, keep=["doc_id"]))
    return _rows(quality.judge(quality.measure(docs), model).where("kept"))


def _staying(docs: DataFrame, own: Column, prints: DataFrame, stay: DataFrame) -> DataFrame:
    """The documents whose hash is in ``stay``, each once."""
    rows = docs.select(F.struct("*").alias("row"), own.alias("own")).join(stay.withColumnRenamed("own", "first"), F.col("own") == F.col("first"))
    # Equal rows have one hash; of those more than one, one stays.
    many = prints.groupBy("own").count().where("count > 1").select(F.col("own").alias("repeated"))
    rows = rows.join(many, F.col("own") == F.col("repeated"), "left")
    single = _rows(rows.where("repeated is null"))
    return single.unionByName(_rows(rows.where("repeated is not null").dropDuplicates(["own"])))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays: that of least id, nulls last; of rows of one id, that of least text hash.

    A group is all documents that links of two kinds connect: SimHash fingerprints within
    ``simhash.RADIUS`` bits, of which few near copies are, and sets of five-word shingles of a
    Jaccard similarity of 0.8 or more.  Both are exact.  Texts without words, nulls among
    them, have one fingerprint and so are one group.  Equal rows are one document.
    """
    own = F.xxhash64(F.col("doc_id"), F.col("text"))
    keyed = docs.select("doc_id", "text", own.alias("own"))
    prints = written(simhash.with_fingerprint(keyed, keep=["doc_id", "own"]).select(
        "row.doc_id", "row.own", F.col("out.fingerprint").alias("fingerprint")), "prints")
    rows, similar = jaccard_join.jaccard_links(keyed, 5, 80, keep=["own"])
    classes = rows.where("node is not null").select(F.col("row.own").alias("of"), "node").distinct()
    # One graph of fingerprints and classes of equal sets, joined by the texts that have both.
    bits, grams = (lambda c: F.xxhash64(F.lit(0), F.col(c))), (lambda c: F.xxhash64(F.lit(1), F.col(c)))
    texts = prints.select("own", "fingerprint").distinct().join(classes, F.col("own") == F.col("of"))
    within = simhash.links(prints.select("fingerprint").distinct())
    edges = (within.select(bits("a").alias("a"), bits("b").alias("b"))
             .unionAll(similar.select(grams("a").alias("a"), grams("b").alias("b")))
             .unionAll(texts.select(bits("fingerprint").alias("a"), grams("node").alias("b")).distinct()))
    order = F.struct(F.col("doc_id").isNull().alias("last"), F.col("doc_id"), F.col("own"))
    # Copies are summed up by fingerprint first, so a large group of them is one row in the join.
    least = prints.groupBy("fingerprint").agg(F.min(order).alias("first")).withColumn("of", bits("fingerprint"))
    stay = (least.join(components(edges), F.col("of") == F.col("a"), "left").groupBy(F.coalesce("b", "of").alias("root"))
            .agg(F.min("first").alias("first")).select(F.col("first.own").alias("own")))
    return _staying(docs, own, prints, stay)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a passage of the benchmark go.

    A null or empty text holds none; equal rows go or stay together.
    """
    found = decontaminate.contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return _rows(found.where(~F.col("out.contaminated")))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are cut out of the texts, and n_chars follows.

    All documents stay.  A null or empty text stays as it is; equal rows stay equal.
    """
    found = secret_scan.scan(docs, secret_scan.thresholds(docs))
    clean = secret_scan.redact(F.col("row.text"), F.col("spans"))
    changed = F.size("spans") > 0
    values = {"text": clean, "n_chars": F.when(changed, F.length(clean).cast("long")).otherwise(F.col("row.n_chars"))}
    return found.select(*[values.get(c, F.col(f"row.{c}")).alias(c) for c in docs.columns])


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each text; decoded_sha256 is over the bytes the ids decode to.

    A null or empty text has no ids; each of equal rows has its own.
    """
    keep = [c for c in ("doc_id", "lang", "source") if c in docs.columns]
    encoded = bpe.encode(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, keep=keep)
    return encoded.select("row.*", "out.n_tokens", "out.ids", "out.ids_sha256", "out.decoded_sha256")


STAGES = [
    ("quality_rules", quality_rules), ("near_duplicates", near_duplicates), ("decontamination", decontamination),
    ("secrets", secrets), ("tokens", tokens),
]

#: The label model and the merges are no SQL; tests compare the rows with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what a stage wrote on its way goes when its result is written."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    with scratch(spark) as results:
        for name, stage in STAGES:
            with scratch(spark) as kept:
                kept.append(work_dir(spark, name))
                found = stage(spark, docs, sf_dir)
                found.write.parquet(kept[0])
            docs = spark.read.schema(found.schema).parquet(kept[0])
        results.append(kept[0])
    return docs
