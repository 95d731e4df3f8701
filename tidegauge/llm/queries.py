"""The registered queries of this subpackage, each an operator on its whole tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegauge.llm import (
    binary_output, bpe, decontaminate, fill_in_middle, jaccard_join, kneser_ney, language, phrases, quality, secret_scan, sharding, simhash, suffix_arrays,
)
from tidegauge.llm.components import written
from tidegauge.session import work_dir


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_binary_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = work_dir(spark, "tokens")
    files = binary_output.write_tokens(
        documents(spark, sf_dir), folder, public_tokenizers.path("word_bpe_49k.json"), end_id=2)
    return binary_output.read_tokens(spark, folder, files)


def op2_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    held = kneser_ney.held_out()
    model = kneser_ney.train(docs.where(~held), work_dir(spark, "ngrams"))
    scored = kneser_ney.score(docs, model, keep=["doc_id"])
    return scored.select("row.doc_id", kneser_ney.held_out("row.doc_id").alias("held_out"), "out.*")


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    # The statistics are a few numbers a document; kept, they spare a second pass over the texts.
    measured = written(quality.measure(documents(spark, sf_dir), keep=["doc_id"]), "statistics")
    judged = quality.judge(measured, quality.fit_votes(measured))
    return judged.select("row.doc_id", *[F.col(f"out.{c}") for c in (
        "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")], "base_failed", "kept", "quality")


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    held = lambda c: F.coalesce(F.crc32(F.col(c).cast("string").cast("binary")) % 5 == 0, F.lit(False))
    trees = language.train(docs.where(~held("doc_id")))
    found = language.identify(docs, trees, keep=["doc_id"])
    return found.select("row.doc_id", held("row.doc_id").alias("held_out"), "out.*")


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    encoded = bpe.encode(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"),
                         public_tokenizers.PATTERN, keep=["doc_id"], arrays=False)
    return encoded.select("row.doc_id", "out.*")


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(documents(spark, sf_dir))


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign_shards(documents(spark, sf_dir))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    found = decontaminate.contamination(documents(spark, sf_dir), benchmark, keep=["doc_id"])
    return found.select("row.doc_id", "out.*")


def op9_suffix_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_arrays.passages(documents(spark, sf_dir))


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    found = secret_scan.scan(docs, secret_scan.thresholds(docs), keep=["doc_id"])
    count = lambda rank: F.size(F.filter("base", lambda s: s["rank"] == rank)).cast("long")
    return found.select(
        "row.doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
        F.sha2(secret_scan.span_text(F.col("base")), 256).alias("base_sha256"), secret_scan.span_text(F.col("spans")).alias("spans"))


def op11_phrase_mining(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(documents(spark, sf_dir))


def op12_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.similar_documents(documents(spark, sf_dir), size=4, percent=85)


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fill_in_middle.fill_in_middle(documents(spark, sf_dir), keep=["doc_id"])
    text = fill_in_middle.restored(F.col("out.output"), F.col("out.form"))
    return made.select(
        "row.doc_id", "out.n", "out.form", "out.prefix_chars", "out.middle_chars",
        F.sha2(F.col("out.output").cast("binary"), 256).alias("output_sha256"), F.sha2(text.cast("binary"), 256).alias("restored_sha256"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (
        op1_binary_output, op2_lm_scoring, op3_quality_rules, op4_language_id, op5_byte_bpe, op6_simhash,
        op7_sharding, op8_decontamination, op9_suffix_arrays, op10_secret_scan, op11_phrase_mining, op12_jaccard_join, op13_fill_in_middle)
}

# The same rows in DuckDB, where SQL can express them.
_CONTENT = (r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), "
            r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')")

_SPACED = (r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), "
           r"'[^\x20\x09-\x0D]+')")

ORACLE_SQL: dict[str, str] = {
    "op8_decontamination": f"""
with docs as (select doc_id, {_CONTENT} as w from documents),
items as (select item_id, {_CONTENT} as w from benchmark),
windows as (
  select distinct i.item_id, least(10, len(w)) as n, array_to_string(w[p:p + least(10, len(w)) - 1], ' ') as win
  from items i, unnest(range(1, len(w) - least(10, len(w)) + 2)) r(p) where len(w) > 0),
found as (
  select d.doc_id, p, n, item_id
  from (select doc_id, n, p, array_to_string(w[p:p + n - 1], ' ') as win
        from docs, (select distinct n from windows), unnest(range(1, len(w) - n + 2)) r(p)) d
  join windows using (n, win)),
hit as (select doc_id, count(distinct k) as n_hit from found, unnest(range(p, p + n)) h(k) group by doc_id),
named as (select doc_id, count(*) as n_items, string_agg(item_id, ',' order by item_id) as ids
          from (select distinct doc_id, item_id::varchar as item_id from found) group by doc_id)
select d.doc_id, len(w)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items,
       sha256(coalesce(ids, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from docs d left join hit using (doc_id) left join named using (doc_id)
""",
    "op11_phrase_mining": r"""
with split as (
  select coalesce(lang, 'und') as lang, unnest(string_split_regex(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) as piece
  from documents),
words as (select lang, regexp_extract_all(piece, '[^\x20\x09]+') as w from split),
totals as (select lang, sum(len(w))::bigint as n from words group by lang),
frequent as (
  select lang, k, array_to_string(w[p:p + k - 1], ' ') as phrase, count(*) as a
  from words, unnest(range(1, 5)) s(k), unnest(range(1, len(w) - k + 2)) t(p) group by all having count(*) >= 30),
parts as (select *, string_split(phrase, ' ') as w from frequent where k > 1),
cuts as (
  select x.lang, x.k, x.phrase, x.a, c, l.a as l, r.a as r, (2000000::hugeint * x.a) // (l.a + r.a) as score
  from (select *, unnest(range(1, k)) as c from parts) x
  join frequent l on l.lang = x.lang and l.phrase = array_to_string(x.w[1:c], ' ')
  join frequent r on r.lang = x.lang and r.phrase = array_to_string(x.w[c + 1:x.k], ' ')),
lowest as (select * from cuts qualify row_number() over (partition by lang, phrase order by score, c) = 1),
inside as (
  select lang, array_to_string(w[p:p + m - 1], ' ') as phrase, max(a) as most
  from parts, unnest(range(2, k)) s(m), unnest(range(1, k - m + 2)) t(p) group by all),
kept as (
  select x.* from lowest x left join inside i on i.lang = x.lang and i.phrase = x.phrase
  where most is null or 100::hugeint * most < 80::hugeint * x.a)
select lang, row_number() over (partition by lang order by score desc, a desc, phrase) as rank, phrase,
       a::bigint as a, l::bigint as l, r::bigint as r, n, score::bigint as score
from kept join totals using (lang) qualify rank <= 2000
""",
    "op12_jaccard_join": f"""
with recursive docs as (select doc_id, {_SPACED} as w from documents),
sets as (select distinct doc_id, array_to_string(w[p:p + 3], ' ') as gram
         from docs, unnest(range(1, greatest(len(w) - 2, 2))) r(p) where len(w) > 0),
sizes as (select doc_id, count(*) as n from sets group by doc_id),
pairs as (select x.doc_id as a, y.doc_id as b, count(*) as c from sets x join sets y on x.gram = y.gram and x.doc_id <> y.doc_id group by all),
links as (select a, b from pairs join sizes s on s.doc_id = a join sizes t on t.doc_id = b where 100 * c >= 85 * (s.n + t.n - c)),
reach as (select distinct a as first, a as node from links union select first, b from reach join links on a = node)
select d.doc_id, coalesce(any_value(n), 0)::bigint as n_shingles, least(d.doc_id, min(node)) as component_id
from docs d left join sizes s on s.doc_id = d.doc_id left join reach on first = d.doc_id group by d.doc_id
""",
    "op13_fill_in_middle": r"""
with units as (
  select doc_id, coalesce(text, '') as t, sha256('42:' || coalesce(doc_id::varchar, '')) as h,
         regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') as u
  from documents),
hashes as (
  select *, len(u) as n, ('0x' || h[1:8])::bigint as h1, ('0x' || h[9:16])::bigint as h2,
         ('0x' || h[17:24])::bigint as h3, ('0x' || h[25:32])::bigint as h4 from units),
cuts as (
  select *, least(h1 % (n + 1), h2 % (n + 1)) as lo, greatest(h1 % (n + 1), h2 % (n + 1)) as hi,
         case when t = '' or contains(t, '<P>') or contains(t, '<S>') or contains(t, '<M>') or h3 % 100 >= 50 then 'plain'
              when h4 % 100 < 80 then 'spm' else 'psm' end as form from hashes),
parts as (
  select *, coalesce(array_to_string(u[1:lo], ''), '') as p, coalesce(array_to_string(u[lo + 1:hi], ''), '') as m,
         coalesce(array_to_string(u[hi + 1:n], ''), '') as s from cuts)
select doc_id, n::bigint as n, form, case when form <> 'plain' then length(p) end::bigint as prefix_chars,
       case when form <> 'plain' then length(m) end::bigint as middle_chars,
       sha256(case form when 'plain' then t when 'psm' then '<P>' || p || '<S>' || s || '<M>' || m
                        else '<S>' || s || '<P>' || p || '<M>' || m end) as output_sha256,
       sha256(p || m || s) as restored_sha256
from parts
""",
}
