"""Queries of the operators over their whole tables, and the SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from sentinela.llm import (
    bpe, contamination, filter_audit, host_rules, imatch, language, periodicity, pii, quality, sequences, simhash,
    toxicity, urls,
)
from sentinela.llm.tables import fold, table
from sentinela.staging import scratch_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(run):
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return run

    return register


@query("op3_bpe_pair_index")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    vocabulary = public_tokenizers.path("word_bpe_49k.json")
    fields = ("n_tokens", "ids_sha256", "decoded_sha256")
    return bpe.encode(docs, vocabulary, fields).select("doc_id", *fields)


@query("op8_simhash_vantage_trees")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    digits = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return found.select("doc_id", digits.alias("fingerprint"), "component_id")


@query("op1_language_bloom_slices")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    filters = language.fit(docs.where(fold(F.col("doc_id"), 5) != 0))
    found = language.identify(docs.select("doc_id", "text"), filters)
    return found.select("doc_id", (fold(F.col("doc_id"), 5) == 0).alias("held_out"), "lang_pred", "score")


@query("op5_toxicity_factorization_machine")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    machine = toxicity.fit(docs, table(spark, sf_dir, "labels").where(fold(F.col("doc_id"), 3) != 1))
    held_out = (fold(F.col("doc_id"), 3) == 1).alias("held_out")
    found = toxicity.score(docs, machine)
    return found.select("doc_id", held_out, "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


@query("op7_quality_attention_mil")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    learnt = table(spark, sf_dir, "labels").where(fold(F.col("doc_id"), 5) != 0)
    model = quality.fit(docs, learnt)
    held_out = (fold(F.col("doc_id"), 5) == 0).alias("held_out")
    found = quality.score(docs, model)
    return found.select("doc_id", held_out, "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


@query("op10_pigeonhole_decontamination")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return contamination.matches(docs, table(spark, sf_dir, "benchmark"))


# Stands for a secret that a real job gets from outside.
PII_KEY = "surrogate key of the registered query"


@query("op9_pii_surrogates")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pii.replace(docs, PII_KEY, count="n_entities")


URL_RULES = [
    urls.Rule("net/", "block"), urls.Rule("example.net/en/", "allow"),
    urls.Rule("example.com/de/", "block"), urls.Rule("org/fr/", "allow"),
]


@query("op4_url_shift_and", """
WITH rest AS (
  SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS r FROM pages
), cut AS (
  SELECT page_id, regexp_extract(r, '^[^/?#]*') AS h, r FROM rest
), parts AS (
  SELECT page_id, translate(h, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(substr(r, length(h) + 1), '^[^?#]*') AS path FROM cut
), ruled AS (
  SELECT *, CASE
    WHEN ends_with('.' || host, '.example.net') AND starts_with(path, '/en/') THEN 'example.net/en/'
    WHEN ends_with('.' || host, '.example.com') AND starts_with(path, '/de/') THEN 'example.com/de/'
    WHEN ends_with('.' || host, '.org') AND starts_with(path, '/fr/') THEN 'org/fr/'
    WHEN ends_with('.' || host, '.net') AND starts_with(path, '/') THEN 'net/' END AS rule
  FROM parts
)
SELECT page_id, host, path, rule,
       CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' ELSE 'allow' END AS verdict
FROM ruled""")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(table(spark, sf_dir, "pages").select("page_id", "url"), URL_RULES).drop("url")


@query("op6_token_sequences_arrow")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    vocabulary = public_tokenizers.path("word_bpe_49k.json")
    manifest = sequences.write(docs, scratch_path(spark, "sequences"), vocabulary, end_id=1)
    return sequences.read(spark, manifest)


@query("op2_imatch_fingerprints")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = imatch.with_edited(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "fingerprint",
                        "edited_fingerprint", "near_edited", "near_next")


@query("op11_periodic_runs")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = periodicity.repeat_tails(table(spark, sf_dir, "documents").select("doc_id", "text"))
    found = periodicity.detect(docs).withColumn("best", periodicity.longest(F.col("runs")))
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(periodicity.listed(F.col("runs")), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"))


@query("op12_filter_shapley", r"""
WITH d AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents
), fails AS (
  SELECT d.doc_id, part, [len(ws) < 50, 100 * len(list_distinct(ws)) < 65 * len(ws),
         100 * len(regexp_replace(t, '[^A-Z]', '', 'g')) > 5 * len(t), regexp_matches(t, '[#$%&*|]'),
         coalesce(d.doc_id > min(d.doc_id) OVER (PARTITION BY t), false)] AS f,
         coalesce(quality = 1, false) AS good, coalesce(toxic = 1, false) AS toxic
  FROM d LEFT JOIN labels l ON d.doc_id = l.doc_id
), letters AS (
  SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS c
), orders AS (
  SELECT a.c || b.c || x.c || y.c || z.c AS filter_order
  FROM letters a, letters b, letters x, letters y, letters z
  WHERE len(list_distinct([a.c, b.c, x.c, y.c, z.c])) = 5
), met AS (
  SELECT part, filter_order, f, good, toxic,
         [f[instr('ABCDE', filter_order[s])] for s in [1, 2, 3, 4, 5]] AS g FROM fails, orders
), went AS (
  SELECT *, coalesce(list_position(g, true), 6) AS gone, len([x for x in f if x]) AS n_failed FROM met
), steps AS (
  SELECT part, filter_order, s AS step, count(*) FILTER (gone > s) AS kept, count(*) FILTER (gone = s) AS removed,
         count(*) FILTER (g[s] AND gone < s) AS redundant, count(*) FILTER (g[s] AND n_failed = 1) AS unique_fails,
         count(*) FILTER (gone = s AND good) AS good_lost, count(*) FILTER (gone = s AND toxic) AS toxic_lost
  FROM went, (SELECT unnest([1, 2, 3, 4, 5]) AS s) GROUP BY ALL
)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
       CAST(sum(removed) OVER (PARTITION BY part, filter_order[step]) AS BIGINT) AS shapley
FROM steps""")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = filter_audit.marked(table(spark, sf_dir, "documents"), "source", table(spark, sf_dir, "labels"))
    return filter_audit.audit(rows, "ABCDE")


_HOST_RULES = {
    "few_words": "n_words < 50", "repetition": "100 * n_repeat_words > 50 * n_words", "symbols": "10 * n_symbols > n_words",
    "lines": "100 * n_dup_lines > 30 * n_lines", "word_length": "word_chars < 3 * n_words OR word_chars > 10 * n_words",
}


@query("op13_host_rules", r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(source, '') AS host, coalesce(text, '') AS t FROM documents
), split AS (
  SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws,
         [x for x in string_split(t, chr(10)) if regexp_matches(x, '[^\x20\x09-\x0D]')] AS ls FROM d
), windows AS (
  SELECT r, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS w
  FROM (SELECT r, ws, unnest(range(1, len(ws) - 1)) AS i FROM split)
), repeated AS (
  SELECT r, count(DISTINCT p) AS n_repeat_words FROM (
    SELECT r, unnest([i, i + 1, i + 2]) AS p FROM (SELECT r, i, count(*) OVER (PARTITION BY r, w) AS n FROM windows) WHERE n > 1
  ) GROUP BY r
), figures AS (
  SELECT doc_id, host, len(ws) AS n_words, len(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS word_chars,
         len(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols, len(ls) AS n_lines,
         len(ls) - len(list_distinct(ls)) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words
  FROM split LEFT JOIN repeated USING (r)
), hosts AS (
  SELECT host, CAST(count(*) AS DOUBLE) AS n, """ + ", ".join(
    f"CAST(count(*) FILTER ({rule}) AS DOUBLE) AS {name}" for name, rule in _HOST_RULES.items()) + """
  FROM figures GROUP BY host
), sums AS (
  SELECT count(*) - 1 AS freedom, sum(n) AS total, sum(n * n) AS squares, """ + ", ".join(
    f"sum({r}) / sum(n) AS mu_{r}, sum({r} * {r} / n) AS sq_{r}" for r in _HOST_RULES) + """ FROM hosts
), priors AS (
  SELECT *, """ + ", ".join(
    f"""CASE WHEN mu_{r} > 0 AND mu_{r} < 1 AND total - squares / total - freedom > 0 THEN
      1 / least(0.999, greatest(1e-6, ((sq_{r} - total * mu_{r} * mu_{r}) / (mu_{r} * (1 - mu_{r})) - freedom)
        / (total - squares / total - freedom))) - 1 ELSE 1 / 0.999 - 1 END AS strength_{r}""" for r in _HOST_RULES) + """ FROM sums
), rejected AS (
  SELECT host FROM hosts, priors WHERE """ + " OR ".join(
    f"({r} + mu_{r} * strength_{r}) / (n + strength_{r}) > 0.5" for r in _HOST_RULES) + """
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
       NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND host NOT IN (SELECT host FROM rejected) AS kept
FROM figures""")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return host_rules.judge(docs, "source").select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
