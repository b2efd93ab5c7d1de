"""Documents to tokens: reject toxic texts, near copies and benchmark leaks, replace personal data, encode.

Every stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame; ``run`` writes each result as
Parquet to the shared folder and gives it to the next stage as read from there, so a lost executor
costs no more than the stage at hand. Stages that filter keep the columns of documents.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from sentinela.llm import bpe, contamination, pii, simhash, toxicity
from sentinela.llm.queries import PII_KEY
from sentinela.llm.tables import fold, table
from sentinela.staging import stage

# SimHash votes and the vocabulary's merges are beyond SQL; tests compare with brute force.
ORACLE_SQL: str | None = None

TOXIC_FROM = 0.7


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    learnt = table(spark, sf_dir, "labels").where(fold(F.col("doc_id"), 3) != 1)
    return toxicity.drop_toxic(docs, toxicity.fit(docs, learnt), TOXIC_FROM)


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.keep_one(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return contamination.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def replace_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pii.replace(docs, PII_KEY).withColumn("n_chars", F.length("text").cast("long"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    fields = ("n_tokens", "ids_sha256", "decoded_sha256")
    return bpe.encode(docs, public_tokenizers.path("word_bpe_49k.json"), fields).select("doc_id", *fields)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("simhash_near_dedup", keep_one_of_each),
    ("benchmark_decontamination", drop_contaminated),
    ("pii", replace_personal_data),
    ("bpe", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, step in STAGES:
        docs = stage(step(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
