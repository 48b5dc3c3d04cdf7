"""The corpus pipeline: toxicity, language, near-duplicates, benchmark leaks, tokens. Each stage's rows are written and read again before the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rolesift.llm import bpe, decontamination, langid, minhash, toxicity
from rolesift.llm.common import crc_mod, written

#: Calibrated probability below which the language of a text counts as unknown.
LEAST_LANGUAGE_SCORE = 0.5


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored at or above the threshold go; empty texts are scored like any other."""
    model = toxicity.train(docs.where(toxicity.learnable()), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = toxicity.score(docs, model, into="__toxicity")
    return scored.where(F.col("__toxicity") < model.params.threshold).drop("__toxicity")


def drop_unknown_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can't be told go: no letter, no text, or a calibrated probability under the least one."""
    model = langid.train(docs.where(crc_mod("doc_id", 5) != 0))
    found = langid.predict(docs, model, into=("__lang", "__score"))
    return found.where((F.col("__lang") != "und") & (F.col("__score") >= LEAST_LANGUAGE_SCORE)).drop("__lang", "__score")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the least id of each group stays."""
    return minhash.deduplicated(docs)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontamination.cleaned(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def to_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document that is left, with digests of the ids and of the bytes decoded from them."""
    encoded = bpe.encode(docs, *bpe.default_ranks(), keep=["doc_id", "lang", "source"])
    return encoded.select("doc_id", "lang", "source", "token_ids", *bpe.digests(encoded))


STAGES = [
    ("toxicity", drop_toxic),
    ("language_id", drop_unknown_language),
    ("minhash_dedup", drop_near_duplicates),
    ("decontamination", drop_benchmark_leaks),
    ("byte_bpe", to_tokens),
]

#: SQL can't express the classifiers, the signatures or the tokens; tests/llm/test_pipeline.py compares with plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs
