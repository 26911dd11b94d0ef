"""The corpus pipeline: quality rules, near-dedup, secrets, source mixing, packing.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next stage's
``docs``. All stages but the last return the columns of ``documents``:

1. quality_rules: failing lines leave the text, rejected documents go; ``n_chars`` follows the text.
2. near_dedup: one document of each SimHash component stays, the one with the smallest id.
3. secret_scan: secrets in the texts are masked; every document stays.
4. mix_sources: each document as often as the mix takes it whole (a row per copy; documents that the mix leaves out go).
5. pack: one row per piece with its sequence and offset.

Rows that repeat an id are judged each on its own; near_dedup leaves one row of them, so ids are unique from there to the mix.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from articleflow.llm import mixing, packing, quality, secrets, simhash
from articleflow.llm.queries import tokenizer_path
from articleflow.session import scratch_path


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.clean_documents(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.keep_one(docs, shingle=3, max_bits=3)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    clean = secrets.redact(docs, secrets.train_on_corpus(docs))
    return clean.withColumn("n_chars", F.coalesce(F.length("text"), F.lit(0)).cast(dict(docs.dtypes)["n_chars"]))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed_documents(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs, tokenizer_path(), 2048)


STAGES = [("quality_rules", quality_rules), ("near_dedup", near_dedup), ("secret_scan", secret_scan),
          ("mix_sources", mix_sources), ("pack", pack)]

#: Hashing, a trained model and a tokenizer are beyond SQL; tests/llm compares the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    for name, stage in STAGES:
        path = scratch_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.mode("overwrite").parquet(path)
        docs = spark.read.parquet(path)
    return docs
