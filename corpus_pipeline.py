"""The corpus pipeline: toxicity, quality rules, near-dedup, mixing, packing; each stage works on what the one before kept.

Every stage but the last returns its input's columns, whatever they are called.  A row is judged by its own text: rows that
repeat a doc_id, or have none, are rows like others.  Null text is empty text, which the quality rules reject; of near
duplicates one row stays; no rows give no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lexground.llm import mixing, near_dedup, packing, quality, toxicity
from lexground.llm.common import checkpoint_dir, removed, table

#: SQL can't express the trained scores, tokenizers and packing of these stages; tests hold them against brute force.
ORACLE_SQL: str | None = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.keep(docs, table(spark, sf_dir, "labels"))


def drop_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dedup.keep_one(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.replicate(docs).select(*[f"`{c}`" for c in docs.columns])


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("quality rules", drop_low_quality),
    ("near-dedup", drop_near_duplicates),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's rows are written to the shared folder and read again by the next, and deleted
    once that has written its own."""
    from uuid import uuid4

    docs, place = table(spark, sf_dir, "documents"), f"{checkpoint_dir(spark)}/pipeline-{uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{place}/{k}")
        if k:
            removed(spark, f"{place}/{k - 1}")
        docs = spark.read.parquet(f"{place}/{k}")
    return docs
