"""Raw documents: page tables, text files and PDF files; tables of few splits, dealt out to all cores."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: A scan of more splits than this for each core is left alone without looking into it.
MANY_SPLITS = 4


def spread(rows: DataFrame) -> DataFrame:
    """``rows`` of a scan, dealt out to all cores if at most half as many of its splits hold rows.

    A Parquet row group can't be divided, so a file of one is worked on by one core whatever its size.  The splits that hold
    rows are counted from footers.  The rows are the same; a scan that can keep half of the cores busy is never shuffled."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    if cores < 2 or rows.rdd.getNumPartitions() > MANY_SPLITS * cores:
        return rows
    held = rows.select(F.spark_partition_id().alias("split")).distinct().count()
    return rows.repartition(cores) if 0 < held <= cores // 2 else rows


def from_pages(pages: DataFrame) -> DataFrame:
    """doc_id, text: the pages (doc_id, page, text) in order, each after ``[PAGE_n]``; blank pages are left out but counted."""
    kept = pages.filter(F.regexp_replace(F.coalesce("text", F.lit("")), r"\s+", "") != "")
    page = F.struct("page", F.concat(F.lit("[PAGE_"), "page", F.lit("]\n"), "text").alias("t"))
    return kept.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(page)), lambda p: p["t"]), "\n").alias("text"))


def read_pdf(spark: SparkSession, path: str, extract: Callable[[bytes], list[str]]) -> DataFrame:
    """(doc_id, page, text) of binary files; ``extract`` gives a file's page texts.  A missing path raises."""
    files = spark.read.format("binaryFile").load(path)

    def run(batches):
        import pandas as pd

        for b in batches:
            rows = [(p, i + 1, t) for p, content in zip(b["path"], b["content"], strict=True) for i, t in enumerate(extract(content))]
            yield pd.DataFrame(rows, columns=["path", "page", "text"])

    pages = files.select("path", "content").mapInPandas(run, "path string, page int, text string")
    return pages.select(F.xxhash64("path").alias("doc_id"), "page", "text")


def read_text(spark: SparkSession, path: str) -> DataFrame:
    """doc_id (a hash of the path), text: one row per file."""
    rows = spark.read.text(path, wholetext=True).withColumn("path", F.col("_metadata.file_path"))
    return rows.select(F.xxhash64("path").alias("doc_id"), F.col("value").alias("text"))
