"""Token counts by an exact length histogram.

Documents are encoded once and aggregated by length, so what remains is one row per distinct length.  Suffix sums over
those rows answer, for a context limit of any length, how many documents and tokens there are, how many are truncated and
what truncation keeps; prefix sums answer quantiles.

Defined cases: null text is empty and has length 0 plus the ``end_tokens``; repeated rows count each time; no rows give no
rows; other columns are ignored.

The tables here grow with the number of distinct lengths, never with the documents: a task sums one block of ``BLOCK``
lengths at most, and one task the blocks (texts of up to a million tokens make 15,625 of them).
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, tidy
from .tokens import WORD_VOCABULARY, slices, word_encoder

#: Lengths are summed within blocks of this width, then over blocks, so that no one task holds all lengths.
BLOCK = 64


def encoded_lengths(documents: DataFrame, tokenizer: str = WORD_VOCABULARY, end_tokens: int = 1) -> DataFrame:
    """doc_id, n_tokens."""
    import pyarrow as pa

    def lengths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = word_encoder(tokenizer)
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            found = [len(ids) // 4 + end_tokens for a, b in slices(texts) for ids in encoder.encode(texts[a:b])]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.int64())], ["doc_id", "n_tokens"])

    return documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(tidy(lengths, tokenizer), "doc_id long, n_tokens long")


def histogram(lengths: DataFrame) -> DataFrame:
    """n_tokens, n_docs: written out, since every answer reads it and documents are to be encoded once."""
    return cut(lengths.groupBy("n_tokens").agg(F.count(F.lit(1)).alias("n_docs")))


def suffix_sums(hist: DataFrame, block: int = BLOCK) -> DataFrame:
    """One row per distinct length L, as context limit: n_docs of that length; docs_over and tokens_over: longer than L;
    docs_upto: L or shorter; total_tokens; kept_tokens: the sum of min(length, L); quantile: docs_upto over all documents."""
    rows = hist.withColumns({"block": F.floor(F.col("n_tokens") / block).cast("long"), "tokens": F.col("n_tokens") * F.col("n_docs")})
    blocks = rows.groupBy("block").agg(F.sum("n_docs").alias("b_docs"), F.sum("tokens").alias("b_tokens"))
    upto = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    blocks = blocks.select(
        F.col("block").alias("b"),
        F.coalesce(F.sum("b_docs").over(upto), F.lit(0)).alias("docs_before"), F.coalesce(F.sum("b_tokens").over(upto), F.lit(0)).alias("tokens_before"),
        F.sum("b_docs").over(every).alias("all_docs"), F.sum("b_tokens").over(every).alias("total_tokens"),
    )
    inside = Window.partitionBy("block").orderBy("n_tokens").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumns({"docs_in": F.sum("n_docs").over(inside), "tokens_in": F.sum("tokens").over(inside)})
    joined = rows.join(blocks, rows["block"] == blocks["b"])
    docs, tokens = F.col("docs_before") + F.col("docs_in"), F.col("tokens_before") + F.col("tokens_in")
    over = F.col("all_docs") - docs
    return joined.select(
        "n_tokens", "n_docs", docs.alias("docs_upto"), over.alias("docs_over"), (F.col("total_tokens") - tokens).alias("tokens_over"),
        "total_tokens", (tokens + over * F.col("n_tokens")).alias("kept_tokens"), (docs / F.col("all_docs")).alias("quantile"),
    )


def for_limits(hist: DataFrame, limits: DataFrame) -> DataFrame:
    """The same answers for any limits (n_tokens, distinct): limit, docs_upto, docs_over, tokens_over, total_tokens,
    kept_tokens, quantile.  A limit joins the histogram as a length that no document has."""
    asked = limits.select(F.col("n_tokens").cast("long").alias("n_tokens"), F.lit(0).cast("long").alias("n_docs"), F.lit(True).alias("asked"))
    both = hist.withColumn("asked", F.lit(False)).unionByName(asked).groupBy("n_tokens").agg(F.sum("n_docs").alias("n_docs"), F.max("asked").alias("asked"))
    both = cut(both)
    found = suffix_sums(both.select("n_tokens", "n_docs")).join(both.filter("asked").select("n_tokens"), "n_tokens", "left_semi")
    return found.drop("n_docs").withColumnRenamed("n_tokens", "limit")


def quantiles(hist: DataFrame, shares: list[float]) -> DataFrame:
    """share, n_tokens: the least length that at least that share of the documents doesn't exceed."""
    rows = suffix_sums(hist).select("n_tokens", "quantile")
    least = [F.min(F.when(F.col("quantile") >= s - 1e-12, F.col("n_tokens"))).alias(f"q{i}") for i, s in enumerate(shares)]
    pairs = F.array(*[F.struct(F.lit(float(s)).alias("share"), F.col(f"q{i}").alias("n_tokens")) for i, s in enumerate(shares)])
    return rows.agg(*least).select(F.explode(pairs).alias("p")).select("p.*").filter("n_tokens is not null")
