"""Embedding tables: the hashing embedder, or a model run over Arrow batches; distinct texts are embedded once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import words
from ..functions.vectors import DIMENSIONS, hashed_embedding, normalise

BATCH = 32


def embed(rows: DataFrame, keys: list[str], text: str = "content", model: Callable[[list[str]], list[list[float]]] | None = None, dimensions: int = DIMENSIONS, max_words: int = 512, batch: int = BATCH) -> DataFrame:
    """keys and embedding (unit vectors).  ``model`` maps up to ``batch`` texts to vectors; blank texts get a zero vector."""
    cut = F.array_join(F.slice(words(F.coalesce(text, F.lit(""))), 1, max_words), " ")
    if model is None:
        return rows.select(*keys, normalise(hashed_embedding(cut, dimensions)).cast("array<float>").alias("embedding"))
    texts = rows.select(cut.alias("t")).distinct()

    def run(batches):
        for b in batches:
            found: list = []
            for i in range(0, len(b), batch):
                found += model(b["t"].iloc[i : i + batch].tolist())
            yield b.assign(embedding=[[0.0] * len(v) if not t.strip() else v for t, v in zip(b["t"], found, strict=True)])

    embedded = texts.mapInPandas(run, "t string, embedding array<double>").withColumn("embedding", normalise("embedding").cast("array<float>"))
    return rows.select(*keys, cut.alias("t")).join(embedded, "t").drop("t")


def embed_one(spark, text: str, **options) -> list[float]:
    """A single text; blank raises."""
    if not text.strip():
        raise ValueError("cannot embed a blank text")
    return embed(spark.createDataFrame([(0, text)], "id int, content string"), ["id"], **options).first()["embedding"]


def dimension(spark, **options) -> int:
    """The number of components that an embedder's vectors have."""
    return len(embed_one(spark, "test", **options))


def mean_pool(rows: DataFrame, keys: list[str], vector: str = "embedding", mask: str | None = None) -> DataFrame:
    """keys and the mean vector of each group, summed per dimension with partial aggregation.  Rows whose ``mask`` is null or 0
    (padding) don't count; a group of none but those has a zero vector."""
    if mask is not None:
        seen = F.coalesce(F.col(mask).cast("double"), F.lit(0.0))
        per = rows.select(*keys, seen.alias("m"), F.posexplode(vector).alias("dim", "x")).groupBy(*keys, "dim")
        per = per.agg(F.coalesce(F.try_divide(F.sum(F.col("x").cast("double") * F.col("m")), F.sum("m")), F.lit(0.0)).alias("x"))
        return per.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("dim", "x"))), lambda s: s["x"]).alias("embedding"))
    per = rows.select(*keys, F.posexplode(vector).alias("dim", "x")).groupBy(*keys, "dim").agg(F.avg(F.col("x").cast("double")).alias("x"))
    return per.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("dim", "x"))), lambda s: s["x"]).alias("embedding"))
