"""The vector store: chunks with their embeddings as Parquet."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.search import vector_search

METADATA = ("chunk_id", "article", "title", "section", "part", "document_title", "hierarchy_level", "method", "token_count")


class VectorStore:
    """``fresh_start`` drops what is stored at ``path`` with the first write."""

    def __init__(self, spark: SparkSession, path: str, fresh_start: bool = False):
        self.spark, self.path, self.mode = spark, path, "overwrite" if fresh_start else "append"

    def add_chunks(self, chunks: DataFrame, embeddings: DataFrame) -> None:
        """Joins by (doc_id, pos); raises unless each chunk has one embedding and each embedding one chunk.  All metadata are
        strings; absent ones stay null."""
        count = lambda rows, name: rows.groupBy("doc_id", "pos").agg(F.count(F.lit(1)).alias(name))
        wrong = count(chunks, "n").join(count(embeddings, "m"), ["doc_id", "pos"], "full_outer").filter("coalesce(n, 0) <> 1 or coalesce(m, 0) <> 1")
        if bad := wrong.first():
            raise ValueError(f"{bad['n'] or 0} chunks but {bad['m'] or 0} embeddings of {bad['doc_id']}, {bad['pos']}")
        meta = [F.col(c).cast("string").alias(c) for c in METADATA if c in chunks.columns]
        ident = F.concat_ws("_", "chunk_id", "doc_id", "pos").alias("id")
        rows = chunks.join(embeddings, ["doc_id", "pos"]).select(ident, "doc_id", "pos", F.col("content").alias("document"), "embedding", *meta)
        rows.write.mode(self.mode).parquet(self.path)
        self.mode = "append"

    def rows(self) -> DataFrame:
        return self.spark.read.parquet(self.path)

    def search(self, queries: DataFrame, top_k: int = 5) -> DataFrame:
        """Hits with content and metadata.  ``queries``: query_id, embedding."""
        stored = self.rows()
        hits = vector_search(stored, queries, top_k)
        return hits.join(stored.drop("embedding"), "id").withColumnRenamed("document", "content")

    def stats(self) -> dict:
        return {"name": self.path.rstrip("/").rsplit("/", 1)[-1], "count": self.rows().count(), "storage": self.path}
