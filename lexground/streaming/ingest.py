"""Incremental ingestion: new document files become chunks as they arrive (stateless, so no watermark)."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..operators.chunking import recursive_chunks


def ingest_chunks(spark: SparkSession, source: str, target: str, checkpoint: str) -> StreamingQuery:
    """Appends the fallback chunks of Parquet files (doc_id, text) that appear in ``source`` to ``target``, each once."""
    docs = spark.readStream.schema("doc_id long, text string").parquet(source)
    chunks = recursive_chunks(docs)
    return chunks.writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).trigger(availableNow=True).outputMode("append").start()
