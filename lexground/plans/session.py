"""A session: a vector store and a knowledge graph that questions are put to."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Config
from ..operators.embedding import embed
from ..sources.store import VectorStore
from . import pipeline

#: Questions that a new index is tried with (fixed values).
TRIAL = ("What is Article 21?", "Right to life and personal liberty", "Fundamental rights in Indian Constitution", "Constitutional amendments process")


class Session:
    """The graph is empty until ``build_graph``; without it, the ranking is by vectors alone.  ``embedder`` and ``answerer`` are
    the functions that ``embed`` and ``generate`` take."""

    def __init__(self, spark: SparkSession, config: Config = Config(), embedder=None, answerer=None, fresh_start: bool = False):
        self.spark, self.config, self.embedder, self.answerer = spark, config, embedder, answerer
        self.store, self.knowledge = VectorStore(spark, config.store_path, fresh_start), None

    def build_index(self, documents: DataFrame) -> dict:
        return pipeline.build_index(documents, self.store, self.config, self.embedder)

    def build_graph(self, documents: DataFrame) -> None:
        chunks = pipeline.build_chunks(documents, self.config)
        found = pipeline.build_graph(chunks)
        ids = F.concat_ws("_", "chunk_id", "doc_id", "pos")  # as in the store
        self.knowledge = found | {"entity_chunks": found["entity_chunks"].select("entity", ids.alias("chunk_id"))}

    def search(self, questions: DataFrame, top_k: int = 3) -> DataFrame:
        """query_id, rank, and the hits with content and metadata, of (query_id, query) rows."""
        return self.store.search(embed(questions, ["query_id"], "query", self.embedder, self.config.embedding_dimensions, self.config.embedding_max_words), top_k)

    def trial(self, top_k: int = 3, chars: int = 200) -> DataFrame:
        """query, rank, article, title, part, hierarchy_level, similarity_score, preview of the trial questions' hits."""
        asked = self.spark.createDataFrame(list(enumerate(TRIAL)), "query_id long, query string")
        preview = F.replace(F.substring("content", 1, chars), F.lit("\n"), F.lit(" ")).alias("preview")
        return self.search(asked, top_k).join(asked, "query_id").select("query", "rank", "article", "title", "part", "hierarchy_level", "similarity_score", preview)

    def ask(self, questions: DataFrame) -> dict[str, DataFrame]:
        """hits, answers, spans, scores of (query_id, query) rows."""
        stored = self.store.rows()
        return pipeline.answer(
            questions, stored.select("id", "article", F.col("document").alias("content")), stored.select("id", "embedding"), self.knowledge, self.config, self.answerer, self.embedder,
        )
