"""Composed plans: index builds and batches of questions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import Config
from ..functions.text import clean_raw_text
from ..operators import chunking, embedding, generation, graph, search, spans
from ..sources.store import VectorStore


def build_chunks(documents: DataFrame, config: Config = Config()) -> DataFrame:
    return chunking.hybrid_chunks(documents.withColumn("text", clean_raw_text("text")), config.max_chunk_size)


def build_index(documents: DataFrame, store: VectorStore, config: Config = Config(), model=None) -> dict:
    """Chunks, their embeddings and their metadata into the store; its statistics."""
    chunks = build_chunks(documents, config).checkpoint()  # joined with its own embeddings
    store.add_chunks(chunks, embedding.embed(chunks, ["doc_id", "pos"], model=model, dimensions=config.embedding_dimensions, max_words=config.embedding_max_words))
    return store.stats()


def build_graph(chunks: DataFrame) -> dict[str, DataFrame]:
    found = graph.with_entities(chunks).drop("content").checkpoint()  # read several times below
    nodes = graph.nodes(graph.entities(found)).checkpoint()
    known = graph.sent(nodes)
    return {"nodes": nodes, "edges": graph.edges(graph.relations(found), known), "entity_chunks": graph.entity_chunks(found, known)}


def answer(questions: DataFrame, chunks: DataFrame, chunk_vectors: DataFrame, knowledge: dict[str, DataFrame] | None = None, config: Config = Config(), model=None, embedder=None) -> dict[str, DataFrame]:
    """hits, answers, spans, scores for (query_id, query).  ``chunks``: id, article, content; ``chunk_vectors``: id, embedding;
    without ``knowledge`` the ranking is by vectors alone."""
    asked = embedding.embed(questions, ["query_id"], "query", embedder, config.embedding_dimensions, config.embedding_max_words)
    found = search.vector_search(chunk_vectors, asked, config.top_k).withColumnRenamed("id", "chunk_id").checkpoint()
    meta = chunks.select(F.col("id").alias("chunk_id"), "article", "content")
    if knowledge is None:
        graph_hits = found.select("query_id", "chunk_id", F.lit(0.0).alias("graph_distance")).filter(F.lit(False))
    else:
        vector_hits = meta.filter("article is not null").select("chunk_id", "article").join(graph.sent(found), "chunk_id")
        seeds = vector_hits.groupBy("query_id", F.concat(F.lit("Article_"), "article").alias("seed")).agg(F.min("rank").alias("seed_rank")).checkpoint()
        near = graph.nearest(knowledge["edges"], seeds, config.graph_depth, config.top_k).checkpoint()
        graph_hits = graph.telling_hits(near, knowledge["entity_chunks"].select("entity", "chunk_id"), found, config.top_k)
    # each stage is written out, as the ones after it read it more than once
    fused = search.fuse(found.select("query_id", "chunk_id", "rank"), graph_hits, config.top_k).checkpoint()
    hits = fused.join(meta.join(graph.sent(fused.select("chunk_id")), "chunk_id", "left_semi"), "chunk_id", "left").checkpoint()
    asked_with = questions.select("query_id", "query").join(search.assemble_context(hits), "query_id")
    answers = generation.generate(asked_with, model).withColumnRenamed("query_id", "answer_id").checkpoint()
    found_spans = spans.detect(answers).checkpoint()
    return {"hits": hits, "answers": answers, "spans": found_spans, "scores": spans.faithfulness(answers, found_spans)}
