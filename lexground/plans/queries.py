"""Registered queries of the retrieval and scoring operators, with their SQL.

The shared tables hold no statutes, so the entity and chunk queries run over a statute view computed from ``documents`` by
functions that both engines have: line j of a document becomes article j."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.entities import CONCEPTS, article_refs, case_refs, concepts, part_refs, section_refs
from ..functions.vectors import normalise, norm
from ..operators import chunking, embedding, generation, graph, search, spans
from ..sources.documents import spread

#: Tables whose rows take long in the scan's own stage.  The others are aggregated, shuffled at once or few.
HEAVY = ("documents",)


def _read(spark: SparkSession, d: str, name: str) -> DataFrame:
    rows = spark.read.parquet(f"{d}/{name}.parquet")
    return spread(rows) if name in HEAVY else rows


def statutes(spark: SparkSession, d: str) -> DataFrame:
    """doc_id, text: the statute view."""
    names = F.array(*[F.lit(c) for c in CONCEPTS])

    def article(p, j):
        n = (j + 1).cast("string")
        tail = F.concat(
            F.lit(" See Article "), ((F.col("doc_id") + j + 1) % 60).cast("string"), F.lit(" and Section "), ((F.col("doc_id") * (j + 1)) % 37).cast("string"),
            F.lit(". It concerns "), F.element_at(names, ((F.col("doc_id") + j) % len(CONCEPTS) + 1).cast("int")), F.lit(" under Part III. (Alpha Beta v. Gamma Delta, 1978)"),
        )
        marked = F.when((F.col("doc_id") + j) % 4 == 0, F.concat(F.lit("\n(1) "), p, F.lit("\n(2) "), p)).otherwise("")
        return F.concat(F.lit("\n"), n, F.lit(". Title of "), n, F.lit(".\n"), p, tail, marked)

    lines = F.split(F.coalesce("text", F.lit("")), "\n")
    return _read(spark, d, "documents").select("doc_id", F.array_join(F.transform(lines, article), "").alias("text"))


def _chunks(spark, d):
    return chunking.article_chunks(statutes(spark, d)).withColumn("chunk_id", F.concat(F.lit("article_"), "article"))


def _found(spark, d):
    return graph.with_entities(_chunks(spark, d))


def _queries_of(e: DataFrame) -> DataFrame:
    """The stated query set: every vector whose id is divisible by 20."""
    return e.filter("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding")


def vector_topk(spark, d):
    e = _read(spark, d, "embeddings")
    return search.vector_search(e.withColumnRenamed("vec_id", "id"), _queries_of(e), 5)


def embedding_normalize(spark, d):
    e = _read(spark, d, "embeddings").select("vec_id", normalise(F.transform("embedding", lambda x: x * 3)).alias("v"))
    rows = e.select("vec_id", F.round(norm("v"), 6).alias("norm"), F.size("v").cast("long").alias("size"), F.posexplode("v").alias("dim", "x"))
    return rows.select("vec_id", "norm", "size", F.col("dim").cast("long").alias("dim"), (F.round("x", 5) + F.lit(0.0)).alias("x"))


def text_embedding(spark, d):
    e = embedding.embed(_read(spark, d, "documents"), ["doc_id"], "text")
    return e.select("doc_id", F.posexplode("embedding").alias("dim", "x")).select("doc_id", F.col("dim").cast("long").alias("dim"), F.round(F.col("x").cast("double"), 5).alias("x"))


def centroid_mean_pool(spark, d):
    return embedding.mean_pool(_read(spark, d, "embeddings"), ["label"]).select("label", F.posexplode("embedding").alias("dim", "x")).select("label", F.col("dim").cast("long").alias("dim"), F.round("x", 6).alias("x"))


def token_count(spark, d):
    return _read(spark, d, "documents").select("doc_id", T.token_count("text").cast("long").alias("tokens"))


def recursive_chunks(spark, d):
    return chunking.recursive_chunks(_read(spark, d, "documents")).select("doc_id", "content", F.col("token_count").cast("long").alias("token_count"))


def chunk_report(spark, d):
    r = chunking.chunk_report(chunking.recursive_chunks(_read(spark, d, "documents")))
    return r.select("total_chunks", "total_tokens", "avg_tokens", F.col("max_tokens").cast("long").alias("max_tokens"), F.col("min_tokens").cast("long").alias("min_tokens"), "oversized")


def sample_chunks(spark, d):
    return chunking.sample_chunks(chunking.recursive_chunks(_read(spark, d, "documents")).withColumn("pos", F.md5(F.col("content").cast("binary"))), 5).select("doc_id", "sample_key", "preview")


def _noisy(spark, d):
    return _read(spark, d, "documents").select("doc_id", F.concat(F.lit("[PAGE_1]\nTHE INDIAN  EVIDENCE ACT, 1872\n"), "text", F.lit("\n 12 \nhy-\nphen [3]  a \t b ****\n\n\n\n 7\nend\n9")).alias("text"))


def clean_raw_text(spark, d):
    return _noisy(spark, d).select("doc_id", T.clean_raw_text("text").alias("cleaned"))


def remove_footers(spark, d):
    return _noisy(spark, d).select("doc_id", T.remove_footers("text").alias("cleaned"))


def clean_text(spark, d):
    return _noisy(spark, d).select("doc_id", T.clean_text("text").alias("cleaned"))


def document_title(spark, d):
    return _noisy(spark, d).select("doc_id", T.document_title(F.col("text")).alias("title"))


def clean_title(spark, d):
    return _read(spark, d, "documents").select("doc_id", T.clean_title(F.concat("text", F.lit(" ,-."))).alias("title"))


def pages_to_text(spark, d):
    from ..sources.documents import from_pages

    turns = _read(spark, d, "conversations")
    return from_pages(turns.select(F.col("conv_id").alias("doc_id"), (F.col("turn") + 1).alias("page"), "text"))


def article_chunks(spark, d):
    return chunking.article_chunks(statutes(spark, d)).select("doc_id", "article", "title", "content", F.col("token_count").cast("long").alias("token_count"))


def smart_subdivide(spark, d):
    return chunking.smart_subdivide(chunking.article_chunks(statutes(spark, d))).select("doc_id", "article", "content", "section", "hierarchy_level", F.col("token_count").cast("long").alias("token_count"))


def hybrid_chunk(spark, d):
    from_checkpoint(spark)
    c = chunking.hybrid_chunks(statutes(spark, d))
    return c.select(*[F.col(x).cast("long").alias(x) if x in ("pos", "token_count") else x for x in c.columns])


def _refs(f):
    return lambda spark, d: statutes(spark, d).select("doc_id", F.explode(f(F.col("text"))).alias("entity"))


def relations(spark, d):
    return graph.relations(_found(spark, d)).groupBy("doc_id", "src", "relationship_type", "dst").agg(F.count(F.lit(1)).alias("n"))


def _written(spark, rows, name):
    """``rows`` as a Parquet table in the checkpoint folder."""
    rows.write.parquet(place := _place(spark, name))
    return spark.read.schema(rows.schema).parquet(place)


def _tables(spark, d):
    found = _written(spark, _found(spark, d).drop("title", "content", "token_count"), "found")  # read three times below
    nodes = graph.nodes(graph.entities(found)).checkpoint()
    known = graph.sent(nodes)
    return found, known, graph.edges(graph.relations(found), known)


def graph_nodes(spark, d):
    return graph.nodes(graph.entities(_found(spark, d)))


def graph_edges(spark, d):
    return _tables(spark, d)[2]


def entity_chunks(spark, d):
    found, nodes, _ = _tables(spark, d)
    return graph.entity_chunks(found, nodes).groupBy("entity").agg(F.count(F.lit(1)).alias("links"), F.countDistinct("doc_id").alias("docs"))


def graph_stats(spark, d):
    _, nodes, edges = _tables(spark, d)
    return graph.graph_stats(nodes, edges)


def graph_volume_edges(spark, d):
    """A graph of the lineitem table: parts are articles, suppliers sections."""
    rows = _read(spark, d, "lineitem").select(
        F.concat(F.lit("Article_"), "l_partkey").alias("src"), F.concat(F.lit("Section_"), "l_suppkey").alias("dst"), F.lit("refers_to").alias("relationship_type")
    )
    ends = rows.select(F.explode(F.array("src", "dst")).alias("entity")).distinct()
    return graph.edges(rows, graph.nodes(ends))


def graph_stats_report(spark, d):
    return graph.stats_report(graph_stats(spark, d))


def _seeds(edges):
    """Every article that has an edge."""
    return edges.select(F.explode(F.array("src", "dst")).alias("seed")).filter(F.col("seed").startswith("Article_")).distinct()


def graph_neighbors(spark, d):
    edges = _tables(spark, d)[2].checkpoint()
    return graph.neighbours(edges, _seeds(edges), 1)


def graph_distance(spark, d):
    edges = _tables(spark, d)[2].checkpoint()
    out = graph.directed_distances(edges, graph.neighbours(edges, _seeds(edges), 1).checkpoint())
    return out.select("seed", "entity", F.when(F.col("graph_distance") < 1e9, F.col("graph_distance")).otherwise(-1.0).alias("graph_distance"))


def from_checkpoint(spark: SparkSession) -> None:
    """A checkpoint folder: the one that the session names; a temporary one only on a local master (tests)."""
    if spark.sparkContext.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None and not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
        import tempfile

        spark.sparkContext.setCheckpointDir(named or tempfile.mkdtemp(prefix="lexground-"))


def _asked(spark, d):
    """Vectors as chunks: those of an id are linked to the article of its remainder by 60, in the graph of the statute view."""
    edges, e = _tables(spark, d)[2].checkpoint(), _read(spark, d, "embeddings")
    hits = search.vector_search(e.withColumnRenamed("vec_id", "id"), _queries_of(e), 5).select("query_id", F.col("id").alias("chunk_id"), "rank").checkpoint()
    article = lambda c: F.concat(F.lit("Article_"), F.col(c) % 60)
    seeds = hits.groupBy("query_id", article("chunk_id").alias("seed")).agg(F.min("rank").alias("seed_rank"))
    return hits, edges, spread(e.select("vec_id")).select(article("vec_id").alias("entity"), F.col("vec_id").alias("chunk_id")), seeds


def graph_search(spark, d):
    _, edges, links, seeds = _asked(spark, d)
    found = graph.graph_search(edges, links, seeds, 1, 5)
    return found.withColumn("graph_distance", F.when(F.col("graph_distance") < 1e9, F.col("graph_distance")).otherwise(-1.0))


def fused_retrieval(spark, d):
    hits, edges, links, seeds = _asked(spark, d)
    near = graph.nearest(edges, seeds, 1, 5).checkpoint()
    return search.fuse(hits, graph.telling_hits(near, links, hits, 5), 5)


def context_assembly(spark, d):
    items = _read(spark, d, "documents").select(F.col("doc_id").alias("chunk_id"), F.col("text").alias("content"))
    fused = fused_retrieval(spark, d).checkpoint()
    return search.assemble_context(fused.join(items.join(graph.sent(fused.select("chunk_id")), "chunk_id", "left_semi"), "chunk_id", "left"))


def _questions(spark, d):
    return _read(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.concat(F.lit("What is "), "text", F.lit("?")).alias("query"), F.col("text").alias("context"))


def prompts(spark, d):
    return generation.generate(_questions(spark, d)).select("query_id", "prompt", "answer")


def _place(spark, name):
    from uuid import uuid4

    from_checkpoint(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid4().hex}"


def _store(spark, d):
    """The fallback chunks of the documents, stored with their embeddings."""
    from ..sources.store import VectorStore

    store = VectorStore(spark, _place(spark, "store"), fresh_start=True)
    chunks = chunking.recursive_chunks(_read(spark, d, "documents")).withColumn("chunk_id", F.concat(F.lit("recursive_"), "pos"))
    store.add_chunks(chunks, embedding.embed(chunks, ["doc_id", "pos"]))
    return store


def store_rows(spark, d):
    r = _store(spark, d).rows()
    return r.select("id", "doc_id", F.col("pos").cast("long").alias("pos"), "document", "token_count", F.size("embedding").cast("long").alias("dim"), F.round(norm("embedding"), 5).alias("norm"))


def store_stats(spark, d):
    found = _store(spark, d).stats()
    return spark.createDataFrame([(found["count"],)], "count long")


def store_search(spark, d):
    asked = embedding.embed(_questions(spark, d), ["query_id"], "query")
    return _store(spark, d).search(asked, 3).select("query_id", "id", F.col("rank").cast("long").alias("rank"), "similarity_score", "content")


def _answered(spark, d):
    """Questions answered from the articles of the statute view, by vectors and graph."""
    from . import pipeline

    from_checkpoint(spark)
    chunks = _chunks(spark, d).withColumn("id", F.concat_ws("_", F.lit("article"), "doc_id", "article")).checkpoint()
    found = pipeline.build_graph(chunks.withColumn("chunk_id", F.col("id")))
    knowledge = found | {"edges": found["edges"].checkpoint(), "entity_chunks": found["entity_chunks"].checkpoint()}
    return pipeline.answer(_questions(spark, d).drop("context"), chunks.select("id", "article", "content"), embedding.embed(chunks, ["id"]).checkpoint(), knowledge)


def process_query(spark, d):
    r = _answered(spark, d)
    return r["answers"].select("answer_id", "answer", F.md5("context").alias("context_md5")).join(r["scores"], "answer_id")


def retrieval_metadata(spark, d):
    r = _answered(spark, d)
    asked = r["answers"].select(F.col("answer_id").alias("query_id"), "query", "context")
    told = generation.generate_with_metadata(asked, r["hits"])
    return told.select("query_id", "answer", F.posexplode("retrieval_metadata").alias("rank", "m")).select("query_id", "answer", F.col("rank").cast("long").alias("rank"), "m.*")


def answer_sources(spark, d):
    r = spans.sources(_answered(spark, d)["hits"])
    return r.withColumn("n", F.col("n").cast("long"))


def _answers(spark, d):
    """Each assistant turn, with the turn before it as its context; a generic phrase in every third."""
    order = Window.partitionBy("conv_id").orderBy("turn")
    t = _read(spark, d, "conversations").withColumn("context", F.coalesce(F.lag("text").over(order), F.lit("")))
    odd = F.when(F.col("turn") % 3 == 1, F.lit(" according to the act.")).otherwise("")
    ident = (F.col("conv_id") * 1000 + F.col("turn")).alias("answer_id")
    return t.filter("role = 'assistant'").select(ident, F.concat("text", odd).alias("answer"), "context")


def answer_spans(spark, d):
    return _answers(spark, d).select("answer_id", F.explode(spans.spans_of(F.col("answer"))).alias("span"))


def generic_span_filter(spark, d):
    return answer_spans(spark, d).filter(~spans.is_generic(F.col("span"))).groupBy("answer_id").agg(F.count(F.lit(1)).alias("spans"))


def span_status(spark, d):
    return spans.detect(_answers(spark, d))


def hallucinated_spans(spark, d):
    return spans.hallucinated(spans.detect(_answers(spark, d)))


def hallucination_summary(spark, d):
    a = _answers(spark, d)
    return spans.summary(a, spans.detect(a))


def answer_report(spark, d):
    r = spans.report(spans.detect(_answers(spark, d)))
    return r.withColumn("n", F.col("n").cast("long"))


def answer_metrics(spark, d):
    a = _answers(spark, d)
    return spans.metrics(a, spans.detect(a))


def faithfulness_scores(spark, d):
    a = _answers(spark, d)
    return spans.faithfulness(a, spans.detect(a))


QUERIES = {f.__name__: f for f in (
    vector_topk, embedding_normalize, centroid_mean_pool, token_count, recursive_chunks, chunk_report, sample_chunks, clean_raw_text, remove_footers, clean_text, document_title,
    text_embedding, store_rows, store_stats, store_search, graph_search, graph_stats_report, process_query, retrieval_metadata, answer_sources, answer_report, answer_metrics,
    clean_title, pages_to_text, article_chunks, smart_subdivide, hybrid_chunk, relations, graph_nodes, graph_edges, entity_chunks, graph_stats, graph_volume_edges, graph_neighbors,
    graph_distance, fused_retrieval, context_assembly, prompts, answer_spans, generic_span_filter, span_status, hallucinated_spans, hallucination_summary, faithfulness_scores,
)} | {"article_refs": _refs(article_refs), "section_refs": _refs(section_refs), "part_refs": _refs(part_refs), "case_refs": _refs(case_refs), "concepts": _refs(concepts)}
