"""Chunking: article-aware, subdivision, fallback split, strategy choice, report."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import clean_title, document_title, remove_footers, strip, token_count

MIN_TOKENS, MAX_CHUNK, SUBDIVIDE_FROM, MIN_REGEX_CHUNKS = 50, 512, 512, 5
#: The article pattern: number, title line, lazy body up to the next article, part or the end (a fixed value).
ARTICLE = r"(?mi)(?:^|\n)\s*(\d+[A-Z]?)\s*[.—\-]?\s*([^\n]+?)\n([\s\S]*?)(?=\n\s*(?:\d+[A-Z]?)\s*[.—\-]|\nPART\s+[IVX]+|\z)"
#: The same matches: a body can only end before a line break or with the text, so whole lines are taken and only breaks are tried.
ARTICLE_BY_LINES = r"(?mi)(?:^|\n)\s*(\d+[A-Z]?)\s*[.—\-]?\s*([^\n]+?)\n([^\n]*+(?:\n(?!\s*(?:\d+[A-Z]?)\s*[.—\-]|PART\s+[IVX]+)[^\n]*+)*+)"
#: The marker of a numbered part (a fixed value).
MARKER = r"\n\s*\(\d+\)\s*"
_CUT = "\x01"


def article_chunks(docs: DataFrame, text: str = "text", *carried: str) -> DataFrame:
    """doc_id, pos, article, title, content, token_count (and the ``carried`` columns) of articles of at least 50 tokens; one
    pass finds whole articles."""
    head = r"(?i)^\s*(\d+[A-Z]?)\s*[.—\-]?\s*([^\n]+?)\n"
    # rows are made in two steps, so that what a step computes is an attribute to the next and computed once
    whole = docs.select("doc_id", *carried, F.posexplode(F.regexp_extract_all(text, F.lit(ARTICLE_BY_LINES), 0)).alias("pos", "whole"))
    parts = F.struct(F.regexp_extract("whole", head, 1).alias("article"), clean_title(F.regexp_extract("whole", head, 2)).alias("title"), strip(F.regexp_replace("whole", head, "")).alias("body"))
    rows = whole.select("doc_id", *carried, "pos", F.explode(F.array(parts)).alias("p"))
    content = F.concat(F.lit("Article "), "p.article", F.lit(". "), "p.title", F.lit("\n"), "p.body")
    rows = rows.select("doc_id", *carried, "pos", "p.article", "p.title", F.explode(F.array(content)).alias("content"))
    rows = rows.select("doc_id", *carried, "pos", "article", "title", "content", F.explode(F.array(token_count("content"))).alias("token_count"))
    return rows.filter(F.col("token_count") >= MIN_TOKENS)


def smart_subdivide(chunks: DataFrame, *carried: str) -> DataFrame:
    """Adds sub, section, hierarchy_level: long chunks with several numbered parts of 50 tokens become those parts."""
    marked = F.split(F.regexp_replace("content", f"({MARKER})", _CUT + "$1"), _CUT)
    parts = F.filter(F.transform(F.slice(marked, F.lit(2), F.size(marked)), strip), lambda p: token_count(p) >= MIN_TOKENS)
    divide = (F.col("token_count") >= SUBDIVIDE_FROM) & (F.size("parts") > 1)
    marked_only = F.when(F.col("token_count") >= SUBDIVIDE_FROM, parts).otherwise(F.array().cast("array<string>"))
    rows = chunks.select("*", F.explode(F.array(marked_only)).alias("parts")).withColumn("divide", divide)
    rows = rows.select(
        "*", F.posexplode(F.when(F.col("divide"), F.col("parts")).otherwise(F.array("content"))).alias("sub", "piece")
    )
    return rows.select(
        "doc_id", *carried, "pos", "sub", "article", "title", F.col("piece").alias("content"), token_count("piece").alias("token_count"),
        F.when(F.col("divide"), F.regexp_extract("piece", r"^\((\d+)\)", 1)).alias("section"), F.when(F.col("divide"), "subsection").otherwise("unknown").alias("hierarchy_level"),
    )


def recursive_chunks(docs: DataFrame, text: str = "text", max_chunk: int = MAX_CHUNK, *carried: str) -> DataFrame:
    """doc_id, pos, content, token_count (and the ``carried`` columns): one split at the first separator that the text holds."""
    c = F.col(text)
    pieces = F.when(c.contains("\n\n"), F.split(c, r"\n\n")).when(c.contains("\n"), F.split(c, r"\n")).when(c.contains(". "), F.split(c, r"\. ")).otherwise(F.split(c, " "))
    good = F.filter(F.transform(pieces, strip), lambda p: p != "")
    rows = docs.select("doc_id", *carried, F.posexplode(good).alias("pos", "content")).withColumn("token_count", token_count("content"))
    return rows.filter(F.col("token_count").between(MIN_TOKENS, 2 * max_chunk))


def hybrid_chunks(docs: DataFrame, max_chunk: int = MAX_CHUNK) -> DataFrame:
    """The final chunks: article-aware where that gives more than five, else the fallback; with ids and metadata."""
    docs = docs.withColumn("document_title", document_title(F.col("text"))).withColumn("text", remove_footers("text"))
    by_article = smart_subdivide(article_chunks(docs, "text", "document_title"), "document_title").checkpoint()  # articles are searched for once; read twice below
    per_doc = Window.partitionBy("doc_id")
    by_article = by_article.withColumn("n", F.count(F.lit(1)).over(per_doc)).filter(F.col("n") > MIN_REGEX_CHUNKS)
    by_article = by_article.withColumn("chunk_id", F.concat_ws("_", F.lit("article"), "article", "n"))
    order = Window.partitionBy("doc_id").orderBy("pos", "sub")
    by_article = by_article.select(
        "doc_id", "document_title", (F.row_number().over(order) - 1).alias("pos"), "chunk_id", "content", "article", "title", "token_count",
        F.lit("improved_regex").alias("method"), "section", "hierarchy_level",
    )
    rest = docs.join(by_article.select("doc_id").distinct(), "doc_id", "left_anti")
    fallback = recursive_chunks(rest, "text", max_chunk, "document_title").select(
        "doc_id", "document_title", "pos", F.concat(F.lit("recursive_"), "pos").alias("chunk_id"), "content", F.lit(None).cast("string").alias("article"), F.substring("content", 1, 100).alias("title"),
        "token_count", F.lit("recursive").alias("method"), F.lit(None).cast("string").alias("section"), F.lit("text_block").alias("hierarchy_level"),
    )
    return by_article.unionByName(fallback).withColumn("part", F.lit("Unknown"))


def chunk_report(chunks: DataFrame, max_chunk: int = MAX_CHUNK) -> DataFrame:
    n = F.col("token_count")
    return chunks.agg(
        F.count(F.lit(1)).alias("total_chunks"), F.sum(n).alias("total_tokens"), F.round(F.avg(n), 1).alias("avg_tokens"),
        F.max(n).alias("max_tokens"), F.min(n).alias("min_tokens"), F.count_if(n > max_chunk).alias("oversized"),
    ).filter("total_chunks > 0")


def sample_chunks(chunks: DataFrame, n: int = 3, seed: str = "0") -> DataFrame:
    """n chunks by a hash, with 500-character previews."""
    key = F.md5(F.concat_ws(":", F.lit(seed), "doc_id", "pos").cast("binary"))
    return chunks.withColumn("sample_key", key).orderBy("sample_key").limit(n).select("doc_id", "pos", "sample_key", F.substring("content", 1, 500).alias("preview"))
