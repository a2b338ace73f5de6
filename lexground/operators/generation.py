"""Prompts and answers: an interface with a deterministic extractive default; remote models plug in as a function."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import strip

REFUSAL = "The provided context does not contain sufficient information."
#: Fixed value; its lines are written without indentation.
PROMPT = (
    "You are a legal assistant answering questions about Indian law.\n\nContext from legal documents:\n%s\n\nQuestion: %s\n\n"
    "Answer based on the provided context and also explain a little based on the provided context. "
    'If the context doesn\'t contain relevant information, say "' + REFUSAL + '"'
)
ANSWER_WORDS = 60


def prompt(context: Column | str, question: Column | str) -> Column:
    return F.format_string(PROMPT, context, question)


def extractive_answer(context: Column) -> Column:
    """The context's first words; the refusal where there are none."""
    first = F.array_join(F.slice(F.split(strip(context), r"\s+"), 1, ANSWER_WORDS), " ")
    return F.when(first == "", F.lit(REFUSAL)).otherwise(first)


def generate(rows: DataFrame, model: Callable[[str], str] | None = None) -> DataFrame:
    """Adds prompt and answer to (query_id, query, context).  ``model`` maps a prompt to an answer, once per row."""
    rows = rows.withColumn("prompt", prompt("context", "query"))
    if model is None:
        return rows.withColumn("answer", extractive_answer(F.col("context")))
    schema = rows.schema.simpleString()[7:-1].replace(":", " ") + ", answer string"
    return rows.mapInPandas(lambda batches: (b.assign(answer=[model(p) for p in b["prompt"]]) for b in batches), schema)


def generate_with_metadata(rows: DataFrame, hits: DataFrame, model: Callable[[str], str] | None = None) -> DataFrame:
    """query_id, query, answer, context_used, retrieval_metadata (article, score, source of each hit, in rank order).
    ``hits``: query_id, rank, article, final_score, source."""
    item = F.struct("rank", F.struct("article", F.col("final_score").alias("score"), "source").alias("m"))
    told = hits.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(item)), lambda s: s["m"]).alias("retrieval_metadata"))
    answers = generate(rows.select("query_id", "query", "context"), model)
    return answers.join(told, "query_id", "left").select("query_id", "query", "answer", F.col("context").alias("context_used"), "retrieval_metadata")
