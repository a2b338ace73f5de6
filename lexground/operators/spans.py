"""Answer spans, their support by the context, and faithfulness scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import strip, words
from ..functions.vectors import DIMENSIONS, bind, hashed_embedding, norm, word_dimensions

SUPPORTED, UNCERTAIN = 0.65, 0.40
WEIGHTS = (0.5, 0.3, 0.2)
#: Fixed values.
GENERIC = ("based on", "according to", "the provided", "the context", "stated above")


#: Ends a span's text in front of its words' dimensions, two hexadecimal digits each.
_MARK = "\x01"
#: Words of the longest span.
LONGEST = 7


def _spans_of(answer: Column, coded: bool) -> Column:
    sentences = F.split(F.coalesce(answer, F.lit("")), r"(?<=[.!?])\s+")

    def cut(s: Column) -> Column:
        def of(w: Column, codes: Column | None) -> Column:
            tail = lambda c: F.concat(F.lit(_MARK), F.array_join(c, ""))
            short = strip(s) if codes is None else F.concat(strip(s), tail(codes))

            def window(i: Column, n: Column) -> Column:
                text = F.array_join(F.slice(w, i, n), " ")
                return text if codes is None else F.concat(text, tail(F.slice(codes, i, n)))

            of_size = lambda n: F.when(F.size(w) >= n, F.transform(F.sequence(F.lit(1), F.greatest(F.size(w) - n + 1, F.lit(1))), lambda i: window(i, n))).otherwise(F.array().cast("array<string>"))
            return F.when(F.size(w) < 5, F.array(short)).otherwise(F.flatten(F.transform(F.sequence(F.lit(4), F.lit(LONGEST)), of_size)))

        # a sentence is cut into words once, not for each of its windows, and each word hashed once
        if not coded:
            return bind(words(s), lambda w: of(w, None))
        codes = F.transform(word_dimensions(s), lambda d: F.lpad(F.hex(d), 2, "0"))
        return bind(words(s), lambda w: bind(codes, lambda c: of(w, c)))

    return F.array_distinct(F.flatten(F.transform(sentences, cut)))


def spans_of(answer: Column) -> Column:
    """Short sentences themselves, else all windows of four to seven words; distinct."""
    return _spans_of(answer, False)


def _has_phrase(span: Column) -> Column:
    low, hit = F.lower(span), F.lit(False)
    for phrase in GENERIC:
        hit = hit | low.contains(phrase)
    return hit


def is_generic(span: Column) -> Column:
    return _has_phrase(span) | (F.size(words(span)) < 3)


def status(confidence: Column, supported: float = SUPPORTED, uncertain: float = UNCERTAIN) -> Column:
    return F.when(confidence >= supported, "supported").when(confidence >= uncertain, "uncertain").otherwise("hallucinated")


def detect(answers: DataFrame) -> DataFrame:
    """answer_id, span, confidence (4 digits), status.  ``answers``: answer_id, answer, context.

    The context's vector is computed once per answer, a word's dimension once per sentence; generic spans go before any similarity
    is.  A span has few words, so its cosine is written out."""
    counts = hashed_embedding(F.coalesce("context", F.lit("")))
    # spans are runs of the answer's words, so most answers show at once that no span has a generic phrase
    phrased = F.coalesce(_has_phrase(F.array_join(words("answer"), " ")), F.lit(False))
    of_answer = bind(counts, lambda dense: F.struct(norm(dense).alias("dense_norm"), F.array_append(dense, F.lit(0.0)).alias("dense"), phrased.alias("phrased")))
    rows = answers.select("answer_id", "answer", F.explode(F.array(of_answer)).alias("a"))  # attributes, so computed once for all spans
    rows = rows.select("answer_id", "a", F.explode(_spans_of(F.col("answer"), True)).alias("coded")).select("answer_id", "a.*", "coded")
    rows = rows.withColumn("codes", F.substring_index("coded", _MARK, -1)).withColumn("n", F.coalesce(F.expr("length(codes) div 2"), F.lit(0)))
    rows = rows.withColumn("span", F.substr("coded", F.lit(1), F.length("coded") - 2 * F.col("n") - 1))
    rows = rows.filter((F.col("n") >= 3) & ~(F.col("phrased") & _has_phrase(F.col("span"))))
    # the dimensions as a number's bytes, as many as the longest span has words: absent words are of one more, which no context has
    absent = F.lit(LONGEST) - F.col("n")
    packed = F.coalesce(F.conv(F.lpad("codes", 2 * LONGEST, f"{DIMENSIONS:02X}"), 16, 10).cast("long"), F.lit(0))
    rows = rows.select("answer_id", "span", "dense", "dense_norm", "n", packed.alias("packed"))
    rows = rows.select("answer_id", "span", "dense", "dense_norm", "n", *[F.shiftrightunsigned("packed", 8 * i).bitwiseAND(F.lit(255)).cast("int").alias(f"d{i}") for i in range(LONGEST)])
    product, equal = F.lit(0.0), F.lit(0)  # sums of whole numbers
    for i in range(LONGEST):
        product = product + F.get("dense", F.col(f"d{i}"))
        for j in range(i):
            equal = equal + (F.col(f"d{i}") == F.col(f"d{j}")).cast("int")
    squares = F.col("n") + 2 * equal - absent * (absent - 1)
    size = F.sqrt(squares.cast("double")) * F.col("dense_norm")
    c = F.when(size == 0, F.lit(0.0)).otherwise(product / size)
    rows = rows.select("answer_id", "span", F.explode(F.array(c)).alias("c"))  # an attribute, so a filter on the status computes nothing twice
    # rounding to nine digits is slow, and tells only beside a threshold
    beside = (F.abs(F.col("c") - SUPPORTED) < 1e-6) | (F.abs(F.col("c") - UNCERTAIN) < 1e-6)
    return rows.select("answer_id", "span", F.round("c", 4).alias("confidence"), status(F.when(beside, F.round("c", 9)).otherwise(F.col("c"))).alias("status"))


def hallucinated(spans: DataFrame) -> DataFrame:
    return spans.filter("status = 'hallucinated'")


def _counts() -> list[Column]:
    return [F.count(F.lit(1)).alias("total_spans"), *[F.count_if(F.col("status") == s).alias(s) for s in ("supported", "uncertain", "hallucinated")]]


def _shares() -> list[Column]:
    s = F.col("status")
    return [
        F.avg((s == "supported").cast("double")).alias("f"), (1 - F.avg((s == "hallucinated").cast("double"))).alias("u"),
        (F.sum(F.when(s != "hallucinated", F.col("confidence")).otherwise(0.0)) / F.count(F.lit(1))).alias("e"),
    ]


def _of_answers(answers: DataFrame, spans: DataFrame, found: list[Column]) -> DataFrame:
    """answer_id and what is ``found`` of its spans; zeros for answers without any."""
    return answers.select("answer_id").join(spans.groupBy("answer_id").agg(*found), "answer_id", "left").fillna(0)


def _scores(weights: tuple[float, float, float]) -> dict[str, Column]:
    overall = weights[0] * F.col("f") + weights[1] * F.col("u") + weights[2] * F.col("e")
    return {"faithfulness_score": F.round("f", 4), "unsupported_claim_score": F.round("u", 4), "evidence_coverage_score": F.round("e", 4), "overall_faithfulness": F.round(overall, 4)}


def summary(answers: DataFrame, spans: DataFrame) -> DataFrame:
    """answer_id, total_spans, supported, uncertain, hallucinated, hallucination_rate; zeros for answers without spans."""
    rows = _of_answers(answers, spans, _counts())
    return rows.withColumn("hallucination_rate", F.when(F.col("total_spans") > 0, F.round(F.col("hallucinated") / F.col("total_spans"), 4)).otherwise(0.0))


def faithfulness(answers: DataFrame, spans: DataFrame, weights: tuple[float, float, float] = WEIGHTS) -> DataFrame:
    """answer_id and the four scores (4 digits); all 0 for answers without spans."""
    return _of_answers(answers, spans, _shares()).select("answer_id", *[c.alias(name) for name, c in _scores(weights).items()])


def report(spans: DataFrame, n_hallucinated: int = 5, n_spans: int = 10, chars: int = 50) -> DataFrame:
    """What a page shows of each answer: the first hallucinated spans, whole, and the first spans, shortened; in order of span."""
    # the spans are gone through once: the first of either list are among the first of those that are hallucinated and of the rest
    rows = spans.withColumn("bad", F.col("status") == "hallucinated")
    rows = rows.withColumn("m", F.row_number().over(Window.partitionBy("answer_id", "bad").orderBy("span"))).filter(F.col("m") <= max(n_hallucinated, n_spans))
    rows = rows.withColumn("n", F.row_number().over(Window.partitionBy("answer_id").orderBy("span")))
    bad = F.when(F.col("bad") & (F.col("m") <= n_hallucinated), F.struct(F.lit("hallucinated").alias("list"), F.col("m").alias("n"), F.col("span").alias("span")))
    first = F.when(F.col("n") <= n_spans, F.struct(F.lit("spans").alias("list"), F.col("n").alias("n"), F.substring("span", 1, chars).alias("span")))
    return rows.select("answer_id", F.explode(F.array_compact(F.array(bad, first))).alias("r"), "confidence", "status").select("answer_id", "r.*", "confidence", "status")


def sources(hits: DataFrame, n_sources: int = 3, chars: int = 500) -> DataFrame:
    """query_id, n (from 1), article, final_score, preview of the first hits.  ``hits``: query_id, rank, article, final_score, content."""
    preview = F.concat(F.substring(F.coalesce("content", F.lit("")), 1, chars), F.lit("..."))
    return hits.filter(F.col("rank") < n_sources).select("query_id", (F.col("rank") + 1).alias("n"), "article", "final_score", preview.alias("preview"))


def metrics(answers: DataFrame, spans: DataFrame) -> DataFrame:
    """answer_id, total_spans, supported, hallucinated, overall_faithfulness, faithfulness and evidence_coverage (2 digits),
    unsupported_claims (a number of spans)."""
    rows = _of_answers(answers, spans, _counts() + _shares())  # the spans are gone through once
    rows = rows.select("*", *[c.alias(name) for name, c in _scores(WEIGHTS).items()])
    return rows.select(
        "answer_id", "total_spans", "supported", "hallucinated", "overall_faithfulness", F.round("faithfulness_score", 2).alias("faithfulness"),
        F.col("hallucinated").alias("unsupported_claims"), F.round("evidence_coverage_score", 2).alias("evidence_coverage"),
    )
