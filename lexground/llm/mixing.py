"""Mixing sources to target weights by Poisson replication (native).

A source's target share is its code points to the power ``temperature``, or what ``weights`` says; its repetition rate is
the share of ``budget`` (1: as many code points as come in) over what the source holds.  Each document draws its count by
inverting the Poisson distribution of its source's rate at a hash of its id, is exploded by the count, and all copies are
dealt out by a hash.

Defined cases: null source is a source of its own; null text has no code points; a source without code points has rate 1,
so empty documents stay; rows that repeat a doc_id draw the same count; null doc_id draws as the text "null"; other columns
pass through; input columns called like an added one (mix_rate, mix_copies, mix_copy, mix_key) keep their name and value, and
the added one is left out; no rows give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, nested

SEED = "mix-1"
TEMPERATURE = 0.5
#: Sources up to this many are broadcast (a few tens of bytes each); beyond, the rates are joined by a shuffle.
BROADCAST_SOURCES = 10_000
_BITS = 52


def hashed_uniform(*parts: Column | str) -> Column:
    """In [0, 1), from the first 52 bits of an MD5, exactly representable."""
    digest = F.md5(F.concat_ws(":", *parts).cast("binary"))
    return F.conv(F.substring(digest, 1, _BITS // 4), 16, 10).cast("double") / F.lit(float(2**_BITS))


def rates(documents: DataFrame, weights: dict[str, float] | None = None, temperature: float = TEMPERATURE, budget: float = 1.0) -> DataFrame:
    """source, size, rate: one row per source."""
    size = F.sum(F.coalesce(F.length("text"), F.lit(0)).cast("long"))
    sources = documents.groupBy("source").agg(size.alias("size"))
    share = F.sqrt("size") if temperature == 0.5 else F.pow(F.col("size").cast("double"), F.lit(temperature))
    if weights is not None:
        known = F.create_map(*[F.lit(x) for k, v in weights.items() for x in (k, float(v))])
        share = F.coalesce(known[F.coalesce("source", F.lit(""))], F.lit(0.0))
    sources = cut(sources.withColumn("share", F.round(share, 6)))
    total = sources.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("size"), F.round(F.coalesce(F.sum("share"), F.lit(0.0)), 6).alias("share")).first()
    rate = F.col("share") / F.lit(float(total["share"] or 1.0)) * F.lit(budget) * F.lit(float(total["size"])) / F.col("size")
    return sources.select(F.col("source").alias("rate_source"), "size", F.when(F.col("size") > 0, F.round(rate, 9)).otherwise(1.0).alias("rate"))


def poisson_quantile(rate: Column, u: Column) -> Column:
    """The least k whose cumulative probability exceeds u.

    The steps are as many as the largest 52-bit u can need, so nothing is cut.  Probabilities are kept as logarithms, so
    large rates do not underflow."""
    most = F.ceil(rate + F.lit(12.0) * F.sqrt(rate) + F.lit(60.0)).cast("int")
    start = F.struct(F.lit(0).alias("count"), (-rate).alias("log_p"), F.exp(-rate).alias("cdf"))

    def step(s: Column, k: Column) -> Column:
        log_p = s["log_p"] + F.ln(rate) - F.ln(k.cast("double"))
        return F.struct(F.when(s["cdf"] <= u, k).otherwise(s["count"]).alias("count"), log_p.alias("log_p"), (s["cdf"] + F.exp(log_p)).alias("cdf"))

    return F.when(rate > 0, F.aggregate(F.sequence(F.lit(1), most), start, step, lambda s: s["count"])).otherwise(0)


ADDED = ("mix_rate", "mix_copies", "mix_copy", "mix_key")


def replicate(documents: DataFrame, weights: dict[str, float] | None = None, temperature: float = TEMPERATURE, budget: float = 1.0, seed: str = SEED) -> DataFrame:
    """The input's columns, and mix_rate, mix_copies, mix_copy (from 0), mix_key: a row per copy, dealt out by mix_key."""
    table = rates(documents, weights, temperature, budget)
    small = table.count() <= BROADCAST_SOURCES
    table = table.select("rate_source", F.col("rate").alias("mix_rate"))
    joined = nested(documents).join(F.broadcast(table) if small else table, F.col("document.source").eqNullSafe(F.col("rate_source")))
    ident = F.coalesce(F.col("document.doc_id").cast("string"), F.lit("null"))
    drawn = joined.withColumn("mix_copies", poisson_quantile(F.col("mix_rate"), hashed_uniform(F.lit(seed), ident)))
    copies = drawn.filter("mix_copies > 0").withColumn("mix_copy", F.explode(F.sequence(F.lit(0), F.col("mix_copies") - 1)))
    keyed = copies.withColumn("mix_key", F.md5(F.concat_ws(":", F.lit(seed), ident, F.col("mix_copy")).cast("binary")))
    return keyed.repartition("mix_key").sortWithinPartitions("mix_key").select("document.*", *[c for c in ADDED if c not in documents.columns])
