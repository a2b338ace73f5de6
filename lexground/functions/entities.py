"""References and concepts in text: string to array, all native."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import strip
from .vectors import bind

#: Reference patterns (fixed values).
ARTICLE, SECTION, PART = r"(?i)(?:Article|Art\.?)\s+(\d+[A-Z]?)", r"(?i)(?:Section|Sec\.?)\s+(\d+[A-Z]?)", r"(?i)Part\s+([IVX]+[A-Z]?)"
CASE = r"([A-Za-z\s]+?)\s+(?:v\.|vs\.?)\s+([A-Za-z\s]+?)(?:\s+\(|,|\n)"
#: Concept keywords (fixed values).
CONCEPTS = (
    "fundamental rights", "directive principles", "equality", "liberty", "life", "personal liberty", "freedom of speech", "freedom of conscience", "freedom of religion",
    "right to property", "right to education", "right to work", "justice", "due process", "equal protection", "state", "constitution", "parliament", "amendment",
)

#: The same matches: one that starts inside a run of letters and blanks also starts at the run's beginning or where the last
#: match ended, so no other start is tried, which keeps the search linear in a run.
CASE_ANCHORED = r"(?:\G|(?<![A-Za-z\s]))" + CASE


def _refs(c: Column | str, pattern: str, prefix: str) -> Column:
    return F.array_distinct(F.transform(F.regexp_extract_all(c, F.lit(pattern), 1), lambda x: F.concat(F.lit(prefix), x)))


def article_refs(c: Column | str) -> Column:
    return _refs(c, ARTICLE, "Article_")


def section_refs(c: Column | str) -> Column:
    return _refs(c, SECTION, "Section_")


def part_refs(c: Column | str) -> Column:
    return _refs(c, PART, "Part_")


def case_refs(c: Column) -> Column:
    """X_v_Y; both raw sides longer than three characters.  Rows without a separator skip the pattern, which is slow on long
    runs of letters."""
    # a match is searched for once in the whole text, its sides in the match alone
    whole = F.regexp_extract_all(c, F.lit(CASE_ANCHORED), 0)
    pairs = F.transform(whole, lambda m: F.struct(F.regexp_extract(m, "^" + CASE, 1).alias("a"), F.regexp_extract(m, "^" + CASE, 2).alias("b")))
    kept = F.filter(pairs, lambda p: (F.length(p["a"]) > 3) & (F.length(p["b"]) > 3))
    found = F.array_distinct(F.transform(kept, lambda p: F.concat(strip(p["a"]), F.lit("_v_"), strip(p["b"]))))
    return F.when(c.rlike(r"\s(?:v\.|vs)"), found).otherwise(F.array().cast("array<string>"))


def concepts(c: Column | str) -> Column:
    """Only texts that hold a concept's letters, of either case, are searched for its words."""
    text = F.col(c) if isinstance(c, str) else c

    def hits(low: Column) -> Column:
        return F.array(*[F.when(low.contains(k) & text.rlike(rf"(?i)\b{k}\b"), F.lit(k.replace(" ", "_"))) for k in CONCEPTS])

    return F.array_compact(bind(F.lower(text), hits))


def entity_type(c: Column | str) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return (
        F.when(c.startswith("Article_"), "article").when(c.startswith("Section_"), "section").when(c.startswith("Part_"), "part")
        .when(c.startswith("Case_") | c.contains("_v_"), "case").otherwise("concept")
    )


def close_in_text(text: Column, a: Column, b: Column, window: int = 500) -> Column:
    """Whether the first mentions of two entities, underscores as spaces, are nearer than ``window`` characters."""
    x, y = (F.call_function("instr", text, F.replace(e, F.lit("_"), F.lit(" "))) for e in (a, b))
    return (x > 0) & (y > 0) & (F.abs(x - y) < window)
