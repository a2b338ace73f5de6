"""Text cleaning and title functions: Column to Column, all native."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Title patterns in order of priority, and the title when none matches (fixed values).
TITLE_PATTERNS = (
    r"THE\s+([A-Z][A-Z\s]+(?:ACT|CODE|CONSTITUTION|ORDINANCE|RULES|REGULATIONS)(?:\s*,\s*\d{4})?)",
    r"([A-Z][A-Z\s]+(?:ACT|CODE|CONSTITUTION|ORDINANCE)(?:\s*,\s*\d{4})?)",
    r"CONSTITUTION\s+OF\s+INDIA",
    r"([A-Z]{3,}(?:\s+[A-Z]{2,}){1,6})",
)
DEFAULT_TITLE = "Unknown Legal Document"
TRAILING = (".", "—", ":", "-", ",")


def strip(c: Column | str) -> Column:
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def collapse(c: Column | str) -> Column:
    return F.regexp_replace(c, r"\s+", " ")


def words(c: Column | str) -> Column:
    return F.filter(F.split(c, r"\s+"), lambda w: w != "")


def token_count(c: Column | str) -> Column:
    """White-space words."""
    return F.size(words(c))


def _chain(c: Column | str, *steps: tuple[str, str]) -> Column:
    for pattern, to in steps:
        c = F.regexp_replace(c, pattern, to)
    return c


#: Patterns of page marks, line ends, blanks and page numbers, and of footers, in the order they are applied (fixed values).
RAW_STEPS = ((r"\[PAGE_\d+\]", ""), (r"-\n", ""), (r"[ \t]+", " "), (r"\n{3,}", "\n\n"), (r"(?md)^\s*\d+\s*$", ""))
FOOTER_STEPS = ((r"(?md)\n\s*\d{1,3}\s*$", ""), (r"\[\d+\]", ""), (r"\*{3,}", ""))


def clean_raw_text(c: Column | str) -> Column:
    """Page marks, hyphenated line ends, runs of blanks and empty lines, lines of a number alone."""
    return strip(_chain(c, *RAW_STEPS))


def remove_footers(c: Column | str) -> Column:
    """Page numbers, bracketed note numbers, runs of stars."""
    return _chain(c, *FOOTER_STEPS)


def clean_text(c: Column | str) -> Column:
    return strip(collapse(c))


def document_title(c: Column) -> Column:
    found = [collapse(strip(F.regexp_extract(F.substring(c, 1, 1000), p, 0))) for p in TITLE_PATTERNS]
    return F.coalesce(*[F.when(F.length(t) > 5, t) for t in found], F.lit(DEFAULT_TITLE))


def clean_title(c: Column) -> Column:
    """One of each trailing mark in turn, white space, 120 characters at a word's end."""
    c = strip(c)
    for mark in TRAILING:  # each step names its input once, so nothing is computed twice
        c = strip(F.regexp_replace(c, rf"\{mark}\z", "") if mark.isascii() else F.regexp_replace(c, rf"{mark}\z", ""))

    def cut(t: Column) -> Column:
        t = F.when(F.length(t) > 120, F.regexp_replace(F.substring(t, 1, 120), r"(?s)^(.*) [^ ]*$", "$1")).otherwise(t)
        return F.when(F.length(t) > 3, t).otherwise(F.lit("Unknown"))

    return F.transform(F.array(collapse(c)), cut)[0]
