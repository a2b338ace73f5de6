"""Quality rules: word counts of a base rule, then tokeniser fertility with bands per language.

A public vocabulary with byte fallback encodes the text.  Characters per token, the share of byte-fallback tokens and the
entropy of the token distribution (over the logarithm of the number of tokens) place a document among all documents of its
language and length class that pass the base rule; the bands follow the corpus and are computed over all of it, by exact
quartiles of the measures rounded to ``DIGITS`` digits.  A distance is counted in distances of lower quartile and median.
Rejected are documents whose characters per token and entropy together lie more than ``REACH`` such distances below the
medians (text that the vocabulary splits badly and that repeats few tokens), those whose byte share lies more than ``REACH``
upper distances, and ``LEAST_BYTES``, above, and those whose token entropy is under ``LEAST_NATS``.

The less documents a band rests on, the more it leans on a wider one: a length class's quartiles count as its documents, and
those of the next wider group of classes (``WIDTHS``, up to the whole language) as ``WEIGHT`` documents; a language's own
distances lean in the same way on fixed wide ones, ``UNSURE``.  So every document has a band of its own language, its own
measures among them, and no number of documents switches anything; a language met a few times is rejected by its token entropy only.

Defined cases: null text has no words and fails the base rule; null language is a language of its own; repeated rows are
judged each, by their own text; other columns pass through ``judge`` unread, but for those called like a column it adds, which are left out;
``keep`` returns its rows as they came; no rows give no rows.

Words are encoded one by one, so the number of tokens is that of the text with each run of white space made one space.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import beside, cut, kept, nested, release, written
from .tokens import MEMO_CHARS, MEMO_CHUNKS, PIECE_VOCABULARY, vocabulary

#: Base rule: words at least, and the share of words in repeated windows of five at most.
MIN_WORDS, MAX_REPEATED, SPAN = 10, 0.20, 5
SYMBOLS = "#*$%&|<>"
#: Numbers of neighbouring length classes that have a band in common; the last is more than there are.
WIDTHS = (1, 4, 128)
#: Documents that a wider group's quartiles count as.
WEIGHT = 20
#: Digits of the measures that quartiles are taken of.
DIGITS = 4
#: The least token entropy, in nats, of a text (1.5: some 4.5 tokens equally often).
LEAST_NATS = 1.5
#: Distances of quartile and median of a language of which nothing is known.
UNSURE = {"chars_per_token": 1.0, "byte_share": 0.2, "entropy": 0.2}
#: The summed distance below the medians, and beyond the byte share's median, that rejects; the least byte share that does.
REACH, LEAST_BYTES = 6.0, 0.05
#: The least distance of quartile and median that counts, so that groups of copies do not make a band too narrow.
LEAST = {"chars_per_token": 0.02, "byte_share": 0.005, "entropy": 0.008}
#: Bands up to this many are broadcast; beyond, they are joined by a shuffle.
BROADCAST_BANDS = 20_000
METRICS = ("chars_per_token", "byte_share", "entropy")

_blank = re.compile("[\x20\x09-\x0d]+")
_MEASURED = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_tokens long, chars_per_token double, byte_share double, entropy double"


def repeated_words(words: list) -> int:
    """How many words lie in windows of ``SPAN`` words that the text holds more than once."""
    import numpy as np

    n = len(words) - SPAN + 1
    if n < 2:
        return 0
    number: dict = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words))
    kinds = len(number)
    windows, size = ids, 1
    for step in range(1, SPAN):  # exact numbers of longer and longer windows
        longer = windows[: len(ids) - step].astype(np.int64) * kinds + ids[step:]
        if step < SPAN - 1 and size * kinds * kinds >= 2**62:
            longer = np.unique(longer, return_inverse=True)[1]
            size = len(longer)
        else:
            size *= kinds
        windows = longer
    order = np.argsort(windows, kind="stable")
    ordered = windows[order]
    same = ordered[1:] == ordered[:-1]
    repeated = np.zeros(n, bool)
    repeated[order[1:][same]] = True
    repeated[order[:-1][same]] = True
    edges = np.zeros(len(ids) + 1, np.int64)
    at = np.flatnonzero(repeated)
    np.add.at(edges, at, 1)
    np.add.at(edges, at + SPAN, -1)
    return int((np.cumsum(edges)[:-1] > 0).sum())


class PieceCounter:
    """Token numbers of texts, chunk by chunk: pieces never cross white space."""

    def __init__(self, name: str = PIECE_VOCABULARY):
        import numpy as np
        import sentencepiece

        self.processor = sentencepiece.SentencePieceProcessor(model_file=vocabulary(name))
        self.is_byte = np.array([self.processor.is_byte(i) for i in range(self.processor.get_piece_size())])
        self.memo: dict[str, bytes] = {"": b""}

    def _chunk(self, chunk: str) -> bytes:
        import struct

        ids = self.processor.encode(chunk)
        found = struct.pack(f"<{len(ids)}I", *ids)
        if len(self.memo) < MEMO_CHUNKS and len(chunk) <= MEMO_CHARS:
            self.memo[chunk] = found
        return found

    def fertility(self, chunks: list[str]) -> tuple[int, float, float]:
        """Tokens, share of byte-fallback tokens, entropy over the logarithm of the number of tokens."""
        import numpy as np

        memo = self.memo
        ids = np.frombuffer(b"".join([memo[c] if c in memo else self._chunk(c) for c in chunks]), "<u4")
        n = len(ids)
        if n < 2:
            return n, 0.0, 1.0
        counts = np.unique(ids, return_counts=True)[1]
        return n, float(self.is_byte[ids].mean()), float(np.log(n) - (counts * np.log(counts)).sum() / n) / float(np.log(n))


def piece_counter(name: str) -> PieceCounter:
    """One counter per Python worker."""
    return kept(name, lambda: PieceCounter(name))


def _measures(tokenizer: str):
    """A function of a text column: the counts and fertility of each whole text.  Only texts leave the JVM; the rows stay."""
    names = [f.split()[0] for f in _MEASURED.split(", ")]

    @F.pandas_udf(_MEASURED)
    def measured(texts: pd.Series) -> pd.DataFrame:
        counter, rows = piece_counter(tokenizer), []
        for text in texts:
            text = text or ""
            words = _blank.sub(" ", text).strip(" ").split(" ") if text else []
            if words == [""]:
                words = []
            chars = sum(map(len, words))
            lines = [x for x in text.split("\n") if x and not _blank.fullmatch(x)]
            tokens, byte_share, entropy = counter.fertility(words)
            rows.append((
                len(words), chars, sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines)), repeated_words(words),
                tokens, chars / max(1, tokens), byte_share, entropy,
            ))
        release()
        return pd.DataFrame(rows, columns=names)

    return measured.asNondeterministic()  # so that it is evaluated once however often its fields are used


def measure(documents: DataFrame, tokenizer: str = PIECE_VOCABULARY) -> DataFrame:
    """document (all columns), lang, the measures, base_failed, length_class."""
    base = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > int(100 * MAX_REPEATED) * F.col("n_words"))
    rows = nested(documents).withColumn("m", _measures(tokenizer)(F.col("document.text").cast("string")))
    rows = rows.select("document", F.col("document.lang").cast("string").alias("lang"), "m.*")
    return rows.withColumns({"base_failed": base, "length_class": F.floor(2 * F.log2(F.greatest("n_tokens", F.lit(1)))).cast("int")})


def _on(left: DataFrame, right: DataFrame, keys: list[str], few: bool) -> DataFrame:
    """Joined, nulls being equal; the keys of ``right`` are dropped."""
    right = right.withColumnsRenamed({k: f"own_{k}" for k in keys})
    joined = left.join(F.broadcast(right) if few else right, [left[k].eqNullSafe(right[f"own_{k}"]) for k in keys], "left")
    return joined.drop(*[f"own_{k}" for k in keys])


def _bands(passing: DataFrame) -> tuple[DataFrame, bool]:
    """lang, length_class, band (for each metric: lower distance, median, upper distance), and whether they can be broadcast."""
    place = lambda w: F.floor(F.col("length_class") / w).cast("int")
    each = F.explode(F.array(*[F.struct(F.lit(w).alias("width"), place(w).alias("place")) for w in WIDTHS]))
    rows = passing.select("lang", each.alias("g"), *[F.round(m, DIGITS).alias(m) for m in METRICS]).select("lang", "g.*", *METRICS)
    quarters = F.array(*[F.lit(x) for x in (0.25, 0.5, 0.75)])
    groups = cut(rows.groupBy("lang", "width", "place").agg(F.count(F.lit(1)).alias("n"), *[F.percentile(m, quarters).alias(m) for m in METRICS]))
    few = groups.count() <= BROADCAST_BANDS
    cells = groups.filter(F.col("width") == WIDTHS[0]).select("lang", F.col("place").alias("length_class"))
    for w in WIDTHS:
        own = groups.filter(F.col("width") == w).select("lang", F.col("place").alias(f"p{w}"), F.struct("n", *METRICS).alias(f"g{w}"))
        cells = _on(cells.withColumn(f"p{w}", place(w)), own, ["lang", f"p{w}"], few).drop(f"p{w}")
    bands = []
    for m in METRICS:
        middle, sides = None, [F.lit(UNSURE[m]), F.lit(UNSURE[m])]
        for w in reversed(WIDTHS):
            n, q = F.col(f"g{w}.n"), F.col(f"g{w}.{m}")
            lean = lambda own, wider: (n * own + WEIGHT * wider) / (n + WEIGHT)  # noqa: B023, E731
            middle = q[1] if middle is None else lean(q[1], middle)
            sides = [lean(q[1] - q[0], sides[0]), lean(q[2] - q[1], sides[1])]
        bands.append(F.array(sides[0], middle, sides[1]).alias(m))
    return cut(cells.select("lang", "length_class", F.struct(*bands).alias("band"))), few


MEASURES = [f.split()[0] for f in _MEASURED.split(", ")]
ADDED = [*MEASURES, "base_failed", "below", "kept"]


def _judged(rows: DataFrame) -> DataFrame:
    """document, and the added columns, from written measures."""
    bands, few = _bands(rows.filter(~F.col("base_failed")))
    rows = _on(rows, bands, ["lang", "length_class"], few)
    band = F.col("band")
    off = lambda m, i: (F.col(m) - band[m][1]) / F.greatest(band[m][i], F.lit(LEAST[m]))
    below = off("chars_per_token", 0) + off("entropy", 0)
    bytes_over = (off("byte_share", 2) > REACH) & (F.col("byte_share") - band["byte_share"][1] > LEAST_BYTES)
    poor = F.col("entropy") * F.ln(F.greatest("n_tokens", F.lit(1))) < LEAST_NATS
    rejected = F.coalesce(below < -REACH, F.lit(False)) | F.coalesce(bytes_over, F.lit(False)) | poor
    return rows.withColumns({"below": below, "kept": ~F.col("base_failed") & ~rejected}).select("document", *ADDED)


def judge(documents: DataFrame, tokenizer: str = PIECE_VOCABULARY) -> DataFrame:
    """The documents' columns, and the measures, base_failed, below (the summed distance), kept.  Texts are not carried."""
    slim = documents.select(*[F.col(f"`{c}`") for c in documents.columns if c != "text"], "text")
    rows = measure(slim, tokenizer).withColumn("document", F.col("document").dropFields("text") if len(slim.columns) > 1 else F.col("document"))
    return beside(_judged(cut(rows)), [c for c in documents.columns if c != "text"], ADDED)


def keep(documents: DataFrame, tokenizer: str = PIECE_VOCABULARY) -> DataFrame:
    """The documents that are kept; each row goes by its own text."""
    return _judged(written(measure(documents, tokenizer))[0]).filter("kept").select("document.*")
