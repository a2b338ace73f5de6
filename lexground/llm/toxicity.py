"""Toxicity by class-conditional Kneser-Ney models.

For each class, toxic and ordinary, an interpolated Kneser-Ney model gives the probability of a word (a run of letters,
digits and underscores, lower case).  Its first level is the word itself; it backs off to the word's spelling, each character
after the ``ORDER - 1`` before it; and the spelling's lower orders are continuation counts that both classes share, so that a
rare expression leans on the same backoff in either model and only what a class has really seen tells them apart.  A word's score is the difference of its two
log-likelihoods.  Scores are length-normalised over windows of ``WINDOW`` words (and over the text), since an insult is a few
words of a long text; the largest window, the text's mean and its length give a probability by logistic regression.

Labels are read only for documents whose crc32(doc_id as text) mod 5 is not 0: remainders 1 to 3 give the counts, 4 the
logistic regression.  The fit is bounded by labelled rows only, about ``MAX_LABELLED`` of a class for the counts and
``MAX_CALIBRATED`` of a class for the regression (by a hash, documented parameters; of fewer rows, all); of these rows every word and every character sequence counts, the rare ones too.  Words are scored where they
lie, and only their 64-bit digests and scores are broadcast.  The bound does not bind how texts are scored: every text is
scored whole.

Defined cases: null text is empty and gets the score of a text without words; a doc_id labelled more than once counts as
toxic if any label says so; null labels do not count; without labels of both classes among the counts every score is 0, and
without both among the regression's rows its weights are ``UNCALIBRATED``; null doc_id is not held out and not learned from;
rows that repeat a doc_id are scored each, by their own text; other columns pass through ``score`` unread, but for those called
like a column it adds, which are left out; ``keep`` returns its rows as they came; no rows give no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import beside, cut, forget, nested, release, tidy
from .tokens import slices

ORDER, WINDOW = 6, 2
MAX_LABELLED, MAX_CALIBRATED = 60_000, 20_000
FOLDS, HELD_OUT, CALIBRATION = 5, 0, 4
MEMO_WORDS = 120_000
#: Characters of texts whose words are counted at once in a worker; the counts are sums and do not depend on it.
SLICE_CHARS = 2_000_000
#: The shared probability of a character after a sequence when they were never met together.
UNMET = 1e-4
#: Weights of window, mean, log_words and the constant where there is nothing to fit them on: a window's likelihood ratio of e.
UNCALIBRATED = (8.0, 0.0, 0.0, -8.0)
_word = re.compile(r"\w+")
#: What stands before and after a word's characters, and before a whole word among the counts.
PAD, STOP, WHOLE = "\x02", "\x03", "\x04"


def fold(doc_id):
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(FOLDS))


def spelt(word: str, order: int = ORDER) -> list[str]:
    """The character sequences of a word, one for each character and its end, with what stands before."""
    padded = PAD * (order - 1) + word + STOP
    return [padded[i : i + order] for i in range(len(word) + 1)]


def gram_counts(labelled: DataFrame, order: int = ORDER) -> DataFrame:
    """gram, toxic, ordinary: occurrences of words and of their character sequences in the texts of each class.
    ``labelled``: text, toxic."""
    import pyarrow as pa

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from collections import Counter

        for batch in batches:
            texts, kinds = [t or "" for t in batch.column(0).to_pylist()], batch.column(1).to_pylist()
            for a, b in slices(texts, SLICE_CHARS):
                words: tuple[Counter, Counter] = (Counter(), Counter())
                for text, toxic in zip(texts[a:b], kinds[a:b], strict=True):
                    words[toxic].update(_word.findall(text.lower()))
                grams: tuple[Counter, Counter] = (Counter(), Counter())
                for kind in (0, 1):
                    for w, n in words[kind].items():
                        grams[kind][WHOLE + w] = n
                        for g in spelt(w, order):
                            grams[kind][g] += n
                names = list(grams[0].keys() | grams[1].keys())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(names, pa.string()), *(pa.array([grams[k][g] for g in names], pa.int64()) for k in (1, 0))], ["gram", "toxic", "ordinary"]
                )

    partial = labelled.select("text", F.col("toxic").cast("int")).mapInArrow(tidy(count), "gram string, toxic long, ordinary long")
    return partial.groupBy("gram").agg(F.sum("toxic").alias("toxic"), F.sum("ordinary").alias("ordinary"))


def word_key(word: str) -> int:
    """A 64-bit digest."""
    import xxhash

    return xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass")) - 2**63


def word_keys(words):
    import numpy as np

    return np.fromiter(map(word_key, words), np.int64, len(words))


class Digests:
    """Rows of figures by the digests of names, as sorted arrays, which take a tenth of a dict's memory in every worker."""

    def __init__(self, names, figures):
        import numpy as np

        keys = word_keys(names)
        order = np.argsort(keys)
        self.keys, self.figures = keys[order], np.asarray(figures, float)[order]

    def find(self, keys):
        """Whether each key is there, and its figures (any, where it is not)."""
        import numpy as np

        if not len(self.keys):
            return np.zeros(len(keys), bool), np.zeros((len(keys), *self.figures.shape[1:]))
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return self.keys[at] == keys, self.figures[at]


class Spelling:
    """Log-probabilities of words by their characters in either class, from the counts of both."""

    def __init__(self, grams: list[str], toxic, ordinary, order: int = ORDER):
        import numpy as np
        import pandas as pd

        self.order = order
        counts = {1: np.asarray(toxic, float), 0: np.asarray(ordinary, float)}
        at, contexts = pd.factorize(np.array([g[:-1] for g in grams], dtype=object))
        self.shared = self._shared(grams)
        lower = np.array([self.shared[g[1:]] for g in grams])
        self.log_p, self.log_backoff = {}, {}
        for k, c in counts.items():
            n1, n2 = (c == 1).sum(), (c == 2).sum()
            discount = n1 / (n1 + 2 * n2) if n1 and n2 else 0.5
            total, kinds = np.bincount(at, c), np.bincount(at, c > 0)
            with np.errstate(divide="ignore", invalid="ignore"):
                backoff = np.where(total > 0, discount * kinds / total, 1.0)
                seen = np.where(total[at] > 0, np.maximum(c - discount, 0) / total[at], 0.0)
            self.log_p[k] = np.log(seen + backoff[at] * lower)
            self.log_backoff[k] = np.log(backoff)
        self.grams, self.contexts = grams, list(contexts)

    def _shared(self, grams: list[str]) -> dict[str, float]:
        """Interpolated probabilities of the last character of each lower-order sequence, from pooled continuation counts."""
        import numpy as np
        import pandas as pd

        levels, kinds = [], list(dict.fromkeys(grams))
        for _ in range(self.order - 1):
            shorter = pd.Series([g[1:] for g in kinds], dtype=object).value_counts(sort=False)  # distinct characters before it
            levels.append(shorter)
            kinds = list(shorter.index)
        lower = {"": 1.0 / (len(levels[-1]) + 1)}
        for counts in reversed(levels):
            names, c = list(counts.index), counts.to_numpy().astype(float)
            n1, n2 = (c == 1).sum(), (c == 2).sum()
            discount = n1 / (n1 + 2 * n2) if n1 and n2 else 0.5
            contexts = pd.Series([g[:-1] for g in names], dtype=object)
            per = pd.DataFrame({"h": contexts, "c": c, "seen": 1.0}).groupby("h")[["c", "seen"]].sum()
            total, seen = per["c"].reindex(contexts).to_numpy(), per["seen"].reindex(contexts).to_numpy()
            below = np.array([lower[g[1:]] for g in names])
            lower = dict(zip(names, (np.maximum(c - discount, 0) + discount * seen * below) / total, strict=True))
        return lower


class Letters:
    """What scoring words by their spelling needs of a model."""

    def __init__(self, spelling: Spelling):
        import numpy as np

        self.order = spelling.order
        both = lambda x: np.stack([x[0], x[1]], axis=1)
        self.grams = Digests(spelling.grams, both(spelling.log_p))
        self.contexts = Digests(spelling.contexts, both(spelling.log_backoff))
        self.lower = Digests(list(spelling.shared), np.log(list(spelling.shared.values())))

    def log_likelihoods(self, words: list[str]):
        """A row for each word: its log-likelihood as ordinary and as toxic."""
        import numpy as np

        number: dict[str, int] = {}
        ids, lengths = [], []
        for w in words:
            grams = spelt(w, self.order)
            lengths.append(len(grams))
            ids += [number.setdefault(g, len(number)) for g in grams]
        grams = list(number)
        found, each = self.grams.find(word_keys(grams))
        new = np.flatnonzero(~found)
        if len(new):
            known, backoff = self.contexts.find(word_keys([grams[i][:-1] for i in new]))
            below, lower = self.lower.find(word_keys([grams[i][1:] for i in new]))
            each = each.copy()
            each[new] = np.where(known[:, None], backoff, 0.0) + np.where(below, lower, np.log(UNMET))[:, None]
        return np.add.reduceat(each[ids], np.cumsum([0, *lengths[:-1]])) if words else np.zeros((0, 2))


class Masses:
    """The first level: the discount of words, the mass left to spellings and the occurrences, of either class."""

    def __init__(self, words: DataFrame):
        """``words``: gram, toxic, ordinary."""
        figures = [f.alias(f"{c}_{n}") for c in ("toxic", "ordinary") for n, f in (
            ("ones", F.count_if(F.col(c) == 1)), ("twos", F.count_if(F.col(c) == 2)), ("kinds", F.count_if(F.col(c) > 0)), ("total", F.coalesce(F.sum(c), F.lit(0))),
        )]
        row = words.agg(*figures).first()
        self.discount, self.left, self.total = {}, {}, {}
        for k, c in ((1, "toxic"), (0, "ordinary")):
            n1, n2 = row[f"{c}_ones"], row[f"{c}_twos"]
            self.total[k] = max(1, row[f"{c}_total"])
            self.discount[k] = n1 / (n1 + 2 * n2) if n1 and n2 else 0.5
            self.left[k] = max(self.discount[k] * row[f"{c}_kinds"] / self.total[k], 1e-6)

    def log_p(self, n, by_letters, k: int):
        """Of words met n times."""
        import numpy as np

        return np.log(np.maximum(n - self.discount[k], 0) / self.total[k] + self.left[k] * np.exp(by_letters) + 1e-300)


def known_scores(words: DataFrame, letters: Letters, masses: Masses) -> DataFrame:
    """key, score of each counted word: the difference of its log-likelihoods.  ``words``: gram, toxic, ordinary."""
    import pyarrow as pa

    shared = words.sparkSession.sparkContext.broadcast((letters, masses))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        letters, masses = shared.value
        for batch in batches:
            names = [g[1:] for g in batch.column(0).to_pylist()]
            found = letters.log_likelihoods(names)
            scores = masses.log_p(batch.column(1).to_numpy(), found[:, 1], 1) - masses.log_p(batch.column(2).to_numpy(), found[:, 0], 0)
            yield pa.RecordBatch.from_arrays([pa.array(word_keys(names), pa.int64()), pa.array(scores, pa.float64())], ["key", "score"])

    return words.select("gram", "toxic", "ordinary").mapInArrow(tidy(run), "key long, score double")


class KneserNey:
    """Differences of log-likelihoods of words."""

    def __init__(self, letters: Letters, masses: Masses, keys, scores):
        """``keys`` and ``scores``: those of all counted words."""
        import numpy as np

        order = np.argsort(keys)
        self.letters, self.keys, self.scores = letters, np.asarray(keys)[order], np.asarray(scores)[order]
        self.unknown = float(np.log(masses.left[1]) - np.log(masses.left[0]))
        self.memo: dict[str, float] = {}

    def words(self, words: list[str]) -> dict[str, float]:
        """The scores of distinct words."""
        import numpy as np

        keys = word_keys(words)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        scores, new = self.scores[at], np.flatnonzero(self.keys[at] != keys)
        if len(new):
            by_letters = self.letters.log_likelihoods([words[i] for i in new])
            scores[new] = self.unknown + by_letters[:, 1] - by_letters[:, 0]
        found = dict(zip(words, scores.round(5).tolist(), strict=True))
        for w, s in found.items():
            if len(self.memo) >= MEMO_WORDS:
                break
            if len(w) < 60:
                self.memo[w] = s
        return found

    def features(self, text: str) -> tuple[float, float, float]:
        """The largest mean of a window of words, the mean over the text, the logarithm of the number of words."""
        import numpy as np

        words = _word.findall(text.lower())
        if not words:
            return 0.0, 0.0, 0.0
        memo = self.memo
        new = list({w for w in words if w not in memo})
        own = self.words(new) if new else {}
        sums = np.cumsum([0.0] + [own[w] if w in own else memo[w] for w in words])
        width = min(WINDOW, len(words))
        return float((sums[width:] - sums[:-width]).max() / WINDOW), float(sums[-1] / len(words)), float(np.log(len(words)))


def logistic(x, y, rounds: int = 60, ridge: float = 1e-3):
    """Weights (the last for the constant), standardisation included."""
    import numpy as np

    x, y = np.asarray(x, float), np.asarray(y, float)
    mean, spread = x.mean(axis=0), x.std(axis=0) + 1e-9
    z = np.c_[(x - mean) / spread, np.ones(len(x))]
    w = np.zeros(z.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        h = (z * (p * (1 - p) + 1e-9)[:, None]).T @ z + ridge * len(x) * np.eye(len(w)) * (np.arange(len(w)) < len(w) - 1) + 1e-9 * np.eye(len(w))
        step = np.linalg.solve(h, z.T @ (y - p) - ridge * len(x) * np.r_[w[:-1], 0])
        w += step
        if np.abs(step).max() < 1e-8:
            break
    scale = w[:-1] / spread
    return [*scale.tolist(), float(w[-1] - scale @ mean)]


def _bounded(labels: DataFrame, most: int) -> DataFrame:
    """About ``most`` rows of either class at most, by a hash: (doc_id, toxic), small enough to broadcast by construction."""
    sizes = {r["toxic"]: r["n"] for r in labels.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}  # two rows
    share = F.when(F.col("toxic") == 1, F.lit(min(1.0, most / max(1, sizes.get(1, 0))))).otherwise(F.lit(min(1.0, most / max(1, sizes.get(0, 0)))))
    return labels.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < F.floor(share * 1_000_000))


def train(documents: DataFrame, labels: DataFrame) -> tuple[KneserNey, list[float]] | None:
    """The models and the weights of the logistic regression."""
    import numpy as np

    known = labels.filter("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    known = known.filter("toxic in (0, 1)").withColumn("fold", fold(F.col("doc_id"))).filter(F.col("fold") != HELD_OUT)
    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    learn = texts.join(F.broadcast(_bounded(known.filter(F.col("fold") != CALIBRATION), MAX_LABELLED)), "doc_id")
    counts = gram_counts(learn)
    whole = F.col("gram").startswith(WHOLE)
    counts = cut(counts)
    rows = counts.filter(~whole).select("gram", "toxic", "ordinary").toArrow().to_pandas().sort_values("gram")
    if not len(rows) or not rows["toxic"].sum() or not rows["ordinary"].sum():
        return None
    words = counts.filter(whole)
    letters, masses = Letters(Spelling(rows["gram"].tolist(), rows["toxic"], rows["ordinary"])), Masses(words)
    del rows
    known_words = known_scores(words, letters, masses).toArrow()
    model = KneserNey(letters, masses, known_words["key"].to_numpy(), known_words["score"].to_numpy())
    del known_words
    held = texts.join(F.broadcast(_bounded(known.filter(F.col("fold") == CALIBRATION), MAX_CALIBRATED)), "doc_id")
    figures = _features(texts.sparkSession, model)
    found = held.select("toxic", figures("text").alias("f")).select("toxic", "f.*").toArrow().to_pandas()
    if found["toxic"].nunique() < 2:
        return model, list(UNCALIBRATED)
    return model, logistic(np.c_[found["window"], found["mean"], found["log_words"]], found["toxic"])


def _features(spark, model: KneserNey):
    """A function of a text column: window, mean, log_words.  Only texts leave the JVM; the rows stay."""
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf("window double, mean double, log_words double")
    def figures(texts: pd.Series) -> pd.DataFrame:
        forget()
        own = shared.value
        found = pd.DataFrame([own.features(t or "") for t in texts], columns=["window", "mean", "log_words"], dtype=float)
        release()
        return found

    return figures.asNondeterministic()  # so that it is evaluated once however often its fields are used


ADDED = ["held_out", "score", "predicted", "window", "mean", "log_words"]


def _scored(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """document, and the added columns."""
    fitted, rows = train(documents, labels), nested(documents)
    text, doc_id = F.col("document.text").cast("string"), F.col("document.doc_id").cast("long")
    if fitted is None:
        p, zero = F.lit(0.0), F.lit(0.0)
        rows = rows.withColumn("f", F.struct(zero.alias("window"), zero.alias("mean"), zero.alias("log_words")))
    else:
        model, (a, b, c, d) = fitted
        rows = rows.withColumn("f", _features(documents.sparkSession, model)(text))
        p = 1 / (1 + F.exp(-(F.lit(a) * F.col("f.window") + F.lit(b) * F.col("f.mean") + F.lit(c) * F.col("f.log_words") + F.lit(d))))
    rows = rows.select("document", "f", p.alias("score"), (F.coalesce(fold(doc_id), F.lit(-1)) == HELD_OUT).alias("held_out"))
    return rows.select("document", "held_out", "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"), "f.*")


def score(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents' columns, and held_out, score, predicted, window, mean, log_words."""
    return beside(_scored(documents, labels), documents.columns, ADDED)


def keep(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that are not predicted toxic; each row goes by its own text."""
    return _scored(documents, labels).filter("predicted = 0").select("document.*")
