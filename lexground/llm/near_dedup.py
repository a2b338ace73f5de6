"""Near-duplicate classes by DartMinHash.

A document is the multiset of its five-word shingles (words: runs of letters, digits and underscores, lower case); two are
linked if their weighted Jaccard similarity is 0.8 or more.

* Darts: a shingle of weight w owns w unit regions, (shingle, occurrence).  Darts fall on a region as a Poisson process in
  rank, drawn from hashes of the region, so equal regions get equal darts in every document.  A document takes the darts up
  to the rank at which it expects ``DARTS`` of them, deals them to coordinates by hash and keeps the earliest of each
  coordinate; where a coordinate stays empty the rank is doubled.  The chance that two documents agree in a coordinate is
  their weighted Jaccard similarity.
* Bands of ``ROWS`` coordinates make buckets.  Documents with the same words are one node from the start, so copies never
  meet in a bucket.  Each document is compared with its buckets' pivots only: the members that collide most over all bands,
  hence near the middle of their group, so a group of m near copies gives about m candidates, not m squared.
* What the pivots leave in different classes meets by what sets it apart from the pivot.  Two documents x and m of a pivot's
  group, with differences X and M from it, differ in |X| + |M| - 2 |X and M| regions, which the similarity bounds; where x is
  not linked to the pivot, they must thus share regions of X and M, a number known from the sizes.  Regions of only one
  difference can't be shared and the others go by rareness, so a prefix of each difference and the place of the first shared
  region exclude nearly all pairs (prefix and positional filtering).  This is exact: every pair that shares a bucket is in
  one class already, excluded by a bound, or verified, and no cap drops a candidate.
* Each candidate pair is verified on its whole shingle multisets.
* Classes are the connected components of the links; a class is named by its least doc_id.

A node is a digest of a text's words, never a doc_id, so rows are judged by their texts alone.  What a join brings to a group
(a bucket's pivot, a class's name) is written out before, so that the join is one of two plain shuffles and a hot group's
rows can be split over tasks (AQE does so only there).

With 0.8 similarity a pair shares a bucket with probability 1 - (1 - 0.8**6)**20 = 0.998.

Defined cases: null or word-less texts are copies of each other; under five words, the text is one shingle; rows that
repeat a doc_id with another text are judged by each text; rows without a doc_id are members like others, of a class named
by the least doc_id there is (null if there is none); other columns are ignored; no rows give no rows.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, nested, tidy
from .tokens import slices

WORDS, SIMILARITY = 5, 0.8
ROWS, BANDS = 6, 20
COORDINATES = ROWS * BANDS
#: Darts expected of a document in the first throw; about one document in eight then needs a second.
DARTS = int(COORDINATES * (math.log(COORDINATES) + 2))
_MEMO_WORDS = 120_000
_word = re.compile(r"\w+")


class Shingler:
    """Regions (shingle, occurrence) of texts as sorted distinct 64-bit numbers."""

    def __init__(self, words: int = WORDS):
        self.words, self.memo = words, {}

    def regions(self, text: str):
        """(digest of the words, regions)"""
        from hashlib import md5

        import numpy as np
        import xxhash

        from .hashing import combine, mix

        found = _word.findall(text.lower())
        digest = md5(" ".join(found).encode("utf-8", "surrogatepass")).digest()
        if not found:
            return digest, np.empty(0, np.uint64)
        memo = self.memo
        if len(memo) > _MEMO_WORDS:
            memo.clear()
        for w in set(found).difference(memo):
            memo[w] = xxhash.xxh64_intdigest(w.encode("utf-8", "surrogatepass"))
        hashes = np.fromiter(map(memo.__getitem__, found), np.uint64, len(found))
        width = min(self.words, len(hashes))
        n = len(hashes) - width + 1
        shingles = mix(hashes[:n])
        for k in range(1, width):
            shingles = combine(shingles, hashes[k : k + n])
        shingles.sort()
        first = np.r_[True, shingles[1:] != shingles[:-1]]
        starts = np.flatnonzero(first)
        occurrence = np.arange(n) - np.repeat(starts, np.diff(np.r_[starts, n]))
        regions = combine(shingles, occurrence.astype(np.uint64))
        regions.sort()
        return digest, regions


def dart_signatures(regions: list, coordinates: int = COORDINATES, darts: int = DARTS):
    """A row of ``coordinates`` dart numbers for each non-empty document."""
    import numpy as np

    from .hashing import mix, unit

    out = np.zeros((len(regions), coordinates), np.uint64)
    todo, throw = np.arange(len(regions)), float(darts)
    while len(todo):
        flat = np.concatenate([regions[i] for i in todo])
        sizes = np.array([len(regions[i]) for i in todo])
        doc = np.repeat(np.arange(len(todo)), sizes)
        limit = (throw / sizes)[doc]
        rank, turn = np.zeros(len(flat)), 0
        docs, ranks, ids = [], [], []
        while len(flat):
            drawn = mix(flat, 2 * turn + 11)
            rank = rank - np.log(unit(drawn))
            stay = rank <= limit
            flat, doc, rank, limit = flat[stay], doc[stay], rank[stay], limit[stay]
            docs.append(doc)
            ranks.append(rank)
            ids.append(mix(flat, 2 * turn + 12))
            turn += 1
        docs, ranks, ids = np.concatenate(docs), np.concatenate(ranks), np.concatenate(ids)
        late_first = np.argsort(-ranks, kind="stable")
        docs, ids = docs[late_first], ids[late_first]
        cell = docs * coordinates + (ids % np.uint64(coordinates)).astype(np.int64)
        sig, hit = np.zeros(len(todo) * coordinates, np.uint64), np.zeros(len(todo) * coordinates, bool)
        sig[cell], hit[cell] = ids, True  # of equal cells the last, that is the earliest dart, stays
        full = hit.reshape(-1, coordinates).all(axis=1)
        out[todo[full]] = sig.reshape(-1, coordinates)[full]
        todo, throw = todo[~full], throw * 2
    return out


def band_keys(signatures, rows: int = ROWS):
    """A 64-bit bucket number for each band."""
    import numpy as np

    from .hashing import combine, mix

    keys = mix(np.broadcast_to(np.arange(signatures.shape[1] // rows, dtype=np.uint64), (len(signatures), signatures.shape[1] // rows)), 5)
    for k in range(rows):
        keys = combine(keys, signatures[:, k::rows])
    return keys.view(np.int64)


def keyed(documents: DataFrame) -> DataFrame:
    """doc_id, text, row_key: equal for rows of equal doc_id and text only, but for rare collisions, which do no harm."""
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.withColumn("row_key", F.xxhash64("doc_id", "text"))


def signatures(documents: DataFrame) -> DataFrame:
    """doc_id, row_key, node, bands (empty for word-less texts)."""
    import pyarrow as pa

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler()
        for batch in batches:
            texts = [t or "" for t in batch.column(2).to_pylist()]
            for a, b in slices(texts, 3_000_000):
                found = [shingler.regions(t) for t in texts[a:b]]
                some = [i for i, (_, r) in enumerate(found) if len(r)]
                bands: list = [[]] * (b - a)
                if some:
                    for i, keys in zip(some, band_keys(dart_signatures([found[i][1] for i in some])), strict=True):
                        bands[i] = keys
                columns = [pa.array([d for d, _ in found], pa.binary()), pa.array(bands, pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays([c.slice(a, b - a) for c in batch.columns[:2]] + columns, ["doc_id", "row_key", "node", "bands"])

    return documents.select("doc_id", "row_key", "text").mapInArrow(tidy(sign), "doc_id long, row_key long, node binary, bands array<long>")


def region_sets(documents: DataFrame) -> DataFrame:
    """node, regions: the sorted regions as bytes, once for the rows of a task that share a node."""
    import pyarrow as pa

    def shingle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, seen = Shingler(), set()
        for batch in batches:
            texts = [t or "" for t in batch.column(0).to_pylist()]
            for a, b in slices(texts, 3_000_000):
                found = {}
                for digest, regions in map(shingler.regions, texts[a:b]):
                    if digest not in seen:
                        seen.add(digest)
                        found[digest] = regions.tobytes()
                yield pa.RecordBatch.from_arrays([pa.array(found, pa.binary()), pa.array(found.values(), pa.binary())], ["node", "regions"])

    return documents.select("text").mapInArrow(tidy(shingle), "node binary, regions binary")


def _paired(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """a, b, a_regions, b_regions of the pairs (a, b)."""
    of = lambda side: sets.select(F.col("node").alias(side), F.col("regions").alias(f"{side}_regions"))
    return pairs.join(of("a"), "a").join(of("b"), "b").select("a", "b", "a_regions", "b_regions")


def _verified(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) of at least that weighted Jaccard similarity."""
    import pyarrow as pa

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x, y = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
                at = np.searchsorted(y, x)
                at[at == len(y)] = 0
                common = int((y[at] == x).sum())
                keep.append(common >= similarity * (len(x) + len(y) - common) - 1e-9)
            yield pa.RecordBatch.from_arrays(batch.columns[:2], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return _paired(pairs, sets).mapInArrow(tidy(compare), "a binary, b binary")


def against_pivots(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """node, pivot, middle (a number of the pivot), linked, size (regions of the
    node), apart (regions of one of the two only), for the pairs (node, pivot)."""
    import pyarrow as pa

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np
        import xxhash

        for batch in batches:
            rows, apart = [], []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x, y = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
                apart.append(np.setxor1d(x, y, assume_unique=True).view(np.int64))
                common = (len(x) + len(y) - len(apart[-1])) // 2
                linked = common >= similarity * (len(x) + len(y) - common) - 1e-9
                rows.append((xxhash.xxh64_intdigest(y.tobytes()) - 2**63, linked, len(x)))
            middle, linked, size = zip(*rows, strict=True) if rows else ((), (), ())
            columns = [pa.array(middle, pa.int64()), pa.array(linked, pa.bool_()), pa.array(size, pa.int64()), pa.array(apart, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], *columns], ["node", "pivot", "middle", "linked", "size", "apart"])

    found = _paired(pairs.select(F.col("node").alias("a"), F.col("pivot").alias("b")), sets)
    return found.mapInArrow(tidy(compare), "node binary, pivot binary, middle long, linked boolean, size long, apart array<long>")


def components(edges: DataFrame) -> DataFrame:
    """node, class_id: the least node that links (a, b) lead to.  Labels spread to neighbours and jump to their label's
    label, so long chains take few rounds."""
    both = cut(edges.select("a", "b").union(edges.select(F.col("b"), F.col("a"))).distinct())
    labels = cut(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("label")))
    while True:
        near = both.join(labels, both["b"] == labels["node"]).groupBy(F.col("a").alias("n")).agg(F.min("label").alias("m"))
        spread = labels.join(near, labels["node"] == near["n"]).select("node", F.col("label").alias("old"), F.least("label", "m").alias("label"))
        jump = labels.select(F.col("node").alias("j"), F.col("label").alias("jumped"))
        spread = cut(spread.join(jump, spread["label"] == jump["j"]).select("node", "old", F.least("label", "jumped").alias("label")))
        moved = spread.filter("label < old").limit(1).count()
        labels = spread.select("node", "label")
        if not moved:
            return labels.select("node", F.col("label").alias("class_id"))


def across(compared: DataFrame, labels: DataFrame, similarity: float) -> DataFrame:
    """Pairs (a, b) of a pivot's group that ``labels`` (node, class_id) leave in different classes and that may be similar
    enough; of such a pair one at least is outside the pivot's class."""
    share = (1 - similarity) / (1 + similarity)  # two documents may differ in that share of their sizes' sum
    rows = compared.join(labels, "node", "left").withColumn("class_id", F.coalesce("class_id", "node"))
    pivot = labels.select(F.col("node").alias("pivot"), F.col("class_id").alias("pivot_class"))
    rows = rows.join(pivot, "pivot", "left").withColumn("outside", F.col("class_id") != F.coalesce("pivot_class", "pivot"))
    rows = rows.withColumn("excess", F.size("apart") - share * F.col("size"))
    # the least that a partner brings: a pair of x and m must share half its excesses' sum
    rows = rows.drop("pivot", "pivot_class", "linked").withColumn("text", F.xxhash64("apart"))
    least = rows.groupBy("middle").agg(F.min("excess").alias("any_least"), F.min(F.when(F.col("outside"), F.col("excess"))).alias("outside_least"))
    rows = rows.join(cut(least.filter("outside_least is not null")), "middle")
    parts = cut(rows.withColumn("region", F.explode("apart")).drop("apart"))
    common = cut(parts.groupBy("middle", "region").agg(F.count(F.lit(1)).alias("members")).filter("members > 1"))
    ordered = (
        parts.join(common, ["middle", "region"])
        .groupBy("middle", "node", "text").agg(
            F.sort_array(F.collect_set(F.struct("members", "region"))).alias("by_rareness"),
            *(F.first(c).alias(c) for c in ("class_id", "size", "outside", "excess", "any_least", "outside_least")),
        )
    )
    owed = lambda a, b: F.greatest(F.lit(1), F.ceil((a + b) / 2 - 1e-6))

    def prefix(rows: DataFrame, partner: str) -> DataFrame:
        n = F.size("by_rareness") - owed(F.col("excess"), F.col(partner)) + 1
        rows = rows.withColumn("length", F.size("by_rareness")).withColumn("n", n.cast("int")).filter("n > 0")
        return rows.select("middle", "node", "class_id", "size", "excess", "length", F.posexplode(F.slice("by_rareness", F.lit(1), F.col("n"))).alias("place", "part")).withColumn(
            "region", F.col("part.region")
        )

    ordered = cut(ordered)
    m, x = prefix(ordered, "outside_least").alias("m"), prefix(ordered.filter("outside"), "any_least").alias("x")
    fits = F.least("m.size", "x.size") >= similarity * F.greatest("m.size", "x.size") - 1e-9
    # no more regions can be shared than follow the first shared one in either
    enough = F.least(F.col("m.length") - F.col("m.place"), F.col("x.length") - F.col("x.place")) >= owed(F.col("m.excess"), F.col("x.excess"))
    same = (F.col("m.middle") == F.col("x.middle")) & (F.col("m.region") == F.col("x.region"))
    met = m.join(x, same & (F.col("m.class_id") != F.col("x.class_id")) & fits & enough)
    return met.select(F.least("m.node", "x.node").alias("a"), F.greatest("m.node", "x.node").alias("b")).distinct()


def linked_classes(bands: DataFrame, sets_of, similarity: float = SIMILARITY) -> DataFrame:
    """node, class_id (a node) of the nodes that have links, by the distinct (node, band) rows.  ``sets_of``: from nodes to
    their region sets."""
    crowd = cut(bands.groupBy("band").agg(F.count(F.lit(1)).alias("crowd")).filter("crowd > 1"))
    rows = cut(bands.join(crowd, "band"))
    reach = rows.groupBy("node").agg(F.sum("crowd").alias("reach"))
    rows = rows.join(reach, "node")
    middle = cut(rows.groupBy("band").agg(F.min(F.struct((-F.col("reach")).alias("reach"), "node"))["node"].alias("pivot")))
    pairs = cut(rows.select("node", "band").join(middle, "band").select("node", "pivot").distinct())
    sets = cut(sets_of(pairs.select("node").distinct()))
    compared = cut(against_pivots(pairs.filter("node <> pivot"), sets, similarity))
    labels = cut(components(compared.filter("linked").select(F.col("node").alias("a"), F.col("pivot").alias("b"))))
    more = cut(_verified(across(compared, labels, similarity), sets, similarity))
    # the further links join whole classes
    of = lambda side: labels.select(F.col("node").alias(side), F.col("class_id").alias(f"{side}_class"))
    more = more.join(of("a"), "a", "left").join(of("b"), "b", "left").select(F.coalesce("a_class", "a").alias("a"), F.coalesce("b_class", "b").alias("b"))
    joined = cut(components(more.distinct())).select(F.col("node").alias("class_id"), F.col("class_id").alias("joined"))
    known = labels.union(more.select("a", "a").union(more.select("b", "b"))).groupBy("node").agg(F.min("class_id").alias("class_id"))
    return known.join(joined, "class_id", "left").select("node", F.coalesce("joined", "class_id").alias("class_id"))


def _named(documents: DataFrame, similarity: float) -> DataFrame:
    """doc_id, row_key, first (no_id, doc_id, row_key of the first row of its class): one row per input row."""
    docs = keyed(documents)
    signed = cut(signatures(docs))
    order = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row_key")
    nodes = cut(signed.groupBy("node").agg(F.min(order).alias("first"), F.first("bands").alias("bands")))

    def sets_of(wanted: DataFrame) -> DataFrame:
        rows = nodes.join(wanted, "node", "left_semi").select(F.col("first.row_key").alias("row_key"))
        return region_sets(docs.join(rows, "row_key", "left_semi"))

    found = cut(linked_classes(nodes.select("node", F.explode("bands").alias("band")), sets_of, similarity))
    linked = nodes.select("node", "first").join(found, "node")
    least = cut(linked.groupBy("class_id").agg(F.min("first").alias("class_first")))
    linked = linked.join(least, "class_id").select("node", "class_first")
    firsts = cut(nodes.select("node", "first").join(linked, "node", "left").select("node", F.coalesce("class_first", "first").alias("first")))
    return signed.select("doc_id", "row_key", "node").join(firsts, "node").select("doc_id", "row_key", "first")


def classes(documents: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """doc_id, class_id (least doc_id of the class): one row per input row."""
    return _named(documents, similarity).select("doc_id", F.col("first.doc_id").alias("class_id"))


def keep_one(documents: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """One row of each class, whole: of the least doc_id, of its texts one by a hash, and of rows that repeat both any one."""
    named = _named(documents, similarity).filter(F.col("row_key") == F.col("first.row_key"))
    stay = cut(named.groupBy("row_key").agg(F.count(F.lit(1)).alias("n")))
    key = F.xxhash64(F.col("document.doc_id").cast("long"), F.col("document.text").cast("string"))
    rows = nested(documents).withColumn("row_key", key).join(stay.select("row_key"), "row_key", "left_semi")
    if not stay.filter("n > 1").isEmpty():  # rows of equal doc_id and text: one of them
        order = Window.partitionBy("row_key").orderBy(F.xxhash64("document"))
        rows = rows.withColumn("n", F.row_number().over(order)).filter("n = 1")
    return rows.select("document.*")
