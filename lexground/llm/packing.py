"""Best-fit packing with bound-certified repacking.

Documents are encoded and cut into pieces of at most ``capacity`` tokens (only longer documents are cut).  Pieces are dealt
into groups of bounded token mass by a hash; each group is packed by best-fit decreasing and gets a lower bound on its bins
from dual-feasible functions, unrounded.  What a group has above it is its gap: no merging of groups can save more bins than
the sum of their gaps.  So a group without a gap is done; of the others the emptiest bins move on, until their free space
covers the gap (all bins under ``OPEN_BELOW``, where best-fit took a whole bin more than the bound).  These meet in exchange
groups of ``GROUP_BINS`` bins at most on average, dealt by a hash; where the bins of such a group exceed the rounded bound, their pieces are packed again, which
counts only if it takes fewer bins.  Rounds go on until no two groups have anything to exchange, or a round saves nothing
and leaves over half as many open bins.  No task ever holds more than a group's mass.  What moves is a piece's id and length;
texts stay where they were read.

Defined cases: null text is empty, so the document is the end token alone; rows that repeat a doc_id are packed each; null
doc_id stays null; other columns are ignored; no rows give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, tidy
from .tokens import WORD_VOCABULARY, slices, word_encoder

CAPACITY, END_ID = 4096, 1
#: Bins' worth of tokens in a group, and the fill below which a bin of a group that is a bin above its bound is open.
GROUP_BINS, OPEN_BELOW = 96, 0.97

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
PACKED = PIECES + ", grp long, bin long, offset long, n_bins long, bound double, stays boolean"


def pieces(documents: DataFrame, tokenizer: str = WORD_VOCABULARY, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32: the token pieces of each document."""
    import pyarrow as pa

    end = end_id.to_bytes(4, "little")

    def cut_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from zlib import crc32

        encoder = word_encoder(tokenizer)
        for batch in batches:
            ids, texts = batch.column(0), [t or "" for t in batch.column(1).to_pylist()]
            for a, b in slices(texts):
                out: list[tuple] = []
                for i, encoded in enumerate(encoder.encode(texts[a:b]), a):
                    whole = encoded + end
                    for k, at in enumerate(range(0, len(whole), 4 * capacity)):
                        part = whole[at : at + 4 * capacity]
                        out.append((i, k, at // 4, len(part) // 4, crc32(part)))
                at, piece, start, length, crc = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays(
                    [ids.take(pa.array(at)), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))],
                    ["doc_id", "piece", "start", "length", "ids_crc32"],
                )

    return documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(tidy(cut_up, tokenizer), PIECES)


def best_fit_decreasing(lengths, capacity: int):
    """Bin of each piece, offset of each piece, fill of each bin.  Open bins are kept by free space: a bit for each size."""
    import numpy as np

    order = np.argsort(-np.asarray(lengths), kind="stable")
    bins, offsets, fill = np.zeros(len(order), np.int64), np.zeros(len(order), np.int64), []
    by_free: list[list[int]] = [[] for _ in range(capacity + 1)]
    free_sizes = 0
    for i in order.tolist():
        n = int(lengths[i])
        at_least = free_sizes >> n
        if at_least:
            free = n + (at_least & -at_least).bit_length() - 1
            b = by_free[free].pop()
            if not by_free[free]:
                free_sizes &= ~(1 << free)
        else:
            b, free = len(fill), capacity
            fill.append(0)
        bins[i], offsets[i] = b, fill[b]
        fill[b] += n
        if left := free - n:
            by_free[left].append(b)
            free_sizes |= 1 << left
    return bins, offsets, np.asarray(fill, np.int64)


def fractional_bound(lengths, capacity: int) -> float:
    """The best of two families of dual-feasible functions: no packing of these lengths has fewer bins."""
    import numpy as np

    counts = np.bincount(np.asarray(lengths, np.int64), minlength=capacity + 1).astype(np.int64)
    sizes = np.arange(capacity + 1, dtype=np.int64)
    mass = np.concatenate([[0], np.cumsum(counts * sizes)])  # mass[x]: of sizes below x
    number = np.concatenate([[0], np.cumsum(counts)])
    # sizes over C - a count as C, those below a as nothing, for each a up to half the capacity
    a = np.arange(0, capacity // 2 + 1)
    scaled = (number[-1] - number[capacity - a + 1]) * capacity + mass[capacity - a + 1] - mass[a]
    best = float(scaled.max()) / capacity
    # rounding: x counts as floor((k + 1) x / C) of k, and as x where that is exact
    for k in range(1, 31):
        exact = (sizes * (k + 1)) % capacity == 0
        value = np.where(exact, sizes * k, (sizes * (k + 1)) // capacity * capacity)  # times capacity * k
        best = max(best, int((value * counts).sum()) / (capacity * k))
    return best


def lower_bound(lengths, capacity: int) -> int:
    """The bound in whole bins."""
    from math import ceil

    return ceil(fractional_bound(lengths, capacity) - 1e-9)


def staying(fill, bound: float, capacity: int):
    """Which bins of a group are done: all but the emptiest, whose free space covers what the group has above its bound."""
    import numpy as np

    gap = len(fill) - bound
    if gap < 1e-6:
        return np.ones(len(fill), bool)
    if gap >= 1:
        return fill >= int(capacity * OPEN_BELOW)
    order = np.argsort(fill, kind="stable")
    before = np.concatenate([[0], np.cumsum(capacity - fill[order])[:-1]])
    stays = np.ones(len(fill), bool)
    stays[order[before < (gap - 1e-6) * capacity]] = False
    return stays


def pack_groups(rows: DataFrame, capacity: int, repack: bool) -> DataFrame:
    """Best-fit decreasing within each ``grp``.  ``repack``: the rows have bins already, which stay unless the new ones are
    fewer; a group whose bins equal its bound is left as it is."""
    import pandas as pd

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        import numpy as np

        pdf = pdf.sort_values(["doc_id", "piece", "ids_crc32"], kind="stable").reset_index(drop=True)
        lengths = pdf["length"].to_numpy()
        bound, bins = fractional_bound(lengths, capacity), None
        if repack:
            names, bins = np.unique(pdf["bin"].to_numpy(), return_inverse=True)
            offsets, fill = pdf["offset"].to_numpy(), np.bincount(bins, lengths).astype(np.int64)
        if bins is None or len(fill) > bound + 1 - 1e-9:
            new = best_fit_decreasing(lengths, capacity)
            if bins is None or len(new[2]) < len(fill):
                bins, offsets, fill = new
        return pdf.assign(bin=bins + (pdf["grp"].to_numpy() << 24), offset=offsets, n_bins=len(fill), bound=bound, stays=staying(fill, bound, capacity)[bins])

    have = rows if repack else rows.withColumns({"bin": F.lit(0).cast("long"), "offset": F.lit(0).cast("long")})
    have = have.withColumns({"n_bins": F.lit(0).cast("long"), "bound": F.lit(0.0), "stays": F.lit(False)})
    names = [f.split()[0] for f in PACKED.split(", ")]
    return have.select(*names).groupBy("grp").applyInPandas(lambda pdf: pack(pdf.astype({"doc_id": "Int64"})), PACKED)


def pack(documents: DataFrame, tokenizer: str = WORD_VOCABULARY, capacity: int = CAPACITY, end_id: int = END_ID, group_bins: int = GROUP_BINS) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset, and round, n_bins, bound: the round and the group's
    certificate under which the piece got its place."""
    rows = cut(pieces(documents, tokenizer, capacity, end_id))
    tokens = rows.agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0]
    groups = max(1, -(-tokens // (capacity * group_bins)))
    # the number of a written row keeps rows that repeat from all falling into one group
    dealt = rows.withColumn("grp", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32", F.monotonically_increasing_id()), F.lit(groups)))
    packed = cut(pack_groups(dealt, capacity, repack=False)).withColumn("round", F.lit(0))
    done, turn = [], 0
    while groups > 1:
        moving = packed.filter(~F.col("stays"))
        n_open = moving.agg(F.countDistinct("bin")).first()[0]
        if not n_open or (turn and 2 * n_open > before and saved == 0):  # noqa: F821
            break
        turn, before, groups = turn + 1, n_open, -(-n_open // group_bins)
        done.append(packed.filter("stays"))
        met = moving.withColumn("grp", F.pmod(F.xxhash64("bin", F.lit(turn)), F.lit(groups)))
        packed = cut(pack_groups(met, capacity, repack=True)).withColumn("round", F.lit(turn))
        saved = n_open - packed.agg(F.countDistinct("bin")).first()[0]
    for part in done:
        packed = packed.unionByName(part)
    return packed.select(
        "doc_id", "piece", "start", "length", "ids_crc32",
        (F.col("round").cast("long") * F.lit(1 << 56) + F.col("bin")).alias("sequence_id"), "offset", "round", "n_bins", "bound",
    )
