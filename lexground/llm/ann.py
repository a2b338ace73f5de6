"""Approximate nearest neighbours by cosine: stable projections of few dimensions, indexed by kd-trees.

Vectors are scaled to length one, so the largest cosine is the least Euclidean distance, and projected by Gaussian (2-stable)
directions to ``M`` dimensions.  For a pair at distance d the squared projected distance over d squared follows a chi-square
distribution with M degrees of freedom.  A search goes through projected neighbours by growing projected distance, computes
their true cosines, and stops when the chi-square probability that a nearer vector has a projected distance beyond the next
one is at most 1 - ``SURE``.

The tree has two levels.  The upper one, fitted on a bounded sample, deals all rows into cells (their number follows the
rows, up to ``MAX_CELLS``, so above MAX_CELLS x CELL_ROWS rows cells grow); a cell of over ``HELD`` rows is searched in shards, dealt by a hash.  The
lower one is built inside each shard.  Cells, and leaves below them, are left out where the stopping test rules out their
bounding box (of all their rows).  A search takes three turns, each with a tighter reach (the k-th distance found so far):

1. the query's own cell, in full;
2. of each cell that the test leaves, the ``PROBES`` nearest projected rows;
3. of each cell that the test still leaves, all projected neighbours up to the stop.

Queries are joined with cells, never with rows: what is routed is a query's vector and a cell number.  How many cells the
test leaves depends on the data: for vectors without any clusters it is all, since no box then lies farther than the stop,
and the pruning is that of projected neighbours; ``n_verified`` says how many true cosines a query took.

Defined cases: vectors that are null, zero, or hold null or non-finite components take no part, as rows or queries; only
vectors of the query's dimension are candidates; a repeated query id counts once (its least vector); rows that repeat a
vec_id are candidates each, but those of the query's id are none; equal scores rank by vec_id; no rows give no rows; other
columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

M, SURE, SEED = 32, 0.91, 20
#: Rows of a cell aimed at, cells at most, sampled rows the upper tree is fitted on, queries and rows held by a task at once.
CELL_ROWS, MAX_CELLS, SAMPLE, HELD = 1024, 4096, 40_000, 4096
#: Rows of a leaf, rows verified at a time, and projected neighbours verified in the second turn.
LEAF, STEP, PROBES = 64, 32, 8


def directions(dim: int, m: int = M, seed: int = SEED):
    import numpy as np

    return np.random.default_rng([seed, dim]).standard_normal((dim, m))


def chi_square_cdf(x, m: int = M):
    """For an even number of degrees of freedom."""
    import numpy as np

    half = np.minimum(np.asarray(x, float) / 2, 700.0)
    term, total = np.ones_like(half), np.ones_like(half)
    for i in range(1, m // 2):
        term = term * half / i
        total = total + term
    return 1 - np.exp(-half) * total


def chi_square_quantile(p: float, m: int = M) -> float:
    low, high = 0.0, 1000.0
    for _ in range(100):
        middle = (low + high) / 2
        low, high = (middle, high) if chi_square_cdf(middle, m) < p else (low, middle)
    return high


def split_tree(points, cells: int):
    """Median splits along the widest dimension: (splits, boxes).  A split is (dimension, value, left, right), children
    being splits or, negative, leaves; boxes of leaves bound the fitted points only where a split does."""
    import numpy as np

    splits: list = []
    boxes: list = []

    def grow(rows, low, high, n) -> int:
        if n <= 1 or len(rows) < 2:
            boxes.append((low, high))
            return -len(boxes)
        d = int(np.argmax(np.quantile(points[rows], 0.9, axis=0) - np.quantile(points[rows], 0.1, axis=0)))
        value = float(np.median(points[rows, d]))
        at = len(splits)
        splits.append(None)
        below = points[rows, d] < value
        left_high, right_low = high.copy(), low.copy()
        left_high[d] = right_low[d] = value
        left = grow(rows[below], low, left_high, n // 2)
        splits[at] = (d, value, left, grow(rows[~below], right_low, high, n - n // 2))
        return at

    m = points.shape[1]
    root = grow(np.arange(len(points)), np.full(m, -np.inf), np.full(m, np.inf), cells)
    return root, splits, np.array([b[0] for b in boxes]), np.array([b[1] for b in boxes])


def cell_of(tree, points):
    import numpy as np

    root, splits, _, _ = tree
    at = np.full(len(points), root)
    while (inner := at >= 0).any():
        for node in np.unique(at[inner]):
            d, value, left, right = splits[node]
            here = at == node
            at[here] = np.where(points[here, d] < value, left, right)
    return -at - 1


def box_distance2(low, high, points):
    """Squared distance of each point from each box (points by boxes)."""
    import numpy as np

    gap = np.maximum(np.maximum(low[None] - points[:, None], points[:, None] - high[None]), 0)
    return (gap * gap).sum(axis=2)


def leaves_of(projected) -> list:
    """The rows of each leaf of a kd-tree that halves along the widest dimension."""
    import numpy as np

    done, todo = [], [np.arange(len(projected))]
    while todo:
        rows = todo.pop()
        if len(rows) <= LEAF:
            done.append(rows)
            continue
        p = projected[rows]
        order = rows[np.argsort(p[:, int(np.argmax(p.max(axis=0) - p.min(axis=0)))], kind="stable")]
        todo += [order[len(order) // 2 :], order[: len(order) // 2]]
    return done


def search_block(ids, vectors, projected, q_ids, q_vectors, q_projected, reach2, k: int, stop2: float, probes: int | None = None):
    """The k best of a block for each query: (ids, cosines padded by -inf, numbers of cosines computed).  ``reach2``: squared
    distance known to be enough.  ``probes``: so many projected neighbours at most."""
    import numpy as np

    leaves = leaves_of(projected)
    low, high = (np.array([f(projected[rows], axis=0) for rows in leaves]) for f in (np.min, np.max))
    leaf = np.empty(len(ids), np.int64)
    for i, rows in enumerate(leaves):
        leaf[rows] = i
    size, q_size = np.sqrt((vectors * vectors).sum(axis=1)), np.sqrt((q_vectors * q_vectors).sum(axis=1))
    squares = (projected * projected).sum(axis=1)
    best_ids, best = np.full((len(q_ids), k), np.iinfo(np.int64).max), np.full((len(q_ids), k), -np.inf)
    verified = np.zeros(len(q_ids), np.int64)
    for a in range(0, len(q_ids), 256):
        part = np.arange(a, min(a + 256, len(q_ids)))
        limit = stop2 * np.maximum(reach2[part], 1e-12)
        p = q_projected[part]
        near2 = np.maximum((p * p).sum(axis=1)[:, None] + squares[None] - 2 * p @ projected.T, 0)
        near2[(box_distance2(low, high, p) > limit[:, None])[:, leaf]] = np.inf
        near2[near2 > limit[:, None] + 1e-9] = np.inf
        near2[ids[None] == q_ids[part, None]] = np.inf
        order = np.argsort(near2, axis=1, kind="stable")
        step = STEP if probes is None else probes
        for at in range(0, len(ids), step):
            # a vector beyond the next projected neighbour is nearer than the k-th so far with probability 1 - SURE at most
            kth2 = np.minimum(np.where(np.isfinite(best[part, -1]), 2 - 2 * best[part, -1], np.inf), reach2[part])
            reached = near2[part - a, order[part - a, at]]
            part = part[(reached <= stop2 * np.maximum(kth2, 1e-12) + 1e-9) & np.isfinite(reached)]
            if not len(part):
                break
            rows = order[part - a, at : at + step]
            score = np.einsum("nd,nrd->nr", q_vectors[part], vectors[rows]) / (q_size[part, None] * size[rows])
            found = ids[rows]
            out = ~np.isfinite(np.take_along_axis(near2[part - a], rows, axis=1))
            score[out] = -np.inf
            verified[part] += (~out).sum(axis=1)
            all_ids, all_scores = np.concatenate([best_ids[part], found], axis=1), np.concatenate([best[part], score], axis=1)
            top = np.lexsort((all_ids, -all_scores), axis=1)[:, :k]
            best_ids[part], best[part] = np.take_along_axis(all_ids, top, axis=1), np.take_along_axis(all_scores, top, axis=1)
            if probes is not None:
                break
    return best_ids, best, verified


def usable(embeddings: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id, vec: the rows that take part."""
    vec = F.col(vector_col).cast("array<double>")
    good = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf")))) & F.exists(vec, lambda x: x != 0)
    return embeddings.select(F.col(id_col).cast("long").alias("vec_id"), vec.alias("vec")).filter(F.col("vec_id").isNotNull() & F.col("vec").isNotNull() & good)


def _projected(pdf):
    import numpy as np

    vectors = np.stack(pdf["vec"].to_numpy()).astype(float)
    unit = vectors / np.sqrt((vectors * vectors).sum(axis=1, keepdims=True))
    return vectors, unit @ directions(vectors.shape[1])


_FOUND = "query_id long, rank int, vec_id long, score double, n_verified long"


def nearest(rows: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """query_id, rank, vec_id, score, n_verified (cosines computed for the query): the k nearest found among ``rows`` for each
    of ``queries`` (both: vec_id, vec).  There is a search for each dimension that queries have."""
    spark = rows.sparkSession
    dims = [r[0] for r in queries.groupBy(F.size("vec").alias("dim")).agg(F.lit(1)).orderBy("dim").collect()]
    parts = [_nearest(rows.filter(F.size("vec") == d), queries.filter(F.size("vec") == d), k) for d in dims]
    if not parts:
        return spark.createDataFrame([], _FOUND)
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _nearest(rows: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    import numpy as np

    n = rows.count()
    cells = min(MAX_CELLS, 2 ** math.ceil(math.log2(max(1, n / CELL_ROWS))))
    # a hash order makes the sample the same each time; it fits the tree only
    share = min(1.0, 2 * SAMPLE / max(1, n))
    sampled = rows.filter(F.pmod(F.xxhash64("vec_id"), F.lit(1_000_000)) < int(share * 1_000_000) + 1).limit(SAMPLE).toArrow().to_pandas()
    tree = split_tree(_projected(sampled)[1], cells) if len(sampled) and cells > 1 else split_tree(np.zeros((1, M)), 1)
    cells, stop2 = len(tree[2]), chi_square_quantile(SURE)

    def place(batches):
        for pdf in batches:
            if len(pdf):
                yield pdf.assign(cell=cell_of(tree, _projected(pdf)[1]).astype("int32"))

    def bound(batches):
        """The number of rows and the box of each cell, of each batch."""
        import pandas as pd

        for pdf in batches:
            if len(pdf):
                p, cell = _projected(pdf)[1], pdf["cell"].to_numpy()
                kinds = np.unique(cell)
                boxes = [[f(p[cell == c], axis=0).tolist() for c in kinds] for f in (np.min, np.max)]
                yield pd.DataFrame({"cell": kinds, "n": [int((cell == c).sum()) for c in kinds], "low": boxes[0], "high": boxes[1]})

    placed = cut(rows.mapInPandas(place, "vec_id long, vec array<double>, cell int"))
    ends = lambda f, c: F.array(*[f(F.col(c)[i]) for i in range(M)]).alias(c)
    cell_rows = placed.mapInPandas(bound, "cell int, n long, low array<double>, high array<double>").groupBy("cell")
    found = cell_rows.agg(F.sum("n").alias("n"), ends(F.min, "low"), ends(F.max, "high")).collect()  # MAX_CELLS rows at most
    crowd = {r["cell"]: r["n"] for r in found}
    low, high = np.full((cells, M), np.inf), np.full((cells, M), -np.inf)  # the box of an empty cell is infinitely far
    for r in found:
        low[r["cell"]], high[r["cell"]] = r["low"], r["high"]
    shards = F.array(*[F.lit(max(1, math.ceil(crowd.get(c, 0) / HELD))) for c in range(cells)])
    asked = queries.groupBy("vec_id").agg(F.min("vec").alias("vec")).mapInPandas(place, "vec_id long, vec array<double>, cell int")

    def route(batches):
        """Cells that the stopping test leaves, besides the query's own."""
        for pdf in batches:
            for a in range(0, len(pdf), 256):
                some = pdf.iloc[a : a + 256]
                near2 = box_distance2(low, high, _projected(some)[1])
                near2[np.arange(len(some)), some["cell"]] = np.inf
                q, cell = np.nonzero(near2 <= stop2 * np.maximum(some["reach2"].to_numpy()[:, None], 1e-12))
                yield some.iloc[q].assign(cell=cell.astype("int32"))

    def search(asking, probes=None):
        """query_id, vec_id, score, and a row without vec_id for each search of a block, with the number of cosines computed."""
        load = {r["cell"]: r["n"] for r in asking.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).collect()}
        turns = F.array(*[F.lit(max(1, math.ceil(load.get(c, 0) / HELD))) for c in range(cells)])
        wanted = placed.filter(F.col("cell").isin(list(load))) if len(load) < len(crowd) else placed
        held = wanted.withColumns({
            "shard": F.pmod(F.xxhash64("vec_id", F.lit(1)), shards[F.col("cell")]).cast("int"),
            "turn": F.explode(F.sequence(F.lit(0), turns[F.col("cell")] - 1)),
        })
        put = asking.withColumns({
            "turn": F.pmod(F.xxhash64("vec_id", F.lit(2)), turns[F.col("cell")]).cast("int"),
            "shard": F.explode(F.sequence(F.lit(0), shards[F.col("cell")] - 1)),
        })

        def block(left, right):
            import pandas as pd

            if not len(left) or not len(right):
                return pd.DataFrame({"query_id": [], "vec_id": [], "score": [], "copy": [], "n": []})
            left = left.sort_values("vec_id", kind="stable")
            (vectors, projected), (asked_vectors, asked_projected) = _projected(left), _projected(right)
            asked_ids = right["vec_id"].to_numpy()
            ids, scores, n = search_block(left["vec_id"].to_numpy(), vectors, projected, asked_ids, asked_vectors, asked_projected, right["reach2"].to_numpy(), k, stop2, probes)
            some = np.isfinite(scores)
            hits = pd.DataFrame({"query_id": np.repeat(asked_ids, some.sum(axis=1)), "vec_id": pd.array(ids[some], "Int64"), "score": scores[some], "copy": 0, "n": 0})
            hits["copy"] = hits.groupby(["query_id", "vec_id", "score"]).cumcount()
            return pd.concat([hits, pd.DataFrame({"query_id": asked_ids, "vec_id": pd.array([None] * len(asked_ids), "Int64"), "score": 0.0, "copy": 0, "n": n})])

        keys = ["cell", "shard", "turn"]
        return cut(held.groupBy(*keys).cogroup(put.groupBy(*keys)).applyInPandas(block, "query_id long, vec_id long, score double, copy int, n long"))

    def best(found):
        order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
        return found.filter("vec_id is not null").withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)

    def reaching(asking, found):
        """With the k-th distance found; the farthest there is if fewer were."""
        reach = best(found).groupBy("query_id").agg(F.when(F.max("rank") >= k, F.min("score")).alias("s")).select(F.col("query_id").alias("vec_id"), "s")
        return cut(asking.drop("reach2").join(reach, "vec_id", "left").withColumn("reach2", F.coalesce(2 - 2 * F.col("s"), F.lit(4.0 + 1e-9)) * 1.0).drop("s"))

    found = search(asked.withColumn("reach2", F.lit(float("inf"))))
    for probes in (PROBES, None):
        asked = reaching(asked, found)
        routed = cut(asked.mapInPandas(route, "vec_id long, vec array<double>, cell int, reach2 double"))
        if routed.isEmpty():
            break
        more = search(routed, probes)
        # the second turn's rows come again in the third where the test still leaves them; ``copy`` numbers rows that repeat
        found = found.unionByName(more)
    counts = found.groupBy("query_id").agg(F.sum("n").alias("n_verified"))
    hits = found.filter("vec_id is not null").select("query_id", "vec_id", "score", "copy").distinct()
    return best(hits).join(counts, "query_id").select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score", "n_verified")
