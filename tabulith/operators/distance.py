"""Distance joins: nearest neighbours, radius search, exact silhouette.

All of them share one shape.  Both sides get a cell, a cell is cut into blocks
of bounded size, and each block pair is one small grouped task that returns
aggregates (the best k, a count, a distance sum), never the pairs themselves.
A cell holding a third of all rows only means more block pairs for it.

* ``knn_join`` assigns rows to pivots and visits only the cells that the
  triangle inequality cannot rule out.
* ``radius_join`` uses square tiles on the two most spread coordinates; a row
  goes to the tiles its radius touches.
* ``silhouette`` has one cell, since every row needs its distance to all others;
  every unordered pair of blocks is met once and gives the sums of both sides.

Blocks of neighbours and silhouettes multiply matrices: products tell which pairs
matter, and those whose digits matter are taken again by differences.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..session import cut_lineage, fan_out

BLOCK_ROWS = 4096
BLOCK_CELLS = 2_097_152  # numbers in a block of products, 32 768 rows at most
TILE_CELLS = 524_288     # pairs of a block looked at together
PIVOTS = 64


def matrix(values: pd.Series) -> np.ndarray:
    """Feature arrays of a batch as one float64 matrix."""
    if len(values) == 0:
        return np.empty((0, 0))
    return np.stack([np.asarray(v, dtype=np.float64) for v in values])


def squared_distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances by differences, row block by row block.

    The product form loses digits for near copies, and ties must stay ties.
    """
    out = np.empty((a.shape[0], b.shape[0]))
    step = max(1, int(4_000_000 / max(1, b.size)))
    for s in range(0, a.shape[0], step):
        diff = a[s:s + step, None, :] - b[None, :, :]
        out[s:s + step] = np.einsum("ijk,ijk->ij", diff, diff)
    return out


def pair_distances(a: np.ndarray, b: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Distances of the listed pairs by differences, some pairs at a time."""
    out = np.empty(len(i))
    step = max(1, TILE_CELLS // max(1, a.shape[1]))
    for s in range(0, len(i), step):
        diff = a[i[s:s + step]] - b[j[s:s + step]]
        out[s:s + step] = np.sqrt(np.einsum("ij,ij->i", diff, diff))
    return out


def _sound(m: np.ndarray) -> bool:
    """Whether products of the rows can be told from each other: finite and without overflow."""
    return bool(np.isfinite(m).all()) and (not m.size or float(np.abs(m).max()) < 1e150)


def product_rows(d: int) -> int:
    """Rows of a block of ``d`` features."""
    return min(32_768, max(1024, BLOCK_CELLS // max(1, d)))


def nearest_pairs(a: np.ndarray, b: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(i, j, distance)`` of the ``k`` rows of ``b`` nearest to each row of ``a``; ties to the first.

    Products bound the k-th distance of a row from above, and all pairs that rounding
    could put below the bound are measured by differences.
    """
    step = max(1, TILE_CELLS // max(1, len(b)))
    found = []
    by_product = _sound(a) and _sound(b) and len(b) > k
    if by_product:
        middle = b.mean(axis=0)
        ac, bc = a - middle, b - middle
        a2, b2 = np.einsum("ij,ij->i", ac, ac), np.einsum("ij,ij->i", bc, bc)
        size = a2 + b2.max()
        reach = np.sqrt(max(np.einsum("ij,ij->i", a, a).max(), np.einsum("ij,ij->i", b, b).max()))
        # rounding of the products, and of the shift to the middle
        margin = 8 * (a.shape[1] + 8) * np.finfo(float).eps * (size + 2 * np.sqrt(size) * reach)
        turned = np.ascontiguousarray(-2.0 * bc.T)
        bunch = max(1, min(64, len(b) // (4 * k)))
        whole = len(b) // bunch * bunch
    for s in range(0, len(a), step):
        if by_product:
            near = ac[s:s + step] @ turned
            near += b2
            # the k-th least of the bunches' least values has k values below it
            least = near[:, :whole].reshape(len(near), bunch, -1).min(axis=1)
            bound = np.partition(least, k - 1, axis=1)[:, k - 1] + 2 * margin[s:s + step]
            i, j = np.divmod(np.flatnonzero(near <= bound[:, None]), len(b))
            d = pair_distances(a, b, i + s, j)
        else:
            exact = np.sqrt(squared_distances(a[s:s + step], b))
            order = np.argsort(exact, axis=1, kind="stable")[:, :k]
            i, j = np.repeat(np.arange(len(exact)), order.shape[1]), order.ravel()
            d = exact[i, j]
        order = np.lexsort((j, d, i))
        i, j, d = i[order], j[order], d[order]
        first = np.arange(len(i)) - np.searchsorted(i, i) < k
        found.append((i[first] + s, j[first], d[first]))
    return tuple(np.concatenate(part) for part in zip(*found))


def distance_sums(
    a: np.ndarray, b: np.ndarray, a_weight: np.ndarray, b_weight: np.ndarray, a_starts: np.ndarray, b_starts: np.ndarray,
) -> tuple[np.ndarray, np.ndarray]:
    """Weighted distance sums of each row to each run of the other side's rows, both ways.

    ``starts`` are the first rows of the runs.  Pairs so close that their products
    lose digits are measured by differences.
    """
    to_b, to_a = np.zeros((len(a), len(b_starts))), np.zeros((len(b), len(a_starts)))
    by_product = _sound(a) and _sound(b)
    if by_product:
        middle = b.mean(axis=0)
        ac, bc = a - middle, b - middle
        a2, b2 = np.einsum("ij,ij->i", ac, ac), np.einsum("ij,ij->i", bc, bc)
        reach = np.sqrt(max(np.einsum("ij,ij->i", a, a).max(), np.einsum("ij,ij->i", b, b).max()))
        # below this a product leaves less than nine digits, the shift to the middle included
        close = np.maximum(1e-5 * (a2 + b2.max()), (1e-6 * reach) ** 2)
    rows, columns = 256, max(256, TILE_CELLS // 256)

    def runs(starts: np.ndarray, lo: int, hi: int) -> tuple[int, np.ndarray]:
        first = int(np.searchsorted(starts, lo, side="right")) - 1
        inside = starts[first + 1:int(np.searchsorted(starts, hi, side="left"))] - lo
        return first, np.concatenate([[0], inside]).astype(np.int64)

    for s in range(0, len(a), rows):
        e = min(len(a), s + rows)
        a_run, a_cuts = runs(a_starts, s, e)
        for t in range(0, len(b), columns):
            u = min(len(b), t + columns)
            if by_product:
                d = ac[s:e] @ bc[t:u].T
                d *= -2.0
                d += a2[s:e, None]
                d += b2[t:u]
                i, j = np.divmod(np.flatnonzero(d <= close[s:e, None]), u - t)
                np.sqrt(np.maximum(d, 0.0, out=d), out=d)
                if len(i):
                    d[i, j] = pair_distances(a, b, i + s, j + t)
            else:
                d = np.sqrt(squared_distances(a[s:e], b[t:u]))
            b_run, b_cuts = runs(b_starts, t, u)
            for n, (lo, hi) in enumerate(zip(b_cuts, [*b_cuts[1:], u - t])):
                to_b[s:e, b_run + n] += d[:, lo:hi] @ b_weight[t + lo:t + hi]
            for n, (lo, hi) in enumerate(zip(a_cuts, [*a_cuts[1:], e - s])):
                to_a[t:u, a_run + n] += a_weight[s + lo:s + hi] @ d[lo:hi]
    return to_b, to_a


# --- blocks ----------------------------------------------------------------

def block_pairs(
    left: DataFrame, right: DataFrame, cell: list[str], left_id: str, right_id: str,
    kernel: Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame], schema: str,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Run ``kernel`` on every (left block, right block) of the same cell.

    Block numbers come from a hash of the id, so they survive a recomputed task.
    The block counts are joined only for cells larger than one block.
    """

    def blocks(df: DataFrame, name: str) -> DataFrame:
        return (
            df.groupBy(*cell).agg(F.count(F.lit(1)).alias("n"))
            .where(F.col("n") > block_rows)
            .select(*cell, F.ceil(F.col("n") / F.lit(block_rows)).cast("int").alias(name))
        )

    left_sizes, right_sizes = blocks(left, "__nl"), blocks(right, "__nr")

    def place(df: DataFrame, ident: str, own: str, other: str, mine: str, theirs: str) -> DataFrame:
        sized = df.join(left_sizes, cell, "left").join(right_sizes, cell, "left")
        own_block = F.pmod(F.xxhash64(ident), F.coalesce(F.col(own), F.lit(1)))
        return (
            sized.withColumn(mine, own_block.cast("int"))
            .withColumn(theirs, F.explode(F.sequence(F.lit(0), F.coalesce(F.col(other), F.lit(1)) - 1)))
            .drop("__nl", "__nr")
        )

    a = place(left, left_id, "__nl", "__nr", "__lb", "__rb")
    b = place(right, right_id, "__nr", "__nl", "__rb", "__lb")
    # fresh column identities, so a table can be paired with itself
    b = b.select(*[F.col(c).alias(c) for c in b.columns])
    keys = [*cell, "__lb", "__rb"]
    return (
        fan_out(a, *keys).groupBy(*keys).cogroup(fan_out(b, *keys).groupBy(*keys)).applyInPandas(kernel, schema)
    )


# --- nearest neighbours ----------------------------------------------------

def _pivots(train: DataFrame, key: str, features: str, count: int) -> np.ndarray:
    """Reference points: the rows with the smallest key hashes (top-k, no sort)."""
    rows = (
        train.select(F.md5(F.concat(F.lit("pivot:"), F.col(key).cast("string"))).alias("h"), features)
        .orderBy("h").limit(count).collect()
    )
    if not rows:
        raise ValueError("The training side is empty.")
    return np.unique(np.array([r[features] for r in rows], dtype=np.float64), axis=0)


def knn_join(
    query: DataFrame, train: DataFrame, k: int, features: str = "features",
    query_key: str = "row_id", train_key: str = "row_id", extra: str | None = None,
    pivots: int = PIVOTS, block_rows: int | None = None,
) -> DataFrame:
    """Exact k nearest training rows: ``(query_id, train_id, distance, rank)``.

    Ties go to the smaller training key.  ``extra`` carries one training column
    along (the class label, for voting).  Blocks have ``block_rows`` rows, by
    default as many as hold a bounded count of numbers.
    """
    if k < 1:
        raise ValueError("k must be at least 1.")
    # of the copies of one point only the k smallest keys can ever be chosen, and
    # equal query rows have equal neighbours: copies cost one point on both sides
    copies = W.partitionBy(features).orderBy(train_key)
    train = train.withColumn("__copy", F.row_number().over(copies)).where(F.col("__copy") <= k).drop("__copy")
    asked = query.select(F.col(query_key).alias("query_id"), F.col(features).cast("array<double>").alias("features"))
    centers = _pivots(train, train_key, features, pivots)
    block_rows = block_rows or product_rows(centers.shape[1])
    key_type = train.schema[train_key].dataType.simpleString()
    query_type = query.schema[query_key].dataType.simpleString()
    extra_type = train.schema[extra].dataType.simpleString() if extra else "int"

    def home(batches):
        for pdf in batches:
            d = np.sqrt(squared_distances(matrix(pdf["features"]), centers)) if len(pdf) else np.empty((0, 1))
            pdf["cell"] = d.argmin(axis=1).astype("int32") if len(pdf) else pd.Series(dtype="int32")
            pdf["gap"] = d.min(axis=1) if len(pdf) else pd.Series(dtype="float64")
            yield pdf

    label = F.col(extra) if extra else F.lit(0)
    right = cut_lineage(train.select(
        F.col(train_key).alias("train_id"), F.col(features).cast("array<double>").alias("features"),
        label.alias("extra"),
    ).mapInPandas(home, f"train_id {key_type}, features array<double>, extra {extra_type}, cell int, gap double"))

    # per pivot: rows, radius and the k smallest gaps - at most pivots * k numbers
    near = W.partitionBy("cell").orderBy("gap")
    radius = {r["cell"]: r["far"] for r in right.groupBy("cell").agg(F.max("gap").alias("far")).collect()}
    close: dict[int, list[float]] = {}
    smallest = (
        right.select("cell", "gap").withColumn("rn", F.row_number().over(near)).where(F.col("rn") <= k)
    )
    for r in smallest.collect():
        close.setdefault(r["cell"], []).append(r["gap"])
    cells = sorted(radius)
    far = np.array([radius[c] for c in cells])
    points = centers[cells]
    known = np.concatenate([np.array(close[c]) for c in cells])
    owner = np.concatenate([np.full(len(close[c]), i) for i, c in enumerate(cells)])
    cell_ids = np.array(cells, dtype="int32")

    @F.pandas_udf("array<int>")
    def visits(values: pd.Series) -> pd.Series:
        if not len(values):
            return pd.Series([], dtype=object)
        lists = []
        x = matrix(values)
        for s in range(0, len(x), 1024):
            d = np.sqrt(squared_distances(x[s:s + 1024], points))
            upper = d[:, owner] + known[None, :]
            take = min(k, upper.shape[1])
            bound = np.partition(upper, take - 1, axis=1)[:, take - 1]
            if upper.shape[1] < k:
                bound = np.full(len(d), np.inf)
            # the margin covers rounding of the two distances being compared
            open_cell = d - far[None, :] <= bound[:, None] * (1 + 1e-9) + 1e-9
            lists += [cell_ids[r] for r in open_cell]
        return pd.Series(lists, dtype=object)

    # a row leaves the function once, with the list of its cells, and is dealt out by Spark
    asking = asked.groupBy("features").agg(F.min("query_id").alias("query_id"))
    left = cut_lineage(asking.select("query_id", "features", visits("features").alias("cells"))).select(
        "query_id", "features", F.explode("cells").alias("cell")
    )

    def best(q: pd.DataFrame, t: pd.DataFrame) -> pd.DataFrame:
        if not len(q) or not len(t):
            return pd.DataFrame()
        t = t.sort_values("train_id", kind="stable").reset_index(drop=True)
        rows, picked, d = nearest_pairs(matrix(q["features"]), matrix(t["features"]), k)
        return pd.DataFrame(
            {
                "query_id": q["query_id"].to_numpy()[rows],
                "train_id": t["train_id"].to_numpy()[picked],
                "distance": d,
                "extra": t["extra"].to_numpy()[picked],
            }
        )

    found = block_pairs(
        left, right.drop("gap"), ["cell"], "query_id", "train_id", best,
        f"query_id {query_type}, train_id {key_type}, distance double, extra {extra_type}", block_rows,
    )
    order = W.partitionBy("query_id").orderBy("distance", "train_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    points = asked.groupBy("features").agg(F.min("query_id").alias("first"))
    named = asked.join(points, "features").select("first", "query_id")
    ranked = ranked.withColumnRenamed("query_id", "first").join(named, "first").select(
        "query_id", "train_id", "distance", "extra", "rank"
    )
    return ranked.withColumnRenamed("extra", extra) if extra else ranked.drop("extra")


def knn_vote(
    neighbours: DataFrame, label: str, weights: str = "uniform"
) -> DataFrame:
    """Class by (weighted) vote with its share; ties go to the smaller label.

    With distance weights, exact matches outvote everything else.
    """
    if weights not in ("uniform", "distance"):
        raise ValueError("weights must be 'uniform' or 'distance'.")
    if weights == "uniform":
        weighted = neighbours.withColumn("w", F.lit(1.0))
    else:
        exact = F.max(F.when(F.col("distance") == 0, 1).otherwise(0)).over(W.partitionBy("query_id"))
        weighted = neighbours.withColumn(
            "w",
            F.when(exact == 1, (F.col("distance") == 0).cast("double"))
            .otherwise(1.0 / F.col("distance")),
        )
    votes = weighted.groupBy("query_id", label).agg(F.sum("w").alias("w"))
    return votes.groupBy("query_id").agg(
        F.min_by(label, F.struct(-F.col("w"), F.col(label))).alias("prediction"),
        (F.max("w") / F.sum("w")).alias("share"),
    )


# --- radius search ---------------------------------------------------------

def _tiles(train: DataFrame, features: str, eps: float, block_rows: int):
    """Two most spread coordinates and a tile side of at least ``eps``."""
    first = train.select(F.size(features).alias("d")).first()
    if first is None:
        raise ValueError("The training side is empty.")
    d = first["d"]
    row = train.agg(
        F.count(F.lit(1)).alias("n"),
        *[F.var_pop(F.col(features)[j]).alias(f"v{j}") for j in range(d)],
        *[F.min(F.col(features)[j]).alias(f"lo{j}") for j in range(d)],
        *[F.max(F.col(features)[j]).alias(f"hi{j}") for j in range(d)],
    ).first()
    order = sorted(range(d), key=lambda j: (-row[f"v{j}"], j))
    a, b = order[0], order[1] if d > 1 else order[0]
    span = max(row[f"hi{a}"] - row[f"lo{a}"], row[f"hi{b}"] - row[f"lo{b}"], eps)
    across = max(1.0, (row["n"] / block_rows) ** (0.5 if d > 1 else 1.0))
    return a, b, max(eps, span / across)


def _tile(features: str, j: int, side: float, shift: float = 0.0) -> Column:
    return F.floor((F.col(features)[j] + F.lit(shift)) / F.lit(side)).cast("bigint")


def _touched(df: DataFrame, features: str, a: int, b: int, side: float, eps: float) -> DataFrame:
    """One row per tile that the square of half-width ``eps`` around a row touches."""
    pad = eps * (1 + 1e-9)
    return df.withColumn(
        "tx", F.explode(F.sequence(_tile(features, a, side, -pad), _tile(features, a, side, pad)))
    ).withColumn(
        "ty", F.explode(F.sequence(_tile(features, b, side, -pad), _tile(features, b, side, pad)))
    )


def radius_join(
    query: DataFrame, train: DataFrame, eps: float, features: str = "features",
    query_key: str = "row_id", train_key: str = "row_id", weight: str | None = None,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Rows within ``eps``: ``(query_id, n_within, nearest_id, nearest_distance)``.

    The pairs are tested block by block and only these aggregates leave a block.
    Every query row appears; one without neighbours has a count of zero.
    """
    if eps <= 0:
        raise ValueError("eps must be positive.")
    a, b, side = _tiles(train, features, eps, block_rows)
    key_type = train.schema[train_key].dataType.simpleString()
    query_type = query.schema[query_key].dataType.simpleString()
    w = F.col(weight).cast("bigint") if weight else F.lit(1).cast("bigint")
    # copies are one point with a weight on the training side and one question on
    # the other, so a large group of copies costs a single row
    right = (
        train.select(
            F.col(train_key).alias("train_id"), F.col(features).cast("array<double>").alias("features"), w.alias("w")
        )
        .groupBy("features").agg(F.min("train_id").alias("train_id"), F.sum("w").alias("w"))
        .select("train_id", "features", "w", _tile("features", a, side).alias("tx"), _tile("features", b, side).alias("ty"))
    )
    slim = query.select(
        F.col(query_key).alias("query_id"), F.col(features).cast("array<double>").alias("features")
    )
    points = slim.groupBy("features").agg(F.min("query_id").alias("query_id"))
    left = _touched(points.select("query_id", "features"), "features", a, b, side, eps)

    def count(q: pd.DataFrame, t: pd.DataFrame) -> pd.DataFrame:
        if not len(q) or not len(t):
            return pd.DataFrame()
        t = t.sort_values("train_id", kind="stable").reset_index(drop=True)
        d = np.sqrt(squared_distances(matrix(q["features"]), matrix(t["features"])))
        inside = d <= eps
        n = inside @ t["w"].to_numpy(dtype=np.int64)
        nearest = np.where(inside, d, np.inf).argmin(axis=1)
        hit = n > 0
        return pd.DataFrame(
            {
                "query_id": q["query_id"].to_numpy()[hit],
                "n": n[hit],
                "train_id": t["train_id"].to_numpy()[nearest[hit]],
                "distance": d[np.nonzero(hit)[0], nearest[hit]],
            }
        )

    found = block_pairs(
        left, right, ["tx", "ty"], "query_id", "train_id", count,
        f"query_id {query_type}, n bigint, train_id {key_type}, distance double", block_rows,
    )
    best = found.groupBy("query_id").agg(
        F.sum("n").alias("n_within"),
        F.min(F.struct("distance", "train_id")).alias("best"),
    )
    answered = points.join(best, "query_id", "left").drop("query_id")
    return slim.join(answered, "features").select(
        "query_id",
        F.coalesce("n_within", F.lit(0)).cast("bigint").alias("n_within"),
        F.col("best.train_id").alias("nearest_id"),
        F.col("best.distance").alias("nearest_distance"),
    )


def nearest_core(
    query: DataFrame, cores: DataFrame, eps: float, features: str = "features",
    query_key: str = "row_id", core_key: str = "row_id", cluster: str = "cluster",
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Cluster of the nearest core row within ``eps``, else -1."""
    near = radius_join(query, cores, eps, features, query_key, core_key, None, block_rows)
    named = cores.select(F.col(core_key).alias("nearest_id"), F.col(cluster).alias("__c"))
    return near.join(named, "nearest_id", "left").select(
        F.col("query_id").alias("row_id"), F.coalesce("__c", F.lit(-1)).cast("int").alias("prediction")
    )


def radius_links(
    points: DataFrame, eps: float, features: str = "features", key: str = "row_id",
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Edges ``(src, dst)`` with the same connected parts as "within eps".

    Every block pair returns only a spanning forest of its links, at most one
    edge per row, so dense regions do not produce all their pairs.
    """
    a, b, side = _tiles(points, features, eps, block_rows)
    key_type = points.schema[key].dataType.simpleString()
    slim = points.select(F.col(key).alias("id"), F.col(features).cast("array<double>").alias("features"))
    right = slim.select("*", _tile("features", a, side).alias("tx"), _tile("features", b, side).alias("ty"))
    left = _touched(slim, "features", a, b, side, eps)

    def forest(q: pd.DataFrame, t: pd.DataFrame) -> pd.DataFrame:
        empty = pd.DataFrame()
        if not len(q) or not len(t):
            return empty
        q = q.sort_values("id", kind="stable").reset_index(drop=True)
        t = t.sort_values("id", kind="stable").reset_index(drop=True)
        ids = np.union1d(q["id"].to_numpy(), t["id"].to_numpy())
        qi, ti = np.searchsorted(ids, q["id"]), np.searchsorted(ids, t["id"])
        parent = np.arange(len(ids))

        def root(i: int) -> int:
            while parent[i] != i:
                parent[i] = parent[parent[i]]
                i = parent[i]
            return i

        src, dst = [], []
        tm = matrix(t["features"])
        qm = matrix(q["features"])
        for s in range(0, len(q), 256):
            near = squared_distances(qm[s:s + 256], tm) <= eps * eps * (1 + 1e-15)
            near &= np.sqrt(squared_distances(qm[s:s + 256], tm)) <= eps
            for r, c in zip(*np.nonzero(near)):
                i, j = root(qi[s + r]), root(ti[c])
                if i != j:
                    parent[max(i, j)] = min(i, j)
                    src.append(ids[qi[s + r]])
                    dst.append(ids[ti[c]])
        return pd.DataFrame({"src": src, "dst": dst}) if src else empty

    return block_pairs(
        left, right, ["tx", "ty"], "id", "id", forest, f"src {key_type}, dst {key_type}", block_rows
    )


# --- silhouette ------------------------------------------------------------

def silhouette_rows(
    df: DataFrame, features: str = "features", label: str = "prediction", key: str = "row_id",
    block_rows: int | None = None,
) -> DataFrame:
    """Exact Euclidean silhouette of every row: ``(row_id, a, b, s)``.

    Copies are collapsed per cluster first.  The work is quadratic in the
    distinct points by definition of the metric; what moves is one distance sum
    per (point, cluster, block).  Each unordered pair of blocks is one task.
    """
    slim = df.select(
        F.col(key).alias("row_id"), F.col(label).cast("int").alias("label"),
        F.col(features).cast("array<double>").alias("features"),
    )
    points = cut_lineage(slim.groupBy("label", "features").agg(
        F.count(F.lit(1)).alias("w"), F.min("row_id").alias("id")
    ))
    key_type = slim.schema["row_id"].dataType.simpleString()
    held = points.agg(
        F.count(F.lit(1)).alias("n"), F.max(F.size("features")).alias("d"), F.count_distinct("label").alias("k")
    ).first()
    if block_rows is None:
        # some pairs of blocks for every core; a block's sums are as wide as there are clusters
        side = np.ceil(np.sqrt(8 * df.sparkSession.sparkContext.defaultParallelism))
        block_rows = min(product_rows(max(held["d"] or 1, held["k"])), max(512, int(np.ceil(held["n"] / side))))
    last = max(1, -(-held["n"] // block_rows)) - 1
    # points without a cluster have no distance sum that counts
    placed = points.where("label IS NOT NULL").withColumn("block", F.pmod(F.xxhash64("id"), F.lit(last + 1)).cast("int"))
    low = placed.withColumns({"lb": F.col("block"), "rb": F.explode(F.sequence("block", F.lit(last)))}).drop("block")
    high = placed.withColumns({"rb": F.col("block"), "lb": F.explode(F.sequence(F.lit(0), "block"))}).drop("block")
    # fresh column identities, so the table can be paired with itself
    high = high.select(*[F.col(c).alias(c) for c in high.columns])

    def listed(p: pd.DataFrame, others: np.ndarray, totals: np.ndarray) -> pd.DataFrame:
        return pd.DataFrame({
            "id": np.repeat(p["id"].to_numpy(), len(others)), "label": np.repeat(p["label"].to_numpy(), len(others)),
            "other": np.tile(others, len(p)), "total": totals.ravel(),
        })

    def sums(pair, q: pd.DataFrame, t: pd.DataFrame) -> pd.DataFrame:
        if not len(q) or not len(t):
            return pd.DataFrame()
        q, t = (p.sort_values("label", kind="stable").reset_index(drop=True) for p in (q, t))
        q_labels, q_starts = np.unique(q["label"].to_numpy(), return_index=True)
        t_labels, t_starts = np.unique(t["label"].to_numpy(), return_index=True)
        to_t, to_q = distance_sums(
            matrix(q["features"]), matrix(t["features"]), q["w"].to_numpy(float), t["w"].to_numpy(float), q_starts, t_starts
        )
        parts = [listed(q, t_labels, to_t)]
        if pair[0] != pair[1]:
            parts.append(listed(t, q_labels, to_q))
        return pd.concat(parts, ignore_index=True)

    keys = ["lb", "rb"]
    partial = fan_out(low, *keys).groupBy(*keys).cogroup(fan_out(high, *keys).groupBy(*keys)).applyInPandas(
        sums, f"id {key_type}, label int, other int, total double"
    )
    sizes = slim.groupBy("label").agg(F.count(F.lit(1)).alias("size"))
    totals = partial.groupBy("id", "label", "other").agg(F.sum("total").alias("total")).join(
        sizes.select(F.col("label").alias("other"), "size"), "other"
    )
    own = F.col("label") == F.col("other")
    per_point = totals.groupBy("id", "label").agg(
        F.max(F.when(own, F.col("size"))).alias("size"),
        F.max(F.when(own & (F.col("size") > 1), F.col("total") / (F.col("size") - 1))).alias("a"),
        F.min(F.when(~own, F.col("total") / F.col("size"))).alias("b"),
    ).withColumn(
        "s",
        F.when(F.col("size") <= 1, F.lit(0.0))
        .when(F.greatest("a", "b") == 0, F.lit(0.0))
        .otherwise((F.col("b") - F.col("a")) / F.greatest("a", "b")),
    )
    return per_point.join(points.select("id", "label", "w"), ["id", "label"])


def silhouette(
    df: DataFrame, features: str = "features", label: str = "prediction", key: str = "row_id",
    block_rows: int | None = None,
) -> DataFrame:
    """Mean silhouette in one row; NULL unless 2 <= clusters < rows."""
    rows = silhouette_rows(df, features, label, key, block_rows)
    return rows.agg(
        (F.sum(F.col("s") * F.col("w")) / F.sum("w")).alias("v"),
        F.count_distinct("label").alias("k"), F.sum("w").alias("n"),
    ).select(
        F.when((F.col("k") >= 2) & (F.col("k") < F.col("n")), F.col("v")).alias("silhouette_score")
    )
