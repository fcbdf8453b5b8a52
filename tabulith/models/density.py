"""Density clustering and merged micro-clusters."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.distance import BLOCK_ROWS, nearest_core, radius_join, radius_links
from ..operators.graph import connected_components
from ..operators.prepare import SEED
from ..session import cut_lineage
from .base import Fitted, Model
from .library import NearestCentre

NOISE = -1


def density_clusters(
    df: DataFrame, eps: float, min_samples: int, features: str = "features", key: str = "row_id",
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """``(row_id, prediction, is_core)`` for every row.

    Copies are collapsed into weighted points first, so a third of all rows
    being one point costs one point.  A point is core when the weight within
    ``eps`` (itself included) reaches ``min_samples``; clusters are the connected
    parts of the core points, numbered by their smallest row; a border row takes
    the lowest-numbered cluster among the core points it touches.
    """
    if eps <= 0 or min_samples < 1:
        raise ValueError("eps must be positive and min_samples at least 1.")
    rows = df.select(F.col(key).alias("row_id"), F.col(features).cast("array<double>").alias("features"))
    first = rows.select(F.size("features").alias("d")).first()
    if first is None:
        raise ValueError("The table has no rows.")
    # rows of one small cell are always within eps of each other
    side = eps / np.sqrt(first["d"]) * (1 - 1e-9)
    cell = F.transform("features", lambda v: F.floor(v / F.lit(float(side))))
    points = cut_lineage(
        rows.groupBy("features").agg(F.min("row_id").alias("id"), F.count(F.lit(1)).alias("w")).withColumn("cell", cell)
    )
    weights = points.groupBy("cell").agg(F.sum("w").alias("cell_w"))
    flagged = points.join(weights, "cell").withColumn("dense", F.col("cell_w") >= min_samples)
    # only rows of thin cells have to count their neighbours
    thin = flagged.where(~F.col("dense")).select("id", "features")
    around = radius_join(thin, points, eps, "features", "id", "id", "w", block_rows)
    counted = cut_lineage(
        flagged.join(around.select(F.col("query_id").alias("id"), "n_within"), "id", "left")
        .select("id", "features", "cell", (F.col("dense") | (F.coalesce("n_within", F.lit(0)) >= min_samples)).alias("is_core"))
    )
    core = counted.where("is_core").select("id", "features", "cell")
    if core.limit(1).count() == 0:
        return rows.select("row_id", F.lit(NOISE).alias("prediction"), F.lit(False).alias("is_core"))
    linked = cut_lineage(_parts(core, first["d"], eps, block_rows))
    numbers = _number(linked.select("component").distinct())
    labelled = core.join(linked, "id").join(numbers, "component").select("id", "features", "cluster")
    border = _lowest_cluster(counted.where(~F.col("is_core")).select("id", "features"), labelled, eps, block_rows)
    assigned = labelled.select("id", "cluster", F.lit(True).alias("is_core")).unionByName(
        border.select("id", "cluster", F.lit(False).alias("is_core"))
    )
    by_point = points.join(assigned, "id").select("features", "cluster", "is_core")
    return rows.join(by_point, "features").select("row_id", F.col("cluster").alias("prediction"), "is_core")


def _parts(core: DataFrame, d: int, eps: float, block_rows: int) -> DataFrame:
    """``(id, component)`` of the core points, connected exactly as "within eps" does.

    Points of a cell hang on the cell's first one.  Cells are linked through
    their outermost points first; only cells that still touch a cell of another
    part compare all their points.  A crowded region is thus settled by a few
    points per cell, and the second round runs on the parts of the first.
    """
    extremes = [F.min_by(F.struct("id", "features"), F.col("features")[j]) for j in range(d)] + [
        F.max_by(F.struct("id", "features"), F.col("features")[j]) for j in range(d)
    ]
    cells = cut_lineage(
        core.groupBy("cell").agg(
            F.min("id").alias("head"),
            F.array_distinct(F.array(*extremes)).alias("outer"),
            F.array(*[F.min(F.col("features")[j]) for j in range(d)]).alias("low"),
            F.array(*[F.max(F.col("features")[j]) for j in range(d)]).alias("high"),
        )
    )
    outer = cells.select("head", F.explode("outer").alias("p")).select("head", "p.id", "p.features")
    quick = radius_links(outer.select("id", "features"), eps, "features", "id", block_rows).unionByName(
        outer.select(F.col("id").alias("src"), F.col("head").alias("dst"))
    )
    found = connected_components(quick, cells.select(F.col("head").alias("id")))
    placed = cut_lineage(cells.join(found.select(F.col("id").alias("head"), "component"), "head"))
    own = core.join(placed.select("cell", "component"), "cell").select("id", "component")
    unsettled = _touching_other_parts(placed, eps, block_rows)
    rest = cut_lineage(
        core.join(placed.join(unsettled, "head").select("cell", "component"), "cell").select("id", "features", "component")
    )
    if rest.limit(1).count() == 0:
        return own
    near = radius_links(rest.select("id", "features"), eps, "features", "id", block_rows)
    name = rest.select("id", "component")
    bridges = (
        near.join(name.select(F.col("id").alias("src"), F.col("component").alias("a")), "src")
        .join(name.select(F.col("id").alias("dst"), F.col("component").alias("b")), "dst")
        .where("a <> b").select(F.col("a").alias("src"), F.col("b").alias("dst")).distinct()
    )
    merged = connected_components(bridges).withColumnsRenamed({"id": "component", "component": "whole"})
    return own.join(merged, "component", "left").select("id", F.coalesce("whole", "component").alias("component"))


def _touching_other_parts(cells: DataFrame, eps: float, block_rows: int) -> DataFrame:
    """Heads of cells whose box comes within ``eps`` of a box of another part."""
    from ..operators.distance import _tile, _tiles, block_pairs, matrix

    a, b, side = _tiles(cells, "low", eps, block_rows)
    slim = cells.select("head", "component", "low", "high")
    right = slim.select("*", _tile("low", a, side).alias("tx"), _tile("low", b, side).alias("ty"))
    # a box is narrower than eps, so boxes in reach start within two eps
    pad = 2 * eps * (1 + 1e-9)
    left = slim.withColumn("tx", F.explode(F.sequence(_tile("low", a, side, -pad), _tile("low", a, side, pad)))).withColumn(
        "ty", F.explode(F.sequence(_tile("low", b, side, -pad), _tile("low", b, side, pad)))
    )

    def near(q: pd.DataFrame, t: pd.DataFrame) -> pd.DataFrame:
        if not len(q) or not len(t):
            return pd.DataFrame()
        ql, qh, tl, th = matrix(q["low"]), matrix(q["high"]), matrix(t["low"]), matrix(t["high"])
        hit = np.zeros(len(q), dtype=bool)
        component = t["component"].to_numpy()
        for s in range(0, len(q), 256):
            part = slice(s, s + 256)
            gap = np.maximum(0.0, np.maximum(tl[None] - qh[part, None], ql[part, None] - th[None]))
            close = (gap**2).sum(axis=2) <= eps * eps * (1 + 1e-9)
            hit[part] = (close & (q["component"].to_numpy()[part, None] != component[None])).any(axis=1)
        return pd.DataFrame({"head": q["head"].to_numpy()[hit]}) if hit.any() else pd.DataFrame()

    kind = cells.schema["head"].dataType.simpleString()
    return block_pairs(left, right, ["tx", "ty"], "head", "head", near, f"head {kind}", block_rows).distinct()


def _number(components: DataFrame) -> DataFrame:
    """Cluster numbers 0.. in the order of the smallest member."""
    from ..operators.prepare import sorted_codes

    values = components.select(F.lit("component").alias("column"), F.col("component").alias("value"))
    return sorted_codes(values, components.count()).select(
        F.col("value").alias("component"), F.col("code").cast("int").alias("cluster")
    )


def _lowest_cluster(border: DataFrame, labelled: DataFrame, eps: float, block_rows: int) -> DataFrame:
    """Smallest cluster number within reach of each border point, else noise."""
    from ..operators.distance import _tile, _tiles, _touched, block_pairs, matrix, squared_distances

    if border.limit(1).count() == 0:
        return border.select("id", F.lit(NOISE).alias("cluster"))
    a, b, side = _tiles(labelled, "features", eps, block_rows)
    right = labelled.select(
        "id", "features", "cluster", _tile("features", a, side).alias("tx"), _tile("features", b, side).alias("ty")
    )
    left = _touched(border, "features", a, b, side, eps)

    def lowest(q: pd.DataFrame, t: pd.DataFrame) -> pd.DataFrame:
        if not len(q) or not len(t):
            return pd.DataFrame()
        d = np.sqrt(squared_distances(matrix(q["features"]), matrix(t["features"])))
        c = np.where(d <= eps, t["cluster"].to_numpy()[None, :], np.iinfo(np.int32).max).min(axis=1)
        hit = c < np.iinfo(np.int32).max
        return pd.DataFrame({"id": q["id"].to_numpy()[hit], "cluster": c[hit]})

    key_type = border.schema["id"].dataType.simpleString()
    found = block_pairs(left, right, ["tx", "ty"], "id", "id", lowest, f"id {key_type}, cluster int", block_rows)
    best = found.groupBy("id").agg(F.min("cluster").alias("cluster"))
    return border.select("id").join(best, "id", "left").select("id", F.coalesce("cluster", F.lit(NOISE)).alias("cluster"))


@dataclass
class DensityClusters(Fitted):
    """Training rows keep their label; all others take the nearest core row's.

    A row counts as a training row if both its key and its features are one's.
    """

    labels: DataFrame | None = None
    cores: DataFrame | None = None
    eps: float = 0.5

    def transform(self, df: DataFrame) -> DataFrame:
        known = self.labels.select("row_id", F.col("features").alias("__at"), F.col("prediction").alias("trained"))
        same = (df["row_id"] == known["row_id"]) & (df["features"] == known["__at"])
        found = df.join(known, same, "left").drop(known["row_id"]).drop("__at")
        if self.cores is None:
            return found.withColumn("prediction", F.coalesce("trained", F.lit(NOISE)).cast("int")).drop("trained")
        near = nearest_core(found.where("trained is null"), self.cores, self.eps, cluster="prediction")
        near = near.withColumnRenamed("prediction", "__near")
        return found.join(near, "row_id", "left").withColumn(
            "prediction", F.coalesce("trained", "__near").cast("int")
        ).drop("trained", "__near")


class DBSCAN(Model):
    key, name, model_type, supervised = "dbscan", "DBSCAN", "clusterer", False

    def __init__(self, eps: float = 0.5, min_samples: int = 5, metric: str = "euclidean") -> None:
        if metric != "euclidean":
            raise ValueError("Only metric='euclidean' is available.")
        if eps <= 0 or min_samples < 1:
            raise ValueError("eps must be positive and min_samples at least 1.")
        self.eps, self.min_samples, self.metric = eps, min_samples, metric

    def _fit(self, train: DataFrame, d: int) -> DensityClusters:
        clusters = density_clusters(train, self.eps, self.min_samples)
        labels = cut_lineage(clusters.join(train.select("row_id", "features"), "row_id"))
        cores = labels.where("is_core").select("row_id", "features", "prediction")
        if cores.limit(1).count() == 0:
            cores = None
        return self._new(DensityClusters, d, labels=labels, cores=cores, eps=self.eps)


# --- merged micro-clusters ---------------------------------------------------

def merge_clusters(centres: np.ndarray, sizes: np.ndarray, linkage: str) -> list[tuple[int, int, float, int]]:
    """Lance-Williams merges of weighted centres: ``(left, right, distance, size)``."""
    n = len(centres)
    gap = np.sqrt(((centres[:, None, :] - centres[None, :, :]) ** 2).sum(axis=2))
    weight = sizes.astype(float).copy()
    if linkage == "ward":
        gap *= np.sqrt(2.0 * weight[:, None] * weight[None, :] / (weight[:, None] + weight[None, :]))
    np.fill_diagonal(gap, np.inf)
    name = list(range(n))
    alive = np.ones(n, dtype=bool)
    merges = []
    for step in range(n - 1):
        masked = np.where(alive[:, None] & alive[None, :], gap, np.inf)
        i, j = sorted(np.unravel_index(int(masked.argmin()), masked.shape))
        height = float(masked[i, j])
        others = alive.copy()
        others[[i, j]] = False
        di, dj, wi, wj, wo = gap[i, others], gap[j, others], weight[i], weight[j], weight[others]
        if linkage == "single":
            new = np.minimum(di, dj)
        elif linkage == "complete":
            new = np.maximum(di, dj)
        elif linkage == "average":
            new = (wi * di + wj * dj) / (wi + wj)
        else:
            new = np.sqrt(((wi + wo) * di**2 + (wj + wo) * dj**2 - wo * height**2) / (wi + wj + wo))
        gap[i, others] = gap[others, i] = new
        alive[j] = False
        weight[i] = wi + wj
        merges.append((*sorted((name[i], name[j])), height, int(weight[i])))
        name[i] = n + step
    return merges


def cut_merges(n: int, merges, n_clusters: int | None, threshold: float | None) -> list[int]:
    """Cluster number of every starting centre after cutting the merge list."""
    members = {i: [i] for i in range(n)}
    for step, (a, b, height, _) in enumerate(merges):
        if threshold is not None and height > threshold:
            break
        if threshold is None and len(members) <= (n_clusters or 1):
            break
        members[n + step] = members.pop(a) + members.pop(b)
    labels = [0] * n
    for number, group in enumerate(sorted(members.values(), key=min)):
        for m in group:
            labels[m] = number
    return labels


class MicroLinkage(Model):
    """Hierarchical merging of at most ``micro`` weighted k-means centres.

    An approximation: rows are summarised first, because linking all pairs of
    rows cannot be distributed.  New rows go to the nearest centre.
    """

    key, name, model_type, supervised = "hierarchical_clustering", "Micro-Cluster Linkage", "clusterer", False

    def __init__(self, n_clusters: int | None = 3, linkage: str = "ward",
                 distance_threshold: float | None = None, micro: int = 64) -> None:
        if linkage not in ("ward", "complete", "average", "single"):
            raise ValueError("linkage must be ward, complete, average or single.")
        if (n_clusters is None) == (distance_threshold is None):
            raise ValueError("Give exactly one of n_clusters and distance_threshold.")
        if not 2 <= micro <= 256:
            raise ValueError("micro must lie between 2 and 256.")
        self.n_clusters, self.linkage = n_clusters, linkage
        self.distance_threshold, self.micro = distance_threshold, micro

    def _fit(self, train: DataFrame, d: int) -> NearestCentre:
        slim = train.select(array_to_vector("features").alias("__vec")).persist()
        try:
            model = KMeans(k=self.micro, seed=SEED, featuresCol="__vec", predictionCol="__pred").fit(
                slim.where("__vec IS NOT NULL"))  # not marked as persisted, so the library keeps its vectors
            centres = np.array(model.clusterCenters())
            sizes = np.zeros(len(centres))
            for r in model.transform(slim).groupBy("__pred").count().collect():
                sizes[r["__pred"]] = r["count"]
        finally:
            slim.unpersist()
        keep = sizes > 0
        centres, sizes = centres[keep], sizes[keep]
        merges = merge_clusters(centres, sizes, self.linkage)
        names = cut_merges(len(centres), merges, self.n_clusters, self.distance_threshold)
        return self._new(NearestCentre, d, centres=centres, names=names, details={"linkage": merges})
