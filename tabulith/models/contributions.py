"""Per-row feature contributions of tree ensembles (path-dependent Shapley values).

The trees are small and travel with the tasks; rows stay where they are.  The
value of a leaf is shared among the features on its path, in closed form over
the subsets, vectorised over the rows of a batch.  The thresholds of a tree cut
the features into cells with one result each; where these are few, they are worked
out once and looked up.  A row leaves Python once, with all its contributions.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Sequence
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import checkpoint_dir
from .base import Fitted, batch_matrix
from .boosting import BoostedClassifier


def ensemble_tables(fitted: Fitted) -> list[dict[str, Any]]:
    """Node arrays of every tree: of boosted trees, or of a library forest read from its saved form."""
    if isinstance(fitted, BoostedClassifier):
        return fitted.tables()
    from pyspark.sql import SparkSession

    spark = SparkSession.active()
    model = getattr(fitted, "model", None)
    if not hasattr(model, "trees"):
        raise ValueError("Contributions need a tree ensemble (forest or boosting).")
    path = f"{checkpoint_dir(spark).rstrip('/')}/ensemble-{uuid.uuid4().hex}"
    model.write().save(path)
    data = spark.read.parquet(f"{path}/data")
    node = "nodeData." if "nodeData" in data.columns else ""
    rows = data.select(
        F.col("treeID").alias("tree"), F.col(f"{node}id").alias("id"), F.col(f"{node}leftChild").alias("l"),
        F.col(f"{node}rightChild").alias("r"), F.col(f"{node}split.featureIndex").alias("f"),
        F.col(f"{node}split.leftCategoriesOrThreshold").alias("t"), F.col(f"{node}impurityStats").alias("s"),
        F.col(f"{node}rawCount").alias("n"),
    ).collect()
    trees: dict[int, dict[int, Any]] = {}
    for r in rows:
        trees.setdefault(r["tree"], {})[r["id"]] = r
    out = []
    for k in sorted(trees):
        nodes = [trees[k][i] for i in range(len(trees[k]))]
        stats = np.array([n["s"] for n in nodes], dtype=float)
        out.append({
            "left": np.array([n["l"] for n in nodes]), "right": np.array([n["r"] for n in nodes]),
            "feature": np.array([n["f"] for n in nodes]),
            "threshold": np.array([n["t"][0] if n["t"] else 0.0 for n in nodes]),
            "cover": np.array([max(float(n["n"]), 1.0) for n in nodes]),
            "value": stats / np.maximum(stats.sum(axis=1, keepdims=True), 1e-300) / len(trees),
        })
    return out


def _paths(tree: dict[str, np.ndarray]):
    """Every leaf with the (node, goes left, cover share) steps above it."""
    stack = [(0, [])]
    while stack:
        i, steps = stack.pop()
        left, right = int(tree["left"][i]), int(tree["right"][i])
        if left < 0:
            yield i, steps
            continue
        total = tree["cover"][left] + tree["cover"][right]
        stack.append((left, [*steps, (i, True, tree["cover"][left] / total)]))
        stack.append((right, [*steps, (i, False, tree["cover"][right] / total)]))


def tree_shap(x: np.ndarray, trees: Sequence[dict[str, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Contributions (rows, features, outputs) and the base value (outputs)."""
    outputs = trees[0]["value"].shape[1]
    phi = np.zeros((len(x), x.shape[1], outputs))
    base = np.zeros(outputs)
    for tree in trees:
        for leaf, steps in _paths(tree):
            value = tree["value"][leaf]
            if not steps:
                base += value
                continue
            follow: dict[int, np.ndarray] = {}
            share: dict[int, float] = {}
            for i, is_left, part in steps:
                f = int(tree["feature"][i])
                ok = (x[:, f] <= tree["threshold"][i]) == is_left
                follow[f] = follow[f] & ok if f in follow else ok
                share[f] = share.get(f, 1.0) * part
            names = list(follow)
            m = len(names)
            base += value * math.prod(share.values())
            one = np.stack([follow[f] for f in names]).astype(float)
            zero = np.array([share[f] for f in names])
            # Coefficients by number of followed features, over all features of the path ...
            poly = np.zeros((m + 1, len(x)))
            poly[0] = 1.0
            for j in range(m):
                poly[1:] = poly[1:] * zero[j] + poly[:-1] * one[j]
                poly[0] *= zero[j]
            weights = np.array([math.factorial(s) * math.factorial(m - s - 1) / math.factorial(m) for s in range(m)])
            for i, f in enumerate(names):
                # ... divided by the factor of this one.
                rest = np.empty((m, len(x)))
                rest[m - 1] = poly[m]
                for s in range(m - 1, 0, -1):
                    rest[s - 1] = poly[s] - zero[i] * rest[s]
                rest = np.where(one[i] > 0, rest, poly[:m] / zero[i])
                phi[:, f, :] += (weights @ rest * (one[i] - zero[i]))[:, None] * value[None, :]
    return phi, base


MOST_CELLS = 4096        # of a tree; larger trees are worked out row by row


class CellTables:
    """``tree_shap`` of an ensemble, by tables for the trees with few cells."""

    def __init__(self, trees: Sequence[dict[str, np.ndarray]], d: int) -> None:
        self.shape = (d, trees[0]["value"].shape[1])
        self.base = np.zeros(self.shape[1])
        self.tables, self.others = [], []
        for tree in trees:
            inner = tree["left"] >= 0
            cuts = {int(f): np.unique(tree["threshold"][inner & (tree["feature"] == f)]) for f in np.unique(tree["feature"][inner])}
            sizes = [len(c) + 1 for c in cuts.values()]
            if math.prod(sizes) > MOST_CELLS or not all(np.isfinite(c).all() for c in cuts.values()):
                self.others.append(tree)
                continue
            # a row of each cell: the cell's upper edge on every feature
            x = np.zeros((math.prod(sizes), d))
            for (f, c), i in zip(cuts.items(), np.unravel_index(np.arange(len(x)), sizes) if sizes else ()):
                x[:, f] = np.append(c, np.inf)[i]
            phi, base = tree_shap(x, [tree])
            self.base += base
            used = [k for k in range(self.shape[1]) if phi[:, :, k].any()]
            self.tables.append((cuts, [(f, k, np.ascontiguousarray(phi[:, f, k])) for f in cuts for k in used]))
        if self.others:
            self.base += tree_shap(np.zeros((1, d)), self.others)[1]

    def __call__(self, x: np.ndarray) -> np.ndarray:
        """Contributions (rows, features, outputs)."""
        sums = np.zeros((*self.shape, len(x)))
        columns = [np.ascontiguousarray(x[:, f]) for f in range(self.shape[0])]
        for cuts, parts in self.tables:
            cell = np.zeros(len(x), np.int64)
            for f, c in cuts.items():
                cell *= len(c) + 1
                cell += np.searchsorted(c, columns[f], side="left")
            for f, k, table in parts:
                sums[f, k] += table[cell]
        phi = np.ascontiguousarray(sums.transpose(2, 0, 1))
        return phi + tree_shap(x, self.others)[0] if self.others else phi


def tree_contributions(df: DataFrame, fitted: Fitted) -> DataFrame:
    """Long table ``(row_id, feature, class, phi, base)``.

    Forests explain class shares; boosting explains the margin of the second of two
    classes, or of each of more.  Contributions of a row plus the base give the model output.
    """
    trees = ensemble_tables(fitted)
    outputs = trees[0]["value"].shape[1]
    d = fitted.n_features
    names = [str(c) for c in fitted.classes] if outputs > 1 else [str(fitted.classes[1])]
    kind = df.schema["row_id"].dataType

    tables = CellTables(trees, d)

    def explain(batches):
        for batch in batches:
            step = max(1, 65_536 // (d * outputs))
            for s in range(0, batch.num_rows, step):
                part = batch.slice(s, step)
                phi = tables(batch_matrix(part))
                ends = pa.array(np.arange(0, phi.size + 1, d * outputs, dtype=np.int32))
                yield pa.RecordBatch.from_arrays(
                    [part.column("row_id"), pa.ListArray.from_arrays(ends, pa.array(phi.ravel()))], names=["row_id", "phi"]
                )

    shared = df.select("row_id", F.col("features").cast("array<double>").alias("features")).mapInArrow(
        explain, f"row_id {kind.simpleString()}, phi array<double>"
    )
    named = F.array(*[F.lit(n) for n in names])
    bases = F.array(*[F.lit(float(v)) for v in tables.base])
    output = F.col("at") % outputs
    return shared.select("row_id", F.posexplode("phi").alias("at", "phi")).select(
        "row_id", F.floor(F.col("at") / outputs).cast("int").alias("feature"), F.get(named, output).alias("class"), "phi",
        F.get(bases, output).alias("base"),
    )


def mean_abs_contribution(contributions: DataFrame) -> DataFrame:
    """Mean absolute contribution per feature and class, with the feature total."""
    from pyspark.sql import Window as W

    per = contributions.groupBy("feature", "class").agg(F.avg(F.abs("phi")).alias("mean_abs"))
    return per.withColumn("total", F.sum("mean_abs").over(W.partitionBy("feature")))
