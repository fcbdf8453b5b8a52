"""Second-order gradient boosting over histograms, one tree per class and round.

Features are cut once into at most ``max_bins`` bins by exact ranks, and rows carry one
byte per feature.  A round grows its trees level by level: tasks route their rows to the
open nodes, sum gradients and curvatures per (tree, node, feature, bin), one shuffle adds
the sums up and running sums over the bins score every cut; what reaches the driver is
the best cut of each open node.  Margins are kept with the rows as of some round; tasks
add the trees grown since, and every ``KEEP`` rounds the rows are persisted with new ones.

Two classes have one tree a round (logistic loss, starting from the log odds), more have
one tree per class (soft-max loss, curvature ``2 p (1 - p)``).
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import argmax_index, number
from ..session import fan_out
from .base import Fitted, Model, batch_matrix, label_at, label_index, labels_of, vector_scores
from .trees import global_edges

SEED = 42
KEEP = 20
LEAST_GAIN = 1e-6        # a split must lower the loss by more than this
LEAST_CURVE = 1e-16
TABLE_BYTES = 128_000_000  # sums a task holds before it hands them on


@dataclass
class BoostTree:
    """Node arrays of one tree; ``feature`` is -1 at a leaf.  Values hold the learning rate."""

    output: int
    feature: list[int] = field(default_factory=lambda: [-1])
    bin: list[int] = field(default_factory=lambda: [-1])
    threshold: list[float] = field(default_factory=lambda: [0.0])
    left: list[int] = field(default_factory=lambda: [-1])
    right: list[int] = field(default_factory=lambda: [-1])
    gain: list[float] = field(default_factory=lambda: [0.0])
    gradient: list[float] = field(default_factory=lambda: [0.0])
    curvature: list[float] = field(default_factory=lambda: [0.0])
    value: list[float] = field(default_factory=lambda: [0.0])

    def split(self, node: int, feature: int, at: int, threshold: float, gain: float, sums: Sequence[float]) -> tuple[int, int]:
        """Two children of ``node``; ``sums`` are gradient and curvature of the left, then of both."""
        self.feature[node], self.bin[node], self.threshold[node], self.gain[node] = feature, at, threshold, gain
        for side, (g, h) in (("left", sums[:2]), ("right", (sums[2] - sums[0], sums[3] - sums[1]))):
            getattr(self, side)[node] = len(self.feature)
            for name, v in (("feature", -1), ("bin", -1), ("threshold", 0.0), ("left", -1), ("right", -1), ("gain", 0.0),
                            ("gradient", g), ("curvature", h), ("value", 0.0)):
                getattr(self, name).append(v)
        return self.left[node], self.right[node]

    def place(self, x: np.ndarray, by: str = "bin") -> np.ndarray:
        """Leaf of every row; ``x`` holds bins, or features with ``by`` as threshold."""
        cut, feature = np.array(getattr(self, by)), np.array(self.feature)
        left, right = np.array(self.left), np.array(self.right)
        at, todo = np.zeros(len(x), np.int64), np.arange(len(x))
        while len(todo):
            todo = todo[feature[at[todo]] >= 0]
            node = at[todo]
            at[todo] = np.where(x[todo, feature[node]] <= cut[node], left[node], right[node])
        return at


def add_trees(margins: np.ndarray, x: np.ndarray, trees: Sequence[BoostTree], by: str = "bin") -> np.ndarray:
    for tree in trees:
        margins[:, tree.output] += np.array(tree.value)[tree.place(x, by)]
    return margins


def derivatives(margins: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gradient and curvature of the loss per row and output."""
    if margins.shape[1] == 1:
        p = 1.0 / (1.0 + np.exp(-margins))
        return p - y[:, None], np.maximum(p * (1 - p), LEAST_CURVE)
    shifted = np.exp(margins - margins.max(axis=1, keepdims=True))
    p = shifted / shifted.sum(axis=1, keepdims=True)
    return p - (y[:, None] == np.arange(margins.shape[1])), np.maximum(2 * p * (1 - p), LEAST_CURVE)


def _drawn(keys: np.ndarray, turn: int, share: float) -> np.ndarray:
    """Rows of a round's sample, by a scrambled row key."""
    x = keys.astype(np.uint64) + np.uint64((turn + 1) * 0x9E3779B97F4A7C15 % (1 << 64))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return ((x ^ (x >> np.uint64(31))) >> np.uint64(11)).astype(np.float64) / float(1 << 53) < share


def _packed(codes: np.ndarray) -> pa.Array:
    """One binary value per row of bytes."""
    ends = np.arange(0, codes.size + 1, codes.shape[1], dtype=np.int32)
    return pa.Array.from_buffers(pa.binary(), len(codes), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(codes))])


def _listed(values: np.ndarray) -> pa.Array:
    """One list per row of numbers."""
    ends = np.arange(0, values.size + 1, values.shape[1], dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(values.ravel().astype(np.float64)))


def _state(batch, d: int, start: Sequence[float]) -> tuple[np.ndarray, np.ndarray]:
    """Bins and margins of a batch."""
    packed = batch.column("codes").cast(pa.binary())
    ends = np.frombuffer(packed.buffers()[1], np.int32)[packed.offset:]
    codes = np.frombuffer(packed.buffers()[2], np.uint8)[ends[0]:ends[batch.num_rows]].reshape(batch.num_rows, d)
    held = batch.column("margins").flatten().to_numpy(zero_copy_only=False)
    return codes, held.reshape(batch.num_rows, len(start)).astype(np.float64)


@dataclass
class BoostedClassifier(Fitted):
    trees: list[BoostTree] = field(default_factory=list)
    start: list[float] = field(default_factory=list)

    def margins(self, df: DataFrame) -> DataFrame:
        """``df`` with the raw outputs as ``__margins``."""
        trees, start = self.trees, np.array(self.start)
        score = vector_scores(lambda x: add_trees(np.tile(start, (len(x), 1)), x, trees, "threshold"), len(start))
        return df.withColumn("__margins", score("features"))

    def transform(self, df: DataFrame) -> DataFrame:
        scored = self.margins(df.drop("probability", "prediction"))
        if len(self.start) == 1:
            p = 1.0 / (1.0 + F.exp(-F.col("__margins")[0]))
            scored = scored.withColumn("probability", F.array(1.0 - p, p))
        else:
            top = F.array_max("__margins")
            raised = F.transform("__margins", lambda m: F.exp(m - top))
            total = F.aggregate(raised, F.lit(0.0), lambda a, v: a + v)
            scored = scored.withColumn("probability", F.transform(raised, lambda v: v / total))
        return scored.drop("__margins").withColumn("prediction", label_at(self.classes, argmax_index("probability")))

    def tables(self) -> list[dict[str, np.ndarray]]:
        """Node arrays of every tree for the contributions, one output column per class tree."""
        out = []
        for k, tree in enumerate(self.trees):
            value = np.zeros((len(tree.value), len(self.start)))
            value[:, tree.output] = tree.value
            if k == 0:
                value += np.array(self.start)
            out.append({
                "left": np.array(tree.left), "right": np.array(tree.right), "feature": np.array(tree.feature),
                "threshold": np.array(tree.threshold), "cover": np.maximum(np.array(tree.curvature), LEAST_CURVE), "value": value,
            })
        return out


class BoostedTrees(Model):
    key, name, model_type = "xgboost", "Gradient-Boosted Trees", "classifier"

    def __init__(self, n_estimators: int = 200, max_depth: int = 6, learning_rate: float = 0.1, subsample: float = 1.0,
                 colsample_bytree: float = 1.0, min_child_weight: float = 1.0, reg_alpha: float = 0.0, reg_lambda: float = 1.0,
                 max_bins: int = 256, random_state: int = SEED) -> None:
        if n_estimators < 1 or max_depth < 0 or learning_rate <= 0:
            raise ValueError("n_estimators must be at least 1, max_depth not negative and learning_rate positive.")
        if not (0 < subsample <= 1 and 0 < colsample_bytree <= 1):
            raise ValueError("subsample and colsample_bytree must lie in (0, 1].")
        if min_child_weight < 0 or reg_alpha < 0 or reg_lambda < 0 or not 2 <= max_bins <= 256:
            raise ValueError("Weights and penalties must not be negative; max_bins lies between 2 and 256.")
        self.n_estimators, self.max_depth, self.learning_rate = n_estimators, max_depth, learning_rate
        self.subsample, self.colsample_bytree, self.min_child_weight = subsample, colsample_bytree, min_child_weight
        self.reg_alpha, self.reg_lambda, self.max_bins, self.random_state = reg_alpha, reg_lambda, max_bins, random_state

    def _fit(self, train: DataFrame, d: int) -> BoostedClassifier:
        classes = labels_of(train)
        key = F.xxhash64("row_id") if "row_id" in train.columns else F.xxhash64("features")
        rows = train.select(label_index(classes).alias("y"), key.alias("key"), F.col("features").cast("array<double>").alias("features"))
        counts = {r["y"]: r["count"] for r in rows.groupBy("y").count().collect()}
        n = sum(counts.values())
        edges = global_edges(rows, d, self.max_bins, n)
        start = [float(np.log(counts[1] / counts[0]))] if len(classes) == 2 else [0.0] * len(classes)
        held = self._binned(rows, edges, start)
        draw = np.random.default_rng(self.random_state)
        trees: list[BoostTree] = []
        kept = 0
        try:
            for turn in range(self.n_estimators):
                width = max(1, int(self.colsample_bytree * d))
                chosen = [np.sort(draw.choice(d, width, replace=False)) if width < d else np.arange(d) for _ in start]
                trees += self._grow(held, trees[kept:], edges, start, chosen, turn)
                if (turn + 1) % KEEP == 0 and turn + 1 < self.n_estimators:
                    held = self._moved(held, trees[kept:], d, start)
                    kept = len(trees)
        finally:
            held.unpersist()
        return self._new(BoostedClassifier, d, classes=classes, trees=trees, start=start, importance=self._importance(trees, d))

    @staticmethod
    def _importance(trees: Sequence[BoostTree], d: int) -> dict[str, float]:
        """Mean gain of each feature's splits, as a share of the sum over features."""
        gain, times = np.zeros(d), np.zeros(d)
        for tree in trees:
            for f, g in zip(tree.feature, tree.gain):
                if f >= 0:
                    gain[f] += g
                    times[f] += 1
        mean = gain / np.maximum(times, 1)
        total = mean.sum()
        return {f"feature_{j}": float(v / total) if total > 0 else 0.0 for j, v in enumerate(mean)}

    @staticmethod
    def _binned(rows: DataFrame, edges: Sequence[np.ndarray], start: Sequence[float]) -> DataFrame:
        def cut(batches):
            for batch in batches:
                if not batch.num_rows:
                    continue
                x = batch_matrix(batch)
                codes = np.column_stack([np.searchsorted(e, x[:, f], side="left") for f, e in enumerate(edges)]).astype(np.uint8)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("y"), batch.column("key"), _packed(codes), _listed(np.tile(start, (len(x), 1)))],
                    ["y", "key", "codes", "margins"],
                )

        return rows.mapInArrow(cut, _ROWS).persist(StorageLevel.MEMORY_AND_DISK)

    @staticmethod
    def _moved(held: DataFrame, trees: Sequence[BoostTree], d: int, start: Sequence[float]) -> DataFrame:
        """The rows with the margins after ``trees``."""

        def move(batches):
            for batch in batches:
                if not batch.num_rows:
                    continue
                codes, margins = _state(batch, d, start)
                new = add_trees(margins, codes, trees)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("y"), batch.column("key"), batch.column("codes"), pa.array(list(new), pa.list_(pa.float64()))],
                    ["y", "key", "codes", "margins"],
                )

        after = held.mapInArrow(move, _ROWS).persist(StorageLevel.MEMORY_AND_DISK)
        after.count()
        held.unpersist()
        return after

    def _sums(self, held: DataFrame, past, trees, open_nodes, d: int, start, chosen, turn: int) -> DataFrame:
        """``tree, node, feature, bin, g, h`` summed over the rows of the open nodes."""
        share = self.subsample

        def listed(sums):
            for (k, node), table in sums.items():
                j, code = np.nonzero(table[:, :, 2])
                size = len(j)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(size, k), pa.int32()), pa.array(np.full(size, node), pa.int32()),
                     pa.array(np.asarray(chosen[k])[j], pa.int32()), pa.array(code, pa.int32()),
                     pa.array(table[j, code, 0]), pa.array(table[j, code, 1])],
                    ["tree", "node", "feature", "bin", "g", "h"],
                )

        def add(batches):
            sums: dict[tuple[int, int], np.ndarray] = {}
            for batch in batches:
                if not batch.num_rows:
                    continue
                codes, margins = _state(batch, d, start)
                g, h = derivatives(add_trees(margins, codes, past), batch.column("y").to_numpy())
                if share < 1:
                    some = _drawn(batch.column("key").to_numpy(), turn, share)
                    codes, g, h = codes[some], g[some], h[some]
                for k, tree in enumerate(trees):
                    at = tree.place(codes)
                    for node in open_nodes[k]:
                        own = np.flatnonzero(at == node)
                        if not len(own):
                            continue
                        table = sums.setdefault((k, node), np.zeros((len(chosen[k]), 256, 3)))
                        for j, f in enumerate(chosen[k]):
                            code = codes[own, f]
                            table[j, :, 0] += np.bincount(code, g[own, k], 256)
                            table[j, :, 1] += np.bincount(code, h[own, k], 256)
                            table[j, :, 2] += np.bincount(code, minlength=256)
                        if len(sums) * table.nbytes > TABLE_BYTES:
                            yield from listed(sums)
                            sums.clear()
            yield from listed(sums)

        parts = held.mapInArrow(add, "tree int, node int, feature int, bin int, g double, h double")
        return fan_out(parts, "tree", "node").groupBy("tree", "node", "feature", "bin").agg(
            F.sum("g").alias("g"), F.sum("h").alias("h")
        )

    def best_cuts(self, sums: DataFrame) -> DataFrame:
        """``tree, node, gain, feature, bin, gl, hl, g, h``: the best cut of every node; ties to the first.

        A node without a cut that is allowed has a null gain.
        """
        return sums.selectExpr(*self._running).selectExpr("tree", "node", "feature", "gt", "ht", self._cut).groupBy("tree", "node").agg(
            F.expr("max(cut) AS cut"), F.expr("max_by(gt, -feature) AS g"), F.expr("max_by(ht, -feature) AS h")
        ).selectExpr("tree", "node", "cut.gain", "-cut.feature AS feature", "-cut.bin AS bin", "cut.gl", "cut.hl", "g", "h")

    #: Sums up to each bin and over the whole group, as SQL text: a fit plans this once per level.
    _running = ["tree", "node", "feature", "bin", *[
        f"{f} OVER (PARTITION BY tree, node, feature{order}) AS {name}" for f, order, name in (
            ("sum(g)", " ORDER BY bin ROWS UNBOUNDED PRECEDING", "gl"), ("sum(h)", " ORDER BY bin ROWS UNBOUNDED PRECEDING", "hl"),
            ("sum(g)", "", "gt"), ("sum(h)", "", "ht"), ("max(bin)", "", "last"),
        )
    ]]

    @property
    def _cut(self) -> str:
        """The gain of an allowed cut with what it is, so that the greatest is the best and the first of equals."""
        alpha, penalty, least = (number(v) for v in (self.reg_alpha, self.reg_lambda, self.min_child_weight))

        def score(g: str, h: str) -> str:
            shrunk = f"greatest(abs({g}) - {alpha}, 0D)" if self.reg_alpha else f"({g})"
            return f"pow({shrunk}, 2) / ({h} + {penalty})"

        gain = f"0.5D * ({score('gl', 'hl')} + {score('gt - gl', '(ht - hl)')} - {score('gt', 'ht')})"
        allowed = f"bin < last AND hl >= {least} AND ht - hl >= {least}"
        return f"CASE WHEN {allowed} THEN named_struct('gain', {gain}, 'feature', -feature, 'bin', -bin, 'gl', gl, 'hl', hl) END AS cut"

    def _grow(self, held: DataFrame, past, edges, start, chosen, turn: int) -> list[BoostTree]:
        """The trees of one round, all classes level by level together."""
        trees = [BoostTree(k) for k in range(len(start))]
        open_nodes = {k: [0] for k in range(len(start))}
        depth = 0
        while any(open_nodes.values()) and (self.max_depth == 0 or depth < self.max_depth):
            found = self.best_cuts(self._sums(held, past, trees, open_nodes, len(edges), start, chosen, turn)).collect()
            open_nodes = {k: [] for k in range(len(start))}
            for r in sorted(found, key=lambda r: (r["tree"], r["node"])):
                tree = trees[r["tree"]]
                if r["node"] == 0:
                    tree.gradient[0], tree.curvature[0] = r["g"], r["h"]
                if r["gain"] is not None and r["gain"] > LEAST_GAIN:
                    threshold = float(edges[r["feature"]][r["bin"]])
                    open_nodes[r["tree"]] += tree.split(
                        r["node"], r["feature"], r["bin"], threshold, r["gain"], (r["gl"], r["hl"], r["g"], r["h"])
                    )
            depth += 1
        for tree in trees:
            g = np.array(tree.gradient)
            g = np.sign(g) * np.maximum(np.abs(g) - self.reg_alpha, 0)
            tree.value = (-self.learning_rate * g / np.maximum(np.array(tree.curvature) + self.reg_lambda, LEAST_CURVE)).tolist()
        return trees


_ROWS = "y int, key long, codes binary, margins array<double>"
