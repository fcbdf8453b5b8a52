"""Sparse oblique tree: hyperplane splits with an axis-parallel fallback.

The one-vs-rest L1 logistic fits of all open nodes of a level run together: one
job returns gradient and curvature for every (node, class) problem, the driver
takes a coordinate-descent step on these d x d systems.  A handful of such jobs
replaces a separate iterative fit per node.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import fan_out
from .base import batch_matrix, labels_of, newton, spread, summed_systems
from .cuts import Cut, exact_cuts
from .trees import TIE, TreeClassifier, _Tree, axis_cuts, best_coarse, global_edges, route, score_features, threshold_rule

STEPS = 1024             # coarse bins along a projection


class Oblique(_Tree):
    key, name, closed_left = "oblique_tree", "Sparse Oblique Decision Tree", True

    def __init__(self, max_depth: int = 5, min_samples_split: int = 20, min_samples_leaf: int = 5,
                 criterion: str = "gini", oblique_C: float = 1.0, newton_steps: int = 10,
                 min_impurity_decrease: float = 0.0, max_candidates: int = 256) -> None:
        if criterion not in ("gini", "entropy"):
            raise ValueError("criterion must be 'gini' or 'entropy'.")
        if max_depth < 1 or min_samples_split < 2 or min_samples_leaf < 1 or oblique_C <= 0:
            raise ValueError("max_depth, min_samples_split, min_samples_leaf or oblique_C is out of range.")
        self.max_depth, self.min_samples_split = max_depth, min_samples_split
        self.min_samples_leaf, self.criterion, self.oblique_C = min_samples_leaf, criterion, oblique_C
        self.newton_steps, self.min_impurity_decrease = newton_steps, min_impurity_decrease
        self.max_candidates = max_candidates

    def _fit(self, train: DataFrame, d: int) -> TreeClassifier:
        classes = labels_of(train)
        k = len(classes)
        rows = spread(self._rows(train, classes))
        rule = threshold_rule(self.criterion, self.min_samples_leaf)
        try:
            nodes = [self._root(rows, k)]
            edges = global_edges(rows, d, self.max_candidates, nodes[0].n)
            level = [0]
            while level:
                open_ids = [
                    i for i in level if self._may_split(nodes[i], d) and nodes[i].n >= 2 * self.min_samples_leaf
                ]
                level = []
                if not open_ids:
                    break
                axis = axis_cuts(self, rows, nodes, open_ids, edges, k)
                problems = []
                for i in open_ids:
                    present = np.flatnonzero(nodes[i].counts)
                    problems += [(i, int(c)) for c in (present[:-1] if len(present) == 2 else present)]
                planes = self._planes(rows, nodes, problems, d)
                tilted = self._best_planes(rows, nodes, planes, k, rule)
                for i in open_ids:
                    a, o = axis.get(i), tilted.get(i)
                    take_plane = o is not None and (a is None or o.cost < a.cost - TIE)
                    found = o if take_plane else a
                    if found is None or nodes[i].impurity - found.cost <= self.min_impurity_decrease:
                        continue
                    start = len(nodes)
                    split = {"gain": nodes[i].impurity - found.cost}
                    if take_plane:
                        plane = planes[i, found.column]
                        split |= {"weights": plane[:-1], "intercept": float(plane[-1])}
                    else:
                        split["feature"] = found.column
                    self._attach(nodes, nodes[i], [found.edge], [0, 1], [found.left, nodes[i].counts - found.left], **split)
                    level += range(start, len(nodes))
        finally:
            rows.unpersist()
        return self._finish(nodes, d, classes)

    # --- L1 logistic planes of one level -------------------------------------

    def _planes(self, rows, nodes, problems: Sequence[tuple[int, int]], d: int):
        """Proximal Newton on every (node, class) problem at once."""
        c = self.oblique_C

        def systems(trial):
            return _curvature(rows, nodes, trial, d, self.closed_left, c)

        found = newton(systems, problems, d + 1, lambda w: np.abs(w[:-1]).sum(), _l1_step,
                       self.newton_steps, 1e-4)
        return {p: v for p, v in found.items() if np.abs(v[:-1]).max() > 0}

    def _best_planes(self, rows, nodes, planes, k: int, rule) -> dict[int, Cut]:
        """Cheapest cut along the planes' projections, every value tried; one winner per node."""
        if not planes:
            return {}
        ranges = _projection_ranges(rows, nodes, planes, self.closed_left)
        edges = {p: np.linspace(lo, hi, STEPS + 1)[1:-1] if hi > lo else np.empty(0) for p, (lo, hi) in ranges.items()}
        counts = _projection_counts(rows, nodes, planes, edges, k, self.closed_left).persist()
        try:
            coarse = best_coarse(score_features(counts, k, rule).collect(), nodes, lambda n, c: edges[n, c])
            return exact_cuts(
                rows, counts, lambda n, c: edges[n, c], coarse, {n: nodes[n].counts for n, _ in planes}, k,
                lambda x: route(x, nodes, True), lambda x, n, c: x @ planes[n, c][:-1] + planes[n, c][-1],
                self.criterion, self.min_samples_leaf,
            )
        finally:
            counts.unpersist()


def _l1_step(w: np.ndarray, g: np.ndarray, h: np.ndarray, sweeps: int = 200) -> np.ndarray:
    """Minimise each quadratic model plus |w| by coordinate descent; returns the moves.

    All problems (first axis) are swept together; the last coordinate is the
    unpenalised intercept.
    """
    d = w.shape[1] - 1
    move = np.zeros_like(w)
    slope = g.copy()
    curve = np.einsum("pjj->pj", h) + 1e-10
    for _ in range(sweeps):
        largest = 0.0
        for j in range(d + 1):
            now = w[:, j] + move[:, j]
            target = now - slope[:, j] / curve[:, j]
            if j < d:
                target = np.sign(target) * np.maximum(np.abs(target) - 1.0 / curve[:, j], 0.0)
            change = target - now
            size = float(np.abs(change).max())
            if size:
                move[:, j] += change
                slope += h[:, :, j] * change[:, None]
                largest = max(largest, size)
        if largest < 1e-7:
            break
    return move


def _by_node(keys) -> dict[int, list[tuple[int, int]]]:
    out: dict[int, list[tuple[int, int]]] = {}
    for p in sorted(keys):
        out.setdefault(p[0], []).append(p)
    return out


def _curvature(rows, nodes, trial, d, closed_left, scale):
    """Loss, gradient and Hessian of each logistic problem of the level."""
    keys = sorted(trial)
    index = {p: k for k, p in enumerate(keys)}
    groups = _by_node(keys)

    def partial(batch):
        x = batch_matrix(batch)
        y = batch.column(batch.schema.get_field_index("y")).to_numpy(zero_copy_only=False)
        at = route(x, nodes, closed_left)
        one = np.hstack([x, np.ones((len(x), 1))])
        for node, problems in groups.items():
            mask = at == node
            if not mask.any():
                continue
            xs, ys = one[mask], y[mask]
            for p in problems:
                sign = np.where(ys == p[1], 1.0, -1.0)
                m = sign * (xs @ trial[p])
                prob = 1.0 / (1.0 + np.exp(-np.clip(m, -500, 500)))
                yield (
                    index[p], scale * np.logaddexp(0.0, -m).sum(), -scale * (xs.T @ (sign * (1 - prob))),
                    scale * (xs * (prob * (1 - prob))[:, None]).T @ xs,
                )

    return summed_systems(rows, partial, keys, d + 1)


def _projection_ranges(rows, nodes, planes, closed_left):
    groups = _by_node(planes)

    def partial(batches):
        low: dict[tuple[int, int], float] = {}
        high: dict[tuple[int, int], float] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            x = batch_matrix(batch)
            at = route(x, nodes, closed_left)
            for node, problems in groups.items():
                mask = at == node
                if not mask.any():
                    continue
                for p in problems:
                    v = x[mask] @ planes[p][:-1] + planes[p][-1]
                    low[p] = min(low.get(p, np.inf), float(v.min()))
                    high[p] = max(high.get(p, -np.inf), float(v.max()))
        if low:
            keys = list(low)
            yield pa.RecordBatch.from_pydict(
                {"node": pa.array([k[0] for k in keys], pa.int32()), "cls": pa.array([k[1] for k in keys], pa.int32()),
                 "lo": pa.array([low[k] for k in keys]), "hi": pa.array([high[k] for k in keys])}
            )

    found = rows.mapInArrow(partial, "node int, cls int, lo double, hi double").groupBy("node", "cls").agg(
        F.min("lo").alias("lo"), F.max("hi").alias("hi")
    ).collect()
    return {(r["node"], r["cls"]): (r["lo"], r["hi"]) for r in found}


def _projection_counts(rows, nodes, planes, edges, n_classes, closed_left):
    """Like ``level_counts``, with the projections of a node in place of features."""
    groups = _by_node(planes)

    def partial(batches):
        sums: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            x = batch_matrix(batch)
            y = batch.column(batch.schema.get_field_index("y")).to_numpy(zero_copy_only=False)
            at = route(x, nodes, closed_left)
            for node, problems in groups.items():
                mask = at == node
                if not mask.any():
                    continue
                for p in problems:
                    v = x[mask] @ planes[p][:-1] + planes[p][-1]
                    code = np.searchsorted(edges[p], v, side="left") * n_classes + y[mask]
                    part = np.bincount(code, minlength=(len(edges[p]) + 1) * n_classes).reshape(-1, n_classes)
                    sums[p] = sums.get(p, 0) + part
        for (node, c), table in sums.items():
            seen = np.flatnonzero(table.sum(axis=1))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(seen), node), pa.int32()), pa.array(np.full(len(seen), c), pa.int32()),
                 pa.array(seen, pa.int32())] + [pa.array(table[seen, j], pa.int64()) for j in range(n_classes)],
                names=["node", "feature", "bin"] + [f"c{j}" for j in range(n_classes)],
            )

    schema = "node int, feature int, bin int, " + ", ".join(f"c{c} bigint" for c in range(n_classes))
    return (
        fan_out(rows.mapInArrow(partial, schema), "node", "feature").groupBy("node", "feature", "bin")
        .agg(*[F.sum(f"c{c}").alias(f"c{c}") for c in range(n_classes)])
    )
