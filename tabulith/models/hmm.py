"""One Gaussian hidden Markov model per class, fitted by distributed Baum-Welch.

Every iteration is one job: tasks add up expected counts of their own sequences
and return one small record per class; the driver only divides.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.quantiles import quantiles
from .base import Fitted, Model, batch_matrix, label_index, labels_of, spread, vector_scores, with_scores

MIN_VARIANCE = 1e-3
TOLERANCE = 1e-2


def _logsumexp(a: np.ndarray, axis: int) -> np.ndarray:
    top = a.max(axis=axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(a - top).sum(axis=axis))


def _emission(x: np.ndarray, p: dict) -> np.ndarray:
    """log N(x | state) for x of shape (rows, steps, width)."""
    diff = x[:, :, None, :] - p["mean"]
    return -0.5 * ((diff**2 / p["var"]) + np.log(2 * np.pi * p["var"])).sum(axis=3)


def _forward(e: np.ndarray, p: dict) -> np.ndarray:
    alpha = np.empty_like(e)
    alpha[:, 0] = np.log(p["start"]) + e[:, 0]
    log_a = np.log(p["trans"])
    for t in range(1, e.shape[1]):
        alpha[:, t] = e[:, t] + _logsumexp(alpha[:, t - 1, :, None] + log_a, axis=1)
    return alpha


def sequence_scores(x: np.ndarray, p: dict) -> np.ndarray:
    return _logsumexp(_forward(_emission(x, p), p)[:, -1], axis=1)


def expected_counts(x: np.ndarray, p: dict) -> dict[str, np.ndarray]:
    """Sufficient statistics of a block of sequences under parameters ``p``."""
    e = _emission(x, p)
    alpha = _forward(e, p)
    log_a = np.log(p["trans"])
    beta = np.zeros_like(e)
    for t in range(e.shape[1] - 2, -1, -1):
        beta[:, t] = _logsumexp(log_a + (e[:, t + 1] + beta[:, t + 1])[:, None, :], axis=2)
    total = _logsumexp(alpha[:, -1], axis=1)
    gamma = np.exp(alpha + beta - total[:, None, None])
    trans = np.zeros_like(p["trans"])
    for t in range(e.shape[1] - 1):
        step = alpha[:, t, :, None] + log_a + (e[:, t + 1] + beta[:, t + 1])[:, None, :]
        trans += np.exp(step - total[:, None, None]).sum(axis=0)
    return {
        "start": gamma[:, 0].sum(axis=0), "trans": trans, "weight": gamma.sum(axis=(0, 1)),
        "first": np.einsum("nts,ntd->sd", gamma, x), "second": np.einsum("nts,ntd->sd", gamma, x**2),
        "loglik": np.array([total.sum()]),
    }


@dataclass
class SequenceClassifier(Fitted):
    parameters: list[dict] = field(default_factory=list)
    steps: int = 5
    size: int = 2

    def transform(self, df: DataFrame) -> DataFrame:
        params, steps, size = self.parameters, self.steps, self.size

        def scores(x):
            seq = x.reshape(len(x), steps, size)
            return np.stack([sequence_scores(seq, p) for p in params], axis=1)

        return with_scores(df, vector_scores(scores, len(params))("features"), self.classes)


class HiddenMarkov(Model):
    key, name, model_type = "hmm", "Hidden Markov Model", "classifier"

    def __init__(self, n_components: int = 3, n_iter: int = 50, lookback: int = 5,
                 covariance_type: str = "diag") -> None:
        if n_components < 1 or n_iter < 1:
            raise ValueError("n_components and n_iter must be positive.")
        if covariance_type != "diag":
            raise ValueError("Only covariance_type='diag' is available.")
        self.n_components, self.n_iter = n_components, n_iter
        self.lookback, self.covariance_type = lookback, covariance_type

    def _fit(self, train: DataFrame, d: int) -> SequenceClassifier:
        if d % self.lookback:
            raise ValueError(f"{d} features are not {self.lookback} equal steps.")
        steps, size, k = self.lookback, d // self.lookback, self.n_components
        classes = labels_of(train)
        slim = spread(train.select(label_index(classes).alias("c"), "features"))
        try:
            counts = {r["c"]: r["count"] for r in slim.groupBy("c").count().collect()}
            for i, c in enumerate(classes):
                if counts[i] < k:
                    raise ValueError(f"Class {c!r} has {counts[i]} sequences, fewer than {k} states.")
            params = self._start(slim, len(classes), steps, size, k)
            done = [False] * len(classes)
            last = [-np.inf] * len(classes)
            for _ in range(self.n_iter):
                stats = self._estep(slim, params, steps, size, done)
                for i, s in stats.items():
                    params[i] = self._mstep(s)
                    if s["loglik"][0] - last[i] < TOLERANCE:
                        done[i] = True
                    last[i] = s["loglik"][0]
                if all(done):
                    break
        finally:
            slim.unpersist()
        return self._new(SequenceClassifier, d, classes=classes, parameters=params, steps=steps, size=size,
                         details={"loglik": last})

    def _start(self, slim, n_classes, steps, size, k):
        """Spread the state means over the quantiles of each step's first feature."""
        points = slim.select(
            "c", F.explode(F.sequence(F.lit(0), F.lit(steps - 1))).alias("t"), "features"
        ).select("c", *[F.element_at("features", F.col("t") * size + (j + 1)).alias(f"x{j}") for j in range(size)])
        params = []
        for i in range(n_classes):
            own = points.where(F.col("c") == i)
            names = [f"x{j}" for j in range(size)]
            levels = quantiles(own, names, [(s + 0.5) / k for s in range(k)])
            row = own.agg(*[F.var_pop(n).alias(n) for n in names]).first()
            var = np.array([max(row[n], MIN_VARIANCE) for n in names])
            params.append(
                {"start": np.full(k, 1.0 / k), "trans": (np.ones((k, k)) + np.eye(k)) / (k + 1),
                 "mean": np.array([[levels[n][s] for n in names] for s in range(k)]),
                 "var": np.tile(var, (k, 1))}
            )
        return params

    def _estep(self, slim, params, steps, size, done):
        open_classes = [i for i, d in enumerate(done) if not d]
        k = self.n_components
        shapes = {"start": (k,), "trans": (k, k), "weight": (k,), "first": (k, size),
                  "second": (k, size), "loglik": (1,)}
        current = [params[i] for i in range(len(params))]

        def partial(batches):
            sums: dict[int, np.ndarray] = {}
            for batch in batches:
                if not batch.num_rows:
                    continue
                x = batch_matrix(batch).reshape(batch.num_rows, steps, size)
                c = batch.column(0).to_numpy(zero_copy_only=False)
                for i in open_classes:
                    if (c == i).any():
                        s = expected_counts(x[c == i], current[i])
                        flat = np.concatenate([s[n].ravel() for n in shapes])
                        sums[i] = sums.get(i, 0.0) + flat
            for i, flat in sums.items():
                yield pa.RecordBatch.from_pydict(
                    {"c": pa.array([i], pa.int32()), "v": pa.array([flat], pa.list_(pa.float64()))}
                )

        width = sum(int(np.prod(s)) for s in shapes.values())
        rows = (
            slim.mapInArrow(partial, "c int, v array<double>").groupBy("c")
            .agg(*[F.sum(F.col("v")[j]).alias(f"v{j}") for j in range(width)]).collect()
        )
        result = {}
        for r in rows:
            flat, at, stats = np.array([r[f"v{j}"] for j in range(width)]), 0, {}
            for n, shape in shapes.items():
                size_n = int(np.prod(shape))
                stats[n] = flat[at:at + size_n].reshape(shape)
                at += size_n
            result[r["c"]] = stats
        return result

    @staticmethod
    def _mstep(s):
        weight = np.maximum(s["weight"], 1e-12)[:, None]
        mean = s["first"] / weight
        var = np.maximum(s["second"] / weight - mean**2, MIN_VARIANCE)
        trans = s["trans"] + 1e-10
        start = s["start"] + 1e-10
        return {"start": start / start.sum(), "trans": trans / trans.sum(axis=1, keepdims=True),
                "mean": mean, "var": var}
