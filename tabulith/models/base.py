"""What every model offers, and helpers shared by the fits.

A model class holds hyperparameters; ``fit(prepared_rows, ctx)`` returns a fitted
object whose ``transform`` adds ``prediction`` (and ``probability`` for
classifiers) to any table with ``features``.
"""

from __future__ import annotations

import time
from collections.abc import Sequence
from dataclasses import dataclass, field
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import argmax_index, number, softmax, sum_text
from ..session import collect_bounded

MAX_LABELS = 1000
INLINE_TERMS = 512       # longer score expressions run as a vectorised function


@dataclass
class Fitted:
    """A fitted model: parameters on the driver, scoring as a projection."""

    name: str
    model_type: str
    hyperparameters: dict[str, Any]
    n_features: int
    classes: list[Any] | None = None
    importance: dict[str, float] | None = None
    details: dict[str, Any] = field(default_factory=dict)
    fit_seconds: float = 0.0

    def transform(self, df: DataFrame) -> DataFrame:
        raise NotImplementedError

    def checked(self, df: DataFrame) -> DataFrame:
        """``df`` that fails on the first row whose features the model cannot score."""
        x = F.col("features")
        finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
        sound = (F.size(x) == self.n_features) & finite
        text = F.concat(F.lit(f"{self.name} scores {self.n_features} finite features; given: "), F.coalesce(x.cast("string"), F.lit("null")))
        return df.withColumn("features", F.when(F.coalesce(sound, F.lit(False)), x).otherwise(F.raise_error(text).cast(df.schema["features"].dataType)))

    def metadata(self) -> dict[str, Any]:
        return {
            "model_name": self.name, "model_type": self.model_type,
            "hyperparameters": self.hyperparameters, "training_time_seconds": self.fit_seconds,
            "n_features": self.n_features, "feature_importance": self.importance,
        }


class Model:
    """Base of the model classes."""

    key = ""
    name = ""
    model_type = ""
    supervised = True

    def hyperparameters(self) -> dict[str, Any]:
        return {k: v for k, v in vars(self).items() if not k.startswith("_")}

    def fit(self, train: DataFrame) -> Fitted:
        started = time.perf_counter()
        if self.supervised and "label" not in train.columns:
            raise ValueError(f"{self.name} needs a label column.")
        d = require_sound(train, "label" if self.supervised else None)
        fitted = self._fit(train, d)
        fitted.fit_seconds = time.perf_counter() - started
        return fitted

    def _fit(self, train: DataFrame, d: int) -> Fitted:
        raise NotImplementedError

    def _new(self, cls, d: int, **kw):
        return cls(self.name, self.model_type, self.hyperparameters(), d, **kw)


def width(df: DataFrame, features: str = "features") -> int:
    row = df.select(F.size(features).alias("d")).first()
    if row is None:
        raise ValueError("The table has no rows.")
    return row["d"]


def require_sound(df: DataFrame, label: str | None, features: str = "features") -> int:
    """The number of features; an error names what a fit cannot use, in one pass over the rows."""
    from ..operators.evaluate import check_features

    d = width(df, features)
    found = check_features(df, features, d, label).first().asDict()
    rows = found.pop("n_rows")
    bad = {k.replace("_", " "): v for k, v in found.items() if v}
    if d < 1:
        raise ValueError("The rows have no feature.")
    if bad:
        listed = ", ".join(f"{k}: {v}" for k, v in bad.items())
        raise ValueError(f"Of {rows} rows some cannot be used ({listed}).")
    return d


def labels_of(df: DataFrame, label: str = "label", minimum: int = 2) -> list[Any]:
    """Sorted class labels; at least two, at most a thousand."""
    rows = collect_bounded(df.select(label).distinct(), MAX_LABELS, "The label list")
    values = [r[0] for r in rows]
    if None in values:
        raise ValueError("The label column has missing values.")
    if len(values) < minimum:
        raise ValueError(f"At least {minimum} classes are required.")
    return sorted(values)


def label_index(classes: Sequence[Any], label: str = "label") -> Column:
    """0-based index of a label in sorted order, as an integer."""
    return (F.array_position(F.array(*[F.lit(c) for c in classes]), F.col(label)) - 1).cast("int")


def label_at(classes: Sequence[Any], index: Column) -> Column:
    return F.element_at(F.array(*[F.lit(c) for c in classes]), index.cast("int") + 1)


def with_scores(df: DataFrame, scores: Column, classes: Sequence[Any]) -> DataFrame:
    """Prediction and softmax probability from one log score per class."""
    scored = df.withColumn("__scores", scores)
    return (
        scored.withColumn("prediction", label_at(classes, argmax_index("__scores")))
        .withColumn("probability", softmax("__scores"))
        .drop("__scores")
    )


def linear_text(weights: Sequence[float], intercept: float, features: str = "features") -> str:
    """SQL text of ``features . weights + intercept`` without the zero terms."""
    terms = [f"{features}[{j}] * {number(w)}" for j, w in enumerate(weights) if w != 0.0]
    return sum_text([number(intercept), *terms])


def array_text(items: Sequence[str]) -> Column:
    return F.expr("array(" + ", ".join(items) + ")")


def batch_matrix(batch, name: str = "features") -> np.ndarray:
    """A list column of an Arrow batch as a matrix, without copying rows."""
    column = batch.column(batch.schema.get_field_index(name))
    if len(column) == 0:
        return np.empty((0, 0))
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def vector_scores(function, n_out: int):
    """A vectorised ``features -> array`` column for long score expressions."""
    from ..operators.distance import matrix

    @F.pandas_udf("array<double>")
    def apply(values: pd.Series) -> pd.Series:
        if not len(values):
            return pd.Series([], dtype=object)
        return pd.Series(list(np.asarray(function(matrix(values)), dtype=np.float64)))

    return apply


def spread(df: DataFrame) -> DataFrame:
    """Persist rows that many passes will read, over at least one task per core.

    A small input arrives in one or two pieces; it is dealt out once.  An input
    with more pieces than cores is left where it is.
    """
    held = df.persist()
    held.count()
    cores = df.sparkSession.sparkContext.defaultParallelism
    if held.rdd.getNumPartitions() >= cores:
        return held
    dealt = held.repartition(cores).persist()
    dealt.count()
    held.unpersist()
    return dealt


def summed_systems(df: DataFrame, partial, keys: Sequence[Any], size: int) -> dict[Any, tuple]:
    """Loss, gradient and Hessian per key, added up over all tasks.

    ``partial(batch)`` yields ``(key index, loss, gradient, hessian)`` for one
    Arrow batch.  Each task returns one small matrix per key; Spark sums them row
    by row, so the merge is spread over keys and rows.
    """

    def tasks(batches):
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            for k, loss, g, h in partial(batch):
                block = np.zeros((size + 1, size + 1))
                block[0, 0], block[0, 1:], block[1:, 1:] = loss, g, h
                sums[k] = sums.get(k, 0.0) + block
        for k, block in sums.items():
            yield pa.RecordBatch.from_pydict(
                {"k": pa.array([k] * (size + 1), pa.int32()), "i": pa.array(range(size + 1), pa.int32()),
                 "v": pa.array(list(block), pa.list_(pa.float64()))}
            )

    rows = (
        df.mapInArrow(tasks, "k int, i int, v array<double>").groupBy("k", "i")
        .agg(*[F.sum(F.col("v")[j]).alias(f"v{j}") for j in range(size + 1)]).collect()
    )
    blocks = {k: np.zeros((size + 1, size + 1)) for k in range(len(keys))}
    for r in rows:
        blocks[r["k"]][r["i"]] = r[2:]
    return {keys[k]: (b[0, 0], b[0, 1:], b[1:, 1:]) for k, b in blocks.items()}


def newton(systems, keys: Sequence[Any], size: int, penalty, move, steps: int, tolerance: float = 1e-6):
    """Damped Newton steps on many small problems that share every pass.

    ``systems(trial)`` evaluates the open problems in one job; ``penalty(w)`` is
    the part of the objective outside the data; ``move`` proposes the steps of all
    problems at once, and a step is halved until its objective falls.
    """
    w = {k: np.zeros(size) for k in keys}
    step = {k: np.zeros(size) for k in keys}
    best = {k: (np.inf, w[k]) for k in keys}
    active = list(keys)
    for _ in range(steps):
        if not active:
            break
        trial = {k: w[k] + step[k] for k in active}
        stats = systems(trial)
        still, accepted = [], []
        for k in active:
            value = stats[k][0] + penalty(trial[k])
            if value > best[k][0] * (1 + 1e-12):
                step[k] = step[k] / 2
                if np.abs(step[k]).max() >= 1e-7:
                    still.append(k)
                continue
            if best[k][0] - value > tolerance * max(1.0, abs(value)):
                still.append(k)
                accepted.append(k)
            best[k] = (value, trial[k])
            w[k] = trial[k]
        if accepted:
            moves = move(
                np.array([w[k] for k in accepted]), np.array([stats[k][1] for k in accepted]),
                np.array([stats[k][2] for k in accepted]),
            )
            step.update(zip(accepted, moves))
        active = still
    return {k: v for k, (_, v) in best.items()}
