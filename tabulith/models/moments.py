"""Sufficient statistics of feature arrays: class moments and covariances.

Narrow tables use JVM aggregates.  Wide ones let every task add up a product
matrix of its own rows and merge the matrices by row index, so what is shuffled
is the size of the model, not of the data.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .base import MAX_LABELS, batch_matrix, labels_of, width
from ..session import collect_bounded

JVM_WIDTH = 16


@dataclass
class ClassStats:
    label: Any
    n: int
    mean: np.ndarray
    cov: np.ndarray | None      # sample covariance, None with fewer than two rows


def class_moments(df: DataFrame, label: str = "label", features: str = "features") -> DataFrame:
    """``(label, feature, n, mean, var)`` with population variance."""
    d = width(df, features)
    wide = df.groupBy(label).agg(
        F.count(F.lit(1)).alias("n"),
        *[F.avg(F.col(features)[j]).alias(f"m{j}") for j in range(d)],
        *[F.var_pop(F.col(features)[j]).alias(f"v{j}") for j in range(d)],
    )
    items = F.array(
        *[
            F.struct(F.lit(j).alias("feature"), F.col(f"m{j}").alias("mean"), F.col(f"v{j}").alias("var"))
            for j in range(d)
        ]
    )
    return wide.select(label, "n", F.explode(items).alias("i")).select(label, "n", "i.*")


def class_covariances(
    df: DataFrame, label: str | None = "label", features: str = "features"
) -> list[ClassStats]:
    """Count, mean and sample covariance per class (or of all rows)."""
    d = width(df, features)
    if label is None:
        df, label = df.withColumn("__one", F.lit(0)), "__one"
    return _jvm(df, label, features, d) if d <= JVM_WIDTH else _partial(df, label, features, d)


def _jvm(df, label, features, d):
    x = [F.col(features)[j] for j in range(d)]
    rows = collect_bounded(
        df.groupBy(label).agg(
            F.count(F.lit(1)).alias("n"),
            *[F.avg(x[j]).alias(f"m{j}") for j in range(d)],
            *[F.covar_samp(x[i], x[j]).alias(f"c{i}_{j}") for i in range(d) for j in range(i, d)],
        ),
        MAX_LABELS, "The label list",
    )
    stats = []
    for r in sorted(rows, key=lambda r: r[label]):
        cov = None
        if r["n"] > 1:
            cov = np.empty((d, d))
            for i in range(d):
                for j in range(i, d):
                    cov[i, j] = cov[j, i] = r[f"c{i}_{j}"]
        stats.append(ClassStats(r[label], r["n"], np.array([r[f"m{j}"] for j in range(d)]), cov))
    return stats


def _partial(df, label, features, d):
    labels = labels_of(df, label, minimum=1)
    index = (F.array_position(F.array(*[F.lit(v) for v in labels]), F.col(label)) - 1).cast("int")
    # a common shift keeps the sums of squares well conditioned
    center = df.agg(*[F.avg(F.col(features)[j]) for j in range(d)]).first()
    shift = np.array([0.0 if v is None else v for v in center])
    slim = df.select(index.alias("c"), F.col(features).alias("features"))

    def products(batches):
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            x = batch_matrix(batch) - shift
            c = batch.column(0).to_numpy(zero_copy_only=False)
            one = np.hstack([np.ones((len(x), 1)), x])
            for k in np.unique(c):
                part = one[c == k]
                sums[int(k)] = sums.get(int(k), 0.0) + part.T @ part
        for k, g in sums.items():
            yield pa.RecordBatch.from_pydict(
                {"c": pa.array([k] * (d + 1), pa.int32()), "i": pa.array(range(d + 1), pa.int32()),
                 "g": pa.array(list(g), pa.list_(pa.float64()))}
            )

    merged = (
        slim.mapInArrow(products, "c int, i int, g array<double>")
        .groupBy("c", "i").agg(*[F.sum(F.col("g")[j]).alias(f"g{j}") for j in range(d + 1)])
        .collect()                                   # classes * (d + 1) rows
    )
    grams = {k: np.empty((d + 1, d + 1)) for k in range(len(labels))}
    for r in merged:
        grams[r["c"]][r["i"]] = [r[f"g{j}"] for j in range(d + 1)]
    stats = []
    for k, value in enumerate(labels):
        g = grams[k]
        n = int(round(g[0, 0]))
        m = g[0, 1:] / n
        cov = (g[1:, 1:] - n * np.outer(m, m)) / (n - 1) if n > 1 else None
        stats.append(ClassStats(value, n, m + shift, cov))
    return stats


def pooled_covariance(stats: list[ClassStats]) -> np.ndarray:
    """Within-class covariance with divisor rows - classes."""
    n = sum(s.n for s in stats)
    if any(s.cov is None for s in stats) or n <= len(stats):
        raise ValueError("Every class needs at least two rows.")
    return sum((s.n - 1) * s.cov for s in stats) / (n - len(stats))


def covariance_table(spark: SparkSession, stats: list[ClassStats]) -> DataFrame:
    """``(label, i, j, cov)`` for i <= j; at most classes * d * (d + 1) / 2 rows."""
    rows = [
        (str(s.label), i, j, float(s.cov[i, j]))
        for s in stats if s.cov is not None
        for i in range(len(s.mean)) for j in range(i, len(s.mean))
    ]
    return spark.createDataFrame(rows, "label string, i int, j int, cov double")


def max_correlation(stats: ClassStats) -> float | None:
    """Largest absolute correlation of two features; None with a constant one."""
    d = len(stats.mean)
    variances = np.diag(stats.cov) * (stats.n - 1) / stats.n
    if d < 2 or (variances <= np.finfo(float).eps).any():
        return None
    scale = np.sqrt(np.diag(stats.cov))
    r = np.abs(stats.cov / np.outer(scale, scale))
    return float(r[np.triu_indices(d, 1)].max())
