"""Closed-form classifiers: linear and quadratic discriminants, naive Bayes.

Each fit is one aggregate over the training rows and a small solve; scoring is
a projection, so the same code serves batch tables and streams.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field
from typing import Any

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import number, sum_text
from .base import INLINE_TERMS, Fitted, Model, array_text, linear_text, vector_scores, with_scores
from .moments import ClassStats, class_covariances, class_moments, max_correlation, pooled_covariance


def _priors(stats, priors):
    if priors is None:
        n = sum(s.n for s in stats)
        return np.array([s.n / n for s in stats])
    p = np.asarray(priors, dtype=float)
    if len(p) != len(stats) or (p < 0).any():
        raise ValueError("priors must hold one non-negative value per class.")
    return p / p.sum()


def _log(values: np.ndarray) -> np.ndarray:
    with np.errstate(divide="ignore"):
        return np.log(values)


@dataclass
class LinearScores(Fitted):
    """Classes with linear log scores."""

    weights: np.ndarray = field(default_factory=lambda: np.empty((0, 0)))
    intercepts: np.ndarray = field(default_factory=lambda: np.empty(0))

    def transform(self, df: DataFrame) -> DataFrame:
        w, b = self.weights, self.intercepts
        if w.size <= INLINE_TERMS:
            scores = array_text([linear_text(w[c], b[c]) for c in range(len(b))])
        else:
            scores = vector_scores(lambda x: x @ w.T + b, len(b))("features")
        return with_scores(df, scores, self.classes)


@dataclass
class QuadraticScores(Fitted):
    """Classes with log scores ``-|R (x - m)|^2 / 2 + b``."""

    means: np.ndarray = field(default_factory=lambda: np.empty((0, 0)))
    roots: list[np.ndarray] = field(default_factory=list)
    intercepts: np.ndarray = field(default_factory=lambda: np.empty(0))

    def transform(self, df: DataFrame) -> DataFrame:
        m, r, b = self.means, self.roots, self.intercepts
        if sum(np.count_nonzero(x) for x in r) <= INLINE_TERMS:
            texts = []
            for c in range(len(b)):
                parts = []
                for row in r[c]:
                    inner = linear_text(row, -float(row @ m[c]))
                    parts.append(f"pow({inner}, 2)")
                texts.append(f"{number(b[c])} - 0.5D * {sum_text(parts)}")
            scores = array_text(texts)
        else:
            def function(x):
                return np.stack(
                    [b[c] - 0.5 * (((x - m[c]) @ r[c].T) ** 2).sum(axis=1) for c in range(len(b))], axis=1
                )
            scores = vector_scores(function, len(b))("features")
        return with_scores(df, scores, self.classes)


class LDA(Model):
    key, name, model_type = "lda", "Linear Discriminant Analysis", "classifier"

    def __init__(self, shrinkage: float | None = None, priors: list[float] | None = None) -> None:
        if isinstance(shrinkage, str) or (shrinkage is not None and not 0.0 <= shrinkage <= 1.0):
            raise ValueError("shrinkage must be a number between 0 and 1 or None.")
        self.shrinkage, self.priors = shrinkage, priors

    def _fit(self, train: DataFrame, d: int) -> LinearScores:
        stats = class_covariances(train)
        if len(stats) < 2:
            raise ValueError("At least 2 classes are required.")
        pooled = pooled_covariance(stats)
        if self.shrinkage:
            pooled = (1 - self.shrinkage) * pooled + self.shrinkage * np.trace(pooled) / d * np.eye(d)
        inverse = np.linalg.pinv(pooled, hermitian=True)
        means = np.array([s.mean for s in stats])
        weights = means @ inverse
        intercepts = -0.5 * np.einsum("cd,cd->c", weights, means) + _log(_priors(stats, self.priors))
        shown = weights[1:] - weights[:1] if len(stats) == 2 else weights - weights.mean(axis=0)
        return self._new(
            LinearScores, d, classes=[s.label for s in stats], weights=weights, intercepts=intercepts,
            importance={f"feature_{j}": float(v) for j, v in enumerate(np.abs(shown).mean(axis=0))},
        )


class QDA(Model):
    key, name, model_type = "qda", "Quadratic Discriminant Analysis", "classifier"

    def __init__(self, reg_param: float = 0.0, priors: list[float] | None = None) -> None:
        if not 0.0 <= reg_param <= 1.0:
            raise ValueError("reg_param must lie between 0 and 1.")
        self.reg_param, self.priors = reg_param, priors

    def _fit(self, train: DataFrame, d: int) -> QuadraticScores:
        stats = class_covariances(train)
        if len(stats) < 2:
            raise ValueError("At least 2 classes are required.")
        if any(s.n < 2 for s in stats):
            raise ValueError("Every class needs at least two rows.")
        if self.reg_param == 0.0 and min(s.n for s in stats) <= d:
            raise ValueError("Unregularised fits need more rows per class than features.")
        roots, logs = [], []
        for s in stats:
            values, vectors = np.linalg.eigh((1 - self.reg_param) * s.cov + self.reg_param * np.eye(d))
            if values.min() <= values.max() * d * np.finfo(float).eps:
                raise ValueError(f"The covariance of class {s.label!r} is rank-deficient; set reg_param.")
            roots.append((vectors / np.sqrt(values)).T)
            logs.append(np.log(values).sum())
        intercepts = -0.5 * np.array(logs) + _log(_priors(stats, self.priors))
        return self._new(
            QuadraticScores, d, classes=[s.label for s in stats], roots=roots,
            means=np.array([s.mean for s in stats]), intercepts=intercepts,
        )


class NaiveBayes(Model):
    key, name, model_type = "naive_bayes", "Gaussian Naive Bayes", "classifier"

    def __init__(self, var_smoothing: float = 1e-9) -> None:
        if var_smoothing <= 0:
            raise ValueError("var_smoothing must be positive.")
        self.var_smoothing = var_smoothing

    def _fit(self, train: DataFrame, d: int) -> QuadraticScores:
        rows = class_moments(train).collect()              # classes * d rows
        classes = sorted({r["label"] for r in rows})
        if len(classes) < 2:
            raise ValueError("At least 2 classes are required.")
        at = {c: i for i, c in enumerate(classes)}
        n = np.zeros(len(classes))
        mean = np.zeros((len(classes), d))
        var = np.zeros((len(classes), d))
        for r in rows:
            i = at[r["label"]]
            n[i], mean[i, r["feature"]], var[i, r["feature"]] = r["n"], r["mean"], r["var"]
        # variance of all rows from the class moments
        share = n / n.sum()
        overall = share @ mean
        spread = share @ (var + (mean - overall) ** 2)
        var = var + self.var_smoothing * spread.max()
        if (var <= 0).any():
            raise ValueError("All features are constant.")
        intercepts = np.log(share) - 0.5 * np.log(2 * math.pi * var).sum(axis=1)
        scores = mean.std(axis=0)
        return self._new(
            QuadraticScores, d, classes=classes, means=mean,
            roots=[np.diag(1.0 / np.sqrt(v)) for v in var], intercepts=intercepts,
            importance={f"feature_{j}": float(v) for j, v in enumerate(scores)},
            details={"mean": mean, "var": var},
        )


# --- suitability of the discriminants ---------------------------------------

# Report cutoffs.
COVARIANCE_DIFFERENCE = 0.35
HIGH_CORRELATION = 0.95


def spread_of(stats: list[ClassStats], overall: ClassStats) -> dict[str, Any]:
    """Facts of the covariance matrices; ``None`` where a matrix is not defined."""
    known = [s.cov for s in stats if s.cov is not None]
    whole = len(known) == len(stats) and overall.n > len(stats)
    pooled = pooled_covariance(stats) if whole else None
    matrices = [pooled, *(s.cov for s in stats)]
    ranks = [None if m is None else int(np.linalg.matrix_rank(m)) for m in matrices]
    conditions = [None if m is None else float(np.linalg.cond(m)) for m in matrices]
    conditions = [c if c is not None and math.isfinite(c) else None for c in conditions]
    tiny = float(np.finfo(float).eps)
    difference = None
    if whole:
        apart = np.linalg.norm(np.stack(known) - pooled, axis=(1, 2))
        difference = float(apart.mean() / max(np.linalg.norm(pooled), tiny))
    variance = overall.cov.diagonal() * (1 - 1 / overall.n)
    return {
        "constant_features": np.flatnonzero(variance <= tiny).tolist(), "max_correlation": max_correlation(overall),
        "pooled_rank": ranks[0], "pooled_condition": conditions[0],
        "class_ranks": ranks[1:], "class_conditions": conditions[1:], "covariance_difference": difference,
    }


def suitability_rules(
    df: DataFrame, k: int = 5, reg_param: float = 0.0, facts: dict[str, Any] | None = None,
    stats: list[ClassStats] | None = None,
) -> DataFrame:
    """``model, rule, value, low, high, blocks, broken``: what each discriminant asks of the rows.

    A rule is broken where its value is known and leaves ``low .. high``; ``blocks``
    tells whether that rules the model out.  The rules of ``both`` bind each model,
    those of ``comparison`` only the cross-validated comparison.
    """
    from ..operators.profile import LOWER_SHARE, UPPER_SHARE

    stats = stats or class_covariances(df)
    facts = facts or spread_of(stats, class_covariances(df, None)[0])
    rows, d = [s.n for s in stats], len(stats[0].mean)
    strict = reg_param == 0.0
    table = [
        ("both", "rows of the smallest class", min(rows), 2, None, True),
        ("both", "constant features", len(facts["constant_features"]), None, 0, True),
        ("both", "largest feature correlation", facts["max_correlation"], None, HIGH_CORRELATION, False),
        ("both", "share of the smallest class", min(rows) / sum(rows), LOWER_SHARE, None, False),
        ("both", "share of the largest class", max(rows) / sum(rows), None, UPPER_SHARE, False),
        ("comparison", "rows of the smallest class for the folds", min(rows), k, None, True),
        ("LDA", "rank of the pooled covariance", facts["pooled_rank"], d, None, False),
        ("LDA", "covariance difference", facts["covariance_difference"], None, COVARIANCE_DIFFERENCE, False),
        ("QDA", "rows of a class in a training fold", min(n - -(-n // k) for n in rows), d + 1, None, strict),
        ("QDA", "least rank of a class covariance", min(r or 0 for r in facts["class_ranks"]), d, None, strict),
    ]
    given = [tuple(None if v is None else float(v) if 2 <= i <= 4 else v for i, v in enumerate(row)) for row in table]
    rules = df.sparkSession.createDataFrame(given, "model string, rule string, value double, low double, high double, blocks boolean")
    return rules.withColumn("broken", F.coalesce((F.col("value") < F.col("low")) | (F.col("value") > F.col("high")), F.lit(False)))


def analyze_suitability(
    df: DataFrame, k: int = 5, reg_param: float = 0.0, confirmed: bool = False
) -> dict[str, Any]:
    """Whether ``(label, features)`` rows can support the discriminants, and which rules they break."""
    from ..operators.profile import is_numeric

    if k < 2:
        raise ValueError("k must be at least 2.")
    sizes = df.groupBy("label").agg(F.count(F.lit(1)).alias("n")).agg(F.sum("n").alias("rows"), F.count(F.lit(1)).alias("classes")).first()
    n, classes = sizes["rows"] or 0, sizes["classes"]
    many = not confirmed and is_numeric(df.schema["label"]) and classes > max(20, math.isqrt(n))
    kind = "regression_like" if many else "classification" if confirmed or classes >= 2 else "invalid"
    report: dict[str, Any] = {"n_rows": n, "n_classes": classes, "target_kind": kind}
    if many or classes < 2:
        nothing = {"lda_warnings": [], "qda_warnings": [], "structural_preference": None, "diagnostics": None}
        return report | nothing | dict.fromkeys(("lda_suitable", "qda_suitable", "can_compare"), False)
    stats = class_covariances(df)
    facts = spread_of(stats, class_covariances(df, None)[0])
    rules = suitability_rules(df, k, reg_param, facts, stats)
    broken = {  # one row per kind of rule
        r["model"]: r for r in rules.groupBy("model").agg(
            F.bool_or(F.col("broken") & F.col("blocks")).alias("out"),
            F.array_sort(F.collect_list(F.when(F.col("broken"), F.col("rule")))).alias("names"),
        ).collect()
    }
    fits = {m: not (broken["both"]["out"] or broken[m]["out"]) for m in ("LDA", "QDA")}
    common = broken["both"]["names"] + broken["comparison"]["names"]
    curved = "covariance difference" in broken["LDA"]["names"] and fits["QDA"]
    return report | {
        "imbalanced": any(name.startswith("share") for name in common),
        "lda_suitable": fits["LDA"], "qda_suitable": fits["QDA"],
        "can_compare": all(fits.values()) and not broken["comparison"]["out"],
        "structural_preference": "QDA" if curved else "LDA",
        "lda_warnings": common + broken["LDA"]["names"], "qda_warnings": common + broken["QDA"]["names"],
        "diagnostics": facts,
    }
