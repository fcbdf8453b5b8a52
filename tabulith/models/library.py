"""Models fitted by Spark's own ML library, under one interface."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from multiprocessing.pool import ThreadPool
from typing import Any

import numpy as np
from pyspark import inheritable_thread_target
from pyspark.ml.classification import (
    LogisticRegression, MultilayerPerceptronClassifier, RandomForestClassifier,
)
from pyspark.ml.clustering import GaussianMixture, KMeans
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import LinearRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ranking import running_sum
from ..functions.scalar import argmax_index, number, sum_text
from ..operators.prepare import SEED, kfold, poly_expressions
from ..operators.series import VARIANCE_RATIO, fit_series
from .base import (
    INLINE_TERMS, Fitted, Model, array_text, batch_matrix, label_at, label_index, labels_of,
    linear_text, newton, spread, summed_systems, vector_scores, width,
)
from .moments import class_covariances


def as_vectors(df: DataFrame, features: str = "features") -> DataFrame:
    return df.withColumn("__vec", array_to_vector(F.col(features)))


def _importance(values) -> dict[str, float]:
    return {f"feature_{j}": float(v) for j, v in enumerate(values)}


@dataclass
class LibraryClassifier(Fitted):
    """Wraps a fitted library classifier; probabilities become plain arrays."""

    model: Any = None

    def transform(self, df: DataFrame) -> DataFrame:
        scored = self.model.transform(as_vectors(df.drop("probability", "prediction")))
        return scored.select(
            *[c for c in df.columns if c not in ("probability", "prediction")],
            vector_to_array("__prob").alias("probability"), label_at(self.classes, F.col("__pred")).alias("prediction"),
        )


class _Classifier(Model):
    model_type = "classifier"

    def _estimator(self, n_rows: int, n_classes: int, d: int):
        raise NotImplementedError

    def _prepare(self, train: DataFrame) -> tuple[DataFrame, list[Any]]:
        classes = labels_of(train)
        slim = train.select(
            array_to_vector("features").alias("__vec"), label_index(classes).cast("double").alias("__y")
        )
        return slim, classes

    def _fit(self, train: DataFrame, d: int) -> Fitted:
        slim, classes = self._prepare(train)
        slim = slim.persist()
        try:
            model = self._estimator(slim.count(), len(classes), d).fit(slim)
        finally:
            slim.unpersist()
        return self._new(LibraryClassifier, d, classes=classes, model=model,
                         importance=self._importance_of(model))

    def _importance_of(self, model) -> dict[str, float] | None:
        return None


_COLUMNS = {"featuresCol": "__vec", "labelCol": "__y", "predictionCol": "__pred", "rawPredictionCol": "__raw"}


class Logistic(_Classifier):
    key, name = "logistic_regression", "Logistic Regression"

    def __init__(self, C: float = 1.0, max_iter: int = 1000) -> None:
        if C <= 0:
            raise ValueError("C must be positive.")
        self.C, self.max_iter = C, max_iter

    def _estimator(self, n_rows, n_classes, d):
        return LogisticRegression(
            regParam=1.0 / (self.C * n_rows), elasticNetParam=0.0, standardization=False,
            maxIter=self.max_iter, probabilityCol="__prob", **_COLUMNS,
        )

    def _importance_of(self, model):
        rows = model.coefficientMatrix.toArray()
        return _importance(np.abs(rows[0]))


class RandomForest(_Classifier):
    key, name = "random_forest", "Random Forest"

    def __init__(self, n_estimators: int = 200, max_depth: int | None = None, max_bins: int = 32) -> None:
        self.n_estimators, self.max_depth, self.max_bins = n_estimators, max_depth, max_bins

    def _estimator(self, n_rows, n_classes, d):
        return RandomForestClassifier(
            numTrees=self.n_estimators, maxDepth=12 if self.max_depth is None else self.max_depth,
            maxBins=self.max_bins, featureSubsetStrategy="sqrt", seed=SEED, probabilityCol="__prob", **_COLUMNS,
        )

    def _importance_of(self, model):
        return _importance(model.featureImportances.toArray())


class Perceptron(_Classifier):
    key, name = "ann", "Multilayer Perceptron"

    def __init__(self, hidden_sizes: tuple[int, ...] = (32, 16), epochs: int = 100) -> None:
        if not hidden_sizes or min(hidden_sizes) < 1 or epochs < 1:
            raise ValueError("hidden_sizes and epochs must be positive.")
        self.hidden_sizes, self.epochs = tuple(hidden_sizes), epochs

    def _estimator(self, n_rows, n_classes, d):
        return MultilayerPerceptronClassifier(
            layers=[d, *self.hidden_sizes, n_classes], maxIter=self.epochs, seed=SEED,
            probabilityCol="__prob", **_COLUMNS,
        )


# --- support vector machine --------------------------------------------------

@dataclass
class KernelMap:
    """Explicit features of a kernel: none, monomials, or random cosines."""

    terms: list[str] | None = None
    directions: np.ndarray | None = None
    phase: np.ndarray | None = None

    def __call__(self, df: DataFrame) -> tuple[DataFrame, str]:
        if self.terms is not None:
            return df.withColumn("__x", F.expr(f"array({', '.join(self.terms)})")), "__x"
        if self.directions is None:
            return df, "features"
        w, phase = self.directions, self.phase
        scale = np.sqrt(2.0 / len(phase))
        apply = vector_scores(lambda x: scale * np.cos(x @ w + phase), len(phase))
        return df.withColumn("__x", apply("features")), "__x"


@dataclass
class CalibratedMargins(Fitted):
    """One margin per class, squashed by its calibration line."""

    planes: list[tuple[np.ndarray, float]] = field(default_factory=list)
    lines: list[tuple[float, float]] = field(default_factory=list)
    expand: KernelMap = field(default_factory=KernelMap)

    def margins(self, df: DataFrame) -> DataFrame:
        wide, column = self.expand(df)
        w = np.array([p[0] for p in self.planes])
        b = np.array([p[1] for p in self.planes])
        if w.size <= INLINE_TERMS:
            m = array_text([linear_text(w[i], b[i], column) for i in range(len(b))])
        else:
            m = vector_scores(lambda x: x @ w.T + b, len(b))(column)
        return wide.withColumn("__m", m)

    def transform(self, df: DataFrame) -> DataFrame:
        scored = self.margins(df)
        items = [
            f"1D / (1D + exp(-({number(a)} * __m[{i}] + {number(c)})))" for i, (a, c) in enumerate(self.lines)
        ]
        if len(self.classes) == 2:
            probability = F.expr(f"array(1D - {items[0]}, {items[0]})")
        else:
            raw = "array(" + ", ".join(items) + ")"
            probability = F.expr(f"transform({raw}, p -> p / ({sum_text(items)}))")
        scored = scored.withColumn("probability", probability)
        return scored.select(
            *df.columns, "probability", label_at(self.classes, argmax_index("probability")).alias("prediction")
        )


class SVM(_Classifier):
    """Linear, polynomial or Gaussian-kernel machine with calibrated margins.

    Kernels become explicit features: monomials, or seeded random cosines for
    the Gaussian kernel.  The calibration line is fitted on out-of-fold margins.
    """

    key, name = "svm", "Support Vector Machine"

    def __init__(self, kernel: str = "rbf", C: float = 1.0, degree: int = 2, gamma: float | None = None,
                 n_components: int = 200, folds: int = 5, max_iter: int = 30) -> None:
        if kernel not in ("linear", "poly", "rbf"):
            raise ValueError(f"kernel {kernel!r} is not supported; use linear, poly or rbf.")
        if C <= 0 or folds < 2:
            raise ValueError("C must be positive and folds at least 2.")
        self.kernel, self.C, self.degree, self.gamma = kernel, C, degree, gamma
        self.n_components, self.folds, self.max_iter = n_components, folds, max_iter

    def _expander(self, train: DataFrame, d: int) -> "KernelMap":
        if self.kernel == "linear":
            return KernelMap()
        if self.kernel == "poly":
            return KernelMap(terms=[t for _, t in poly_expressions("features", d, self.degree)])
        gamma = self.gamma
        if gamma is None:
            # 1 / (d * variance over all entries of the feature table)
            row = train.select(F.explode("features").alias("v")).agg(F.var_pop("v")).first()
            gamma = 1.0 / (d * row[0]) if row[0] else 1.0 / d
        draw = np.random.default_rng(SEED)
        return KernelMap(
            directions=draw.normal(size=(d, self.n_components)) * np.sqrt(2 * gamma),
            phase=draw.uniform(0, 2 * np.pi, self.n_components),
        )

    def _fit(self, train: DataFrame, d: int) -> CalibratedMargins:
        """All folds and classes are fitted together, one pass per Newton step."""
        classes = labels_of(train)
        expand = self._expander(train, d)
        base = train.withColumn("__h", F.xxhash64("features"))
        wide, column = expand(kfold(base, "__h", "label", self.folds).drop("__h"))
        slim = spread(wide.select(label_index(classes).alias("y"), "fold", F.col(column).alias("features")))
        try:
            size = width(slim) + 1
            targets = [1] if len(classes) == 2 else list(range(len(classes)))
            problems = [(f, c) for f in [*range(self.folds), -1] for c in targets]
            found = newton(
                lambda trial: _squared_hinge(slim, trial, size, self.C), problems, size,
                lambda w: 0.5 * float(w[:-1] @ w[:-1]), _ridge_step, self.max_iter,
            )
            lines = _platt(slim, found, targets, self.folds)
        finally:
            slim.unpersist()
        planes = [(found[(-1, c)][:-1], float(found[(-1, c)][-1])) for c in targets]
        return self._new(CalibratedMargins, d, classes=classes, planes=planes,
                         lines=[lines[c] for c in targets], expand=expand)


def _batch_columns(batch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    x = batch_matrix(batch)
    y = batch.column(batch.schema.get_field_index("y")).to_numpy(zero_copy_only=False)
    fold = batch.column(batch.schema.get_field_index("fold")).to_numpy(zero_copy_only=False)
    return np.hstack([x, np.ones((len(x), 1))]), y, fold


def _squared_hinge(slim: DataFrame, trial, size: int, c: float):
    """Squared hinge loss of every (left-out fold, class) problem."""
    keys = sorted(trial)

    def partial(batch):
        x, y, fold = _batch_columns(batch)
        for k, (f, target) in enumerate(keys):
            own = fold != f
            xs, sign = x[own], np.where(y[own] == target, 1.0, -1.0)
            slack = np.maximum(0.0, 1.0 - sign * (xs @ trial[(f, target)]))
            hit = slack > 0
            xs, sign, slack = xs[hit], sign[hit], slack[hit]
            yield k, c * float(slack @ slack), -2 * c * (xs.T @ (sign * slack)), 2 * c * (xs.T @ xs)

    return summed_systems(slim, partial, keys, size)


def _ridge_step(w: np.ndarray, g: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Newton moves of all problems; the last coordinate is the free intercept."""
    ridge = np.eye(w.shape[1])
    ridge[-1, -1] = 1e-8
    g = g.copy()
    g[:, :-1] += w[:, :-1]
    return -np.linalg.solve(h + ridge, g[:, :, None])[:, :, 0]


def _platt(slim: DataFrame, planes, targets, folds: int) -> dict[int, tuple[float, float]]:
    """Calibration line per class on the margins of rows each plane never saw."""

    def systems(trial):
        keys = sorted(trial)
        by_fold = {t: np.array([planes[(f, t)] for f in range(folds)]) for t in keys}

        def partial(batch):
            x, y, fold = _batch_columns(batch)
            for k, target in enumerate(keys):
                m = np.einsum("ij,ij->i", x, by_fold[target][fold])
                one = np.column_stack([m, np.ones(len(m))])
                sign = np.where(y == target, 1.0, -1.0)
                z = sign * (one @ trial[target])
                p = 1.0 / (1.0 + np.exp(-np.clip(z, -500, 500)))
                yield k, np.logaddexp(0.0, -z).sum(), -(one.T @ (sign * (1 - p))), (one * (p * (1 - p))[:, None]).T @ one

        return summed_systems(slim, partial, keys, 2)

    found = newton(systems, list(targets), 2, lambda w: 0.0,
                   lambda w, g, h: -np.linalg.solve(h + 1e-9 * np.eye(2), g[:, :, None])[:, :, 0], 25)
    return {c: (float(w[0]), float(w[1])) for c, w in found.items()}


# --- nearest neighbours ------------------------------------------------------

@dataclass
class NeighbourVotes(Fitted):
    train: DataFrame | None = None
    k: int = 5
    weights: str = "uniform"

    def transform(self, df: DataFrame) -> DataFrame:
        from ..operators.distance import knn_join

        near = knn_join(df, self.train, self.k, extra="label")
        if self.weights == "distance":
            near = near.withColumn(
                "w", F.when(F.min("distance").over(_per_query()) == 0, (F.col("distance") == 0).cast("double"))
                .otherwise(1.0 / F.col("distance")),
            )
        else:
            near = near.withColumn("w", F.lit(1.0))
        votes = near.groupBy(F.col("query_id").alias("row_id")).agg(
            F.array(*[F.sum(F.when(F.col("label") == F.lit(c), F.col("w")).otherwise(0.0)) for c in self.classes]).alias("__v")
        )
        total = F.aggregate("__v", F.lit(0.0), lambda a, v: a + v)
        voted = votes.select(
            "row_id", F.transform("__v", lambda v: v / total).alias("probability"),
            label_at(self.classes, argmax_index("__v")).alias("prediction"),
        )
        return df.join(voted, "row_id")


def _per_query():
    from pyspark.sql import Window as W

    return W.partitionBy("query_id")


class Neighbours(Model):
    key, name, model_type = "knn", "K-Nearest Neighbours", "classifier"

    def __init__(self, n_neighbors: int = 5, weights: str = "uniform") -> None:
        if n_neighbors < 1 or weights not in ("uniform", "distance"):
            raise ValueError("n_neighbors must be positive, weights 'uniform' or 'distance'.")
        self.n_neighbors, self.weights = n_neighbors, weights

    def _fit(self, train: DataFrame, d: int) -> NeighbourVotes:
        return self._new(
            NeighbourVotes, d, classes=labels_of(train), k=self.n_neighbors, weights=self.weights,
            train=train.select("row_id", "features", "label"),
        )


# --- clustering --------------------------------------------------------------

@dataclass
class NearestCentre(Fitted):
    """Index of the closest centre; ties go to the lower index."""

    centres: np.ndarray = field(default_factory=lambda: np.empty((0, 0)))
    names: list[int] | None = None

    def transform(self, df: DataFrame) -> DataFrame:
        m = self.centres
        if m.size <= INLINE_TERMS:
            items = [
                sum_text([f"pow(features[{j}] - {number(v)}, 2)" for j, v in enumerate(row)]) for row in m
            ]
            distances = array_text(items)
        else:
            distances = vector_scores(
                lambda x: np.stack([((x - c) ** 2).sum(axis=1) for c in m], axis=1), len(m)
            )("features")
        nearest = df.withColumn("__d", distances).withColumn(
            "prediction", (F.array_position("__d", F.array_min("__d")) - 1).cast("int")
        ).drop("__d")
        if self.names is None:
            return nearest
        return nearest.withColumn("prediction", label_at(self.names, F.col("prediction")).cast("int"))


STARTS_AT_ONCE = 8


def each_start(slim: DataFrame, n_init: int, fit: Callable[[DataFrame, int], tuple]) -> list[tuple]:
    """``fit(rows, i)`` for every start, several at a time, in the order of the starts.

    The library keeps the vectors it goes over in every round only of rows that are
    not marked as persisted, such as filtered ones; of others it decodes the columns again.
    """
    held = slim.persist()
    try:
        held.count()
        rows = held.where("__vec IS NOT NULL")
        run = inheritable_thread_target(slim.sparkSession)(lambda i: fit(rows, i))
        with ThreadPool(min(n_init, STARTS_AT_ONCE)) as pool:
            return pool.map(run, range(n_init), chunksize=1)
    finally:
        held.unpersist()


class KMeansClusters(Model):
    key, name, model_type, supervised = "kmeans", "K-Means", "clusterer", False

    def __init__(self, n_clusters: int = 3, n_init: int = 10, max_iter: int = 300) -> None:
        if n_clusters < 1 or n_init < 1:
            raise ValueError("n_clusters and n_init must be positive.")
        self.n_clusters, self.n_init, self.max_iter = n_clusters, n_init, max_iter

    def _fit(self, train: DataFrame, d: int) -> NearestCentre:
        def start(rows: DataFrame, i: int) -> tuple[float, np.ndarray]:
            model = KMeans(k=self.n_clusters, initSteps=2, seed=SEED + i, maxIter=self.max_iter,
                           tol=1e-4, featuresCol="__vec", predictionCol="__pred").fit(rows)
            return model.summary.trainingCost, np.array(model.clusterCenters())

        slim = train.select(array_to_vector("features").alias("__vec"))
        best = min(each_start(slim, self.n_init, start), key=lambda found: found[0])
        return self._new(NearestCentre, d, centres=best[1], details={"cost": best[0]})


@dataclass
class MixtureClusters(Fitted):
    model: Any = None

    def transform(self, df: DataFrame) -> DataFrame:
        scored = self.model.transform(as_vectors(df))
        return scored.select(
            *df.columns, F.col("__pred").cast("int").alias("prediction"),
            vector_to_array("__prob").alias("probability"),
        )


class Mixture(Model):
    key, name, model_type, supervised = "gmm", "Gaussian Mixture", "clusterer", False

    def __init__(self, n_components: int = 3, covariance_type: str = "full", max_iter: int = 100, n_init: int = 3) -> None:
        if covariance_type != "full":
            raise ValueError("Only covariance_type='full' is available.")
        if n_components < 1 or n_init < 1:
            raise ValueError("n_components and n_init must be positive.")
        self.n_components, self.covariance_type = n_components, covariance_type
        self.max_iter, self.n_init = max_iter, n_init

    def _fit(self, train: DataFrame, d: int) -> MixtureClusters:
        """The likeliest of ``n_init`` seeded starts."""
        def start(rows: DataFrame, i: int) -> tuple[float, Any]:
            model = GaussianMixture(
                k=self.n_components, maxIter=self.max_iter, seed=SEED + i, featuresCol="__vec",
                predictionCol="__pred", probabilityCol="__prob",
            ).fit(rows)
            return model.summary.logLikelihood, model

        slim = as_vectors(train).select("__vec")
        best = max(each_start(slim, self.n_init, start), key=lambda found: found[0])
        return self._new(MixtureClusters, d, model=best[1], details={"log_likelihood": best[0]})


# --- principal components ----------------------------------------------------

@dataclass
class Components(Fitted):
    mean: np.ndarray = field(default_factory=lambda: np.empty(0))
    loadings: np.ndarray = field(default_factory=lambda: np.empty((0, 0)))
    ratio: list[float] = field(default_factory=list)

    def transform(self, df: DataFrame) -> DataFrame:
        v, m = self.loadings, self.mean
        if v.size <= INLINE_TERMS:
            columns = array_text([linear_text(row, -float(row @ m)) for row in v])
        else:
            columns = vector_scores(lambda x: (x - m) @ v.T, len(v))("features")
        return df.withColumn("components", columns)


class PrincipalComponents(Model):
    """Eigenvectors of the covariance matrix; the largest loading is positive."""

    key, name, model_type, supervised = "pca", "Principal Components", "dimensionality_reducer", False

    def __init__(self, n_components: int = 2) -> None:
        if n_components < 1:
            raise ValueError("n_components must be positive.")
        self.n_components = n_components

    def _fit(self, train: DataFrame, d: int) -> Components:
        if self.n_components > d:
            raise ValueError(f"n_components={self.n_components} is more than {d} features.")
        stats = class_covariances(train, None)[0]
        if stats.cov is None:
            raise ValueError("At least two rows are required.")
        values, vectors = np.linalg.eigh(stats.cov)
        order = np.argsort(values)[::-1][: self.n_components]
        loadings = vectors[:, order].T
        for row in loadings:
            if row[np.argmax(np.abs(row))] < 0:
                row *= -1
        total = float(values.sum())
        ratio = [float(values[i] / total) if total > 0 else float("nan") for i in order]
        return self._new(Components, d, mean=stats.mean, loadings=loadings, ratio=ratio,
                         details={"explained_variance_ratio": ratio})


# --- regression --------------------------------------------------------------

@dataclass
class LinearPrediction(Fitted):
    terms: list[str] = field(default_factory=list)
    coefficients: np.ndarray = field(default_factory=lambda: np.empty(0))
    intercept: float = 0.0

    def transform(self, df: DataFrame) -> DataFrame:
        parts = [f"{t} * {number(w)}" for t, w in zip(self.terms, self.coefficients)]
        return df.withColumn("prediction", F.expr(sum_text([number(self.intercept), *parts])))


def require_numeric_label(df: DataFrame, label: str = "label") -> Column:
    from ..operators.profile import is_numeric

    if not is_numeric(df.schema[label]):
        raise ValueError("A regressor needs a numeric target.")
    return F.col(label).cast("double")


@dataclass
class SeriesPrediction(Fitted):
    """A line through one feature; a differenced series is summed up from its last known level, by row key."""

    slope: float = 0.0
    intercept: float = 0.0
    differenced: bool = False
    last_level: float | None = None

    def transform(self, df: DataFrame) -> DataFrame:
        step = F.col("features")[0] * self.slope + self.intercept
        if not self.differenced:
            return df.withColumn("prediction", step)
        summed = running_sum(df.withColumn("__step", step), [], "row_id", {"__step": "__sum"})
        return summed.withColumn("prediction", F.col("__sum") + self.last_level).drop("__step", "__sum")


class PolynomialRegression(Model):
    """Least squares: all monomials up to ``poly_degree`` of several features, or a line through one.

    With one feature the rows are a series by key.  If the level varies more than
    ``variance_ratio_threshold`` times as much as its differences, the differences are fitted.
    """

    key, name, model_type = "regression", "Polynomial Regression", "regressor"
    one_feature = True

    def __init__(self, poly_degree: int = 2, variance_ratio_threshold: float = VARIANCE_RATIO) -> None:
        if poly_degree < 1:
            raise ValueError("poly_degree must be at least 1.")
        self.poly_degree, self.variance_ratio_threshold = poly_degree, variance_ratio_threshold

    def _fit_series(self, train: DataFrame, y: Column) -> SeriesPrediction:
        rows = train.select("row_id", F.col("features")[0].alias("x"), y.alias("y"))
        found = fit_series(rows, [], "row_id", "x", "y", self.variance_ratio_threshold).first()
        if found["n"] < 3:
            raise ValueError("At least three rows are required.")
        flat = found["slope"] is None  # the feature is constant
        slope = 0.0 if flat else found["slope"]
        intercept = found["mean_diff" if found["differenced"] else "mean_level"] if flat else found["intercept"]
        return self._new(
            SeriesPrediction, 1, slope=float(slope), intercept=float(intercept), differenced=found["differenced"],
            last_level=None if found["last_level"] is None else float(found["last_level"]), importance={"feature_0": float(slope)},
            details={"mode": "univariate", "stationarity_score": found["ratio"], "differenced": found["differenced"]},
        )

    def _fit(self, train: DataFrame, d: int) -> Fitted:
        y = require_numeric_label(train)
        if d == 1 and self.one_feature:
            return self._fit_series(train, y)
        names, terms = (list(v) for v in zip(*poly_expressions("features", d, self.poly_degree)))
        if len(terms) > 4096:
            raise ValueError("More than 4096 expanded features.")
        slim = train.select(
            array_to_vector(F.expr("array(" + ", ".join(terms) + ")")).alias("__vec"), y.alias("__y")
        )
        model = LinearRegression(
            regParam=0.0, solver="normal", featuresCol="__vec", labelCol="__y", predictionCol="__pred"
        ).fit(slim)
        weights = model.coefficients.toArray()
        return self._new(
            LinearPrediction, d, terms=terms, coefficients=weights, intercept=float(model.intercept), importance=_importance(weights),
            details={"mode": "multivariate", "terms": [list(n) for n in names]},
        )


class LaggedRegression(PolynomialRegression):
    """Least squares on flattened lookback rows."""

    key, name = "lagged_regression", "Lagged Linear Regression"
    one_feature = False

    def __init__(self) -> None:
        super().__init__(1)
