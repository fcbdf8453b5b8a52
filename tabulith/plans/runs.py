"""Training runs: prepare once, fit several models, evaluate, keep, score."""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence
from dataclasses import dataclass, field
from typing import Any

from pyspark.ml import Estimator
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..models.base import Fitted, Model
from ..models.density import DBSCAN, MicroLinkage
from ..models.discriminant import LDA, QDA, NaiveBayes
from ..models.hmm import HiddenMarkov
from ..models.library import (
    KMeansClusters, LaggedRegression, Logistic, Mixture, Neighbours, Perceptron,
    PolynomialRegression, PrincipalComponents, RandomForest, SVM,
)
from ..models.adapter import adapt
from ..models.boosting import BoostedTrees
from ..models.oblique import Oblique
from ..models.trees import CART, CHAID, ID3
from ..operators.evaluate import confusion_matrix, evaluate
from ..operators.prepare import TEST_SIZE, FittedPrep, Prepared, fit_prepare, transform_new
from ..operators.profile import infer_problem_type, require_valid
from .state import Reader, Writer

MODELS: dict[str, type[Model]] = {
    m.key: m
    for m in (
        Logistic, CART, ID3, CHAID, Oblique, RandomForest, BoostedTrees, SVM, Neighbours, KMeansClusters,
        Mixture, DBSCAN, PrincipalComponents, MicroLinkage, LDA, QDA, NaiveBayes, HiddenMarkov,
        PolynomialRegression, LaggedRegression, Perceptron,
    )
}

FITS = {
    "classifier": ("classification",),
    "regressor": ("regression",),
    "clusterer": ("clustering",),
    "dimensionality_reducer": ("classification", "regression", "clustering"),
}


def register_model(model: type[Model]) -> type[Model]:
    """Makes a model class known to runs by its ``key``; usable as a decorator.

    Its fitted class must be a dataclass derived from ``Fitted``; such runs are saved and
    loaded like all others once the class is imported.
    """
    if not (isinstance(model, type) and issubclass(model, Model)):
        raise TypeError("Only subclasses of Model can be registered.")
    if not model.key or model.model_type not in FITS:
        raise ValueError(f"A model needs a key and one of the types {', '.join(FITS)}.")
    if MODELS.setdefault(model.key, model) is not model:
        raise ValueError(f"A model is registered as '{model.key}' already.")
    return model


def register_estimator(key: str, name: str, model_type: str, estimator: Estimator) -> type[Model]:
    """Makes an estimator of Spark's ML library known to runs as a model."""
    return register_model(adapt(key, name, model_type, estimator))


@dataclass
class Spec:
    model_key: str
    hyperparameters: dict[str, Any] = field(default_factory=dict)


@dataclass
class Result:
    model_key: str
    fitted: Fitted | None
    metrics: dict[str, float | None]
    error: str | None = None


@dataclass
class Run:
    run_id: str
    problem_type: str
    target: str | None
    prep: FittedPrep
    test_size: float
    n_rows: int
    results: list[Result]

    def result(self, model_key: str) -> Result:
        for r in self.results:
            if r.model_key == model_key:
                return r
        raise KeyError(f"No model '{model_key}' in run '{self.run_id}'.")


def check_specs(specs: Sequence[Spec], problem_type: str) -> list[Model]:
    """Build every model before any is fitted; unknown or unfit ones are refused."""
    models = []
    for s in specs:
        if s.model_key not in MODELS:
            raise ValueError(f"No registered model '{s.model_key}'.")
        model = MODELS[s.model_key](**s.hyperparameters)
        if problem_type not in FITS[model.model_type]:
            raise ValueError(
                f"Model '{s.model_key}' ({model.model_type}) does not fit a {problem_type} table."
            )
        models.append(model)
    if not models:
        raise ValueError("Give at least one model.")
    return models


def train_run(
    df: DataFrame, key: str, target: str | None, specs: Sequence[Spec],
    problem_type: str | None = None, test_size: float = TEST_SIZE, run_id: str | None = None,
) -> tuple[Run, Prepared]:
    """Check, prepare once, then fit and evaluate each model.

    Both parts are kept in memory (spilling to disk) for the fits and released at
    the end.  A model that fails is recorded and does not lose the others.
    """
    require_valid(df.drop(key))
    problem_type = problem_type or infer_problem_type(df, target, target is not None)
    models = check_specs(specs, problem_type)
    prepared = fit_prepare(df, key, target, problem_type, test_size)
    train, test = prepared.train.persist(), prepared.test.persist()
    results = []
    try:
        for spec, model in zip(specs, models):
            try:
                rows = train if model.supervised else train.drop("label")
                fitted = model.fit(rows)
                scored = fitted.transform(test)
                # cluster metrics read the scored rows several times
                several = model.model_type == "clusterer"
                scored = scored.persist() if several else scored
                try:
                    metrics = evaluate(model.model_type, scored)
                finally:
                    if several:
                        scored.unpersist()
                results.append(Result(spec.model_key, fitted, metrics))
            except Exception as error:  # noqa: BLE001 - kept per model
                results.append(Result(spec.model_key, None, {}, f"{type(error).__name__}: {error}"))
    finally:
        train.unpersist()
        test.unpersist()
    run = Run(run_id or uuid.uuid4().hex, problem_type, target, prepared.prep, test_size, prepared.n_rows, results)
    return run, prepared


# --- tables of a run ---------------------------------------------------------

def metrics_table(spark: SparkSession, runs: Sequence[Run]) -> DataFrame:
    """``(run_id, model_key, metric, value)``; metrics without a value are left out."""
    rows = [
        (run.run_id, r.model_key, name, float(value))
        for run in runs for r in run.results for name, value in r.metrics.items() if value is not None
    ]
    return spark.createDataFrame(rows, "run_id string, model_key string, metric string, value double")


def run_metadata(spark: SparkSession, run: Run) -> DataFrame:
    """One row per model with its metadata, failures included."""
    rows = []
    for r in run.results:
        m = r.fitted.metadata() if r.fitted else {}
        model = MODELS[r.model_key]
        rows.append(
            (run.run_id, r.model_key, model.name, model.model_type,
             json.dumps(m.get("hyperparameters"), default=str, sort_keys=True) if m else None,
             m.get("training_time_seconds"), m.get("n_features"), r.error)
        )
    return spark.createDataFrame(
        rows, "run_id string, model_key string, model_name string, model_type string, "
        "hyperparameters string, fit_seconds double, n_features int, error string",
    )


def importance_table(spark: SparkSession, run: Run) -> DataFrame:
    """``(model_key, feature, importance)`` with the prepared feature names."""
    prepared = run.prep.feature_names

    def named(fitted: Fitted, feature: str) -> str:
        """Expanded terms are named by the features in them."""
        j = int(feature.rsplit("_", 1)[1])
        terms = fitted.details.get("terms")
        return " * ".join(prepared[i] for i in terms[j]) if terms else prepared[j]

    rows = [
        (r.model_key, named(r.fitted, f), float(v))
        for r in run.results if r.fitted and r.fitted.importance for f, v in r.fitted.importance.items()
    ]
    return spark.createDataFrame(rows, "model_key string, feature string, importance double")


def predict_run(run: Run, model_key: str, df: DataFrame) -> DataFrame:
    """Score new rows with the fitted preparation; works on batches and streams."""
    result = run.result(model_key)
    if result.fitted is None:
        raise ValueError(f"Model '{model_key}' failed in this run: {result.error}")
    scored = result.fitted.transform(result.fitted.checked(transform_new(df, run.prep)))
    shown = ["row_id", "components" if result.fitted.model_type == "dimensionality_reducer" else "prediction"]
    if result.fitted.model_type == "classifier":
        shown.append("probability")
    return scored.select(*shown)


def plot_data(model_type: str, scored: DataFrame, d: int) -> DataFrame | None:
    """Chart rows: actual against predicted, or two-dimensional cluster points."""
    if model_type == "regressor":
        return scored.select("row_id", F.col("label").cast("double").alias("y_true"), F.col("prediction").alias("y_pred"))
    if model_type == "clusterer":
        if d >= 2:
            flat = PrincipalComponents(2).fit(scored.select("features")).transform(scored)
            return flat.select("row_id", F.col("components")[0].alias("x"), F.col("components")[1].alias("y"), "prediction")
        return scored.select("row_id", F.col("features")[0].alias("x"), F.lit(0.0).alias("y"), "prediction")
    if model_type in ("classifier", "dimensionality_reducer"):
        return None
    raise ValueError(f"Unrecognised model_type: {model_type!r}")


def report_tables(spark: SparkSession, run: Run, df: DataFrame, test: DataFrame, source: str) -> dict[str, DataFrame]:
    """The report sections as tables."""
    from ..operators.profile import class_imbalance, profile_dataset, report_columns
    from ..operators.report import compare_models, prediction_distribution, prediction_sample

    shown = report_columns(df.drop(run.prep.key), run.target)
    metrics = metrics_table(spark, [run])
    done = [r for r in run.results if r.fitted is not None]
    tables = {
        "summary": report_summary(df, run.prep.key, run.target, run.problem_type, source, run.test_size,
                                  [MODELS[r.model_key].name for r in run.results]),
        "dataset": profile_dataset(shown, run.target, run.target is not None),
        "models": run_metadata(spark, run),
        "metrics": metrics,
        "importance": importance_table(spark, run),
    }
    if run.problem_type == "classification":
        tables["imbalance"] = class_imbalance(df, run.target)
    if len(done) > 1:
        tables["comparison"] = compare_models(metrics, [(run.run_id, r.model_key) for r in done])
    for r in done:
        if r.fitted.model_type == "dimensionality_reducer":
            continue
        scored = r.fitted.transform(test)
        numeric = r.fitted.model_type == "regressor"
        tables[f"predictions_{r.model_key}"] = prediction_distribution(scored, numeric)
        tables[f"sample_{r.model_key}"] = prediction_sample(
            scored, numeric, probabilities=r.fitted.model_type == "classifier"
        )
        if r.fitted.model_type == "classifier":
            tables[f"confusion_{r.model_key}"] = confusion_matrix(scored)
    return tables


def report_summary(
    df: DataFrame, key: str, target: str | None, problem_type: str, source: str, test_size: float,
    model_names: Sequence[str],
) -> DataFrame:
    """Header of the report in one row."""
    return df.agg(F.count(F.lit(1)).alias("n_rows")).select(
        F.lit(source).alias("dataset"), "n_rows",
        F.lit(len([c for c in df.columns if c != key])).cast("bigint").alias("n_cols"),
        F.lit(target).cast("string").alias("target"), F.lit(problem_type).alias("data_type"),
        F.lit(float(test_size)).alias("test_size"), F.lit(", ".join(model_names)).alias("models"),
    )


# --- keeping a run -----------------------------------------------------------

def save_run(run: Run, path: str) -> None:
    """Metrics, metadata and parameters as parquet, library models in their own form."""
    spark = SparkSession.active()
    base = f"{path.rstrip('/')}/{run.run_id}"
    metrics_table(spark, [run]).coalesce(1).write.parquet(f"{base}/metrics")
    run_metadata(spark, run).coalesce(1).write.parquet(f"{base}/models")
    rows = [
        (i, r.model_key, json.dumps(r.metrics), r.error, None if r.fitted is None else Writer(base, str(i)).text(r.fitted))
        for i, r in enumerate(run.results)
    ]
    spark.createDataFrame(
        rows, "position int, model_key string, metrics string, error string, state string"
    ).coalesce(1).write.parquet(f"{base}/fitted")
    if run.prep.codes is not None:
        run.prep.codes.write.parquet(f"{base}/codes")
    header = [(run.run_id, run.problem_type, run.target, run.prep.to_json(), run.test_size, run.n_rows,
               run.prep.codes is not None)]
    spark.createDataFrame(
        header, "run_id string, problem_type string, target string, prep string, test_size double, "
        "n_rows bigint, has_codes boolean",
    ).coalesce(1).write.parquet(f"{base}/run")


def load_run(spark: SparkSession, path: str, run_id: str) -> Run:
    base = f"{path.rstrip('/')}/{run_id}"
    head = spark.read.parquet(f"{base}/run").first()
    codes = spark.read.parquet(f"{base}/codes") if head["has_codes"] else None
    reader = Reader(spark, base)
    results = [
        Result(r["model_key"], None if r["state"] is None else reader.value(r["state"]), json.loads(r["metrics"]), r["error"])
        for r in spark.read.parquet(f"{base}/fitted").orderBy("position").collect()
    ]
    return Run(
        run_id, head["problem_type"], head["target"], FittedPrep.from_json(head["prep"], codes),
        head["test_size"], head["n_rows"], results,
    )


def load_metrics(spark: SparkSession, path: str, run_id: str) -> DataFrame:
    return spark.read.parquet(f"{path.rstrip('/')}/{run_id}/metrics")
