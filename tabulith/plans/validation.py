"""Cross-validation and the comparison of the two discriminants."""

from __future__ import annotations

from collections.abc import Sequence
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..models.base import Model, labels_of
from ..models.discriminant import LDA, QDA, analyze_suitability
from ..operators.evaluate import classifier_metrics, roc_auc
from ..operators.prepare import SEED, kfold

METRICS = ("accuracy", "precision", "recall", "f1", "roc_auc")
RANKED = ("f1", "roc_auc", "accuracy")


def out_of_fold(folded: DataFrame, model: Model, k: int) -> DataFrame:
    """Predictions of rows by the model that never saw them.

    ``folded`` is ``(row_id, label, features, fold)``.
    """
    parts = None
    for f in range(k):
        fitted = model.fit(folded.where(F.col("fold") != f))
        scored = fitted.transform(folded.where(F.col("fold") == f)).select(
            "row_id", "fold", "label", "prediction", "probability"
        )
        parts = scored if parts is None else parts.unionByName(scored)
    return parts


def fold_metrics(held: DataFrame, classes: Sequence[Any]) -> DataFrame:
    """All five metrics per fold, in one pass over the union of the folds."""
    return classifier_metrics(held, by=["fold"]).join(roc_auc(held, classes, by=["fold"]), "fold")


def cv_metrics(df: DataFrame, model: Model, k: int = 5, seed: int = SEED) -> DataFrame:
    """Mean and population deviation of each metric over the folds."""
    folded = kfold(df, "row_id", "label", k, seed).persist()
    try:
        rows = fold_metrics(out_of_fold(folded, model, k), labels_of(folded)).collect()   # k rows
    finally:
        folded.unpersist()
    per_fold = [(m, float(r[m])) for r in rows for m in METRICS if r[m] is not None]
    return df.sparkSession.createDataFrame(per_fold, "metric string, v double").groupBy("metric").agg(
        F.avg("v").alias("mean"), F.stddev_pop("v").alias("std"), F.count(F.lit(1)).alias("folds")
    )


def compare_lda_qda(
    df: DataFrame, k: int = 5, reg_param: float = 0.0, require_suitable: bool = True, seed: int = SEED
) -> tuple[DataFrame, str]:
    """Cross-validated metrics of both discriminants and the recommended one.

    The means stand side by side, one row per model, and are sorted by ``RANKED``,
    rounded; a tie goes to the simpler linear model, which is first by name.
    """
    report = analyze_suitability(df, k, reg_param)
    if report["target_kind"] != "classification":
        raise ValueError("The comparison needs a categorical target.")
    if require_suitable and not report["can_compare"]:
        raise ValueError(f"The table is not suitable: {'; '.join(sorted({*report['lda_warnings'], *report['qda_warnings']}))}.")
    linear, quadratic = (
        cv_metrics(df, model, k, seed).select(F.lit(model.key.upper()).alias("model"), "metric", "mean", "std")
        for model in (LDA(), QDA(reg_param))
    )
    both = linear.unionByName(quadratic)
    side_by_side = both.groupBy("model").pivot("metric", list(RANKED)).agg(F.first("mean"))
    winner = side_by_side.orderBy(*[F.round(m, 12).desc() for m in RANKED], "model").first()["model"]
    return both.withColumn("recommended", F.col("model") == winner), winner
