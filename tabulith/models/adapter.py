"""Any estimator of Spark's ML library as a model of this one."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Any

from pyspark.ml import Estimator
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import Fitted, Model, label_at, label_index, labels_of

#: Columns an estimator is told to use, where it has the parameter.
COLUMNS = {
    "featuresCol": "__vec", "inputCol": "__vec", "labelCol": "__y", "predictionCol": "__pred", "probabilityCol": "__prob",
    "rawPredictionCol": "__raw", "outputCol": "__out",
}
KINDS = ("classifier", "regressor", "clusterer", "dimensionality_reducer")


@dataclass
class EstimatorFitted(Fitted):
    """A fitted library model; its columns become ``prediction``, ``probability`` or ``components``."""

    model: Any = None

    def transform(self, df: DataFrame) -> DataFrame:
        kept = [c for c in df.columns if c not in ("prediction", "probability", "components")]
        scored = self.model.transform(df.select(*kept).withColumn("__vec", array_to_vector("features")))
        if self.model_type == "dimensionality_reducer":
            return scored.select(*kept, vector_to_array("__out").alias("components"))
        if self.model_type == "regressor":
            return scored.select(*kept, F.col("__pred").cast("double").alias("prediction"))
        if self.model_type == "clusterer":
            return scored.select(*kept, F.col("__pred").cast("int").alias("prediction"))
        if "__prob" in scored.columns:
            shares = vector_to_array("__prob")
        else:  # a model without probabilities is sure of its class
            shares = F.array(*[(F.col("__pred") == i).cast("double") for i in range(len(self.classes))])
        return scored.select(*kept, shares.alias("probability"), label_at(self.classes, F.col("__pred")).alias("prediction"))


class EstimatorModel(Model):
    """Base of the adapted estimators; hyperparameters are the estimator's own."""

    estimator: Estimator

    def __init__(self, **params: Any) -> None:
        for name in params:
            if not self.estimator.hasParam(name) or name in COLUMNS:
                raise ValueError(f"{self.name} has no hyperparameter {name!r}.")
        self.__dict__.update(params)

    def _fit(self, train: DataFrame, d: int) -> EstimatorFitted:
        classes, columns = None, [array_to_vector("features").alias("__vec")]
        if self.model_type == "classifier":
            classes = labels_of(train)
            columns.append(label_index(classes).cast("double").alias("__y"))
        elif self.supervised:
            columns.append(F.col("label").cast("double").alias("__y"))
        given = {k: v for k, v in COLUMNS.items() if self.estimator.hasParam(k)} | self.hyperparameters()
        ready = self.estimator.copy({self.estimator.getParam(k): v for k, v in given.items()})
        slim = train.select(*columns).persist()
        try:
            model = ready.fit(slim)
        finally:
            slim.unpersist()
        weights = getattr(model, "featureImportances", None)
        importance = None if weights is None else {f"feature_{j}": float(v) for j, v in enumerate(weights.toArray())}
        return self._new(EstimatorFitted, d, classes=classes, model=model, importance=importance)


def adapt(key: str, name: str, model_type: str, estimator: Estimator) -> type[Model]:
    """A model class around ``estimator``, with its settings as defaults."""
    if model_type not in KINDS:
        raise ValueError(f"model_type must be one of {', '.join(KINDS)}.")
    supervised = model_type in ("classifier", "regressor")
    return type(f"Adapted_{key}", (EstimatorModel,), {
        "key": key, "name": name, "model_type": model_type, "supervised": supervised, "estimator": estimator, "__doc__": f"{name}, adapted.",
    })
