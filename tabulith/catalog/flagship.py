"""The flagship query: an imbalanced classification from raw table to metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..models.discriminant import NaiveBayes
from ..operators.evaluate import classifier_metrics, confusion_matrix
from .common import big, docs_prepared, rnd
from pyspark.sql import functions as F


def flagship(spark: SparkSession, sf: str) -> DataFrame:
    """Confusion cells and weighted metrics of naive Bayes on held-out documents."""
    p = docs_prepared(spark, sf)
    scored = NaiveBayes().fit(p.train).transform(p.test)
    cells = confusion_matrix(scored).select(
        F.concat(F.lit("actual "), "actual", F.lit(" predicted "), "predicted").alias("item"),
        big("n").cast("double").alias("value"),
    )
    m = classifier_metrics(scored)
    items = F.array(*[F.struct(F.lit(c).alias("item"), rnd(c).alias("value")) for c in m.columns])
    return cells.unionByName(m.select(F.explode(items).alias("i")).select("i.*"))
