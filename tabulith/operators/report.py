"""Comparison and report tables over metric, confusion and prediction tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.ranking import prefix_scan
from ..functions.scalar import format_metric, impurity

# Fixed values of the report.
SCALE_STEPS = 5
SAMPLE_ROWS = 25


def confusion_scale(matrix: DataFrame) -> DataFrame:
    """Five-step intensity of each cell, relative to the largest of its row."""
    largest = F.max("n").over(W.partitionBy("actual"))
    step = F.least(F.ceil(F.col("n") / largest * SCALE_STEPS), F.lit(SCALE_STEPS)) - 1
    return matrix.select(
        "actual", "predicted", "n",
        F.when((F.col("n") <= 0) | (largest <= 0), F.lit(0)).otherwise(step).cast("int").alias("step"),
        (F.col("actual") == F.col("predicted")).alias("is_correct"),
    )


def cumulative_variance(ratios: DataFrame) -> DataFrame:
    """Running sum of variance ratios by component; undefined ones are skipped.

    One row per component, so the ordered window is small by construction.
    """
    order = W.orderBy("component").rowsBetween(W.unboundedPreceding, 0)
    return ratios.select(
        F.concat(F.lit("PC"), F.col("component") + 1).alias("label"), "component", "ratio",
        F.sum(F.coalesce("ratio", F.lit(0.0))).over(order).alias("cumulative"),
    )


def importance_ranking(importance: DataFrame) -> DataFrame:
    """Features by descending importance with their rank."""
    order = W.orderBy(F.desc("importance"), F.asc("feature"))
    return importance.withColumn("rank", F.row_number().over(order))


def common_metrics(metrics: DataFrame) -> DataFrame:
    """Metrics every compared model has a value for."""
    per = metrics.groupBy("metric").agg(F.count_distinct("run_id", "model_key").alias("k"))
    total = metrics.agg(F.count_distinct("run_id", "model_key")).scalar()
    return per.where(F.col("k") == total).select("metric")


def metrics_pivot(metrics: DataFrame, models: Sequence[str]) -> DataFrame:
    """One row per metric, one column per model."""
    return metrics.groupBy("metric").pivot("model_key", list(models)).agg(F.first("value"))


def compare_models(metrics: DataFrame, refs: Sequence[tuple[str, str]]) -> DataFrame:
    """Common metrics of the chosen ``(run_id, model_key)`` pairs, request order kept."""
    if len(refs) < 2:
        raise ValueError("Compare at least two models.")
    wanted = metrics.sparkSession.createDataFrame(
        [(i, r, m) for i, (r, m) in enumerate(refs)], "position int, run_id string, model_key string"
    )
    chosen = metrics.join(F.broadcast(wanted), ["run_id", "model_key"])
    return chosen.join(common_metrics(chosen), "metric", "left_semi").select(
        "position", "run_id", "model_key", "metric", "value"
    )


def prediction_text(column: str, numeric: bool) -> Column:
    return format_metric(F.col(column).cast("double")) if numeric else F.col(column).cast("string")


def prediction_distribution(pred: DataFrame, numeric: bool = False) -> DataFrame:
    """Predicted values by descending count (ties: value)."""
    return (
        pred.groupBy(prediction_text("prediction", numeric).alias("value"))
        .agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "value")
    )


def prediction_sample(
    pred: DataFrame, numeric: bool = False, rows: int = SAMPLE_ROWS, probabilities: bool = True
) -> DataFrame:
    """First rows by key with their probabilities as text."""
    first = pred.orderBy("row_id").limit(rows)
    shown = [F.col("row_id"), prediction_text("prediction", numeric).alias("prediction")]
    if probabilities:
        shown.append(
            F.array_join(F.transform("probability", lambda p: F.format_string("%.3f", p)), ", ").alias("probabilities")
        )
    return first.select(*shown)


def run_overview(models: DataFrame, test_size: float) -> DataFrame:
    """Total training time, model count and test share of a run."""
    return models.agg(
        F.sum(F.coalesce("fit_seconds", F.lit(0.0))).alias("total_seconds"),
        F.count(F.lit(1)).alias("n_models"),
    ).withColumn("test_share", F.lit(float(test_size)))


def format_metrics(metrics: DataFrame) -> DataFrame:
    """Metric values as the tables show them."""
    return metrics.withColumn("text", format_metric("value"))


def impurity_table(df: DataFrame, by: Sequence[str], target: str, classes: Sequence) -> DataFrame:
    """Entropy and Gini of the class counts of every group."""
    counted = df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        *[F.count_if(F.col(target) == F.lit(c)).alias(f"c{i}") for i, c in enumerate(classes)],
    )
    counts = [F.col(f"c{i}").cast("double") for i in range(len(classes))]
    return counted.select(
        *by, "n", impurity(counts, "entropy").alias("entropy"), impurity(counts, "gini").alias("gini")
    )


def chi_square_table(df: DataFrame, feature: str, target: str) -> DataFrame:
    """Statistic and degrees of freedom of a contingency table, in one row.

    Expected counts come from the margins; empty cells contribute their expected
    count, which is the row count minus what the filled cells expected.
    """
    cells = df.groupBy(F.col(feature).alias("r"), F.col(target).alias("c")).agg(F.count(F.lit(1)).alias("n"))
    total = cells.agg(F.sum("n").cast("double")).scalar()
    rows = F.sum("n").over(W.partitionBy("r"))
    columns = F.sum("n").over(W.partitionBy("c"))
    expected = rows * columns / total
    scored = cells.withColumn("e", expected).withColumn("n", F.col("n").cast("double"))
    return scored.agg(
        (F.sum((F.col("n") - F.col("e")) ** 2 / F.col("e")) + F.sum("n") - F.sum("e")).alias("statistic"),
        ((F.count_distinct("r") - 1) * (F.count_distinct("c") - 1)).alias("dof"),
    )


def best_threshold(
    df: DataFrame, by: Sequence[str], value: str, target: str, classes: Sequence,
    criterion: str = "gini", min_leaf: int = 1,
) -> DataFrame:
    """Cheapest binary cut of one column per group: first minimum, midpoint.

    Rows are counted by distinct value first; one prefix scan over the sorted values
    gives the class counts up to each and the value after it, so a large group is spread.
    """
    counted = df.groupBy(*by, F.col(value).cast("double").alias("v")).agg(
        *[F.count_if(F.col(target) == F.lit(c)).alias(f"n{i}") for i, c in enumerate(classes)]
    )
    names = {f"n{i}": f"l{i}" for i in range(len(classes))}
    scanned = prefix_scan(counted, by, "v", sums=names, after={"v": "next"})
    # The counts only rise, so the largest are those of the whole group.
    totals = scanned.groupBy(*by).agg(*[F.max(f"l{i}").alias(f"t{i}") for i in range(len(classes))])
    joined = scanned.join(totals, list(by)) if by else scanned.select(
        "*", *[totals.select(f"t{i}").scalar().alias(f"t{i}") for i in range(len(classes))]
    )
    l = [F.col(f"l{i}").cast("double") for i in range(len(classes))]
    r = [(F.col(f"t{i}") - F.col(f"l{i}")).cast("double") for i in range(len(classes))]
    nl, nr = sum(l[1:], l[0]), sum(r[1:], r[0])
    cost = (nl * impurity(l, criterion) + nr * impurity(r, criterion)) / (nl + nr)
    scored = joined.where(F.col("next").isNotNull()).select(
        *by, "v", ((F.col("v") + F.col("next")) / 2).alias("threshold"), cost.alias("cost"),
        nl.alias("nl"), nr.alias("nr"),
    ).where((F.col("nl") >= min_leaf) & (F.col("nr") >= min_leaf))
    best = F.struct(F.round("cost", 12).alias("k"), "v")
    return scored.groupBy(*by).agg(
        F.min_by("threshold", best).alias("threshold"), F.min_by("cost", best).alias("cost")
    )
