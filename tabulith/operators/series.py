"""Ordered-series operators: differences, lookback rows, anchored sums, forecasts.

Every operator takes an explicit order column and series columns.  Rows are dealt out by
range and scanned with carries, so one series holding most rows is still spread.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.ranking import previous_value, running_sum

# Fixed values of the one-feature regression.
VARIANCE_RATIO = 1.5
RATIO_EPSILON = 1e-12


def difference(
    df: DataFrame, by: Sequence[str], order: str, value: str, out: str = "diff"
) -> DataFrame:
    """First difference; the first row of a series has NULL."""
    lagged = previous_value(df, by, order, {value: "__prev"}, 1)
    return lagged.withColumn(out, F.col(value) - F.col("__prev_1")).drop("__prev_1")


def lookback(
    df: DataFrame, by: Sequence[str], order: str, columns: Sequence[str], steps: int
) -> DataFrame:
    """``features`` = the ``steps`` rows before, oldest first, step by step.

    Rows without a full history are left out.
    """
    lagged = previous_value(df, by, order, {c: f"__p_{c}" for c in columns}, steps)
    flat = [F.col(f"__p_{c}_{k}") for k in range(steps, 0, -1) for c in columns]
    complete = F.lit(True)
    for x in flat:
        complete = complete & x.isNotNull()
    return (
        lagged.where(complete)
        .withColumn("features", F.array(*[x.cast("double") for x in flat]))
        .drop(*[f"__p_{c}_{k}" for c in columns for k in range(1, steps + 1)])
    )


def anchored_sum(
    df: DataFrame, by: Sequence[str], order: str, value: str, anchor: str,
    out: str = "level",
) -> DataFrame:
    """Running sum of predicted differences on top of the last known level."""
    summed = running_sum(df, by, order, {value: "__sum"})
    return summed.withColumn(out, F.col("__sum") + F.col(anchor)).drop("__sum")


def stationarity(
    df: DataFrame, by: Sequence[str], order: str, value: str,
    threshold: float = VARIANCE_RATIO,
) -> DataFrame:
    """var(y) / var(diff y) per series and whether it calls for differencing."""
    ratio = F.col("var_level") / (F.col("var_diff") + F.lit(RATIO_EPSILON))
    return (
        difference(df, by, order, value, "__d")
        .groupBy(*by)
        .agg(F.var_pop(value).alias("var_level"), F.var_pop("__d").alias("var_diff"))
        .withColumn("ratio", ratio)
        .withColumn("differenced", F.col("ratio") > threshold)
    )


def fit_series(
    df: DataFrame, by: Sequence[str], order: str, x: str, y: str,
    threshold: float = VARIANCE_RATIO,
) -> DataFrame:
    """One-feature regression of many series in one job.

    A series with a high variance ratio is fitted on differences and remembers
    its last level; the others are fitted on the levels.
    """
    with_diff = difference(df, by, order, y, "__d")
    per_series = with_diff.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        (F.var_pop(y) / (F.var_pop("__d") + F.lit(RATIO_EPSILON))).alias("ratio"),
        F.regr_slope(F.col("__d"), F.col(x)).alias("slope_diff"),
        F.regr_intercept(F.col("__d"), F.col(x)).alias("intercept_diff"),
        F.regr_slope(F.col(y), F.col(x)).alias("slope_level"),
        F.regr_intercept(F.col(y), F.col(x)).alias("intercept_level"),
        F.max_by(y, order).alias("last_level"), F.avg("__d").alias("mean_diff"), F.avg(y).alias("mean_level"),
    )
    differenced = F.col("ratio") > threshold
    return per_series.select(
        *by, "n", "ratio", differenced.alias("differenced"),
        F.when(differenced, F.col("slope_diff")).otherwise(F.col("slope_level")).alias("slope"),
        F.when(differenced, F.col("intercept_diff")).otherwise(F.col("intercept_level")).alias("intercept"),
        F.when(differenced, F.col("last_level")).alias("last_level"), "mean_diff", "mean_level",
    )


def predict_series(
    df: DataFrame, fitted: DataFrame, by: Sequence[str], order: str, x: str
) -> DataFrame:
    """Apply ``fit_series``; differenced series are summed up from their anchor."""
    scored = df.join(fitted.select(*by, "differenced", "slope", "intercept", "last_level"), list(by))
    scored = scored.withColumn("__step", F.col("slope") * F.col(x) + F.col("intercept"))
    summed = running_sum(scored, by, order, {"__step": "__sum"})
    return summed.withColumn(
        "prediction",
        F.when(F.col("differenced"), F.col("__sum") + F.col("last_level")).otherwise(F.col("__step")),
    ).drop("__step", "__sum", "differenced", "slope", "intercept", "last_level")
