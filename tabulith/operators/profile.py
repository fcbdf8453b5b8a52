"""Checks and profile of a raw table, and the class-imbalance flag.

One wide aggregate gives the moments; one long ``(column, value, n)`` frequency
table answers everything about distinct values.  That table is built with
map-side counting, so a value holding a third of all rows is one shuffled row
per task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from ..functions.quantiles import quantiles
from ..sources.tables import normalize_missing

# Limits and sizes the profile screens rely on.
MIN_ROWS = 50
MAX_COLUMNS = 100
HISTOGRAM_BINS = 10
TOP_CATEGORIES = 20
MIN_CLASSES = 2
MAX_CLASSES = 10
LOWER_SHARE = 0.20
UPPER_SHARE = 0.80
IMBALANCE_MESSAGE = "Class imbalance present; predictions may be biased."


def is_numeric(field: T.StructField) -> bool:
    return isinstance(field.dataType, T.NumericType)


def column_kinds(df: DataFrame, exclude: Sequence[str] = ()) -> tuple[list[str], list[str]]:
    """Numeric and categorical columns in table order; nested types are refused."""
    numeric, categorical = [], []
    for field in df.schema.fields:
        if field.name in exclude:
            continue
        if isinstance(field.dataType, (T.ArrayType, T.MapType, T.StructType, T.BinaryType)):
            raise ValueError(
                f"Column '{field.name}' is {field.dataType.simpleString()}; "
                "project it to plain columns first."
            )
        (numeric if is_numeric(field) else categorical).append(field.name)
    return numeric, categorical


def category_text(df: DataFrame, column: str) -> Column:
    """Text of a categorical value; dates and booleans take their Spark text."""
    return F.col(column).cast("string")


# --- checks ----------------------------------------------------------------

def validate_table(df: DataFrame) -> DataFrame:
    """The three reject rules; one row per broken rule.

    The row rule reads at most fifty rows; the other two look at the schema.
    """
    n_columns = len(df.columns)
    n_numeric = sum(1 for f in df.schema.fields if is_numeric(f))
    few_rows = df.limit(MIN_ROWS).agg(F.count(F.lit(1)).alias("observed"))
    rules = few_rows.select(
        F.explode(
            F.array(
                F.struct(F.lit("min_rows").alias("rule"), F.col("observed"),
                         F.lit(MIN_ROWS).cast("bigint").alias("bound"),
                         (F.col("observed") < MIN_ROWS).alias("broken")),
                F.struct(F.lit("max_columns").alias("rule"),
                         F.lit(n_columns).cast("bigint").alias("observed"),
                         F.lit(MAX_COLUMNS).cast("bigint").alias("bound"),
                         F.lit(n_columns > MAX_COLUMNS).alias("broken")),
                F.struct(F.lit("numeric_columns").alias("rule"),
                         F.lit(n_numeric).cast("bigint").alias("observed"),
                         F.lit(1).cast("bigint").alias("bound"),
                         F.lit(n_numeric == 0).alias("broken")),
            )
        ).alias("r")
    ).select("r.*")
    return rules.where("broken").drop("broken")


def require_valid(df: DataFrame) -> None:
    broken = validate_table(df).collect()
    if broken:
        raise ValueError(
            "Table rejected: " + "; ".join(f"{r['rule']}={r['observed']}" for r in broken)
        )


def resolve_target(df: DataFrame, target: str | None = None, has_target: bool = True) -> str | None:
    """The named target, the last column, or none for clustering."""
    if not has_target:
        return None
    if target is None:
        return df.columns[-1]
    if target not in df.columns:
        raise ValueError(f"Target column '{target}' not found in the table.")
    return target


def problem_type_table(df: DataFrame, target: str) -> DataFrame:
    """Distinct-count rule as a one-row table."""
    x = F.col(target)
    field = df.schema[target]
    if isinstance(field.dataType, (T.FloatType, T.DoubleType)):
        x = F.when(~F.isnan(x), x)
    distinct = df.select(x.alias("v")).where("v is not null").distinct()
    return distinct.agg(F.count(F.lit(1)).alias("n_unique")).select(
        F.lit(target).alias("target_column"),
        "n_unique",
        F.when(F.col("n_unique") < MIN_CLASSES, F.lit("invalid"))
        .when(F.col("n_unique") <= MAX_CLASSES, F.lit("classification"))
        .otherwise(F.lit("regression"))
        .alias("problem_type"),
    )


def infer_problem_type(
    df: DataFrame, target: str | None = None, has_target: bool = True
) -> str:
    """``classification``, ``regression`` or ``clustering``.

    Only eleven distinct values are ever needed, so the count stops there.
    """
    target = resolve_target(df, target, has_target)
    if target is None:
        return "clustering"
    clean = normalize_missing(df.select(target)).where(F.col(target).isNotNull())
    n = clean.distinct().limit(MAX_CLASSES + 1).count()
    if n < MIN_CLASSES:
        raise ValueError(
            f"Target column '{target}' has {n} unique value(s); at least "
            f"{MIN_CLASSES} are required."
        )
    return "classification" if n <= MAX_CLASSES else "regression"


def report_columns(df: DataFrame, target: str | None, limit: int = 20) -> DataFrame:
    """Columns as the report shows them: target first, at most ``limit``."""
    ordered = ([target] if target else []) + [c for c in df.columns if c != target]
    return df.select(*ordered[:limit])


def drop_target(df: DataFrame, target: str | None) -> DataFrame:
    return df.drop(target) if target else df


# --- profile ---------------------------------------------------------------

def frequencies(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Long ``(column, value, n)`` table of non-null values as text."""
    columns = list(columns or df.columns)
    pairs = F.explode(
        F.array(
            *[
                F.struct(F.lit(c).alias("column"), category_text(df, c).alias("value"))
                for c in columns
            ]
        )
    )
    return (
        df.select(pairs.alias("p")).select("p.column", "p.value")
        .where(F.col("value").isNotNull())
        .groupBy("column", "value")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def distinct_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``(column, unique_count)`` of numeric columns.

    Whole numbers and fractions keep their own slots, so nothing is turned into
    text and no digit is lost.
    """

    def slots(c: str) -> Column:
        kind = df.schema[c].dataType
        whole = isinstance(kind, T.IntegralType)
        real = isinstance(kind, T.FractionalType) and not isinstance(kind, T.DecimalType)
        return F.struct(
            F.lit(c).alias("column"),
            (F.col(c).cast("bigint") if whole else F.lit(None).cast("bigint")).alias("whole"),
            (F.col(c).cast("double") if real else F.lit(None).cast("double")).alias("real"),
            (F.lit(None).cast("string") if whole or real else F.col(c).cast("string")).alias("text"),
        )

    long = df.select(F.explode(F.array(*[slots(c) for c in columns])).alias("p")).select("p.*")
    present = F.coalesce(F.col("whole").isNotNull() | F.col("real").isNotNull() | F.col("text").isNotNull(), F.lit(False))
    return long.where(present).distinct().groupBy("column").agg(F.count(F.lit(1)).alias("unique_count"))


def profile_numeric(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Missing, unique, mean, sample std, min, max, median; one row per column."""
    df = normalize_missing(df)
    columns = list(columns) if columns is not None else column_kinds(df)[0]
    df = df.select(*columns)
    unique = distinct_counts(df, columns)
    aggregates = [F.count(F.lit(1)).alias("rows")]
    for i, c in enumerate(columns):
        x = F.col(c).cast("double")
        aggregates += [
            F.count(x).alias(f"n{i}"), F.avg(x).alias(f"mean{i}"),
            F.stddev_samp(x).alias(f"std{i}"), F.min(x).alias(f"min{i}"),
            F.max(x).alias(f"max{i}"),
        ]
    wide = df.agg(*aggregates)
    medians = quantiles(df, columns, [0.5])
    rows = [
        F.struct(
            F.lit(c).alias("column"),
            (F.col("rows") - F.col(f"n{i}")).alias("missing_count"),
            F.when(F.col("rows") > 0, (F.col("rows") - F.col(f"n{i}")) / F.col("rows"))
            .otherwise(F.lit(0.0)).alias("missing_pct"),
            F.col(f"mean{i}").alias("mean"),
            F.when(F.col(f"n{i}") > 1, F.col(f"std{i}")).alias("std"),
            F.col(f"min{i}").alias("min"),
            F.col(f"max{i}").alias("max"),
            F.lit(medians[c][0] if medians[c] else None).cast("double").alias("median"),
        )
        for i, c in enumerate(columns)
    ]
    return (
        wide.select(F.explode(F.array(*rows)).alias("r")).select("r.*")
        .join(unique, "column", "left")
        .withColumn("unique_count", F.coalesce("unique_count", F.lit(0)).cast("bigint"))
    )


def profile_categorical(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Missing, unique, most frequent value (ties: smallest) and its count."""
    columns = list(columns) if columns is not None else column_kinds(df)[1]
    df = df.select(*columns)
    counts = (
        frequencies(df, columns).groupBy("column").agg(
            F.sum("n").alias("present"),
            F.count(F.lit(1)).alias("unique_count"),
            F.min_by("value", F.struct(-F.col("n"), F.col("value"))).alias("top_value"),
            F.max("n").alias("top_value_freq"),
        )
    )
    names = df.agg(F.count(F.lit(1)).alias("rows")).select(
        "rows", F.explode(F.array(*[F.lit(c) for c in columns])).alias("column")
    )
    present = F.coalesce("present", F.lit(0))
    return names.join(counts, "column", "left").select(
        "column",
        (F.col("rows") - present).alias("missing_count"),
        F.when(F.col("rows") > 0, (F.col("rows") - present) / F.col("rows"))
        .otherwise(F.lit(0.0)).alias("missing_pct"),
        F.coalesce("unique_count", F.lit(0)).cast("bigint").alias("unique_count"),
        "top_value",
        "top_value_freq",
    )


def histogram(
    df: DataFrame, columns: Sequence[str] | None = None, bins: int = HISTOGRAM_BINS
) -> DataFrame:
    """Equal-width bins per numeric column, the last one closed on the right.

    A constant column gets the range ``[v - 0.5, v + 0.5]``.  Only the range
    table (one row per column) is broadcast.
    """
    df = normalize_missing(df)
    columns = list(columns) if columns is not None else column_kinds(df)[0]
    long = df.select(
        F.explode(
            F.array(
                *[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("x"))
                  for c in columns]
            )
        ).alias("p")
    ).select("p.*").where("x is not null")
    wide = df.agg(
        *[F.min(F.col(c).cast("double")).alias(f"lo{i}") for i, c in enumerate(columns)],
        *[F.max(F.col(c).cast("double")).alias(f"hi{i}") for i, c in enumerate(columns)],
    )
    ranges = wide.select(
        F.explode(
            F.array(
                *[F.struct(F.lit(c).alias("column"), F.col(f"lo{i}").alias("lo"),
                           F.col(f"hi{i}").alias("hi")) for i, c in enumerate(columns)]
            )
        ).alias("r")
    ).select("r.*").where("lo is not null").select(
        "column",
        F.when(F.col("lo") == F.col("hi"), F.col("lo") - 0.5).otherwise(F.col("lo")).alias("lo"),
        F.when(F.col("lo") == F.col("hi"), F.col("hi") + 0.5).otherwise(F.col("hi")).alias("hi"),
    )
    position = F.floor((F.col("x") - F.col("lo")) * bins / (F.col("hi") - F.col("lo")))
    counted = (
        long.join(F.broadcast(ranges), "column")
        .groupBy("column", F.least(position, F.lit(bins - 1)).cast("int").alias("bin"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
    frame = ranges.select("column", "lo", "hi", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    step = (F.col("hi") - F.col("lo")) / bins
    return frame.join(counted, ["column", "bin"], "left").select(
        "column", "bin",
        (F.col("lo") + F.col("bin") * step).alias("lower"),
        F.when(F.col("bin") == bins - 1, F.col("hi"))
        .otherwise(F.col("lo") + (F.col("bin") + 1) * step).alias("upper"),
        F.coalesce("n", F.lit(0)).cast("bigint").alias("n"),
    )


def top_categories(
    df: DataFrame, columns: Sequence[str] | None = None, limit: int = TOP_CATEGORIES
) -> DataFrame:
    """Most frequent values per column plus one ``Other`` total.

    The rank filter is applied before the shuffle as well (window group limit),
    and ``Other`` is the column total minus the listed counts, so no task ever
    holds all distinct values of a column.
    """
    columns = list(columns) if columns is not None else column_kinds(df)[1]
    counts = frequencies(df.select(*columns), columns)
    order = W.partitionBy("column").orderBy(F.desc("n"), F.asc("value"))
    top = counts.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit)
    totals = counts.groupBy("column").agg(F.sum("n").alias("total"))
    listed = top.groupBy("column").agg(F.sum("n").alias("listed"))
    other = (
        totals.join(listed, "column").where(F.col("total") > F.col("listed"))
        .select("column", F.lit(limit + 1).alias("rank"), F.lit("Other").alias("value"),
                (F.col("total") - F.col("listed")).alias("n"))
    )
    return top.select("column", "rank", "value", "n").unionByName(other)


def distribution_buckets(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Chart buckets of every column, with the most common one marked."""
    chosen = df.select(*columns) if columns else df
    numeric, categorical = column_kinds(chosen)
    parts = []
    if numeric:
        label = F.concat(F.format_string("%.1f", "lower"), F.lit("–"), F.format_string("%.1f", "upper"))
        parts.append(
            histogram(chosen, numeric).select("column", F.col("bin").alias("position"), label.alias("label"), "n")
        )
    if categorical:
        parts.append(
            top_categories(chosen, categorical).select(
                "column", (F.col("rank") - 1).alias("position"), F.col("value").alias("label"), "n"
            )
        )
    buckets = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    first_max = W.partitionBy("column")
    best = F.min_by("position", F.struct(-F.col("n"), F.col("position"))).over(first_max)
    return buckets.withColumn("most_common", F.col("position") == best)


def class_imbalance(df: DataFrame, target: str) -> DataFrame:
    """Class counts and the flag: any share strictly below 20 % or above 80 %."""
    counts = (
        df.where(F.col(target).isNotNull())
        .groupBy(category_text(df, target).alias("label"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
    total = counts.agg(F.sum("n")).scalar()
    shared = counts.withColumn("share", F.col("n") / total)
    flag = shared.agg(
        F.bool_or((F.col("share") < LOWER_SHARE) | (F.col("share") > UPPER_SHARE))
    ).scalar()
    return shared.withColumn("is_imbalanced", flag).withColumn(
        "message", F.when(F.col("is_imbalanced"), F.lit(IMBALANCE_MESSAGE))
    )


def profile_dataset(
    df: DataFrame, target: str | None = None, has_target: bool = True
) -> DataFrame:
    """All columns in table order with table-level fields repeated."""
    df = normalize_missing(df)
    target = resolve_target(df, target, has_target)
    kind = infer_problem_type(df, target, has_target)
    numeric, categorical = column_kinds(df)
    none_double, none_text, none_long = (
        F.lit(None).cast("double"), F.lit(None).cast("string"), F.lit(None).cast("bigint")
    )
    parts = []
    if numeric:
        parts.append(
            profile_numeric(df, numeric).select(
                "column", F.lit("numeric").alias("dtype"), "missing_count", "missing_pct",
                "unique_count", "mean", "std", "min", "max", "median",
                none_text.alias("top_value"), none_long.alias("top_value_freq"),
            )
        )
    if categorical:
        parts.append(
            profile_categorical(df, categorical).select(
                "column", F.lit("categorical").alias("dtype"), "missing_count", "missing_pct",
                "unique_count", none_double.alias("mean"), none_double.alias("std"),
                none_double.alias("min"), none_double.alias("max"), none_double.alias("median"),
                "top_value", "top_value_freq",
            )
        )
    columns = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    n_rows = df.agg(F.count(F.lit(1))).scalar()
    order = F.array_position(F.array(*[F.lit(c) for c in df.columns]), F.col("column")) - 1
    return columns.select(
        order.cast("bigint").alias("position"), "*", n_rows.alias("n_rows"),
        F.lit(len(df.columns)).cast("bigint").alias("n_columns"),
        F.lit(kind).alias("data_type"),
        F.lit(target).cast("string").alias("target_column"),
        F.coalesce(F.col("column") == F.lit(target), F.lit(False)).alias("is_target"),
    )
