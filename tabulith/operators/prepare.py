"""Split, impute, encode, scale and assemble, fitted on the training part only.

Fitting reads the training rows twice (one aggregate for the numeric moments,
one frequency table for the categories).  What is fitted is a small record, so
applying it is a projection: no shuffle, except for columns with so many
categories that their code table has to be joined.
"""

from __future__ import annotations

import json
import math
from collections.abc import Sequence
from dataclasses import dataclass, field, asdict
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.quantiles import quantiles
from ..functions.ranking import order_hash, prefix_length, with_hash_rank
from ..functions.scalar import number
from ..session import collect_bounded, cut_lineage
from ..sources.tables import normalize_missing
from .profile import MAX_CLASSES, category_text, column_kinds, frequencies

# Defaults of the preparation stage.
SEED = 42
TEST_SIZE = 0.2
ONE_HOT_LIMIT = 10
INLINE_CODES = 256       # label codes kept in the record itself; more go to a table


# --- split -----------------------------------------------------------------

def class_quotas(counts: dict[Any, int], test_size: float) -> dict[Any, int]:
    """Test rows per class: largest remainder, ties by class value."""
    total = sum(counts.values())
    wanted = math.ceil(test_size * total)
    floors = {c: n * wanted // total for c, n in counts.items()}
    left = wanted - sum(floors.values())
    by_remainder = sorted(counts, key=lambda c: (-(counts[c] * wanted % total), str(c)))
    for c in by_remainder[:left]:
        floors[c] += 1
    return floors


def split_flag(
    df: DataFrame,
    key: str,
    target: str | None = None,
    problem_type: str = "clustering",
    test_size: float = TEST_SIZE,
    seed: int = SEED,
) -> tuple[Column, int]:
    """Boolean test-row expression and the row count.

    Rows are ordered by ``md5(seed:key)``.  Instead of ranking the whole table,
    the hash of the last test row of each class is looked up (counts by hash
    prefix, then one prefix bucket ranked), and the split is a plain comparison
    with it: no row is moved.
    """
    if not 0.0 < test_size < 1.0:
        raise ValueError("test_size must lie between 0 and 1.")
    stratified = problem_type == "classification"
    group = F.col(target) if stratified else F.lit(0)
    slim = df.select(group.alias("g"), order_hash(key, seed).alias("h"))
    rows = collect_bounded(
        slim.groupBy("g").agg(F.count(F.lit(1)).alias("n")), 1000, "The class count"
    )
    counts = {r["g"]: r["n"] for r in rows}
    total = sum(counts.values())
    if None in counts:
        raise ValueError(f"Target column '{target}' has missing values.")
    quotas = class_quotas(counts, test_size)
    n_test = sum(quotas.values())
    if total < 2 or n_test >= total:
        raise ValueError(f"Could not split {total} rows at test_size={test_size}.")
    if stratified:
        if min(counts.values()) < 2:
            raise ValueError("Every class needs at least two rows to split.")
        if n_test < len(counts) or total - n_test < len(counts):
            raise ValueError("Each side of the split needs at least one row per class.")

    digits = prefix_length(total)
    sizes = slim.groupBy("g", F.substring("h", 1, digits).alias("prefix")).agg(
        F.count(F.lit(1)).alias("n")
    )
    spark = df.sparkSession
    wanted = spark.createDataFrame(
        [(g, int(q)) for g, q in quotas.items() if q > 0],
        schema=f"g {slim.schema['g'].dataType.simpleString()}, quota bigint",
    )
    upto = F.sum("n").over(
        W.partitionBy("g").orderBy("prefix").rowsBetween(W.unboundedPreceding, 0)
    )
    edge = (
        sizes.withColumn("upto", upto)
        .join(F.broadcast(wanted), "g")
        .where((F.col("upto") >= F.col("quota")) & (F.col("upto") - F.col("n") < F.col("quota")))
        .select("g", "prefix", (F.col("quota") - F.col("upto") + F.col("n")).alias("rest"))
    )
    inside = (
        slim.withColumn("prefix", F.substring("h", 1, digits))
        .join(F.broadcast(edge), ["g", "prefix"])
        .withColumn("rn", F.row_number().over(W.partitionBy("g").orderBy("h")))
        .where(F.col("rn") == F.col("rest"))
    )
    limits = {r["g"]: r["h"] for r in inside.select("g", "h").collect()}
    h = order_hash(key, seed)
    flag = F.lit(False)
    for g, limit in limits.items():
        below = h <= F.lit(limit)
        flag = F.when(F.col(target) == F.lit(g), below).otherwise(flag) if stratified else below
    return flag, total


def split(df: DataFrame, key: str, target: str | None = None,
          problem_type: str = "clustering", test_size: float = TEST_SIZE,
          seed: int = SEED) -> DataFrame:
    """The table with a ``split`` column holding ``train`` or ``test``."""
    flag, _ = split_flag(df, key, target, problem_type, test_size, seed)
    return df.withColumn("split", F.when(flag, F.lit("test")).otherwise(F.lit("train")))


def kfold(df: DataFrame, key: str, target: str, k: int = 5, seed: int = SEED) -> DataFrame:
    """Stratified fold of every row: rank in its class by hash, modulo ``k``."""
    if k < 2:
        raise ValueError("k must be at least 2.")
    counts = collect_bounded(
        df.groupBy(target).agg(F.count(F.lit(1)).alias("n")), 1000, "The class count"
    )
    if min(r["n"] for r in counts) < k:
        raise ValueError(f"Each class needs at least {k} rows for {k} folds.")
    digits = prefix_length(sum(r["n"] for r in counts))
    ranked = with_hash_rank(
        df.withColumn("__h", order_hash(key, seed)), [target], "__h", "__rank", digits
    )
    return ranked.withColumn("fold", F.pmod(F.col("__rank") - 1, F.lit(k)).cast("int")).drop(
        "__h", "__rank"
    )


# --- fitted record ---------------------------------------------------------

@dataclass
class NumericFit:
    column: str
    median: float
    mean: float
    std: float


@dataclass
class CategoryFit:
    column: str
    mode: str
    strategy: str                      # "onehot" | "label"
    n_values: int
    values: list[str] = field(default_factory=list)   # sorted; empty if in a table


@dataclass
class FittedPrep:
    """Everything needed to transform new rows without looking at data again."""

    key: str
    target: str | None
    numeric: list[NumericFit]
    categorical: list[CategoryFit]
    codes: DataFrame | None = None     # (column, value, code) of large columns

    @property
    def feature_names(self) -> list[str]:
        names = [n.column for n in self.numeric]
        for c in self.categorical:
            names += [f"{c.column}={v}" for v in c.values] if c.strategy == "onehot" else [c.column]
        return names

    @property
    def input_columns(self) -> list[str]:
        return [n.column for n in self.numeric] + [c.column for c in self.categorical]

    def to_json(self) -> str:
        return json.dumps(
            {"key": self.key, "target": self.target,
             "numeric": [asdict(n) for n in self.numeric],
             "categorical": [asdict(c) for c in self.categorical]}
        )

    @staticmethod
    def from_json(text: str, codes: DataFrame | None = None) -> "FittedPrep":
        d = json.loads(text)
        return FittedPrep(
            d["key"], d["target"], [NumericFit(**n) for n in d["numeric"]],
            [CategoryFit(**c) for c in d["categorical"]], codes,
        )


def fit_numeric(train: DataFrame, columns: Sequence[str]) -> list[NumericFit]:
    """Median, and mean and population std after filling with it.

    Filling changes the moments in closed form, so they take one pass beside the median's.
    """
    if not columns:
        return []
    aggregates = []
    for i, c in enumerate(columns):
        x = F.col(c).cast("double")
        aggregates += [F.count(x).alias(f"n{i}"), F.avg(x).alias(f"m{i}"), F.var_pop(x).alias(f"v{i}")]
    row = train.agg(F.count(F.lit(1)).alias("rows"), *aggregates).first()
    medians = quantiles(train, columns, [0.5])
    fits = []
    for i, c in enumerate(columns):
        if not row[f"n{i}"]:
            raise ValueError(f"Column '{c}' has no value in the training part.")
        median = float(medians[c][0])
        seen, filled = row[f"n{i}"], row["rows"] - row[f"n{i}"]
        total = row["rows"]
        mean = (seen * row[f"m{i}"] + filled * median) / total
        var = (
            seen * (row[f"v{i}"] + (row[f"m{i}"] - mean) ** 2) + filled * (median - mean) ** 2
        ) / total
        std = math.sqrt(var)
        fits.append(NumericFit(c, median, mean, std if std > 0 else 1.0))
    return fits


def fit_categories(
    train: DataFrame, columns: Sequence[str], inline: int = INLINE_CODES
) -> tuple[list[CategoryFit], DataFrame | None]:
    """Mode, strategy and sorted categories per column from one frequency table."""
    if not columns:
        return [], None
    counts = cut_lineage(frequencies(train, columns))
    facts = {
        r["column"]: r
        for r in counts.groupBy("column").agg(
            F.count(F.lit(1)).alias("n_values"),
            F.min_by("value", F.struct(-F.col("n"), F.col("value"))).alias("mode"),
        ).collect()
    }
    for c in columns:
        if c not in facts:
            raise ValueError(f"Column '{c}' has no value in the training part.")
    small = [c for c in columns if facts[c]["n_values"] <= inline]
    large = [c for c in columns if facts[c]["n_values"] > inline]
    values: dict[str, list[str]] = {c: [] for c in columns}
    if small:
        for r in counts.where(F.col("column").isin(small)).select("column", "value").collect():
            values[r["column"]].append(r["value"])
    fits = [
        CategoryFit(
            c, facts[c]["mode"],
            "onehot" if facts[c]["n_values"] <= ONE_HOT_LIMIT else "label",
            facts[c]["n_values"], sorted(values[c]),
        )
        for c in columns
    ]
    codes = None
    for c in large:
        part = sorted_codes(counts.where(F.col("column") == c), facts[c]["n_values"])
        codes = part if codes is None else codes.unionByName(part)
    return fits, codes


def sorted_codes(values: DataFrame, n_values: int, one_task: int = 200_000) -> DataFrame:
    """``(column, value, code)`` with codes 0..n-1 in sorted order of the value.

    Large value sets are range-partitioned by value and numbered per partition;
    the partition sizes give the offsets.
    """
    if n_values <= one_task:
        order = W.partitionBy("column").orderBy("value")
        return values.select(
            "column", "value", (F.row_number().over(order) - 1).cast("bigint").alias("code")
        )
    parts = max(2, n_values // one_task)
    placed = cut_lineage(
        values.select("column", "value").repartitionByRange(parts, "value")
        .withColumn("part", F.spark_partition_id())
    )
    sizes = placed.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    before = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    offsets = sizes.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    inside = W.partitionBy("part").orderBy("value")
    return (
        placed.withColumn("rn", F.row_number().over(inside)).join(offsets, "part")
        .select("column", "value", (F.col("rn") - 1 + F.col("offset")).cast("bigint").alias("code"))
    )


# --- applying --------------------------------------------------------------

def column_diff(expected: Sequence[str], actual: Sequence[str]) -> dict[str, list[str]]:
    """Missing and unexpected column names, sorted."""
    return {
        "missing": sorted(set(expected) - set(actual)),
        "unexpected": sorted(set(actual) - set(expected)),
    }


def imputed_number(fit: NumericFit) -> Column:
    x = F.col(fit.column).cast("double")
    return F.coalesce(F.when(~F.isnan(x), x), F.lit(fit.median))


def scaled(fit: NumericFit) -> Column:
    return (imputed_number(fit) - F.lit(fit.mean)) / F.lit(fit.std)


def imputed_category(fit: CategoryFit) -> Column:
    return F.coalesce(F.col(fit.column).cast("string"), F.lit(fit.mode))


def one_hot(fit: CategoryFit) -> list[Column]:
    x = imputed_category(fit)
    return [(x == F.lit(v)).cast("double") for v in fit.values]


def inline_code(fit: CategoryFit) -> Column:
    """Position in the sorted list; an unseen value gets the next code."""
    literal = F.array(*[F.lit(v) for v in fit.values])
    found = F.array_position(literal, imputed_category(fit))
    return F.when(found > 0, found - 1).otherwise(F.lit(fit.n_values)).cast("double")


def transform(
    df: DataFrame, prep: FittedPrep, keep: Sequence[str] = (), flat: bool = False
) -> DataFrame:
    """``row_id``, kept columns and the features, as one array or as columns.

    Inline parameters become literals.  Only columns with a code table are
    joined, without a hint: a table too large to broadcast is shuffled and AQE
    splits hot values.
    """
    joined = df
    codes: dict[str, Column] = {}
    for i, c in enumerate(prep.categorical):
        if c.strategy != "label":
            continue
        if c.values:
            codes[c.column] = inline_code(c)
            continue
        table = prep.codes.where(F.col("column") == c.column).select(
            F.col("value").alias(f"__v{i}"), F.col("code").alias(f"__c{i}")
        )
        joined = joined.join(table, imputed_category(c) == F.col(f"__v{i}"), "left").drop(f"__v{i}")
        codes[c.column] = F.coalesce(F.col(f"__c{i}"), F.lit(c.n_values)).cast("double")
    features: list[Column] = [scaled(n) for n in prep.numeric]
    for c in prep.categorical:
        features += one_hot(c) if c.strategy == "onehot" else [codes[c.column]]
    if not features:
        raise ValueError("The table has no columns to build features from.")
    head = [F.col(prep.key).alias("row_id"), *[F.col(k) for k in keep]]
    if flat:
        return joined.select(*head, *[x.alias(f"f{i}") for i, x in enumerate(features)])
    return joined.select(*head, F.array(*features).alias("features"))


def transform_new(df: DataFrame, prep: FittedPrep) -> DataFrame:
    """Apply to new rows; any column mismatch is refused before a job starts."""
    actual = [c for c in df.columns if c not in (prep.key, prep.target)]
    diff = column_diff(prep.input_columns, actual)
    if diff["missing"] or diff["unexpected"]:
        raise ValueError(f"Columns do not match the fitted columns: {diff}")
    return transform(df, prep)


@dataclass
class Prepared:
    """Both parts as ``(row_id, label, features)`` plus what was fitted."""

    train: DataFrame
    test: DataFrame
    prep: FittedPrep
    problem_type: str
    target: str | None
    n_rows: int
    test_size: float

    @property
    def feature_names(self) -> list[str]:
        return self.prep.feature_names


def fit_prepare(
    df: DataFrame,
    key: str,
    target: str | None,
    problem_type: str,
    test_size: float = TEST_SIZE,
    seed: int = SEED,
) -> Prepared:
    """Split, then fit imputation, encoding and scaling on train, then apply."""
    df = normalize_missing(df)
    numeric, categorical = column_kinds(df, exclude=[key] + ([target] if target else []))
    if not numeric and not categorical:
        raise ValueError("The table has no columns to build features from.")
    flag, n_rows = split_flag(df, key, target, problem_type, test_size, seed)
    train, test = df.where(~flag), df.where(flag)
    categories, codes = fit_categories(train, categorical)
    prep = FittedPrep(
        key, target, fit_numeric(train, numeric), categories, codes
    )
    keep = [target] if target else []

    def part(rows: DataFrame) -> DataFrame:
        out = transform(rows, prep, keep)
        return out.withColumnRenamed(target, "label") if target else out.withColumn(
            "label", F.lit(None).cast("string")
        )

    return Prepared(part(train), part(test), prep, problem_type, target, n_rows, test_size)


# --- extra feature builders ------------------------------------------------

def poly_expressions(features: str, d: int, degree: int = 2, limit: int = 5000) -> list[tuple[tuple[int, ...], str]]:
    """SQL text of every monomial up to ``degree`` of an array column."""
    from itertools import combinations_with_replacement

    out = []
    for power in range(1, degree + 1):
        for combo in combinations_with_replacement(range(d), power):
            out.append((combo, " * ".join(f"{features}[{i}]" for i in combo)))
            if len(out) > limit:
                raise ValueError(f"Expansion has more than {limit} features.")
    return out


def poly_features(df: DataFrame, features: str, d: int, degree: int = 2, out: str = "poly") -> DataFrame:
    """All monomials up to ``degree`` as one array."""
    terms = poly_expressions(features, d, degree)
    return df.withColumn(out, F.expr("array(" + ", ".join(t for _, t in terms) + ")"))


def bin_edges(
    df: DataFrame, columns: Sequence[str], n_bins: int
) -> dict[str, list[float]]:
    """Midpoints for few distinct values, else interior quantiles, per column."""
    probabilities = [i / n_bins for i in range(1, n_bins)]
    levels = quantiles(df, columns, [0.0, *probabilities, 1.0])
    # the estimate only decides which columns are worth an exact distinct list
    guess = df.agg(
        *[F.approx_count_distinct(F.col(c)).alias(f"u{i}") for i, c in enumerate(columns)]
    ).first()
    candidates = {c for i, c in enumerate(columns) if guess[i] <= 2 * n_bins + 10}
    edges: dict[str, list[float]] = {}
    for c in columns:
        q = levels[c]
        if q is None or q[0] == q[-1]:
            edges[c] = []
            continue
        low, high = q[0], q[-1]
        values = few_distinct(df, c, n_bins) if c in candidates else None
        if values is not None:
            edges[c] = [(a + b) / 2.0 for a, b in zip(values, values[1:])]
            continue
        inner = sorted({x for x in q[1:-1] if low <= x < high})
        edges[c] = inner or [(low + high) / 2.0]
    return edges


def few_distinct(df: DataFrame, column: str, limit: int) -> list[float] | None:
    """The sorted distinct values if there are at most ``limit``, else ``None``."""
    x = F.col(column).cast("double")
    rows = df.select(x.alias("v")).where("v is not null").distinct().take(limit + 1)
    return sorted(r["v"] for r in rows) if len(rows) <= limit else None


def bin_index(column: str | Column, edges: Sequence[float]) -> Column:
    """Number of edges at or below the value (value on an edge goes right)."""
    x = F.col(column) if isinstance(column, str) else column
    if not edges:
        return F.lit(0)
    literal = F.expr("array(" + ", ".join(number(e) for e in edges) + ")")
    return F.size(F.filter(literal, lambda e: e <= x))


def discretize(df: DataFrame, edges: dict[str, list[float]], suffix: str = "_bin") -> DataFrame:
    return df.select(
        "*", *[bin_index(F.col(c).cast("double"), e).alias(f"{c}{suffix}") for c, e in edges.items()]
    )
