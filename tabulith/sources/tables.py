"""Reading, cleaning and writing tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

# Texts a CSV reader of the data-frame kind takes as missing.
NA_TOKENS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
    "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a",
    "nan", "null",
)


def read_table(spark: SparkSession, directory: str, name: str) -> DataFrame:
    """A dataset addressed by its id inside a folder of parquet tables."""
    return spark.read.parquet(f"{directory.rstrip('/')}/{name}.parquet")


def read_csv(
    spark: SparkSession, path: str, schema: T.StructType | None = None, multi_line: bool | None = None
) -> DataFrame:
    """CSV with a header row; missing-value texts become NULL.

    With a schema the file is read once.  Without one, a first text-only pass
    decides for every column whether all its values are whole numbers, numbers,
    booleans or text.  Rows with the wrong number of fields fail the read.

    Quoted fields may hold commas, doubled quotes and line breaks.  A file with line
    breaks in fields is read by one task.  Whether there are any is found by a first
    distributed pass over the lines, unless ``multi_line`` says so.
    """
    if multi_line is None:
        multi_line = not _whole_lines(spark, path)
    quoting = {"quote": '"', "escape": '"', "multiLine": multi_line}
    header = spark.read.options(header=True, inferSchema=False, **quoting).csv(path)
    if not header.columns:
        raise ValueError("The CSV has no columns.")
    text_schema = T.StructType([T.StructField(c, T.StringType()) for c in header.columns])
    raw = (
        spark.read.schema(text_schema)
        .options(header=True, mode="FAILFAST", enforceSchema=False, **quoting)
        .csv(path)
    )
    cleaned = raw.select(
        *[
            F.when(~F.trim(F.col(_q(c))).isin(*NA_TOKENS), F.col(_q(c))).alias(c)
            for c in raw.columns
        ]
    )
    if schema is None:
        schema = _infer(cleaned)
    elif [f.name for f in schema.fields] != cleaned.columns:
        raise ValueError("The CSV header does not match the given schema.")
    return cleaned.select(
        *[F.col(_q(f.name)).cast(f.dataType).alias(f.name) for f in schema.fields]
    )


def _whole_lines(spark: SparkSession, path: str) -> bool:
    """Whether every line is a list of complete fields, so that no record goes on in the next line."""
    line = F.concat(F.lit(","), F.regexp_replace("value", '""', ""))
    left = F.regexp_replace(line, r',(?:"[^"]*+"|[^",]*+)(?=,|\z)', "")
    return spark.read.text(path).where(left != "").isEmpty()


def _q(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def _infer(df: DataFrame) -> T.StructType:
    checks = []
    for i, c in enumerate(df.columns):
        x = F.col(_q(c))
        checks += [
            F.count(x).alias(f"n{i}"),
            F.count_if(x.isNotNull() & x.try_cast("bigint").isNotNull()
                       & ~x.contains(".")).alias(f"l{i}"),
            F.count_if(x.isNotNull() & x.try_cast("double").isNotNull()).alias(f"d{i}"),
            F.count_if(F.lower(x).isin("true", "false")).alias(f"b{i}"),
        ]
    row = df.agg(*checks).first()
    fields = []
    for i, c in enumerate(df.columns):
        n = row[f"n{i}"]
        if n and row[f"l{i}"] == n:
            kind: T.DataType = T.LongType()
        elif row[f"d{i}"] == n:
            kind = T.DoubleType()
        elif row[f"b{i}"] == n:
            kind = T.BooleanType()
        else:
            kind = T.StringType()
        fields.append(T.StructField(c, kind))
    return T.StructType(fields)


def normalize_missing(df: DataFrame) -> DataFrame:
    """NaN in floating-point columns becomes NULL; nothing else changes."""
    floats = {
        f.name for f in df.schema.fields if isinstance(f.dataType, (T.FloatType, T.DoubleType))
    }
    if not floats:
        return df
    return df.select(
        *[
            F.when(~F.isnan(F.col(_q(c))), F.col(_q(c))).alias(c) if c in floats else F.col(_q(c))
            for c in df.columns
        ]
    )


def text_of(field: T.StructField) -> Column:
    """Reproducible text of a value, the same on other engines."""
    c = F.col(_q(field.name))
    if isinstance(field.dataType, (T.FloatType, T.DoubleType)):
        return F.round(c * 1_000_000).cast("bigint").cast("string")
    if isinstance(field.dataType, (T.TimestampType, T.TimestampNTZType)):
        return F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS")
    return c.cast("string")


def with_row_key(
    df: DataFrame, out: str = "row_id", columns: Sequence[str] | None = None,
    unique: bool = True,
) -> DataFrame:
    """md5 key over the row's text, for tables without a key column.

    With ``unique`` copies are told apart by input partition and a number inside
    it, so even a third of all rows being one row is numbered in parallel.
    """
    fields = [f for f in df.schema.fields if columns is None or f.name in columns]
    text = F.concat_ws("~", *[F.coalesce(text_of(f), F.lit("")) for f in fields])
    keyed = df.withColumn(out, F.md5(text))
    if not unique:
        return keyed
    placed = keyed.withColumn("__part", F.spark_partition_id())
    copies = W.partitionBy(out, "__part").orderBy(F.lit(0))
    return placed.withColumn(
        out,
        F.concat_ws("-", F.col(out), F.col("__part"), F.row_number().over(copies)),
    ).drop("__part")


def sample_datasets(spark: SparkSession, directory: str) -> DataFrame:
    """Ready-made tables, one per problem type, with their sizes."""
    manifest = [
        ("orders", "Orders", "Order status from price and priority.",
         "classification", "o_orderstatus"),
        ("lineitem", "Line items", "Extended price from quantity, discount and tax.",
         "regression", "l_extendedprice"),
        ("embeddings", "Embeddings", "Unlabelled vectors for clustering.", "clustering", None),
    ]
    parts = []
    for ident, name, description, kind, target in manifest:
        table = read_table(spark, directory, ident)
        parts.append(
            table.agg(F.count(F.lit(1)).alias("n_rows")).select(
                F.lit(ident).alias("id"),
                F.lit(name).alias("name"),
                F.lit(description).alias("description"),
                F.lit(kind).alias("data_type"),
                F.lit(target).cast("string").alias("target_column"),
                F.col("n_rows").cast("bigint").alias("n_rows"),
                F.lit(len(table.columns)).cast("bigint").alias("n_columns"),
            )
        )
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result


def make_blobs(
    spark: SparkSession, n: int = 200, centers: int = 3, d: int = 4, seed: int = 42
) -> DataFrame:
    """Gaussian clusters around seeded centres in [-10, 10], generated in place."""
    import random

    draw = random.Random(seed)
    points = [[draw.uniform(-10, 10) for _ in range(d)] for _ in range(centers)]
    rows = spark.range(n).withColumn("blob", F.pmod(F.col("id"), F.lit(centers)).cast("int"))
    features = [
        (
            F.element_at(F.array(*[F.lit(p[j]) for p in points]), F.col("blob") + 1)
            + F.randn(seed + j)
        ).alias(f"feature_{j}")
        for j in range(d)
    ]
    return rows.select(F.col("id").alias("row_id"), *features, "blob")


def write_predictions(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Scored rows as parquet, one file set per input partition (no shuffle)."""
    df.write.mode(mode).parquet(path)
