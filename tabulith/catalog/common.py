"""Registry of the queries, and the tasks and SQL pieces they share.

Every query reads whole tables from the given folder.  Missing values are put in
by rule, since the supplied tables have none.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.prepare import Prepared, fit_prepare, split
from ..session import checkpoint_dir
from ..sources.tables import read_table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query under ``name`` with the SQL that must give the same rows."""

    def register(function):
        QUERIES[name] = function
        if sql is not None:
            SQL[name] = sql
        return function

    return register


def rnd(value: str | Column, digits: int = 6) -> Column:
    """Rounded double without a negative zero."""
    value = F.col(value) if isinstance(value, str) else value
    rounded = F.round(value.cast("double"), digits)
    return F.when(rounded == 0, F.lit(0.0)).otherwise(rounded)


def R(expression: str, digits: int = 6) -> str:
    """The same rounding as SQL text."""
    e = f"round(CAST({expression} AS DOUBLE), {digits})"
    return f"(CASE WHEN {e} = 0 THEN CAST(0 AS DOUBLE) ELSE {e} END)"


def big(value: str | Column) -> Column:
    value = F.col(value) if isinstance(value, str) else value
    return value.cast("bigint")


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder next to the checkpoints for files a query writes and reads."""
    return f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


# --- documents with quality labels: classification, imbalanced ----------------

def docs_raw(spark: SparkSession, sf: str) -> DataFrame:
    """Labelled documents; 1 in 17 lengths and 1 in 13 languages are missing."""
    d = read_table(spark, sf, "documents").select("doc_id", "n_chars", "lang", "source")
    labels = read_table(spark, sf, "labels").select("doc_id", "quality")
    return with_gaps(d).join(labels, "doc_id")


def with_gaps(d: DataFrame) -> DataFrame:
    return d.select(
        "doc_id",
        F.when(F.col("doc_id") % 17 != 0, F.col("n_chars")).alias("n_chars"),
        F.when(F.col("doc_id") % 13 != 0, F.col("lang")).alias("lang"),
        "source",
    )


def docs_prepared(spark: SparkSession, sf: str) -> Prepared:
    return fit_prepare(docs_raw(spark, sf), "doc_id", "quality", "classification")


_GAPS = (
    "CASE WHEN d.doc_id % 17 = 0 THEN NULL ELSE d.n_chars END AS n_chars, "
    "CASE WHEN d.doc_id % 13 = 0 THEN NULL ELSE d.lang END AS lang, d.source"
)

DOCS_RAW = f"""
docs AS (
  SELECT d.doc_id, {_GAPS}, l.quality FROM documents d JOIN labels l ON d.doc_id = l.doc_id
)"""


def stratified_sql(table: str, key: str, target: str, out: str, share: float = 0.2) -> str:
    """CTEs that add ``is_test`` to ``table``: quota per class, md5 order inside it."""
    return f"""
{out}_c AS (SELECT {target} AS g, count(*) AS n FROM {table} GROUP BY 1),
{out}_t AS (SELECT sum(n) AS total, CAST(ceil(CAST({share} AS DOUBLE) * sum(n)) AS BIGINT) AS want FROM {out}_c),
{out}_f AS (SELECT g, n * want // total AS f, n * want % total AS rem FROM {out}_c, {out}_t),
{out}_q AS (
  SELECT g, f + CASE WHEN row_number() OVER (ORDER BY rem DESC, CAST(g AS VARCHAR))
    <= (SELECT want FROM {out}_t) - (SELECT sum(f) FROM {out}_f) THEN 1 ELSE 0 END AS quota FROM {out}_f),
{out} AS (
  SELECT b.*, row_number() OVER (PARTITION BY b.{target}
    ORDER BY md5('42:' || CAST(b.{key} AS VARCHAR))) <= q.quota AS is_test
  FROM {table} b JOIN {out}_q q ON b.{target} = q.g)"""


def random_sql(table: str, key: str, out: str, share: float = 0.2) -> str:
    return f"""
{out} AS (
  SELECT b.*, row_number() OVER (ORDER BY md5('42:' || CAST(b.{key} AS VARCHAR)))
    <= ceil(CAST({share} AS DOUBLE) * (SELECT count(*) FROM {table})) AS is_test FROM {table} b)"""


DOCS_SPLIT = DOCS_RAW + "," + stratified_sql("docs", "doc_id", "quality", "docs_s")

# parameters fitted on the training rows only
DOCS_FIT = DOCS_SPLIT + """,
docs_med AS (SELECT median(CAST(n_chars AS DOUBLE)) AS med FROM docs_s WHERE NOT is_test),
docs_mode AS (
  SELECT lang AS mode FROM docs_s WHERE NOT is_test AND lang IS NOT NULL
  GROUP BY lang ORDER BY count(*) DESC, lang LIMIT 1),
docs_scale AS (
  SELECT avg(coalesce(n_chars, med)) AS mu, stddev_pop(coalesce(n_chars, med)) AS sd
  FROM docs_s, docs_med WHERE NOT is_test),
docs_langs AS (SELECT list(DISTINCT lang ORDER BY lang) AS langs FROM docs_s WHERE NOT is_test AND lang IS NOT NULL),
docs_codes AS (
  SELECT source AS code_source, row_number() OVER (ORDER BY source) - 1 AS code
  FROM (SELECT DISTINCT source FROM docs_s WHERE NOT is_test))"""


def docs_features_sql(table: str, keep: str) -> str:
    """Select of the six prepared features from ``table``."""
    hot = ", ".join(
        f"CAST(coalesce(t.lang, mode) = langs[{i}] AS DOUBLE) AS f{i}" for i in range(1, 5)
    )
    return f"""
  SELECT {keep}, (coalesce(CAST(t.n_chars AS DOUBLE), med) - mu) / sd AS f0, {hot},
    CAST(coalesce(code, (SELECT count(*) FROM docs_codes)) AS DOUBLE) AS f5
  FROM {table} t LEFT JOIN docs_codes ON t.source = code_source,
    docs_med, docs_mode, docs_scale, docs_langs"""


DOCS_FLAT = DOCS_FIT + f""",
docs_x AS ({docs_features_sql("docs_s", "t.doc_id AS row_id, t.quality AS label, t.is_test")})"""

DOCS_LONG = DOCS_FLAT + """,
docs_l AS (
  SELECT row_id, label, is_test, CAST(substr(name, 2) AS INTEGER) AS feature, x
  FROM (UNPIVOT docs_x ON f0, f1, f2, f3, f4, f5 INTO NAME name VALUE x))"""


def naive_bayes_sql(long: str, prefix: str, rows: str) -> str:
    """CTEs from a long feature table to predictions of ``rows`` (a WHERE clause)."""
    p = prefix
    return f"""
{p}_m AS (
  SELECT label, feature, count(*) AS n, avg(x) AS mean, var_pop(x) AS var
  FROM {long} WHERE NOT is_test GROUP BY 1, 2),
{p}_e AS (
  SELECT 1e-9 * max(v) AS eps FROM (SELECT feature, var_pop(x) AS v FROM {long} WHERE NOT is_test GROUP BY 1)),
{p}_p AS (SELECT label, ln(CAST(n AS DOUBLE) / sum(n) OVER ()) AS prior FROM {p}_m WHERE feature = 0),
{p}_s AS (
  SELECT l.row_id, l.label AS actual, m.label AS cls, any_value(p.prior)
    + sum(-0.5 * ln(2 * pi() * (m.var + eps)) - (l.x - m.mean) * (l.x - m.mean) / (2 * (m.var + eps))) AS score
  FROM {long} l JOIN {p}_m m ON l.feature = m.feature JOIN {p}_p p ON p.label = m.label, {p}_e
  WHERE {rows} GROUP BY 1, 2, 3),
{p}_x AS (
  SELECT *, exp(score - max(score) OVER (PARTITION BY row_id)) AS w,
    row_number() OVER (PARTITION BY row_id ORDER BY score DESC, cls) AS rn FROM {p}_s),
{p} AS (
  SELECT row_id, actual, max(CASE WHEN rn = 1 THEN cls END) AS prediction,
    max(CASE WHEN cls = 1 THEN w END) / sum(w) AS p1 FROM {p}_x GROUP BY 1, 2)"""


# --- line items: regression and tree tasks ------------------------------------

LINE_FEATURES = ("l_quantity", "l_discount", "l_tax")
FLAGS = ("A", "N", "R")


def line_rows(spark: SparkSession, sf: str) -> DataFrame:
    """``(y, features)``: return flag from quantity, discount, tax and line status."""
    li = read_table(spark, sf, "lineitem")
    flags = F.array(*[F.lit(f) for f in FLAGS])
    return li.select(
        (F.array_position(flags, F.col("l_returnflag")) - 1).cast("int").alias("y"),
        F.array("l_quantity", "l_discount", "l_tax", (F.col("l_linestatus") == "O").cast("double")).alias("features"),
    )


LINE_LONG = """
line_x AS (
  SELECT row_number() OVER () AS rid, l_returnflag AS cls, l_quantity AS f0, l_discount AS f1, l_tax AS f2,
    CAST(l_linestatus = 'O' AS DOUBLE) AS f3 FROM lineitem),
line_l AS (
  SELECT rid, cls, CAST(substr(name, 2) AS INTEGER) AS feature, x
  FROM (UNPIVOT line_x ON f0, f1, f2, f3 INTO NAME name VALUE x))"""


# --- embeddings: clustering ----------------------------------------------------

def vectors(spark: SparkSession, sf: str) -> DataFrame:
    return read_table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("row_id"), F.col("embedding").cast("array<double>").alias("features"), "label"
    )


def vector_split(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    both = split(vectors(spark, sf), "row_id")
    return both.where("split = 'train'").drop("split"), both.where("split = 'test'").drop("split")


VECTORS = """
vec AS (SELECT vec_id AS row_id, CAST(embedding AS DOUBLE[]) AS v, label FROM embeddings)"""
VECTOR_SPLIT = VECTORS + "," + random_sql("vec", "row_id", "vec_s")


def clusters(spark: SparkSession, sf: str) -> DataFrame:
    """Vectors with their label as cluster; label 9 plays the noise."""
    return vectors(spark, sf).withColumn(
        "prediction", F.when(F.col("label") == 9, F.lit(-1)).otherwise(F.col("label"))
    )


CLUSTERS = VECTORS + """,
clu AS (SELECT row_id, v, CASE WHEN label = 9 THEN -1 ELSE label END AS c FROM vec)"""


# --- orders: predictions with known mistakes ------------------------------------

def order_predictions(spark: SparkSession, sf: str) -> DataFrame:
    """Order status, a rule-made prediction and three rule-made probabilities."""
    o = read_table(spark, sf, "orders")
    k = F.col("o_orderkey")
    a, b, c = 1 + k % 10, 1 + k % 7, 1 + k % 3
    total = (a + b + c).cast("double")
    return o.select(
        k.alias("row_id"), F.col("o_orderstatus").alias("label"),
        F.when(k % 5 == 0, F.lit("F")).when(k % 7 == 0, F.lit("N")).when(k % 3 == 0, F.lit("O"))
        .otherwise(F.col("o_orderstatus")).alias("prediction"),
        F.array(a / total, b / total, c / total).alias("probability"),
    )


ORDER_PRED = """
opred AS (
  SELECT o_orderkey AS row_id, o_orderstatus AS label,
    CASE WHEN o_orderkey % 5 = 0 THEN 'F' WHEN o_orderkey % 7 = 0 THEN 'N' WHEN o_orderkey % 3 = 0 THEN 'O'
      ELSE o_orderstatus END AS prediction,
    (1 + o_orderkey % 10) / CAST(3 + o_orderkey % 10 + o_orderkey % 7 + o_orderkey % 3 AS DOUBLE) AS p0,
    (1 + o_orderkey % 7) / CAST(3 + o_orderkey % 10 + o_orderkey % 7 + o_orderkey % 3 AS DOUBLE) AS p1,
    (1 + o_orderkey % 3) / CAST(3 + o_orderkey % 10 + o_orderkey % 7 + o_orderkey % 3 AS DOUBLE) AS p2
  FROM orders)"""

ORDER_CELLS = ORDER_PRED + """,
cells AS (SELECT label AS actual, prediction AS predicted, count(*) AS n FROM opred GROUP BY 1, 2)"""


# --- events: daily series --------------------------------------------------------

def daily(spark: SparkSession, sf: str) -> DataFrame:
    """Events per type and day: count and mean value."""
    e = read_table(spark, sf, "events")
    return e.groupBy("event_type", F.unix_date(F.to_date("ts")).cast("bigint").alias("day")).agg(
        F.count(F.lit(1)).cast("double").alias("n"), F.avg("value").alias("mean_value")
    )


DAILY = """
daily AS (
  SELECT event_type, CAST(CAST(ts AS DATE) - DATE '1970-01-01' AS BIGINT) AS day,
    CAST(count(*) AS DOUBLE) AS n, avg(value) AS mean_value FROM events GROUP BY 1, 2)"""


# --- metric tables of several runs -------------------------------------------------

def metric_rows(spark: SparkSession, sf: str) -> DataFrame:
    """A ``(run_id, model_key, metric, value)`` table taken from line items."""
    per = read_table(spark, sf, "lineitem").groupBy(
        F.col("l_linestatus").alias("run_id"), F.col("l_returnflag").alias("model_key")
    ).agg(
        F.avg("l_quantity").alias("quantity"), F.avg("l_tax").alias("tax"),
        F.avg(F.when(F.col("l_linestatus") == "O", F.col("l_discount"))).alias("discount"),
        F.count(F.lit(1)).cast("double").alias("lines"),
    )
    names = ("quantity", "tax", "discount", "lines")
    items = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("value")) for m in names])
    return per.select("run_id", "model_key", F.explode(items).alias("i")).select(
        "run_id", "model_key", "i.*"
    ).where("value is not null")


METRICS = """
mwide AS (
  SELECT l_linestatus AS run_id, l_returnflag AS model_key, avg(l_quantity) AS quantity, avg(l_tax) AS tax,
    avg(CASE WHEN l_linestatus = 'O' THEN l_discount END) AS discount, CAST(count(*) AS DOUBLE) AS lines
  FROM lineitem GROUP BY 1, 2),
mrows AS (
  SELECT run_id, model_key, metric, value
  FROM (UNPIVOT mwide ON quantity, tax, discount, lines INTO NAME metric VALUE value) WHERE value IS NOT NULL)"""


# --- customers: two-dimensional density -----------------------------------------------

def places(spark: SparkSession, sf: str, table: str = "customer", p: str = "c", key: str = "c_custkey") -> DataFrame:
    """Balance and nation on comparable scales."""
    t = read_table(spark, sf, table)
    return t.select(
        F.col(key).alias("row_id"),
        F.array(F.col(f"{p}_acctbal") / 3000.0, F.col(f"{p}_nationkey") / 7.0).alias("features"),
        F.col(f"{p}_nationkey").alias("nation"),
    )


PLACES = """
cust AS (SELECT c_custkey AS id, c_acctbal / CAST(3000 AS DOUBLE) AS x, c_nationkey / CAST(7 AS DOUBLE) AS y FROM customer),
supp AS (SELECT s_suppkey AS id, s_acctbal / CAST(3000 AS DOUBLE) AS x, s_nationkey / CAST(7 AS DOUBLE) AS y,
  s_nationkey AS nation FROM supplier)"""
