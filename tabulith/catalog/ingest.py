"""Queries: sources, checks and the column profile."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import profile as P
from ..operators.evaluate import audit_predictions, check_features
from ..operators.report import prediction_distribution
from ..sources import tables as S
from .common import DOCS_RAW, ORDER_PRED, R, big, order_predictions, query, rnd, scratch, with_gaps


@query("src_csv", f"""
SELECT p_partkey, p_brand, CASE WHEN p_partkey % 11 = 0 THEN NULL ELSE CAST(p_size AS BIGINT) END AS p_size,
  {R('p_retailprice', 4)} AS p_retailprice FROM part""")
def src_csv(spark, sf):
    part = S.read_table(spark, sf, "part")
    path = scratch(spark, "csv")
    part.select(
        "p_partkey", "p_brand",
        F.when(F.col("p_partkey") % 11 == 0, F.lit("N/A")).otherwise(F.col("p_size").cast("string")).alias("p_size"),
        "p_retailprice",
    ).write.csv(path, header=True)
    read = S.read_csv(spark, path)
    return read.select(big("p_partkey").alias("p_partkey"), "p_brand", big("p_size").alias("p_size"),
                       rnd("p_retailprice", 4).alias("p_retailprice"))


@query("normalize_missing", "SELECT event_id, CASE WHEN event_id % 17 = 0 THEN NULL ELSE value END AS value FROM events")
def normalize_missing(spark, sf):
    e = S.read_table(spark, sf, "events").select(
        "event_id", F.when(F.col("event_id") % 17 == 0, F.lit(float("nan"))).otherwise(F.col("value")).alias("value")
    )
    return S.normalize_missing(e)


@query("samples", """
SELECT 'orders' AS id, 'Orders' AS name, 'Order status from price and priority.' AS description,
  'classification' AS data_type, 'o_orderstatus' AS target_column, count(*) AS n_rows, CAST(6 AS BIGINT) AS n_columns FROM orders
UNION ALL SELECT 'lineitem', 'Line items', 'Extended price from quantity, discount and tax.', 'regression',
  'l_extendedprice', count(*), 11 FROM lineitem
UNION ALL SELECT 'embeddings', 'Embeddings', 'Unlabelled vectors for clustering.', 'clustering', NULL, count(*), 3 FROM embeddings""")
def samples(spark, sf):
    return S.sample_datasets(spark, sf)


@query("prediction_sink", f"WITH {ORDER_PRED} SELECT row_id, prediction, {R('p0')} AS p0, {R('p1')} AS p1, {R('p2')} AS p2 FROM opred")
def prediction_sink(spark, sf):
    path = scratch(spark, "predictions")
    S.write_predictions(order_predictions(spark, sf), path)
    p = F.col("probability")
    return spark.read.parquet(path).select(
        "row_id", "prediction", *[rnd(p[i]).alias(f"p{i}") for i in range(3)]
    )


@query("validate_table", """
SELECT 'region' AS source, 'min_rows' AS rule, least(count(*), 50) AS observed, CAST(50 AS BIGINT) AS bound FROM region HAVING count(*) < 50
UNION ALL SELECT 'nation', 'min_rows', least(count(*), 50), 50 FROM nation HAVING count(*) < 50
UNION ALL SELECT 'orders', 'min_rows', least(count(*), 50), 50 FROM orders HAVING count(*) < 50
UNION ALL SELECT 'conversations', 'min_rows', least(count(*), 50), 50 FROM conversations HAVING count(*) < 50
UNION ALL SELECT 'conversations', 'numeric_columns', 0, 1""")
def validate_table(spark, sf):
    parts = []
    for name in ("region", "nation", "orders", "conversations"):
        t = S.read_table(spark, sf, name)
        if name == "conversations":
            t = t.select("role", "text")
        parts.append(P.validate_table(t).select(F.lit(name).alias("source"), "rule", "observed", "bound"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _problem(table, column):
    kind = "CASE WHEN count(DISTINCT {c}) < 2 THEN 'invalid' WHEN count(DISTINCT {c}) <= 10 THEN 'classification' ELSE 'regression' END"
    return (f"SELECT '{column}' AS target_column, count(DISTINCT {column}) AS n_unique, "
            f"{kind.format(c=column)} AS problem_type FROM {table}")


_TARGETS = [("orders", "o_orderstatus"), ("labels", "quality"), ("lineitem", "l_extendedprice"), ("documents", "source")]


@query("problem_type", " UNION ALL ".join(_problem(t, c) for t, c in _TARGETS))
def problem_type(spark, sf):
    out = None
    for table, column in _TARGETS:
        part = P.problem_type_table(S.read_table(spark, sf, table), column)
        out = part if out is None else out.unionByName(part)
    return out


@query("report_columns", "SELECT p_retailprice, p_partkey, p_name, p_brand, p_type, CAST(p_size AS BIGINT) AS p_size FROM part")
def report_columns(spark, sf):
    t = S.read_table(spark, sf, "part").withColumn("p_size", big("p_size"))
    return P.report_columns(t, "p_retailprice")


@query("check_features", """
SELECT count(*) AS n_rows, count(*) FILTER (WHERE vec_id % 50 = 0) AS null_features,
  count(*) FILTER (WHERE vec_id % 50 = 3) AS null_values, count(*) FILTER (WHERE vec_id % 50 = 1) AS not_finite,
  count(*) FILTER (WHERE vec_id % 50 = 2) AS wrong_width, count(*) FILTER (WHERE label = 4) AS missing_label FROM embeddings""")
def check_features_query(spark, sf):
    e = S.read_table(spark, sf, "embeddings")
    x, k = F.col("embedding").cast("array<double>"), F.col("vec_id") % 50
    broken = (
        F.when(k == 0, F.lit(None)).when(k == 1, F.transform(x, lambda v, i: F.when(i == 5, F.lit(float("nan"))).otherwise(v)))
        .when(k == 2, F.slice(x, 1, 63)).when(k == 3, F.transform(x, lambda v, i: F.when(i != 7, v))).otherwise(x)
    )
    t = e.select(broken.alias("features"), F.when(F.col("label") != 4, F.col("label")).alias("label"))
    return check_features(t, "features", 64, "label")


@query("audit_predictions", """
WITH truth AS (SELECT doc_id, quality, toxic FROM labels),
pred AS (
  SELECT doc_id, CASE WHEN doc_id % 29 = 0 THEN 5 ELSE quality END AS prediction,
    CASE WHEN doc_id % 23 = 0 THEN -0.1 ELSE 0.25 END AS a, CASE WHEN doc_id % 19 = 0 THEN 0.9 WHEN doc_id % 23 = 0 THEN 1.1 ELSE 0.75 END AS b
  FROM truth WHERE toxic = 0),
twice AS (SELECT * FROM pred UNION ALL SELECT * FROM pred WHERE prediction = 0),
per AS (SELECT doc_id, count(*) AS n FROM twice GROUP BY 1)
SELECT count(*) FILTER (WHERE per.n IS NULL) AS rows_without_prediction, count(*) FILTER (WHERE t.doc_id IS NULL) AS unexpected_rows,
  count(*) FILTER (WHERE per.n > 1) AS rows_predicted_twice,
  (SELECT count(*) FROM twice WHERE a < 0 OR b < 0) AS negative_probability,
  (SELECT count(*) FROM twice WHERE abs(a + b - 1) > 0.000001) AS bad_probability_sum,
  (SELECT count(*) FROM twice WHERE prediction NOT IN (SELECT DISTINCT quality FROM truth)) AS unknown_labels,
  (SELECT count(*) FROM twice WHERE doc_id % 31 = 0) AS fits_disagree
FROM truth t FULL JOIN per ON t.doc_id = per.doc_id""")
def audit(spark, sf):
    labels = S.read_table(spark, sf, "labels").withColumnsRenamed({"doc_id": "row_id", "quality": "label"})
    truth = labels.select("row_id", "label")
    k = F.col("row_id")
    pred = labels.where("toxic = 0").select(
        "row_id", F.when(k % 29 == 0, F.lit(5)).otherwise(F.col("label")).alias("prediction"),
        F.array(
            F.when(k % 23 == 0, F.lit(-0.1)).otherwise(F.lit(0.25)),
            F.when(k % 19 == 0, F.lit(0.9)).when(k % 23 == 0, F.lit(1.1)).otherwise(F.lit(0.75)),
        ).alias("probability"),
    )
    twice = pred.unionByName(pred.where("prediction = 0"))
    second = pred.withColumn("prediction", F.when(k % 31 == 0, F.lit(-7)).otherwise(F.col("prediction")))
    return audit_predictions(twice, truth, truth, second)


# --- profile -------------------------------------------------------------------

_LINE = ("l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_linenumber", "l_suppkey")


def _numeric_sql(table, column):
    x = f"CAST({column} AS DOUBLE)"
    return (
        f"SELECT '{column}' AS \"column\", count(*) - count({column}) AS missing_count, "
        f"{R(f'(count(*) - count({column})) / CAST(count(*) AS DOUBLE)')} AS missing_pct, count(DISTINCT {column}) AS unique_count, "
        f"{R(f'avg({x})', 4)} AS mean, {R(f'stddev_samp({x})', 4)} AS std, {R(f'min({x})', 4)} AS min, "
        f"{R(f'max({x})', 4)} AS max, {R(f'median({x})', 4)} AS median FROM {table}"
    )


def _shown(df):
    return df.select("column", "missing_count", rnd("missing_pct").alias("missing_pct"), "unique_count",
                     *[rnd(c, 4).alias(c) for c in ("mean", "std", "min", "max", "median")])


@query("profile_numeric", f"WITH {DOCS_RAW} " + " UNION ALL ".join(
    [_numeric_sql("lineitem", c) for c in _LINE] + [_numeric_sql("docs", "n_chars")]))
def profile_numeric(spark, sf):
    from .common import docs_raw

    lines = P.profile_numeric(S.read_table(spark, sf, "lineitem"), _LINE)
    return _shown(lines).unionByName(_shown(P.profile_numeric(docs_raw(spark, sf), ["n_chars"])))


def _gap_table(spark, sf):
    return with_gaps(S.read_table(spark, sf, "documents").select("doc_id", "n_chars", "lang", "source"))


_GAP_SQL = """
gap AS (SELECT doc_id, CASE WHEN doc_id % 17 = 0 THEN NULL ELSE n_chars END AS n_chars,
  CASE WHEN doc_id % 13 = 0 THEN NULL ELSE lang END AS lang, source FROM documents)"""


def _categorical_sql(table, column):
    top = f"(SELECT {column} FROM {table} WHERE {column} IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, {column} LIMIT 1)"
    return (
        f"SELECT '{column}' AS \"column\", count(*) - count({column}) AS missing_count, "
        f"{R(f'(count(*) - count({column})) / CAST(count(*) AS DOUBLE)')} AS missing_pct, "
        f"count(DISTINCT {column}) AS unique_count, {top} AS top_value, "
        f"(SELECT count(*) FROM {table} WHERE {column} = {top}) AS top_value_freq FROM {table}"
    )


@query("profile_categorical", f"WITH {_GAP_SQL} " + " UNION ALL ".join(_categorical_sql("gap", c) for c in ("lang", "source")))
def profile_categorical(spark, sf):
    out = P.profile_categorical(_gap_table(spark, sf), ["lang", "source"])
    return out.withColumn("missing_pct", rnd("missing_pct"))


def _hist_sql(table, column, lower="lower", upper="upper"):
    return f"""
SELECT '{column}' AS "column", CAST(b AS BIGINT) AS bin, lo + b * ((hi - lo) / 10) AS lower,
  CASE WHEN b = 9 THEN hi ELSE lo + (b + 1) * ((hi - lo) / 10) END AS upper,
  (SELECT count(*) FROM {table} WHERE {column} IS NOT NULL
    AND least(floor((CAST({column} AS DOUBLE) - lo) * 10 / (hi - lo)), 9) = b) AS n
FROM (SELECT CASE WHEN lo0 = hi0 THEN lo0 - 0.5 ELSE lo0 END AS lo, CASE WHEN lo0 = hi0 THEN hi0 + 0.5 ELSE hi0 END AS hi
  FROM (SELECT min(CAST({column} AS DOUBLE)) AS lo0, max(CAST({column} AS DOUBLE)) AS hi0 FROM {table})), range(10) r(b)"""


@query("histogram", "SELECT \"column\", bin, " + R("lower", 4) + " AS lower, " + R("upper", 4) + " AS upper, n FROM (" +
       " UNION ALL ".join(_hist_sql("lineitem", c) for c in ("l_quantity", "l_extendedprice", "l_discount")) + ")")
def histogram(spark, sf):
    h = P.histogram(S.read_table(spark, sf, "lineitem"), ["l_quantity", "l_extendedprice", "l_discount"])
    return h.select("column", big("bin").alias("bin"), rnd("lower", 4).alias("lower"), rnd("upper", 4).alias("upper"), "n")


def _top_sql(table, column):
    return f"""
SELECT '{column}' AS "column", CAST(least(rk, 21) AS BIGINT) AS rank, CASE WHEN rk <= 20 THEN v ELSE 'Other' END AS value,
  CAST(sum(n) AS BIGINT) AS n
FROM (SELECT {column} AS v, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, {column}) AS rk
  FROM {table} WHERE {column} IS NOT NULL GROUP BY 1) GROUP BY 1, 2, 3"""


@query("top_categories", " UNION ALL ".join(_top_sql("part", c) for c in ("p_brand", "p_type", "p_name")))
def top_categories(spark, sf):
    t = P.top_categories(S.read_table(spark, sf, "part"), ["p_brand", "p_type", "p_name"])
    return t.withColumn("rank", big("rank"))


@query("distribution_buckets", f"""
WITH h AS ({_hist_sql('part', 'p_size')}), t AS ({_top_sql('part', 'p_brand')}),
b AS (
  SELECT "column", bin AS position, format('{{:.1f}}', lower) || '–' || format('{{:.1f}}', upper) AS label, n FROM h
  UNION ALL SELECT "column", rank - 1, value, n FROM t)
SELECT "column", position, label, n,
  row_number() OVER (PARTITION BY "column" ORDER BY n DESC, position) = 1 AS most_common FROM b""")
def distribution_buckets(spark, sf):
    b = P.distribution_buckets(S.read_table(spark, sf, "part"), ["p_size", "p_brand"])
    return b.withColumn("position", big("position"))


@query("class_imbalance", f"""
WITH c AS (SELECT CAST(quality AS VARCHAR) AS label, count(*) AS n FROM labels WHERE quality IS NOT NULL GROUP BY 1),
s AS (SELECT label, n, n / CAST(sum(n) OVER () AS DOUBLE) AS share FROM c),
f AS (SELECT bool_or(share < 0.2 OR share > 0.8) AS flag FROM s)
SELECT label, n, {R('share')} AS share, flag AS is_imbalanced,
  CASE WHEN flag THEN 'Class imbalance present; predictions may be biased.' END AS message FROM s, f""")
def class_imbalance(spark, sf):
    c = P.class_imbalance(S.read_table(spark, sf, "labels"), "quality")
    return c.withColumn("share", rnd("share"))


@query("profile_dataset", f"""
WITH {_GAP_SQL},
a AS (SELECT CAST(0 AS BIGINT) AS position, 'numeric' AS dtype, *, CAST(NULL AS VARCHAR) AS top_value, CAST(NULL AS BIGINT) AS top_value_freq
  FROM ({_numeric_sql('gap', 'n_chars')})),
b AS (SELECT CASE "column" WHEN 'lang' THEN 1 ELSE 2 END AS position, 'categorical' AS dtype, "column", missing_count, missing_pct, unique_count,
  CAST(NULL AS DOUBLE) AS mean, CAST(NULL AS DOUBLE) AS std, CAST(NULL AS DOUBLE) AS min, CAST(NULL AS DOUBLE) AS max,
  CAST(NULL AS DOUBLE) AS median, top_value, top_value_freq
  FROM ({_categorical_sql('gap', 'lang')} UNION ALL {_categorical_sql('gap', 'source')}))
SELECT u.*, (SELECT count(*) FROM gap) AS n_rows, CAST(3 AS BIGINT) AS n_columns, 'classification' AS data_type,
  'lang' AS target_column, u."column" = 'lang' AS is_target FROM (SELECT * FROM a UNION ALL SELECT * FROM b) u""")
def profile_dataset(spark, sf):
    out = P.profile_dataset(_gap_table(spark, sf).drop("doc_id"), "lang")
    for c in ("mean", "std", "min", "max", "median"):
        out = out.withColumn(c, rnd(c, 4))
    return out.withColumn("missing_pct", rnd("missing_pct"))


@query("prediction_distribution", f"WITH {ORDER_PRED} SELECT prediction AS value, count(*) AS n FROM opred GROUP BY 1")
def prediction_distribution_query(spark, sf):
    return prediction_distribution(order_predictions(spark, sf))
