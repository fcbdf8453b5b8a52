"""Queries: split, imputation, encoding, scaling and feature builders."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import prepare as P
from ..operators import series as X
from ..sources.tables import read_table, with_row_key
from .common import (
    DAILY, DOCS_FIT, DOCS_FLAT, DOCS_SPLIT, R, big, daily, docs_features_sql, docs_prepared, docs_raw, query,
    random_sql, rnd, with_gaps,
)

_SPLIT = "CASE WHEN is_test THEN 'test' ELSE 'train' END AS split"


@query("split_stratified", f"WITH {DOCS_SPLIT} SELECT doc_id, CAST(quality AS BIGINT) AS quality, {_SPLIT} FROM docs_s")
def split_stratified(spark, sf):
    out = P.split(docs_raw(spark, sf), "doc_id", "quality", "classification")
    return out.select("doc_id", big("quality").alias("quality"), "split")


_LINE_KEY = """
lk AS (
  SELECT md5(concat_ws('~', CAST(l_orderkey AS VARCHAR), CAST(l_partkey AS VARCHAR), CAST(l_suppkey AS VARCHAR),
    CAST(l_linenumber AS VARCHAR), CAST(CAST(round(l_quantity * 1000000) AS BIGINT) AS VARCHAR),
    CAST(CAST(round(l_extendedprice * 1000000) AS BIGINT) AS VARCHAR), CAST(CAST(round(l_discount * 1000000) AS BIGINT) AS VARCHAR),
    CAST(CAST(round(l_tax * 1000000) AS BIGINT) AS VARCHAR), l_returnflag, l_linestatus,
    strftime(l_shipdate, '%Y-%m-%d %H:%M:%S.%f'))) AS row_id FROM lineitem)"""


@query("split_random", f"WITH {_LINE_KEY},{random_sql('lk', 'row_id', 'lk_s')} SELECT row_id, {_SPLIT} FROM lk_s")
def split_random(spark, sf):
    keyed = with_row_key(read_table(spark, sf, "lineitem"), unique=False)
    return P.split(keyed, "row_id", problem_type="regression").select("row_id", "split")


def _docs_fits(spark, sf):
    raw = docs_raw(spark, sf)
    flag, n = P.split_flag(raw, "doc_id", "quality", "classification")
    return raw, raw.where(~flag), n


@query("impute_median", f"WITH {DOCS_FIT} SELECT doc_id, {R('coalesce(CAST(n_chars AS DOUBLE), med)')} AS n_chars FROM docs_s, docs_med")
def impute_median(spark, sf):
    raw, train, n = _docs_fits(spark, sf)
    fit = P.fit_numeric(train, ["n_chars"])[0]
    return raw.select("doc_id", rnd(P.imputed_number(fit)).alias("n_chars"))


@query("impute_mode", f"WITH {DOCS_FIT} SELECT doc_id, coalesce(lang, mode) AS lang FROM docs_s, docs_mode")
def impute_mode(spark, sf):
    raw, train, _ = _docs_fits(spark, sf)
    fit = P.fit_categories(train, ["lang"])[0][0]
    return raw.select("doc_id", P.imputed_category(fit).alias("lang"))


@query("one_hot", f"WITH {DOCS_FLAT} SELECT row_id, f1 AS v0, f2 AS v1, f3 AS v2, f4 AS v3 FROM docs_x")
def one_hot(spark, sf):
    raw, train, _ = _docs_fits(spark, sf)
    fit = P.fit_categories(train, ["lang"])[0][0]
    return raw.select(F.col("doc_id").alias("row_id"), *[x.alias(f"v{i}") for i, x in enumerate(P.one_hot(fit))])


@query("label_encode", f"""
WITH base AS (SELECT c_custkey, c_name FROM customer),{random_sql('base', 'c_custkey', 's')},
codes AS (SELECT c_name AS v, row_number() OVER (ORDER BY c_name) - 1 AS code FROM (SELECT DISTINCT c_name FROM s WHERE NOT is_test))
SELECT c_custkey AS row_id, CAST(coalesce(code, (SELECT count(*) FROM codes)) AS DOUBLE) AS code FROM s LEFT JOIN codes ON c_name = v""")
def label_encode(spark, sf):
    c = read_table(spark, sf, "customer").select("c_custkey", "c_name")
    prepared = P.fit_prepare(c, "c_custkey", None, "clustering")
    both = prepared.train.unionByName(prepared.test)
    return both.select("row_id", F.col("features")[0].alias("code"))


@query("scale", f"WITH {DOCS_FLAT} SELECT row_id, {R('f0')} AS n_chars FROM docs_x")
def scale(spark, sf):
    raw, train, n = _docs_fits(spark, sf)
    fit = P.fit_numeric(train, ["n_chars"])[0]
    return raw.select(F.col("doc_id").alias("row_id"), rnd(P.scaled(fit)).alias("n_chars"))


_F6 = ", ".join(f"{R(f'f{i}')} AS f{i}" for i in range(6))


@query("prepare", f"WITH {DOCS_FLAT} SELECT row_id, CAST(label AS BIGINT) AS label, {_SPLIT}, {_F6} FROM docs_x")
def prepare(spark, sf):
    p = docs_prepared(spark, sf)
    both = p.train.withColumn("split", F.lit("train")).unionByName(p.test.withColumn("split", F.lit("test")))
    return both.select("row_id", big("label").alias("label"), "split",
                       *[rnd(F.col("features")[i]).alias(f"f{i}") for i in range(6)])


@query("transform_new", f"""
WITH {DOCS_FIT}, fresh AS (SELECT doc_id, CASE WHEN doc_id % 17 = 0 THEN NULL ELSE n_chars END AS n_chars,
  CASE WHEN doc_id % 13 = 0 THEN NULL ELSE lang END AS lang, CASE WHEN doc_id % 19 = 0 THEN 'elsewhere' ELSE source END AS source FROM documents),
x AS ({docs_features_sql('fresh', 't.doc_id AS row_id')}) SELECT row_id, {_F6} FROM x""")
def transform_new(spark, sf):
    prep = docs_prepared(spark, sf).prep
    new = with_gaps(read_table(spark, sf, "documents").select("doc_id", "n_chars", "lang", "source")).withColumn(
        "source", F.when(F.col("doc_id") % 19 == 0, F.lit("elsewhere")).otherwise(F.col("source"))
    )
    return P.transform_new(new, prep).select("row_id", *[rnd(F.col("features")[i]).alias(f"f{i}") for i in range(6)])


_POLY = ["q", "d", "t", "q * q", "q * d", "q * t", "d * d", "d * t", "t * t"]


@query("poly_features", f"WITH {_LINE_KEY.replace('AS row_id FROM', 'AS row_id, l_quantity AS q, l_discount AS d, l_tax AS t FROM')} SELECT row_id, "
       + ", ".join(f"{R(e)} AS p{i}" for i, e in enumerate(_POLY)) + " FROM lk")
def poly_features(spark, sf):
    keyed = with_row_key(read_table(spark, sf, "lineitem"), unique=False).select(
        "row_id", F.array("l_quantity", "l_discount", "l_tax").alias("features")
    )
    return P.poly_features(keyed, "features", 3).select("row_id", *[rnd(F.col("poly")[i]).alias(f"p{i}") for i in range(9)])


_BINS = [("customer", "c_custkey", "c_acctbal"), ("customer", "c_custkey", "c_nationkey"), ("embeddings", "vec_id", "label")]


def _bins_sql(table, key, column):
    x = f"CAST({column} AS DOUBLE)"
    q = ", ".join(f"CAST({i / 10} AS DOUBLE)" for i in range(1, 10))
    return f"""
SELECT '{column}' AS name, {key} AS row_id, CAST((
    SELECT count(*) FROM (
      SELECT DISTINCT e FROM (
        SELECT unnest(quantile_cont({x}, [{q}])) AS e, min({x}) AS lo, max({x}) AS hi, count(DISTINCT {x}) AS k FROM {table})
      WHERE k > 10 AND e >= lo AND e < hi
      UNION ALL
      SELECT (v + nxt) / 2 FROM (SELECT v, lead(v) OVER (ORDER BY v) AS nxt, count(*) OVER () AS k
        FROM (SELECT DISTINCT {x} AS v FROM {table})) WHERE k <= 10 AND nxt IS NOT NULL) edges
    WHERE edges.e <= CAST(t.{column} AS DOUBLE)) AS BIGINT) AS bin FROM {table} t"""


@query("discretize", " UNION ALL ".join(_bins_sql(*b) for b in _BINS))
def discretize(spark, sf):
    out = None
    for table, key, column in _BINS:
        t = read_table(spark, sf, table)
        edges = P.bin_edges(t, [column], 10)
        part = P.discretize(t.select(key, column), edges).select(
            F.lit(column).alias("name"), big(key).alias("row_id"), big(f"{column}_bin").alias("bin")
        )
        out = part if out is None else out.unionByName(part)
    return out


@query("lookback_features", f"""
WITH {DAILY}, l AS (SELECT event_type, day,
  lag(n, 3) OVER w AS f0, lag(mean_value, 3) OVER w AS f1, lag(n, 2) OVER w AS f2, lag(mean_value, 2) OVER w AS f3,
  lag(n, 1) OVER w AS f4, lag(mean_value, 1) OVER w AS f5, n AS label FROM daily WINDOW w AS (PARTITION BY event_type ORDER BY day))
SELECT event_type, day, {_F6}, label FROM l WHERE f0 IS NOT NULL AND f1 IS NOT NULL""")
def lookback_features(spark, sf):
    out = X.lookback(daily(spark, sf), ["event_type"], "day", ["n", "mean_value"], 3)
    return out.select("event_type", "day", *[rnd(F.col("features")[i]).alias(f"f{i}") for i in range(6)], F.col("n").alias("label"))


@query("kfold_assign", """
SELECT o_orderkey AS row_id, o_orderstatus AS label,
  CAST((row_number() OVER (PARTITION BY o_orderstatus ORDER BY md5('42:' || CAST(o_orderkey AS VARCHAR))) - 1) % 5 AS BIGINT) AS fold FROM orders""")
def kfold_assign(spark, sf):
    o = read_table(spark, sf, "orders").select(F.col("o_orderkey").alias("row_id"), F.col("o_orderstatus").alias("label"))
    return P.kfold(o, "row_id", "label").select("row_id", "label", big("fold").alias("fold"))


# --- ordered series ---------------------------------------------------------------

@query("series_diff", f"WITH {DAILY} SELECT event_type, day, {R('n - lag(n) OVER (PARTITION BY event_type ORDER BY day)')} AS diff FROM daily")
def series_diff(spark, sf):
    return X.difference(daily(spark, sf), ["event_type"], "day", "n").select("event_type", "day", rnd("diff").alias("diff"))


@query("forecast_cumsum", f"""
WITH {DAILY}, a AS (SELECT event_type, max_by(n, day) AS anchor FROM daily GROUP BY 1)
SELECT event_type, day, {R('anchor + sum(mean_value) OVER (PARTITION BY event_type ORDER BY day)')} AS level FROM daily JOIN a USING (event_type)""")
def forecast_cumsum(spark, sf):
    d = daily(spark, sf)
    anchored = d.join(d.groupBy("event_type").agg(F.max_by("n", "day").alias("anchor")), "event_type")
    return X.anchored_sum(anchored, ["event_type"], "day", "mean_value", "anchor").select(
        "event_type", "day", rnd("level").alias("level"))


_RATIO = "var_pop(n) / (var_pop(diff) + 1e-12)"
_DIFFED = DAILY + ", dd AS (SELECT *, n - lag(n) OVER (PARTITION BY event_type ORDER BY day) AS diff FROM daily)"


@query("stationarity_ratio", f"WITH {_DIFFED} SELECT event_type, {R(_RATIO)} AS ratio, {_RATIO} > 1.5 AS differenced FROM dd GROUP BY 1")
def stationarity_ratio(spark, sf):
    return X.stationarity(daily(spark, sf), ["event_type"], "day", "n").select("event_type", rnd("ratio").alias("ratio"), "differenced")


@query("fit_series_regression", f"""
WITH {_DIFFED}, f AS (
  SELECT event_type, count(*) AS n_rows, {_RATIO} AS ratio, regr_slope(diff, mean_value) AS sd, regr_intercept(diff, mean_value) AS idf,
    regr_slope(n, mean_value) AS sl, regr_intercept(n, mean_value) AS il, max_by(n, day) AS last_n FROM dd GROUP BY 1)
SELECT event_type, n_rows AS n, {R('ratio')} AS ratio, ratio > 1.5 AS differenced, {R('CASE WHEN ratio > 1.5 THEN sd ELSE sl END')} AS slope,
  {R('CASE WHEN ratio > 1.5 THEN idf ELSE il END')} AS intercept, CASE WHEN ratio > 1.5 THEN last_n END AS last_level FROM f""")
def fit_series_regression(spark, sf):
    out = X.fit_series(daily(spark, sf), ["event_type"], "day", "mean_value", "n")
    return out.select("event_type", "n", rnd("ratio").alias("ratio"), "differenced", rnd("slope").alias("slope"),
                      rnd("intercept").alias("intercept"), "last_level")
