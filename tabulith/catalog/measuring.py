"""Queries: evaluation metrics, windows, report and comparison tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.scalar import softmax
from ..models.discriminant import LDA
from ..operators import evaluate as E
from ..operators import report as P
from ..operators.distance import silhouette
from ..plans.runs import plot_data, report_summary
from ..plans.validation import cv_metrics
from ..sources.tables import read_table
from .common import (
    CLUSTERS, DOCS_LONG, DOCS_RAW, METRICS, ORDER_CELLS, ORDER_PRED, R, big, clusters, docs_prepared, docs_raw,
    VECTORS, metric_rows, order_predictions, query, rnd, vectors,
)

_DENSE = ORDER_CELLS + """,
names AS (SELECT actual AS l FROM cells UNION SELECT predicted FROM cells),
dense AS (SELECT a.l AS actual, p.l AS predicted, coalesce(c.n, 0) AS n
  FROM names a CROSS JOIN names p LEFT JOIN cells c ON c.actual = a.l AND c.predicted = p.l)"""


@query("confusion_matrix", f"WITH {_DENSE} SELECT * FROM dense")
def confusion_matrix(spark, sf):
    return E.confusion_matrix(order_predictions(spark, sf))


def metrics_sql(cells: str) -> str:
    """Weighted metrics from a confusion CTE."""
    return f"""
per AS (
  SELECT l, sum(CASE WHEN actual = l THEN n ELSE 0 END) AS support, sum(CASE WHEN predicted = l THEN n ELSE 0 END) AS called,
    sum(CASE WHEN actual = l AND predicted = l THEN n ELSE 0 END) AS hit
  FROM {cells}, (SELECT actual AS l FROM {cells} UNION SELECT predicted FROM {cells}) GROUP BY l),
sc AS (SELECT support, hit, CASE WHEN called > 0 THEN hit / called ELSE 0 END AS p, CASE WHEN support > 0 THEN hit / support ELSE 0 END AS r,
  CASE WHEN called + support > 0 THEN 2 * hit / (called + support) ELSE 0 END AS f FROM per),
metr AS (SELECT sum(hit) / sum(support) AS accuracy, sum(p * support) / sum(support) AS precision,
  sum(r * support) / sum(support) AS recall, sum(f * support) / sum(support) AS f1 FROM sc)"""


_FOUR = ", ".join(f"{R(c)} AS {c}" for c in ("accuracy", "precision", "recall", "f1"))


@query("classifier_metrics", f"WITH {ORDER_CELLS},{metrics_sql('cells')} SELECT {_FOUR} FROM metr")
def classifier_metrics(spark, sf):
    m = E.classifier_metrics(order_predictions(spark, sf))
    return m.select(*[rnd(c).alias(c) for c in m.columns])


@query("regressor_metrics", f"""
WITH e AS (SELECT l_extendedprice AS y, l_quantity * 1500 AS p FROM lineitem),
m AS (SELECT avg((y - p) * (y - p)) AS mse, avg(abs(y - p)) AS mae, var_pop(y) AS v FROM e)
SELECT {R('mse', 1)} AS mse, {R('sqrt(mse)', 4)} AS rmse, {R('1 - mse / v')} AS r2, {R('mae', 4)} AS mae FROM m""")
def regressor_metrics(spark, sf):
    p = read_table(spark, sf, "lineitem").select(
        F.col("l_extendedprice").alias("label"), (F.col("l_quantity") * 1500).alias("prediction")
    )
    return E.regressor_metrics(p).select(
        rnd("mse", 1).alias("mse"), rnd("rmse", 4).alias("rmse"), rnd("r2").alias("r2"), rnd("mae", 4).alias("mae"))


_CLU_LONG = CLUSTERS + """,
cl AS (SELECT row_id, c, unnest(v) AS x, unnest(range(len(v))) AS j FROM clu),
cen AS (SELECT c, j, avg(x) AS m, var_pop(x) AS s, count(*) AS n FROM cl GROUP BY 1, 2)"""


@query("cluster_inertia", f"WITH {_CLU_LONG} SELECT {R('sum(s * n)')} AS inertia FROM cen WHERE c <> -1")
def cluster_inertia(spark, sf):
    return E.cluster_inertia(clusters(spark, sf)).select(rnd("inertia").alias("inertia"))


@query("davies_bouldin", f"""
WITH {_CLU_LONG},
d AS (SELECT cl.row_id, cl.c, sqrt(sum((x - m) * (x - m))) AS dist FROM cl JOIN cen ON cl.c = cen.c AND cl.j = cen.j GROUP BY 1, 2),
s AS (SELECT c, avg(dist) AS s FROM d GROUP BY 1),
g AS (SELECT a.c AS i, b.c AS j2, sqrt(sum((a.m - b.m) * (a.m - b.m))) AS gap FROM cen a JOIN cen b ON a.j = b.j AND a.c <> b.c GROUP BY 1, 2),
w AS (SELECT i, max((si.s + sj.s) / gap) AS worst FROM g JOIN s si ON si.c = i JOIN s sj ON sj.c = j2 GROUP BY 1)
SELECT {R('avg(worst)')} AS davies_bouldin_score FROM w""")
def davies_bouldin(spark, sf):
    return E.davies_bouldin(clusters(spark, sf)).select(rnd("davies_bouldin_score").alias("davies_bouldin_score"))


@query("silhouette", f"""
WITH {CLUSTERS},
p AS (SELECT a.row_id, a.c, b.c AS o, sum(list_distance(a.v, b.v)) AS total FROM clu a CROSS JOIN clu b GROUP BY 1, 2, 3),
n AS (SELECT c, count(*) AS n FROM clu GROUP BY 1),
ab AS (SELECT row_id, p.c, max(CASE WHEN p.c = o AND n.n > 1 THEN total / (n.n - 1) END) AS a,
  max(CASE WHEN p.c = o THEN n.n END) AS size, min(CASE WHEN p.c <> o THEN total / n.n END) AS b FROM p JOIN n ON n.c = o GROUP BY 1, 2)
SELECT {R('avg(CASE WHEN size <= 1 THEN 0 ELSE (b - a) / greatest(a, b) END)')} AS silhouette_score FROM ab""")
def silhouette_query(spark, sf):
    return silhouette(clusters(spark, sf)).select(rnd("silhouette_score").alias("silhouette_score"))


@query("silhouette_squared", f"""
WITH {VECTORS}, p AS (SELECT row_id, CASE WHEN label = 9 THEN -1 ELSE label END AS c, v FROM vec),
l AS (SELECT row_id, c, unnest(v) AS x, unnest(range(len(v))) AS j FROM p),
m AS (SELECT c AS o, j, avg(x) AS mu FROM l GROUP BY 1, 2),
s AS (SELECT row_id, c, sum(x * x) AS q FROM l GROUP BY 1, 2),
k AS (SELECT c AS o, count(*) AS n, avg(q) AS mq FROM s GROUP BY 1),
d AS (
  SELECT s.row_id, s.c, k.o, k.n, s.q + k.mq - 2 * t.dot AS far
  FROM (SELECT row_id, o, sum(x * mu) AS dot FROM l JOIN m USING (j) GROUP BY 1, 2) t JOIN s USING (row_id) JOIN k USING (o)),
r AS (
  SELECT row_id, max(CASE WHEN o = c THEN n END) AS n, max(CASE WHEN o = c THEN far * n / (n - 1) END) AS a, min(CASE WHEN o <> c THEN far END) AS b
  FROM d GROUP BY 1)
SELECT {R('avg(CASE WHEN n = 1 THEN 0 ELSE (b - a) / greatest(a, b) END)')} AS silhouette_squared FROM r""")
def silhouette_squared(spark, sf):
    return E.silhouette_squared(clusters(spark, sf)).select(rnd("silhouette_squared").alias("silhouette_squared"))


@query("reducer_variance_ratio", """
WITH x AS (SELECT CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
t AS (SELECT sum(s) AS total FROM (SELECT j, var_pop(x) AS s FROM (SELECT unnest(v) AS x, unnest(range(len(v))) AS j FROM x) GROUP BY 1)),
c AS (SELECT var_pop(v[1] + v[2]) AS a, var_pop(v[3] - v[4]) AS b FROM x)
SELECT CAST(0 AS BIGINT) AS component, """ + R("a / total") + " AS ratio FROM c, t UNION ALL SELECT 1, " + R("b / total") + " FROM c, t")
def reducer_variance_ratio(spark, sf):
    v = vectors(spark, sf)
    x = F.col("features")
    out = E.reducer_variance_ratio(v.withColumn("components", F.array(x[0] + x[1], x[2] - x[3])))
    return out.select(big("component").alias("component"), rnd("ratio").alias("ratio"))


@query("plot_regressor", "SELECT p_partkey AS row_id, p_retailprice AS y_true, 900.0 + CAST(p_size AS DOUBLE) AS y_pred FROM part")
def plot_regressor(spark, sf):
    p = read_table(spark, sf, "part").select(
        F.col("p_partkey").alias("row_id"), F.col("p_retailprice").alias("label"),
        (F.lit(900.0) + F.col("p_size")).alias("prediction"),
    )
    return plot_data("regressor", p, 1)


@query("plot_cluster")
def plot_cluster(spark, sf):
    return plot_data("clusterer", clusters(spark, sf), 64)


@query("roc_auc", f"""
WITH {ORDER_PRED},
long AS (
  SELECT 'F' AS cls, p0 AS score, label = 'F' AS hit FROM opred UNION ALL
  SELECT 'O', p1, label = 'O' FROM opred UNION ALL SELECT 'P', p2, label = 'P' FROM opred),
rk AS (SELECT cls, hit, rank() OVER (PARTITION BY cls ORDER BY score) + (count(*) OVER (PARTITION BY cls, score) - 1) / 2.0 AS r FROM long),
auc AS (SELECT cls, CAST(count(*) FILTER (WHERE hit) AS DOUBLE) AS p, CAST(count(*) FILTER (WHERE NOT hit) AS DOUBLE) AS q,
  sum(CASE WHEN hit THEN r ELSE 0 END) AS rs FROM rk GROUP BY 1),
docs AS (SELECT l.quality, (d.doc_id * 37 % 100) / CAST(100 AS DOUBLE) AS score FROM documents d JOIN labels l ON d.doc_id = l.doc_id),
rb AS (SELECT quality = 1 AS hit, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0 AS r FROM docs),
ab AS (SELECT CAST(count(*) FILTER (WHERE hit) AS DOUBLE) AS p, CAST(count(*) FILTER (WHERE NOT hit) AS DOUBLE) AS q,
  sum(CASE WHEN hit THEN r ELSE 0 END) AS rs FROM rb)
SELECT 'orders' AS task, {R('sum((rs - p * (p + 1) / 2) / (p * q) * p) / sum(p)')} AS roc_auc FROM auc
UNION ALL SELECT 'documents', {R('(rs - p * (p + 1) / 2) / (p * q)')} FROM ab""")
def roc_auc(spark, sf):
    multi = E.roc_auc(order_predictions(spark, sf), ["F", "O", "P"])
    score = (F.col("doc_id") * 37 % 100) / 100.0
    two = docs_raw(spark, sf).select(F.col("quality").alias("label"), F.array(1 - score, score).alias("probability"))
    binary = E.roc_auc(two, [0, 1])
    return multi.select(F.lit("orders").alias("task"), rnd("roc_auc").alias("roc_auc")).unionByName(
        binary.select(F.lit("documents").alias("task"), rnd("roc_auc").alias("roc_auc")))


@query("cv_metrics")
def cv_metrics_query(spark, sf):
    p = docs_prepared(spark, sf)
    return cv_metrics(p.train, LDA(), 5)


@query("align_predictions", f"""
WITH {ORDER_PRED} SELECT o_orderkey AS row_id, o_orderpriority AS label, prediction
FROM orders LEFT JOIN opred ON o_orderkey = row_id AND label <> 'P'""")
def align_predictions(spark, sf):
    truth = read_table(spark, sf, "orders").select(F.col("o_orderkey").alias("row_id"), F.col("o_orderpriority").alias("label"))
    pred = order_predictions(spark, sf).where("label <> 'P'").select("row_id", "prediction")
    return E.align(pred, truth)


# --- thresholds, impurity, tests ------------------------------------------------------

def _gini(n, total):
    return "1 - (" + " + ".join(f"({c} / {total}) * ({c} / {total})" for c in n) + ")"


_STATUS = ("F", "O", "P")


@query("best_threshold", f"""
WITH v AS (SELECT o_orderpriority AS g, o_totalprice AS v,
  {', '.join(f"CAST(count(*) FILTER (WHERE o_orderstatus = '{c}') AS DOUBLE) AS n{i}" for i, c in enumerate(_STATUS))} FROM orders GROUP BY 1, 2),
w AS (SELECT g, v, lead(v) OVER o AS nxt, {', '.join(f'sum(n{i}) OVER (PARTITION BY g ORDER BY v) AS l{i}, sum(n{i}) OVER (PARTITION BY g) AS t{i}' for i in range(3))}
  FROM v WINDOW o AS (PARTITION BY g ORDER BY v)),
c AS (SELECT g, v, (v + nxt) / 2 AS threshold, l0 + l1 + l2 AS nl, t0 + t1 + t2 - l0 - l1 - l2 AS nr,
  {_gini(['l0', 'l1', 'l2'], '(l0 + l1 + l2)')} AS gl,
  {_gini(['(t0 - l0)', '(t1 - l1)', '(t2 - l2)'], '(t0 + t1 + t2 - l0 - l1 - l2)')} AS gr FROM w WHERE nxt IS NOT NULL),
k AS (SELECT g, v, threshold, (nl * gl + nr * gr) / (nl + nr) AS cost FROM c WHERE nl >= 5 AND nr >= 5),
b AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY round(cost, 12), v) AS rn FROM k)
SELECT g AS o_orderpriority, {R('threshold', 4)} AS threshold, {R('cost', 9)} AS cost FROM b WHERE rn = 1""")
def best_threshold(spark, sf):
    o = read_table(spark, sf, "orders")
    out = P.best_threshold(o, ["o_orderpriority"], "o_totalprice", "o_orderstatus", _STATUS, "gini", 5)
    return out.select("o_orderpriority", rnd("threshold", 4).alias("threshold"), rnd("cost", 9).alias("cost"))


_LANGS = ("de", "en", "es", "fr")


@query("impurity", f"""
WITH c AS (SELECT source, count(*) AS n, {', '.join(f"CAST(count(*) FILTER (WHERE lang = '{c}') AS DOUBLE) AS n{i}" for i, c in enumerate(_LANGS))} FROM documents GROUP BY 1)
SELECT source, n, {R(' + '.join(f'(CASE WHEN n{i} > 0 THEN -(n{i} / n) * log2(n{i} / n) ELSE 0 END)' for i in range(4)))} AS entropy,
  {R(_gini([f'n{i}' for i in range(4)], 'n'))} AS gini FROM c""")
def impurity(spark, sf):
    t = P.impurity_table(read_table(spark, sf, "documents"), ["source"], "lang", _LANGS)
    return t.select("source", "n", rnd("entropy").alias("entropy"), rnd("gini").alias("gini"))


@query("chi_square", f"""
WITH c AS (SELECT o_orderpriority AS r, o_orderstatus AS s, CAST(count(*) AS DOUBLE) AS n FROM orders GROUP BY 1, 2),
rr AS (SELECT r, sum(n) AS nr FROM c GROUP BY 1), ss AS (SELECT s, sum(n) AS ns FROM c GROUP BY 1), t AS (SELECT sum(n) AS nt FROM c),
e AS (SELECT nr * ns / nt AS e, coalesce(n, 0) AS n FROM rr CROSS JOIN ss CROSS JOIN t LEFT JOIN c ON c.r = rr.r AND c.s = ss.s)
SELECT {R('sum((n - e) * (n - e) / e)')} AS statistic,
  ((SELECT count(*) FROM rr) - 1) * ((SELECT count(*) FROM ss) - 1) AS dof FROM e""")
def chi_square(spark, sf):
    t = P.chi_square_table(read_table(spark, sf, "orders"), "o_orderpriority", "o_orderstatus")
    return t.select(rnd("statistic").alias("statistic"), big("dof").alias("dof"))


@query("softmax", f"""
WITH s AS (SELECT o_orderkey AS row_id, o_totalprice / CAST(100000 AS DOUBLE) AS a, CAST(o_orderkey % 7 AS DOUBLE) AS b, CAST(o_orderkey % 3 AS DOUBLE) AS c FROM orders),
x AS (SELECT row_id, exp(a - greatest(a, b, c)) AS ea, exp(b - greatest(a, b, c)) AS eb, exp(c - greatest(a, b, c)) AS ec FROM s)
SELECT row_id, {R('ea / (ea + eb + ec)')} AS p0, {R('eb / (ea + eb + ec)')} AS p1, {R('ec / (ea + eb + ec)')} AS p2 FROM x""")
def softmax_query(spark, sf):
    k = F.col("o_orderkey")
    s = read_table(spark, sf, "orders").select(
        k.alias("row_id"),
        F.array(F.col("o_totalprice") / 100000.0, (k % 7).cast("double"), (k % 3).cast("double")).alias("s"),
    ).withColumn("p", softmax("s"))
    return s.select("row_id", *[rnd(F.col("p")[i]).alias(f"p{i}") for i in range(3)])


# --- report and comparison tables -----------------------------------------------------------

@query("importance_ranking", f"""
WITH {DOCS_LONG}, m AS (SELECT feature, label, avg(x) AS mean FROM docs_l WHERE NOT is_test GROUP BY 1, 2),
i AS (SELECT feature, stddev_pop(mean) AS importance FROM m GROUP BY 1)
SELECT 'feature_' || feature AS feature, {R('importance')} AS importance, row_number() OVER (ORDER BY importance DESC, feature) AS rank FROM i""")
def importance_ranking(spark, sf):
    from ..models.discriminant import NaiveBayes

    fitted = NaiveBayes().fit(docs_prepared(spark, sf).train)
    table = spark.createDataFrame(list(fitted.importance.items()), "feature string, importance double")
    return P.importance_ranking(table).select("feature", rnd("importance").alias("importance"), big("rank").alias("rank"))


@query("prediction_sample", f"""
WITH {ORDER_PRED} SELECT row_id, prediction, format('{{:.3f}}, {{:.3f}}, {{:.3f}}', p0 + 1e-12, p1 + 1e-12, p2 + 1e-12) AS probabilities
FROM opred ORDER BY row_id LIMIT 25""")
def prediction_sample(spark, sf):
    return P.prediction_sample(order_predictions(spark, sf))


@query("run_overview", f"""
WITH m AS (SELECT l_returnflag, avg(CASE WHEN l_returnflag <> 'N' THEN l_quantity END) AS s FROM lineitem GROUP BY 1)
SELECT {R('sum(coalesce(s, 0))')} AS total_seconds, count(*) AS n_models, CAST(0.2 AS DOUBLE) AS test_share FROM m""")
def run_overview(spark, sf):
    m = read_table(spark, sf, "lineitem").groupBy("l_returnflag").agg(
        F.avg(F.when(F.col("l_returnflag") != "N", F.col("l_quantity"))).alias("fit_seconds"))
    return P.run_overview(m, 0.2).withColumn("total_seconds", rnd("total_seconds"))


@query("common_metrics", f"""
WITH {METRICS} SELECT metric FROM mrows GROUP BY 1
HAVING count(*) = (SELECT count(*) FROM (SELECT DISTINCT run_id, model_key FROM mrows))""")
def common_metrics(spark, sf):
    return P.common_metrics(metric_rows(spark, sf))


@query("metrics_pivot", f"""
WITH {METRICS} SELECT metric, {', '.join(f"{R(f'max(CASE WHEN model_key = {chr(39)}{m}{chr(39)} THEN value END)')} AS {m}" for m in 'ANR')}
FROM mrows WHERE run_id = 'O' GROUP BY 1""")
def metrics_pivot(spark, sf):
    t = P.metrics_pivot(metric_rows(spark, sf).where("run_id = 'O'"), ["A", "N", "R"])
    return t.select("metric", *[rnd(m).alias(m) for m in "ANR"])


@query("compare_models", f"""
WITH {METRICS}, refs(position, run_id, model_key) AS (VALUES (CAST(0 AS BIGINT), 'O', 'R'), (1, 'F', 'A'), (2, 'O', 'N')),
c AS (SELECT position, m.* FROM mrows m JOIN refs USING (run_id, model_key)),
k AS (SELECT metric FROM c GROUP BY 1 HAVING count(*) = 3)
SELECT position, run_id, model_key, metric, {R('value')} AS value FROM c WHERE metric IN (SELECT metric FROM k)""")
def compare_models(spark, sf):
    t = P.compare_models(metric_rows(spark, sf), [("O", "R"), ("F", "A"), ("O", "N")])
    return t.withColumn("position", big("position")).withColumn("value", rnd("value"))


@query("format_metrics", f"""
WITH {METRICS} SELECT run_id, model_key, metric,
  CASE WHEN value = floor(value) THEN format('{{:.0f}}', value) ELSE format('{{:.4f}}', value) END AS text FROM mrows""")
def format_metrics(spark, sf):
    return P.format_metrics(metric_rows(spark, sf)).drop("value")


@query("confusion_scale", f"""
WITH {_DENSE}, m AS (SELECT *, max(n) OVER (PARTITION BY actual) AS top FROM dense)
SELECT actual, predicted, n, CAST(CASE WHEN n <= 0 OR top <= 0 THEN 0 ELSE least(ceil(n / CAST(top AS DOUBLE) * 5), 5) - 1 END AS BIGINT) AS step,
  actual = predicted AS is_correct FROM m""")
def confusion_scale(spark, sf):
    t = P.confusion_scale(E.confusion_matrix(order_predictions(spark, sf)))
    return t.withColumn("step", big("step"))


@query("cluster_summary", f"""
WITH {CLUSTERS}, s AS (SELECT CAST(c AS BIGINT) AS cluster, count(*) AS n FROM clu GROUP BY 1)
SELECT cluster, n, (SELECT count(*) FROM s WHERE cluster <> -1) AS n_clusters,
  CAST((SELECT coalesce(sum(n), 0) FROM s WHERE cluster = -1) AS BIGINT) AS n_noise FROM s""")
def cluster_summary(spark, sf):
    return E.cluster_summary(clusters(spark, sf)).withColumn("cluster", big("cluster"))


@query("cumulative_variance", f"""
WITH x AS (SELECT CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
s AS (SELECT j, var_pop(x) AS s FROM (SELECT unnest(v) AS x, unnest(range(len(v))) AS j FROM x) GROUP BY 1),
r AS (SELECT j, CASE WHEN j <> 3 THEN s / (SELECT sum(s) FROM s) END AS ratio FROM s)
SELECT 'PC' || (j + 1) AS label, CAST(j AS BIGINT) AS component, {R('ratio')} AS ratio, {R('sum(coalesce(ratio, 0)) OVER (ORDER BY j)')} AS cumulative FROM r""")
def cumulative_variance(spark, sf):
    t = E.reducer_variance_ratio(vectors(spark, sf).withColumn("components", F.col("features")))
    gap = t.withColumn("ratio", F.when(F.col("component") != 3, F.col("ratio")))
    return P.cumulative_variance(gap).select(
        "label", big("component").alias("component"), rnd("ratio").alias("ratio"), rnd("cumulative").alias("cumulative"))


@query("report_summary", f"""
WITH {DOCS_RAW} SELECT 'documents' AS dataset, count(*) AS n_rows, CAST(4 AS BIGINT) AS n_cols, 'quality' AS target,
  'classification' AS data_type, CAST(0.2 AS DOUBLE) AS test_size, 'Gaussian Naive Bayes, Linear Discriminant Analysis' AS models FROM docs""")
def report_summary_query(spark, sf):
    return report_summary(docs_raw(spark, sf), "doc_id", "quality", "classification", "documents", 0.2,
                          ["Gaussian Naive Bayes", "Linear Discriminant Analysis"])
