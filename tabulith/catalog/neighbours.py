"""Queries: neighbour joins, radius search, components and density clusters."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..models.density import DBSCAN, density_clusters
from ..models.library import NearestCentre
from ..operators import distance as D
from ..operators.evaluate import centroids
from ..operators.graph import connected_components
from ..operators.prepare import split
from ..session import collect_bounded
from .common import PLACES, VECTOR_SPLIT, VECTORS, R, big, places, query, random_sql, rnd, vector_split, vectors

_KNN = VECTOR_SPLIT + """,
pairs AS (SELECT q.row_id AS query_id, t.row_id AS train_id, t.label, list_distance(q.v, t.v) AS distance
  FROM vec_s q CROSS JOIN vec_s t WHERE q.is_test AND NOT t.is_test),
near AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, train_id) AS rank FROM pairs)"""


@query("knn_join", f"WITH {_KNN} SELECT query_id, train_id, {R('distance')} AS distance, rank FROM near WHERE rank <= 5")
def knn_join(spark, sf):
    train, test = vector_split(spark, sf)
    return D.knn_join(test, train, 5).select("query_id", "train_id", rnd("distance").alias("distance"), big("rank").alias("rank"))


@query("knn_classify", f"""
WITH {_KNN}, v AS (SELECT query_id, label, count(*) AS n FROM near WHERE rank <= 5 GROUP BY 1, 2),
b AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY n DESC, label) AS rn FROM v)
SELECT query_id, CAST(label AS BIGINT) AS prediction, {R('n / CAST(5 AS DOUBLE)')} AS share FROM b WHERE rn = 1""")
def knn_classify(spark, sf):
    train, test = vector_split(spark, sf)
    votes = D.knn_vote(D.knn_join(test, train, 5, extra="label"), "label")
    return votes.select("query_id", big("prediction").alias("prediction"), rnd("share").alias("share"))


_GAP = "sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y))"


@query("eps_join", f"""
WITH {PLACES}, p AS (SELECT a.id AS query_id, b.id AS other, {_GAP} AS d FROM cust a JOIN supp b ON {_GAP} <= 0.2),
s AS (SELECT query_id, count(*) AS n, min(d) AS d, arg_min(other, (d, other)) AS nearest FROM p GROUP BY 1)
SELECT c.id AS query_id, coalesce(n, 0) AS n_within, nearest AS nearest_id, {R('d')} AS nearest_distance
FROM cust c LEFT JOIN s ON s.query_id = c.id""")
def eps_join(spark, sf):
    cust, supp = places(spark, sf), places(spark, sf, "supplier", "s", "s_suppkey")
    return D.radius_join(cust, supp, 0.2).withColumn("nearest_distance", rnd("nearest_distance"))


@query("nearest_core", f"""
WITH {PLACES}, p AS (SELECT a.id, b.nation, row_number() OVER (PARTITION BY a.id ORDER BY {_GAP}, b.id) AS rn
  FROM cust a JOIN supp b ON {_GAP} <= 0.15)
SELECT c.id AS row_id, CAST(coalesce(p.nation, -1) AS BIGINT) AS prediction FROM cust c LEFT JOIN p ON p.id = c.id AND rn = 1""")
def nearest_core(spark, sf):
    cust, supp = places(spark, sf), places(spark, sf, "supplier", "s", "s_suppkey")
    return D.nearest_core(cust, supp, 0.15, cluster="nation").withColumn("prediction", big("prediction"))


@query("connected_components", f"""
WITH RECURSIVE {VECTORS},
n AS (SELECT a.row_id AS src, b.row_id AS dst, row_number() OVER (PARTITION BY a.row_id ORDER BY list_distance(a.v, b.v), b.row_id) AS rn
  FROM vec a CROSS JOIN vec b WHERE a.row_id <> b.row_id),
e AS (SELECT src, dst FROM n WHERE rn = 1 UNION SELECT dst, src FROM n WHERE rn = 1),
reach(id, other) AS (SELECT row_id, row_id FROM vec UNION SELECT r.id, e.dst FROM reach r JOIN e ON e.src = r.other)
SELECT id, min(other) AS component FROM reach GROUP BY 1""")
def components(spark, sf):
    """Every vector linked to its closest other vector; the connected parts."""
    v = vectors(spark, sf)
    near = D.knn_join(v, v, 2).where("query_id <> train_id").groupBy("query_id").agg(
        F.min(F.struct("distance", "train_id")).alias("best"))
    edges = near.select(F.col("query_id").alias("src"), F.col("best.train_id").alias("dst"))
    return connected_components(edges, v.select(F.col("row_id").alias("id")))


@query("kmeans_assign", f"""
WITH {VECTORS}, l AS (SELECT label, unnest(v) AS x, unnest(range(len(v))) AS j FROM vec),
c AS (SELECT label, list(m ORDER BY j) AS m FROM (SELECT label, j, avg(x) AS m FROM l GROUP BY 1, 2) GROUP BY 1),
d AS (SELECT row_id, c.label AS k, row_number() OVER (PARTITION BY row_id ORDER BY list_distance(v, m), c.label) AS rn FROM vec CROSS JOIN c)
SELECT row_id, CAST(k AS BIGINT) AS prediction FROM d WHERE rn = 1""")
def kmeans_assign(spark, sf):
    """Nearest of the given centres: the mean vector of each label."""
    import numpy as np

    v = vectors(spark, sf)
    rows = collect_bounded(centroids(v, "features", "label"), 1000, "The centre list")
    rows = sorted(rows, key=lambda r: r["label"])
    model = NearestCentre("given centres", "clusterer", {}, 64, centres=np.array([r["centroid"] for r in rows]),
                          names=[r["label"] for r in rows])
    return model.transform(v).select("row_id", big("prediction").alias("prediction"))


def _density_sql(rows: str, eps: float) -> str:
    """Cluster numbers of core and border rows of a table of places."""
    return f"""
p AS (SELECT a.id AS i, b.id AS j FROM {rows} a JOIN {rows} b ON {_GAP} <= {eps}),
core AS (SELECT i AS id FROM p GROUP BY 1 HAVING count(*) >= 4),
e AS (SELECT p.i, p.j FROM p JOIN core a ON a.id = p.i JOIN core b ON b.id = p.j),
reach(id, other) AS (SELECT id, id FROM core UNION SELECT r.id, e.j FROM reach r JOIN e ON e.i = r.other),
comp AS (SELECT id, min(other) AS c FROM reach GROUP BY 1),
num AS (SELECT c, row_number() OVER (ORDER BY c) - 1 AS k FROM (SELECT DISTINCT c FROM comp)),
lab AS (SELECT id, k FROM comp JOIN num USING (c)),
border AS (SELECT p.i AS id, min(k) AS k FROM p JOIN lab ON lab.id = p.j WHERE p.i NOT IN (SELECT id FROM core) GROUP BY 1)"""


@query("dbscan", f"""
WITH RECURSIVE {PLACES},{_density_sql("cust", 0.05)}
SELECT cust.id AS row_id, CAST(coalesce(lab.k, border.k, -1) AS BIGINT) AS prediction, lab.id IS NOT NULL AS is_core
FROM cust LEFT JOIN lab ON lab.id = cust.id LEFT JOIN border ON border.id = cust.id""")
def dbscan(spark, sf):
    return density_clusters(places(spark, sf), 0.05, 4).withColumn("prediction", big("prediction"))


@query("fit_dbscan", f"""
WITH RECURSIVE {PLACES},{random_sql("cust", "id", "parted")},
train AS (SELECT * FROM parted WHERE NOT is_test),{_density_sql("train", 0.1)},
near AS (
  SELECT a.id, lab.k, row_number() OVER (PARTITION BY a.id ORDER BY {_GAP}, b.id) AS rn
  FROM parted a JOIN train b ON {_GAP} <= 0.1 JOIN lab ON lab.id = b.id WHERE a.is_test)
SELECT c.id AS row_id, CAST(CASE WHEN is_test THEN coalesce(near.k, -1) ELSE coalesce(lab.k, border.k, -1) END AS BIGINT) AS prediction
FROM parted c LEFT JOIN lab ON lab.id = c.id LEFT JOIN border ON border.id = c.id LEFT JOIN near ON near.id = c.id AND rn = 1""")
def fit_dbscan(spark, sf):
    """Clusters of the training part; its rows keep their label, the others take the nearest core row's."""
    both = split(places(spark, sf), "row_id")
    model = DBSCAN(0.1, 4).fit(both.where("split = 'train'"))
    return model.transform(both).select("row_id", big("prediction").alias("prediction"))
