"""Queries: model statistics, fits, trees and contributions."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from ..functions.scalar import chi_square
from ..models import boosting, density, discriminant, hmm, library, oblique, trees
from ..models.contributions import mean_abs_contribution, tree_contributions
from ..models.moments import class_covariances, class_moments, covariance_table, max_correlation, pooled_covariance, ClassStats
from ..operators.prepare import fit_prepare, split
from ..operators.series import lookback
from ..sources.tables import read_table
from .common import (
    DOCS_LONG, FLAGS, LINE_LONG, R, VECTORS, big, daily, docs_prepared, line_rows, naive_bayes_sql, places, query, rnd,
    vector_split, vectors,
)

# --- statistics behind the closed-form fits -----------------------------------------


@query("naive_bayes_stats", f"""
WITH {DOCS_LONG} SELECT CAST(label AS BIGINT) AS label, CAST(feature AS BIGINT) AS feature, count(*) AS n, {R('avg(x)')} AS mean, {R('var_pop(x)')} AS var
FROM docs_l WHERE NOT is_test GROUP BY 1, 2""")
def naive_bayes_stats(spark, sf):
    t = class_moments(docs_prepared(spark, sf).train)
    return t.select(big("label").alias("label"), big("feature").alias("feature"), "n", rnd("mean").alias("mean"), rnd("var").alias("var"))


@query("naive_bayes_predict", f"""
WITH {DOCS_LONG},{naive_bayes_sql('docs_l', 'nb', 'l.is_test')}
SELECT row_id, CAST(actual AS BIGINT) AS label, CAST(prediction AS BIGINT) AS prediction, {R('p1')} AS p1 FROM nb""")
def naive_bayes_predict(spark, sf):
    p = docs_prepared(spark, sf)
    out = discriminant.NaiveBayes().fit(p.train).transform(p.test)
    return out.select("row_id", big("label").alias("label"), big("prediction").alias("prediction"),
                      rnd(F.col("probability")[1]).alias("p1"))


@query("lda_class_stats", f"""
WITH {DOCS_LONG} SELECT CAST(label AS BIGINT) AS label, CAST(feature AS BIGINT) AS feature, count(*) AS n,
  {R('count(*) / CAST((SELECT count(*) FROM docs_x WHERE NOT is_test) AS DOUBLE)')} AS prior, {R('avg(x)')} AS mean
FROM docs_l WHERE NOT is_test GROUP BY 1, 2""")
def lda_class_stats(spark, sf):
    stats = class_covariances(docs_prepared(spark, sf).train)
    total = sum(s.n for s in stats)
    rows = [(s.label, j, s.n, s.n / total, float(m)) for s in stats for j, m in enumerate(s.mean)]
    t = spark.createDataFrame(rows, "label bigint, feature bigint, n bigint, prior double, mean double")
    return t.withColumn("prior", rnd("prior")).withColumn("mean", rnd("mean"))


_COV = DOCS_LONG + """,
cov AS (SELECT a.label, a.feature AS i, b.feature AS j, count(*) AS n, covar_samp(a.x, b.x) AS cov
  FROM docs_l a JOIN docs_l b ON a.row_id = b.row_id AND a.feature <= b.feature WHERE NOT a.is_test GROUP BY 1, 2, 3)"""


@query("lda_pooled_cov", f"""
WITH {_COV} SELECT CAST(i AS BIGINT) AS i, CAST(j AS BIGINT) AS j, {R('sum((n - 1) * cov) / (sum(n) - count(*))')} AS cov FROM cov GROUP BY 1, 2""")
def lda_pooled_cov(spark, sf):
    stats = class_covariances(docs_prepared(spark, sf).train)
    pooled = ClassStats("all", sum(s.n for s in stats), stats[0].mean, pooled_covariance(stats))
    return covariance_table(spark, [pooled]).select(big("i").alias("i"), big("j").alias("j"), rnd("cov").alias("cov"))


_COV_OUT = f"WITH {_COV} SELECT CAST(label AS VARCHAR) AS label, CAST(i AS BIGINT) AS i, CAST(j AS BIGINT) AS j, {R('cov')} AS cov FROM cov"


def _covariances(spark, sf):
    t = covariance_table(spark, class_covariances(docs_prepared(spark, sf).train))
    return t.select("label", big("i").alias("i"), big("j").alias("j"), rnd("cov").alias("cov"))


@query("qda_class_cov", _COV_OUT)
def qda_class_cov(spark, sf):
    return _covariances(spark, sf)


@query("class_covariance", f"""
WITH {VECTORS}, l AS (SELECT row_id, label, unnest(v) AS x, unnest(range(len(v))) AS j FROM vec)
SELECT CAST(a.label AS VARCHAR) AS label, CAST(a.j AS BIGINT) AS i, CAST(b.j AS BIGINT) AS j, {R('covar_samp(a.x, b.x)')} AS cov
FROM l a JOIN l b ON a.row_id = b.row_id AND a.j <= b.j GROUP BY 1, 2, 3""")
def class_covariance(spark, sf):
    """Ten classes by 64 features: the wide path of the covariance job."""
    t = covariance_table(spark, class_covariances(vectors(spark, sf)))
    return t.select("label", big("i").alias("i"), big("j").alias("j"), rnd("cov").alias("cov"))


@query("pca_covariance", f"""
WITH {VECTORS}, l AS (SELECT row_id, unnest(v) AS x, unnest(range(len(v))) AS j FROM vec)
SELECT CAST(a.j AS BIGINT) AS i, CAST(b.j AS BIGINT) AS j, {R('covar_samp(a.x, b.x)')} AS cov
FROM l a JOIN l b ON a.row_id = b.row_id AND a.j <= b.j GROUP BY 1, 2""")
def pca_covariance(spark, sf):
    t = covariance_table(spark, class_covariances(vectors(spark, sf), None))
    return t.select(big("i").alias("i"), big("j").alias("j"), rnd("cov").alias("cov"))


@query("max_correlation", f"""
WITH {VECTORS}, l AS (SELECT row_id, unnest(v) AS x, unnest(range(len(v))) AS j FROM vec),
c AS (SELECT abs(corr(a.x, b.x)) AS r FROM l a JOIN l b ON a.row_id = b.row_id AND a.j < b.j GROUP BY a.j, b.j)
SELECT {R('max(r)')} AS max_correlation FROM c""")
def max_correlation_query(spark, sf):
    value = max_correlation(class_covariances(vectors(spark, sf), None)[0])
    return spark.createDataFrame([(value,)], "max_correlation double").select(rnd("max_correlation").alias("max_correlation"))


_OLS = ("l_quantity", "l_discount", "l_tax", "l_extendedprice")


@query("ols_normal_stats", " UNION ALL ".join(
    f"SELECT CAST({i} AS BIGINT) AS i, CAST({j} AS BIGINT) AS j, {R(f'covar_samp({_OLS[i]}, {_OLS[j]})', 1 if j == 3 and i == 3 else 3)} AS cov FROM lineitem"
    for i in range(4) for j in range(i, 4)))
def ols_normal_stats(spark, sf):
    li = read_table(spark, sf, "lineitem").select(F.array(*_OLS).alias("features"))
    t = covariance_table(spark, class_covariances(li, None))
    last = (F.col("i") == 3) & (F.col("j") == 3)
    return t.select(big("i").alias("i"), big("j").alias("j"), F.when(last, rnd("cov", 1)).otherwise(rnd("cov", 3)).alias("cov"))


# --- fits checked by invariants ---------------------------------------------------------


def _classified(fitted, rows):
    out = fitted.transform(rows)
    return out.select("row_id", "label", "prediction", F.transform("probability", lambda p: F.round(p, 6)).alias("probability"))


def _docs_fit(name, model):
    @query(name)
    def run(spark, sf):
        p = docs_prepared(spark, sf)
        return _classified(model().fit(p.train), p.test)

    return run


_docs_fit("fit_logistic", library.Logistic)
_docs_fit("fit_lda", discriminant.LDA)
_docs_fit("fit_qda", lambda: discriminant.QDA(reg_param=0.1))
_docs_fit("fit_cart", lambda: trees.CART(ccp_alpha=0.001))
_docs_fit("fit_id3", trees.ID3)
_docs_fit("fit_chaid", trees.CHAID)
_docs_fit("fit_oblique", oblique.Oblique)
_docs_fit("fit_random_forest", lambda: library.RandomForest(n_estimators=20, max_depth=6))
_docs_fit("fit_gbt", lambda: boosting.BoostedTrees(n_estimators=50))
_docs_fit("fit_svm_linear", lambda: library.SVM("linear"))
_docs_fit("fit_svm_rbf", lambda: library.SVM("rbf", n_components=50))
_docs_fit("fit_mlp", lambda: library.Perceptron((16, 8), 50))


def _flag_rows(spark, sf):
    """Line items with their return flag as label; every feature has few distinct values."""
    li = read_table(spark, sf, "lineitem")
    key = F.concat_ws("-", "l_orderkey", "l_linenumber")
    return li.select(key.alias("row_id"), F.col("l_returnflag").alias("label"), F.array(*[F.col(c).cast("double") for c in _FLAG_FEATURES]).alias("features"))


_FLAG_FEATURES = ("l_quantity", "l_discount", "l_tax")
_PICK = "CASE b.feature " + " ".join(f"WHEN {j} THEN x{j}" for j in range(3)) + " END"


def _cuts_sql(depth: int) -> str:
    """Best cut per class and node of a level: gradients 1/3 - [label = class], curvatures 4/9, one as penalty."""
    part = lambda g, h: f"({g}) * ({g}) / ({h} + 1)"
    return f"""
h{depth} AS (
  SELECT cls, path, feature, x, count(*) / 3e0 - count(*) FILTER (label = cls) AS g, count(*) * 4 / 9e0 AS h
  FROM (SELECT cls, path, label, unnest([0, 1, 2]) AS feature, unnest([x0, x1, x2]) AS x FROM n{depth}) GROUP BY ALL),
s{depth} AS (
  SELECT *, sum(g) OVER w AS gl, sum(h) OVER w AS hl, sum(g) OVER t AS gt, sum(h) OVER t AS ht, max(x) OVER t AS last FROM h{depth}
  WINDOW w AS (PARTITION BY cls, path, feature ORDER BY x), t AS (PARTITION BY cls, path, feature)),
c{depth} AS (
  SELECT *, ({part("gl", "hl")} + {part("gt - gl", "ht - hl")} - {part("gt", "ht")}) / 2 AS gain,
  FROM s{depth} WHERE x < last AND hl >= 1 AND ht - hl >= 1),
b{depth} AS MATERIALIZED (
  SELECT c.*, e.threshold FROM c{depth} c JOIN edge e USING (feature, x) WHERE gain > 1e-6
  QUALIFY row_number() OVER (PARTITION BY cls, path ORDER BY gain DESC, feature, x) = 1)"""


@query("boost_first_trees", f"""
WITH li AS (SELECT l_returnflag AS label, CAST(l_quantity AS DOUBLE) AS x0, CAST(l_discount AS DOUBLE) AS x1, CAST(l_tax AS DOUBLE) AS x2 FROM lineitem),
edge AS (
  SELECT feature, x, x + (lead(x) OVER (PARTITION BY feature ORDER BY x) - x) / 2 AS threshold
  FROM (SELECT DISTINCT unnest([0, 1, 2]) AS feature, unnest([x0, x1, x2]) AS x FROM li)),
n0 AS (SELECT li.*, k.cls, '' AS path FROM li, (SELECT DISTINCT label AS cls FROM li) k),{_cuts_sql(0)},
n1 AS (SELECT n.* EXCLUDE (path), CASE WHEN {_PICK} <= b.threshold THEN 'L' ELSE 'R' END AS path FROM n0 n JOIN b0 b ON b.cls = n.cls),{_cuts_sql(1)},
l AS (
  SELECT b.cls, b.path || side AS path, CASE side WHEN 'L' THEN gl ELSE gt - gl END AS g, CASE side WHEN 'L' THEN hl ELSE ht - hl END AS h
  FROM b1 b, (VALUES ('L'), ('R')) t(side))
SELECT cls, path, CAST(feature AS BIGINT) AS feature, {R('threshold')} AS threshold, {R('gain', 4)} AS gain, CAST(0 AS DOUBLE) AS value FROM b0
UNION ALL SELECT cls, path, CAST(feature AS BIGINT), {R('threshold')}, {R('gain', 4)}, 0 FROM b1
UNION ALL SELECT cls, path, -1, 0, 0, {R('-0.1 * g / (h + 1)')} FROM l""")
def boost_first_trees(spark, sf):
    """The trees of the first round, one per class, two levels deep."""
    fitted = boosting.BoostedTrees(n_estimators=1, max_depth=2).fit(_flag_rows(spark, sf))
    rows = []
    for tree in fitted.trees:
        paths = {0: ""}
        for i, f in enumerate(tree.feature):
            if f >= 0:
                paths[tree.left[i]], paths[tree.right[i]] = paths[i] + "L", paths[i] + "R"
            inner = (f, tree.threshold[i], tree.gain[i], 0.0) if f >= 0 else (-1, 0.0, 0.0, tree.value[i])
            rows.append((fitted.classes[tree.output], paths[i], *inner))
    t = spark.createDataFrame(rows, "cls string, path string, feature bigint, threshold double, gain double, value double")
    return t.select("cls", "path", "feature", rnd("threshold").alias("threshold"), rnd("gain", 4).alias("gain"), rnd("value").alias("value"))


def _vector_fit(name, model):
    @query(name)
    def run(spark, sf):
        train, test = vector_split(spark, sf)
        return model().fit(train.drop("label")).transform(test).select("row_id", "prediction")

    return run


_vector_fit("fit_kmeans", library.KMeansClusters)
_vector_fit("fit_gmm", library.Mixture)
_vector_fit("micro_linkage", lambda: density.MicroLinkage(3, micro=32))


@query("fit_pca")
def fit_pca(spark, sf):
    train, test = vector_split(spark, sf)
    out = library.PrincipalComponents(2).fit(train.drop("label")).transform(test)
    return out.select("row_id", *[rnd(F.col("components")[i]).alias(f"pc{i + 1}") for i in range(2)])


@query("fit_poly_regression")
def fit_poly_regression(spark, sf):
    part = read_table(spark, sf, "part").select("p_partkey", "p_size", "p_type", "p_brand", "p_retailprice")
    p = fit_prepare(part, "p_partkey", "p_retailprice", "regression")
    return library.PolynomialRegression(2).fit(p.train).transform(p.test).select("row_id", "label", rnd("prediction", 4).alias("prediction"))


def _sequences(spark, sf, steps):
    """One lookback row per event type and day."""
    rows = lookback(daily(spark, sf), ["event_type"], "day", ["n", "mean_value"], steps)
    return rows.withColumn("row_id", F.concat_ws("-", "event_type", "day"))


@query("fit_lagged_regression")
def fit_lagged_regression(spark, sf):
    both = split(_sequences(spark, sf, 3).withColumn("label", F.col("n")), "row_id").select("row_id", "label", "features", "split")
    model = library.LaggedRegression().fit(both.where("split = 'train'"))
    return model.transform(both.where("split = 'test'")).select("row_id", "label", rnd("prediction", 4).alias("prediction"))


@query("fit_hmm")
def fit_hmm(spark, sf):
    rows = _sequences(spark, sf, 5).withColumn("label", (F.col("n") > F.col("features")[8]).cast("int"))
    both = split(rows, "row_id", "label", "classification").select("row_id", "label", "features", "split")
    return _classified(hmm.HiddenMarkov().fit(both.where("split = 'train'")), both.where("split = 'test'"))


# --- trees ---------------------------------------------------------------------------------

_COUNTS = ", ".join(f"count(*) FILTER (WHERE cls = '{c}') AS c{i}" for i, c in enumerate(FLAGS))


def _gini(n, total):
    return "1 - (" + " + ".join(f"({c} / {total}) * ({c} / {total})" for c in n) + ")"


def _entropy(n, total):
    return " + ".join(f"(CASE WHEN {c} > 0 THEN -({c} / {total}) * log2({c} / {total}) ELSE 0 END)" for c in n)


@query("cart_root_split", f"""
WITH {LINE_LONG}, v AS (SELECT feature, x, {_COUNTS} FROM line_l GROUP BY 1, 2),
w AS (SELECT feature, x, lead(x) OVER o AS nxt, {', '.join(f'CAST(sum(c{i}) OVER (PARTITION BY feature ORDER BY x) AS DOUBLE) AS l{i}, CAST(sum(c{i}) OVER (PARTITION BY feature) AS DOUBLE) AS t{i}' for i in range(3))}
  FROM v WINDOW o AS (PARTITION BY feature ORDER BY x)),
c AS (SELECT feature, (x + nxt) / 2 AS threshold, l0 + l1 + l2 AS nl, t0 + t1 + t2 - l0 - l1 - l2 AS nr, {_gini(['t0', 't1', 't2'], '(t0 + t1 + t2)')} AS g0,
  {_gini(['l0', 'l1', 'l2'], '(l0 + l1 + l2)')} AS gl, {_gini(['(t0 - l0)', '(t1 - l1)', '(t2 - l2)'], '(t0 + t1 + t2 - l0 - l1 - l2)')} AS gr
  FROM w WHERE nxt IS NOT NULL),
k AS (SELECT *, g0 - (nl * gl + nr * gr) / (nl + nr) AS gain FROM c),
b AS (SELECT *, row_number() OVER (PARTITION BY feature ORDER BY round(gain, 12) DESC, threshold) AS rn FROM k)
SELECT CAST(feature AS BIGINT) AS feature, {R('threshold')} AS threshold, {R('gain', 10)} AS gain, CAST(nl AS BIGINT) AS n_left, CAST(nr AS BIGINT) AS n_right FROM b WHERE rn = 1""")
def cart_root_split(spark, sf):
    rows = line_rows(spark, sf)
    root, edges = _root(rows, 256)
    counts = trees.level_counts(rows, [root], [0], {0: edges}, 3, True)
    best = trees.score_features(counts, 3, trees.threshold_rule("gini", 1))
    at = F.array(*[F.array(*[F.lit(float(e)) for e in es]) for es in edges])
    size = lambda i: F.aggregate(F.col("tables")[i], F.lit(0).cast("bigint"), lambda a, v: a + v)
    return best.select(big("feature").alias("feature"), rnd(at[F.col("feature")][F.col("bins")[0]]).alias("threshold"),
                       rnd("gain", 10).alias("gain"), size(0).alias("n_left"), size(1).alias("n_right"))


def _root(rows, n_bins):
    r = rows.agg(*[F.count_if(F.col("y") == c).alias(f"c{c}") for c in range(3)]).first()
    counts = np.array(list(r))
    root = trees.Node(0, None, None, 0, counts, float(trees.impurity_of(counts, "entropy")[0]))
    return root, trees.global_edges(rows, 4, n_bins, int(counts.sum()))


def _edges_sql(n):
    q = ", ".join(f"CAST({i / n} AS DOUBLE)" for i in range(1, n))
    return LINE_LONG + f""",
q AS (SELECT feature, unnest(quantile_cont(x, [{q}])) AS e, min(x) AS lo, max(x) AS hi, count(DISTINCT x) AS k FROM line_l GROUP BY 1),
d AS (SELECT feature, x, lead(x) OVER (PARTITION BY feature ORDER BY x) AS nxt, count(*) OVER (PARTITION BY feature) AS k
  FROM (SELECT DISTINCT feature, x FROM line_l)),
edges AS (SELECT DISTINCT feature, e FROM q WHERE k > {n} AND e >= lo AND e < hi
  UNION ALL SELECT feature, (x + nxt) / 2 FROM d WHERE k <= {n} AND nxt IS NOT NULL),
binned AS (SELECT rid, cls, l.feature, count(e.e) AS bin FROM line_l l LEFT JOIN edges e ON e.feature = l.feature AND e.e <= l.x GROUP BY 1, 2, 3)"""


@query("id3_root_gain", f"""
WITH {_edges_sql(4)}, b AS (SELECT feature, bin, {_COUNTS} FROM binned GROUP BY 1, 2),
h AS (SELECT feature, c0 + c1 + c2 AS n, c0, c1, c2, {_entropy(['c0', 'c1', 'c2'], '(c0 + c1 + c2)')} AS h FROM b),
s AS (SELECT feature, sum(n) AS n, sum(c0) AS c0, sum(c1) AS c1, sum(c2) AS c2, sum(n * h) / sum(n) AS inside, count(*) AS bins FROM h GROUP BY 1)
SELECT CAST(feature AS BIGINT) AS feature, bins, {R('(' + _entropy(['c0', 'c1', 'c2'], 'n') + ') - inside', 10)} AS gain FROM s""")
def id3_root_gain(spark, sf):
    rows = line_rows(spark, sf)
    root, edges = _root(rows, 4)
    counts = trees.level_counts(rows, [root], [0], {0: edges}, 3)
    best = trees.score_features(counts, 3, trees.multiway_rule(1))
    return best.select(big("feature").alias("feature"), F.size("bins").cast("bigint").alias("bins"), rnd("gain", 10).alias("gain"))


@query("chaid_root_table", f"""
WITH {_edges_sql(10)} SELECT CAST(feature AS BIGINT) AS feature, bin, {_COUNTS} FROM binned GROUP BY 1, 2""")
def chaid_root_table(spark, sf):
    rows = line_rows(spark, sf)
    root, _ = _root(rows, 10)
    edges = trees.local_edges(rows, [root], [0], 4, 10)
    counts = trees.level_counts(rows, [root], [0], edges, 3)
    return counts.select(big("feature").alias("feature"), big("bin").alias("bin"), "c0", "c1", "c2")


@query("chaid_root_test", f"""
WITH {_edges_sql(10)}, c AS (SELECT feature, bin, cls, CAST(count(*) AS DOUBLE) AS n FROM binned GROUP BY 1, 2, 3),
r AS (SELECT feature, bin, sum(n) AS nr FROM c GROUP BY 1, 2), s AS (SELECT feature, cls, sum(n) AS ns FROM c GROUP BY 1, 2),
t AS (SELECT feature, sum(n) AS nt FROM c GROUP BY 1),
e AS (SELECT t.feature, nr * ns / nt AS e, coalesce(n, 0) AS n, r.bin, s.cls FROM t JOIN r ON r.feature = t.feature JOIN s ON s.feature = t.feature
  LEFT JOIN c ON c.feature = t.feature AND c.bin = r.bin AND c.cls = s.cls)
SELECT CAST(feature AS BIGINT) AS feature, {R('sum((n - e) * (n - e) / e)')} AS statistic, (count(DISTINCT bin) - 1) * (count(DISTINCT cls) - 1) AS dof FROM e GROUP BY 1""")
def chaid_root_test(spark, sf):
    """Chi-square of each binned feature before any bins are merged."""
    import pandas as pd

    counts = chaid_root_table(spark, sf)

    def test(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        statistic, dof, _ = chi_square(pdf[["c0", "c1", "c2"]].to_numpy())
        return pd.DataFrame({"feature": [key[0]], "statistic": [statistic], "dof": [dof]})

    out = counts.groupBy("feature").applyInPandas(test, "feature bigint, statistic double, dof bigint")
    return out.withColumn("statistic", rnd("statistic"))


def _given_tree(rows):
    """Line status first, then quantity or discount; counts come from the rows."""
    N = trees.Node
    zero = np.zeros(3, dtype=np.int64)
    nodes = [
        N(0, None, None, 0, zero, 0.0, feature=3, edges=np.array([0.5]), children=[1, 4]),
        N(1, 0, 0, 1, zero, 0.0, feature=0, edges=np.array([10.5, 30.5]), children=[2, 3, 2]),
        N(2, 1, 0, 2, zero, 0.0), N(3, 1, 1, 2, zero, 0.0),
        N(4, 0, 1, 1, zero, 0.0, feature=1, edges=np.array([0.045]), children=[5, 6]),
        N(5, 4, 0, 2, zero, 0.0), N(6, 4, 1, 2, zero, 0.0),
    ]
    return trees.TreeClassifier(
        "given tree", "classifier", {}, 4, classes=list(FLAGS), nodes=trees.recount(rows, nodes, 3)
    )


_NAMES = ["quantity", "discount", "tax", "open"]

_LEAF = LINE_LONG.split("line_l AS")[0].rstrip().rstrip(",") + """,
leaf AS (SELECT cls, CASE WHEN f3 < 0.5 THEN CASE WHEN f0 >= 10.5 AND f0 < 30.5 THEN 3 ELSE 2 END
  WHEN f1 < 0.045 THEN 5 ELSE 6 END AS leaf FROM line_x),
up(node, below) AS (VALUES (0, 2), (0, 3), (0, 5), (0, 6), (1, 2), (1, 3), (2, 2), (3, 3), (4, 5), (4, 6), (5, 5), (6, 6)),
nd AS (SELECT node, CAST(count(*) AS DOUBLE) AS n, """ + ", ".join(
    f"CAST(count(*) FILTER (WHERE cls = '{c}') AS DOUBLE) AS c{i}" for i, c in enumerate(FLAGS)) + """
  FROM leaf JOIN up ON leaf = below GROUP BY 1),
im AS (SELECT *, """ + _entropy(["c0", "c1", "c2"], "n") + """ AS h,
  CASE WHEN c0 >= c1 AND c0 >= c2 THEN 'A' WHEN c1 >= c2 THEN 'N' ELSE 'R' END AS pred FROM nd)"""


@query("tree_level_counts", f"""
WITH {_edges_sql(4)}, o AS (SELECT rid, CASE WHEN f3 < 0.5 THEN 1 ELSE 2 END AS node FROM line_x)
SELECT CAST(node AS BIGINT) AS node, CAST(feature AS BIGINT) AS feature, bin, {_COUNTS} FROM binned JOIN o USING (rid) GROUP BY 1, 2, 3""")
def tree_level_counts(spark, sf):
    rows = line_rows(spark, sf)
    root, edges = _root(rows, 4)
    zero = np.zeros(3, dtype=np.int64)
    root.feature, root.edges, root.children = 3, np.array([0.5]), [1, 2]
    nodes = [root, trees.Node(1, 0, 0, 1, zero, 0.0), trees.Node(2, 0, 1, 1, zero, 0.0)]
    counts = trees.level_counts(rows, nodes, [1, 2], {1: edges, 2: edges}, 3)
    return counts.select(big("node").alias("node"), big("feature").alias("feature"), big("bin").alias("bin"), "c0", "c1", "c2")


@query("tree_score", f"""
WITH {_LEAF} SELECT l.cls AS label, pred AS prediction, {R('c0 / n')} AS p0, {R('c1 / n')} AS p1, {R('c2 / n')} AS p2, count(*) AS rows
FROM leaf l JOIN im ON im.node = l.leaf GROUP BY 1, 2, 3, 4, 5""")
def tree_score(spark, sf):
    rows = line_rows(spark, sf)
    flags = F.array(*[F.lit(f) for f in FLAGS])
    out = _given_tree(rows).transform(rows.withColumn("label", F.element_at(flags, F.col("y") + 1)))
    p = F.col("probability")
    return out.groupBy("label", "prediction", *[rnd(p[i]).alias(f"p{i}") for i in range(3)]).agg(F.count(F.lit(1)).alias("rows"))


@query("tree_importance", f"""
WITH {_LEAF}, g AS (
  SELECT p.node, p.n / (SELECT n FROM im WHERE node = 0) * (p.h - sum(c.n * c.h) / any_value(p.n)) AS gain
  FROM im p JOIN (VALUES (0, 1), (0, 4), (1, 2), (1, 3), (4, 5), (4, 6)) k(a, b) ON p.node = a JOIN im c ON c.node = b GROUP BY p.node, p.n, p.h)
SELECT CAST(CASE node WHEN 0 THEN 3 WHEN 1 THEN 0 ELSE 1 END AS BIGINT) AS feature, {R('gain', 10)} AS gain,
  {R('gain / sum(gain) OVER ()')} AS importance FROM g""")
def tree_importance(spark, sf):
    nodes = trees.tree_nodes(spark, _given_tree(line_rows(spark, sf)), _NAMES)
    t = trees.tree_importance(nodes)
    return t.select(big("feature").alias("feature"), rnd("gain", 10).alias("gain"), rnd("importance").alias("importance"))


@query("tree_rules", f"""
WITH {_LEAF}, p(node, path, text) AS (VALUES (2, '0.0.0', 'open < 0.5000 → quantity in 2 bins → class '), (3, '0.0.1', 'open < 0.5000 → quantity in 2 bins → class '),
  (5, '0.1.0', 'open < 0.5000 → discount < 0.0450 → class '), (6, '0.1.1', 'open < 0.5000 → discount < 0.0450 → class '))
SELECT path, text || pred AS rule FROM p JOIN im ON im.node = p.node""")
def tree_rules(spark, sf):
    return trees.tree_rules(trees.tree_nodes(spark, _given_tree(line_rows(spark, sf)), _NAMES))


@query("tree_export")
def tree_export(spark, sf):
    p = docs_prepared(spark, sf)
    fitted = trees.CHAID().fit(p.train)
    return trees.tree_json(trees.tree_nodes(spark, fitted, p.feature_names), trees.tree_edges(spark, fitted, p.feature_names))


@query("tree_contributions")
def tree_contributions_query(spark, sf):
    p = docs_prepared(spark, sf)
    forest = library.RandomForest(n_estimators=10, max_depth=4).fit(p.train)
    out = tree_contributions(p.test, forest)
    return out.withColumn("phi", rnd("phi")).withColumn("base", rnd("base"))


@query("boost_contributions")
def boost_contributions(spark, sf):
    """Margins of three classes, shared among the features."""
    rows = _flag_rows(spark, sf)
    fitted = boosting.BoostedTrees(n_estimators=5, max_depth=3).fit(rows)
    out = tree_contributions(rows, fitted).groupBy("class", "feature").agg(F.avg("phi").alias("phi"), F.avg(F.abs("phi")).alias("mean_abs"), F.first("base").alias("base"))
    return out.select("class", "feature", rnd("phi").alias("phi"), rnd("mean_abs").alias("mean_abs"), rnd("base").alias("base"))


@query("mean_abs_contribution", f"""
WITH {VECTORS}, l AS (SELECT label, unnest(v) AS x, unnest(range(len(v))) AS j FROM vec),
m AS (SELECT j, label, avg(abs(x)) AS m FROM l GROUP BY 1, 2)
SELECT CAST(j AS BIGINT) AS feature, CAST(label AS VARCHAR) AS class, {R('m')} AS mean_abs, {R('sum(m) OVER (PARTITION BY j)')} AS total FROM m""")
def mean_abs_contribution_query(spark, sf):
    t = vectors(spark, sf).select("row_id", F.col("label").cast("string").alias("class"), F.posexplode("features").alias("feature", "phi"))
    m = mean_abs_contribution(t)
    return m.select(big("feature").alias("feature"), "class", rnd("mean_abs").alias("mean_abs"), rnd("total").alias("total"))
