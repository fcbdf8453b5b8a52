"""Quoted CSV, splits without gain, labels of training rows, choice of the silhouette, suitability rules."""

import numpy as np
import pytest

from tabulith.models.density import DBSCAN
from tabulith.models.discriminant import suitability_rules
from tabulith.models.trees import CART, merge_rule
from tabulith.operators.evaluate import evaluate
from tabulith.sources.tables import read_csv


def test_quoted_csv(spark, tmp_path):
    path = tmp_path / "t.csv"
    path.write_text('a,b\n1,"x ""q"" y, z"\n2,"two\nlines"\n3,NA\n')
    assert [tuple(r) for r in read_csv(spark, str(path)).orderBy("a").collect()] == [(1, 'x "q" y, z'), (2, "two\nlines"), (3, None)]


def test_cart_takes_a_split_without_gain(spark):
    rows = [(i, float(a ^ b), [float(a), float(b)]) for i, (a, b) in enumerate([(0, 0), (0, 1), (1, 0), (1, 1)] * 5)]
    train = spark.createDataFrame(rows, "row_id long, label double, features array<double>")
    scored = CART().fit(train).transform(train)
    assert scored.where("prediction <> label").count() == 0


def test_dbscan_keeps_training_labels(spark):
    xs = [0.0, 0.1, 0.2, 0.3, 1.2, 2.0, 2.1, 2.2, 2.3, 0.75, 9.0]
    train = spark.createDataFrame([(i, [x]) for i, x in enumerate(xs)], "row_id long, features array<double>")
    fitted = DBSCAN(eps=0.5, min_samples=4).fit(train)
    known = {r.row_id: r.prediction for r in fitted.labels.collect()}
    assert {r.row_id: r.prediction for r in fitted.transform(train).collect()} == known


def test_silhouette_by_argument(spark):
    rows = [(i, [float(i % 2 * 10), i / 10], i % 2) for i in range(20)]
    pred = spark.createDataFrame(rows, "row_id long, features array<double>, prediction int")
    assert "silhouette_squared" not in evaluate("clusterer", pred)
    rough = evaluate("clusterer", pred, exact_silhouette=False)
    assert rough["silhouette_score"] is None and rough["silhouette_squared"] > 0.9


def test_suitability_rules(spark):
    rng = np.random.default_rng(2)
    rows = [(int(i < 3), [float(v), 1.0]) for i, v in enumerate(rng.normal(size=40))]
    few, many = (np.var([r[1][0] for r in rows if r[0] == c], ddof=1) for c in (1, 0))
    pooled = (2 * few + 36 * many) / 38
    assert (abs(few - pooled) + abs(many - pooled)) / pooled / 2 > 0.35
    rules = suitability_rules(spark.createDataFrame(rows, "label int, features array<double>"), 5)
    assert {tuple(r) for r in rules.where("broken").select("model", "rule").collect()} == {
        ("both", "constant features"), ("both", "share of the smallest class"), ("both", "share of the largest class"),
        ("comparison", "rows of the smallest class for the folds"), ("LDA", "rank of the pooled covariance"),
        ("LDA", "covariance difference"),
        ("QDA", "rows of a class in a training fold"), ("QDA", "least rank of a class covariance"),
    }


def test_merge_joins_small_bins_to_the_more_alike_side():
    found = merge_rule(0.05, 10, True)(np.arange(4), np.array([[40, 2], [3, 0], [1, 30], [2, 60]]))
    assert found["groups"] == [0, 0, 1, 1] and found["tables"] == [[43, 2], [3, 90]]


def test_only_csv_with_line_breaks_is_read_whole(spark, tmp_path):
    plain, broken, empty = tmp_path / "plain.csv", tmp_path / "broken.csv", tmp_path / "empty.csv"
    lines = "".join(f'{i},"x, ""{i}""",\n' for i in range(20000))
    plain.write_text("a,b,c\n" + lines)
    broken.write_text("a,b,c\n" + lines + '9,"two\nlines ""and"" more",\n')
    empty.write_text('a,b\n1,""\n')
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64k")
    try:
        rows = read_csv(spark, str(plain))
        assert rows.rdd.getNumPartitions() > 1
        assert rows.where("b = concat('x, \"', a, '\"') and c is null").count() == rows.count() == 20000
        whole = read_csv(spark, str(broken))
        assert whole.count() == 20001 and whole.where("b like '%\n%'").count() == 1
        assert [tuple(r) for r in read_csv(spark, str(empty)).collect()] == [(1, None)]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_fits_are_registered_with_the_reference_defaults(spark, sf, monkeypatch):
    import __spark_entry__
    import pytest

    from tabulith.models import hmm, library, oblique

    class Asked(Exception):
        pass

    def fit(self, *args, **kwargs):
        raise Asked(self)

    want = {
        "fit_oblique": (oblique.Oblique, {"max_depth": 5}), "fit_kmeans": (library.KMeansClusters, {"n_clusters": 3, "n_init": 10}),
        "fit_gmm": (library.Mixture, {"n_components": 3, "n_init": 3, "max_iter": 100}), "fit_hmm": (hmm.HiddenMarkov, {"n_components": 3, "n_iter": 50}),
    }
    for name, (kind, values) in want.items():
        monkeypatch.setattr(kind, "fit", fit)
        with pytest.raises(Asked) as asked:
            __spark_entry__.queries()[name](spark, sf)
        assert {k: getattr(asked.value.args[0], k) for k in values} == values


@pytest.mark.parametrize("bad", [[None, 1.0], [float("nan"), 1.0], [float("inf"), 1.0], [1.0], None])
def test_every_fit_and_score_checks_its_rows(spark, bad):
    from tabulith.models.discriminant import NaiveBayes
    from tabulith.models.library import KMeansClusters

    good = [(i, [float(i % 7), float(i % 5)], i % 2) for i in range(40)]
    schema = "row_id int, features array<double>, label int"
    df = spark.createDataFrame([*good, (99, bad, 1)], schema)
    for model in (NaiveBayes(), KMeansClusters(2)):
        with pytest.raises(ValueError, match="cannot be used"):
            model.fit(df)
    fitted = NaiveBayes().fit(spark.createDataFrame(good, schema))
    assert fitted.transform(fitted.checked(spark.createDataFrame(good, schema))).count() == 40
    with pytest.raises(Exception, match="scores 2 finite features"):
        fitted.transform(fitted.checked(df)).collect()
    with pytest.raises(ValueError, match="missing label: 1"):
        NaiveBayes().fit(spark.createDataFrame([*good, (99, [1.0, 2.0], None)], schema))


def test_one_feature_regression_in_a_run(spark):
    """A trending series is differenced and summed up again; a level one is fitted as it is; a constant feature gives the mean."""
    import numpy as np

    from tabulith.models.library import PolynomialRegression

    rng = np.random.default_rng(2)
    x = rng.normal(size=60)
    trend = np.cumsum(2.0 + 3.0 * x)
    for y, differenced in ((trend, True), (5.0 + 0.5 * x + rng.normal(size=60), False)):
        df = spark.createDataFrame([(i, [float(v)], float(w)) for i, (v, w) in enumerate(zip(x, y))], "row_id int, features array<double>, label double")
        fitted = PolynomialRegression().fit(df.where("row_id < 50"))
        assert fitted.details["differenced"] is differenced
        ratio = np.var(y[:50]) / (np.var(np.diff(y[:50])) + 1e-12)
        assert fitted.details["stationarity_score"] == pytest.approx(ratio)
        a, b = (x[1:50], np.diff(y[:50])) if differenced else (x[:50], y[:50])
        slope, intercept = np.polyfit(a, b, 1)
        want = slope * x[50:] + intercept
        want = y[49] + np.cumsum(want) if differenced else want
        got = {r.row_id: r.prediction for r in fitted.transform(df.where("row_id >= 50").repartition(4)).collect()}
        assert [got[i] for i in range(50, 60)] == pytest.approx(list(want))
        assert fitted.importance == {"feature_0": pytest.approx(slope)}
    flat = spark.createDataFrame([(i, [1.0], float(i % 2)) for i in range(10)], "row_id int, features array<double>, label double")
    assert {r.prediction for r in PolynomialRegression().fit(flat).transform(flat).collect()} == {0.5}
    with pytest.raises(ValueError, match="three rows"):
        PolynomialRegression().fit(flat.limit(2))


def test_importance_names_expanded_terms(spark):
    from tabulith.plans.runs import Spec, importance_table, train_run

    df = spark.range(80).selectExpr("id", "cast(id % 9 as double) as a", "cast(id % 7 as double) as b", "cast((id % 9) * (id % 7) as double) as y")
    run, _ = train_run(df, "id", "y", [Spec("regression")], "regression")
    rows = importance_table(spark, run).collect()
    assert run.results[0].error is None and len({r.feature for r in rows}) == len(rows) == 5
