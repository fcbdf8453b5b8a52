import numpy as np
import pytest
from pyspark.sql import functions as F

from tabulith.operators import evaluate as E
from tabulith.operators import report as R
from tabulith.operators.distance import silhouette
from tabulith.functions.scalar import chi2_tail, chi_square, log_chi2_tail
from tabulith.plans.runs import plot_data


def pred(spark, y, p):
    return spark.createDataFrame([(i, str(a), str(b)) for i, (a, b) in enumerate(zip(y, p))], "row_id int, label string, prediction string")


def test_perfect_classes(spark):
    t = pred(spark, [0, 1, 0, 1, 2, 2], [0, 1, 0, 1, 2, 2])
    assert E.evaluate("classifier", t) == {"accuracy": 1.0, "precision": 1.0, "recall": 1.0, "f1": 1.0}
    m = {(r["actual"], r["predicted"]): r["n"] for r in E.confusion_matrix(t).collect()}
    assert len(m) == 9 and m[("2", "2")] == 2 and m[("0", "1")] == 0


def test_half_right_and_zero_division(spark):
    assert E.classifier_metrics(pred(spark, [0, 0, 1, 1], [0, 1, 1, 0])).first()["accuracy"] == 0.5
    row = E.classifier_metrics(pred(spark, [0, 0], [1, 1])).first()
    assert row.asDict() == {"accuracy": 0.0, "precision": 0.0, "recall": 0.0, "f1": 0.0}


def test_regression(spark):
    t = spark.createDataFrame([(0.0, 1.0), (0.0, 3.0)], "label double, prediction double")
    row = E.regressor_metrics(t).first()
    assert (row["mse"], row["mae"], row["r2"]) == (5.0, 2.0, 0.0)
    same = spark.createDataFrame([(2.0, 2.0), (2.0, 2.0)], "label double, prediction double")
    assert E.regressor_metrics(same).first()["r2"] == 1.0


def clusters(spark, x, labels):
    return spark.createDataFrame([(i, [float(v) for v in r], int(c)) for i, (r, c) in enumerate(zip(x, labels))],
                                 "row_id int, features array<double>, prediction int")


def test_far_clusters(spark):
    rng = np.random.default_rng(0)
    x = np.vstack([rng.normal(-10, 0.1, (20, 2)), rng.normal(10, 0.1, (20, 2))])
    m = E.evaluate("clusterer", clusters(spark, x, [0] * 20 + [1] * 20))
    assert m["silhouette_score"] > 0.9 and m["davies_bouldin_score"] < 0.5


def test_degenerate_clusters(spark):
    one = E.evaluate("clusterer", clusters(spark, [[0, 0]] * 10, [0] * 10))
    assert one["silhouette_score"] is None and one["davies_bouldin_score"] is None and one["inertia"] == 0.0
    assert E.evaluate("clusterer", clusters(spark, [[0, 0]] * 5, [-1] * 5))["inertia"] is None
    noise = clusters(spark, [[0, 0], [0, 0], [100, 100]], [0, 0, -1])
    assert E.cluster_inertia(noise).first()[0] == 0.0
    s = E.cluster_summary(noise).collect()
    assert {r["n_clusters"] for r in s} == {1} and {r["n_noise"] for r in s} == {1}


def brute_silhouette(x, labels):
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
    out = []
    for i, c in enumerate(labels):
        own = labels == c
        if own.sum() == 1:
            out.append(0.0)
            continue
        a = d[i, own].sum() / (own.sum() - 1)
        b = min(d[i, labels == o].mean() for o in set(labels) if o != c)
        out.append((b - a) / max(a, b))
    return float(np.mean(out))


def test_silhouette_meets_each_pair_of_blocks_once(spark):
    from tabulith.operators.distance import silhouette_rows

    rng = np.random.default_rng(2)
    x = rng.normal(0, 1, (40, 3))
    t = spark.createDataFrame([(i, r.tolist(), i % 3) for i, r in enumerate(x)], "row_id bigint, features array<double>, prediction int")
    silhouette_rows(t, block_rows=10)
    low = [r for r in silhouette_rows(t, block_rows=10)._jdf.queryExecution().optimizedPlan().toString().split("\n") if "sequence(block" in r]
    assert low                                             # blocks from its own on, not all


def test_silhouette_against_brute_force(spark):
    rng = np.random.default_rng(3)
    x = np.vstack([rng.normal(0, 1, (60, 3)), np.zeros((30, 3)), [[9.0, 9.0, 9.0]]])
    labels = np.array([i % 3 for i in range(90)] + [7])
    t = clusters(spark, x, labels)
    want = brute_silhouette(x, labels)
    assert silhouette(t).first()[0] == pytest.approx(want)
    assert silhouette(t, block_rows=11).first()[0] == pytest.approx(want)


def test_reducer_ratio(spark):
    t = spark.createDataFrame([([0.0, 0.0], [0.0]), ([2.0, 4.0], [3.0])], "features array<double>, components array<double>")
    assert E.reducer_variance_ratio(t).first()["ratio"] == pytest.approx(2.25 / 5.0)
    flat = spark.createDataFrame([([1.0], [1.0]), ([1.0], [1.0])], "features array<double>, components array<double>")
    assert E.reducer_variance_ratio(flat).first()["ratio"] is None


def test_unknown_type(spark):
    with pytest.raises(ValueError):
        E.evaluate("thing", spark.range(1))


def test_roc_auc_ties(spark):
    rows = [(0, [0.9, 0.1]), (0, [0.5, 0.5]), (1, [0.5, 0.5]), (1, [0.2, 0.8])]
    t = spark.createDataFrame(rows, "label int, probability array<double>")
    assert E.roc_auc(t, [0, 1]).first()[0] == pytest.approx(0.875)


def test_plot_data(spark):
    t = clusters(spark, [[1], [2], [3]], [0, 1, -1])
    assert [(r["x"], r["y"]) for r in plot_data("clusterer", t, 1).orderBy("row_id").collect()] == [(1, 0), (2, 0), (3, 0)]
    assert plot_data("classifier", t, 1) is None
    with pytest.raises(ValueError):
        plot_data("other", t, 1)


def test_chi_square_tail():
    # reference values of the chi-square distribution
    assert chi2_tail(3.841458820694124, 1) == pytest.approx(0.05, rel=1e-10)
    assert chi2_tail(18.307038053275146, 10) == pytest.approx(0.05, rel=1e-10)
    assert chi2_tail(0.0, 3) == 1.0
    assert log_chi2_tail(2 * 5000.0, 2) == pytest.approx(-5000.0)       # exp(-x/2) underflows
    assert chi_square(np.array([[10, 20], [20, 10]]))[0] == pytest.approx(20 / 3)
    assert chi_square(np.array([[5, 5]]))[1:] == (0, 0.0)


def test_best_threshold_in_buckets(spark):
    rows = [("g", float(i), "a" if i < 40 else "b") for i in range(100)]
    t = spark.createDataFrame(rows, "g string, v double, y string")
    row = R.best_threshold(t, ["g"], "v", "y", ["a", "b"]).first()
    assert row["threshold"] == 39.5 and row["cost"] == pytest.approx(0.0)
    whole = R.best_threshold(t.drop("g"), [], "v", "y", ["a", "b"], "entropy").first()
    assert whole["threshold"] == 39.5


def test_report_tables(spark):
    m = spark.createDataFrame(
        [("r", "a", "accuracy", 1.0), ("r", "b", "accuracy", 0.5), ("r", "b", "f1", 0.25)],
        "run_id string, model_key string, metric string, value double")
    assert [r[0] for r in R.common_metrics(m).collect()] == ["accuracy"]
    out = R.compare_models(m, [("r", "b"), ("r", "a")]).orderBy("position").collect()
    assert [(r["model_key"], r["value"]) for r in out] == [("b", 0.5), ("a", 1.0)]
    with pytest.raises(ValueError):
        R.compare_models(m, [("r", "a")])
    text = {r["value"]: r["text"] for r in R.format_metrics(m).collect()}
    assert text[1.0] == "1" and text[0.25] == "0.2500"
    sample = spark.createDataFrame([(2, "x", [0.25, 0.75]), (1, "y", [1.0, 0.0])], "row_id int, prediction string, probability array<double>")
    assert R.prediction_sample(sample).first()["probabilities"] == "1.000, 0.000"
    cm = spark.createDataFrame([("a", "a", 10), ("a", "b", 1), ("b", "a", 0), ("b", "b", 0)], "actual string, predicted string, n bigint")
    assert [r["step"] for r in R.confusion_scale(cm).orderBy("actual", "predicted").collect()] == [4, 0, 0, 0]
