import numpy as np
import pytest
from pyspark.sql import functions as F

from tabulith.models import library as L
from tabulith.models.boosting import BoostedTrees
from tabulith.models.density import MicroLinkage
from tabulith.models.discriminant import LDA, QDA, NaiveBayes, analyze_suitability
from tabulith.models.hmm import HiddenMarkov, expected_counts, sequence_scores
from tabulith.models.moments import class_covariances, _partial
from tabulith.operators.evaluate import evaluate
from tabulith.plans.validation import compare_lda_qda, cv_metrics


def table(spark, x, y=None):
    rows = [(i, [float(v) for v in r]) + ((y[i] if isinstance(y[i], str) else float(y[i]),) if y is not None else ())
            for i, r in enumerate(x)]
    kind = "" if y is None else (", label string" if isinstance(y[0], str) else ", label double")
    return spark.createDataFrame(rows, "row_id int, features array<double>" + kind).repartition(3)


@pytest.fixture(scope="module")
def three(spark):
    rng = np.random.default_rng(1)
    y = [["a", "b", "c"][i % 3] for i in range(240)]
    x = np.array([rng.normal(ord(c) - 97, 0.6, 4) * [1, -1, 1, 0.5] for c in y])
    return x, y, table(spark, x, y)


CLASSIFIERS = [
    LDA(), LDA(shrinkage=0.3), QDA(), QDA(reg_param=0.2), NaiveBayes(), L.Logistic(), L.RandomForest(10, 5), BoostedTrees(5, 3),
    L.Perceptron((8,), 60), L.SVM("linear", folds=3), L.SVM("poly", folds=3), L.SVM("rbf", n_components=60, folds=3),
    L.Neighbours(5), L.Neighbours(5, "distance"),
]


@pytest.mark.parametrize("model", CLASSIFIERS, ids=lambda m: m.key)
def test_classifiers(three, model):
    _, y, df = three
    fitted = model.fit(df)
    out = fitted.transform(df).toPandas().sort_values("row_id")
    assert (out["prediction"] == y).mean() > 0.8
    p = np.array(out["probability"].tolist())
    assert p.shape == (240, 3) and (p >= 0).all() and np.allclose(p.sum(axis=1), 1, atol=1e-6)
    assert (np.array(fitted.classes)[p.argmax(axis=1)] == out["prediction"]).mean() > 0.99
    assert set(fitted.metadata()) == {"model_name", "model_type", "hyperparameters", "training_time_seconds", "n_features", "feature_importance"}
    again = model.fit(df).transform(df).toPandas().sort_values("row_id")
    assert (again["prediction"].to_numpy() == out["prediction"].to_numpy()).all()


def test_discriminants_against_formulas(three):
    x, y, df = three
    y = np.array(y)
    means = np.array([x[y == c].mean(axis=0) for c in "abc"])
    pooled = sum((x[y == c] - m).T @ (x[y == c] - m) for c, m in zip("abc", means)) / (240 - 3)
    inv = np.linalg.inv(pooled)
    score = x @ inv @ means.T - 0.5 * np.einsum("cd,de,ce->c", means, inv, means) + np.log(1 / 3)
    want = np.exp(score - score.max(axis=1, keepdims=True))
    want /= want.sum(axis=1, keepdims=True)
    got = np.array(LDA().fit(df).transform(df).orderBy("row_id").toPandas()["probability"].tolist())
    assert got == pytest.approx(want, abs=1e-9)
    q = []
    for c, m in zip("abc", means):
        cov = np.cov(x[y == c], rowvar=False)
        diff = x - m
        q.append(-0.5 * (np.einsum("nd,de,ne->n", diff, np.linalg.inv(cov), diff) + np.linalg.slogdet(cov)[1]) + np.log(1 / 3))
    q = np.array(q).T
    want = np.exp(q - q.max(axis=1, keepdims=True))
    want /= want.sum(axis=1, keepdims=True)
    got = np.array(QDA().fit(df).transform(df).orderBy("row_id").toPandas()["probability"].tolist())
    assert got == pytest.approx(want, abs=1e-9)


def test_wide_covariance_path(three):
    x, _, df = three
    a = class_covariances(df)
    b = _partial(df, "label", "features", 4)
    for s, t in zip(a, b):
        assert (s.label, s.n) == (t.label, t.n)
        assert s.mean == pytest.approx(t.mean) and s.cov == pytest.approx(t.cov)


def test_refused_parameters(three):
    _, _, df = three
    for bad in (lambda: L.SVM("sigmoid"), lambda: L.Mixture(covariance_type="tied"), lambda: BoostedTrees(reg_alpha=-1),
                lambda: QDA(reg_param=2), lambda: NaiveBayes(0), lambda: MicroLinkage(None), lambda: L.Neighbours(0)):
        with pytest.raises(ValueError):
            bad()
    with pytest.raises(ValueError):
        L.PolynomialRegression().fit(df)


def test_polynomial_regression(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(200, 4))
    y = 2 * x[:, 0] ** 2 + 1.5 * x[:, 1] + 0.5 * x[:, 2] * x[:, 3]
    df = table(spark, x, y)
    m = evaluate("regressor", L.PolynomialRegression(2).fit(df).transform(df))
    assert m["r2"] > 0.999999


def test_clusters_and_components(spark):
    rng = np.random.default_rng(7)
    x = np.vstack([rng.normal(c, 0.3, (60, 4)) for c in (-4, 0, 4)])
    df = table(spark, x)
    for model in (L.KMeansClusters(3, 2), L.Mixture(3, max_iter=30), MicroLinkage(3, micro=20)):
        out = model.fit(df).transform(df).toPandas().sort_values("row_id")["prediction"].to_numpy()
        groups = {tuple(sorted(set(out[i:i + 60].tolist()))) for i in (0, 60, 120)}
        # the mixture starts at random and may settle on two of the three
        assert len(groups) >= (2 if model.key == "gmm" else 3), model.key
    assert evaluate("clusterer", L.KMeansClusters(3, 2).fit(df).transform(df))["silhouette_score"] > 0.5
    pca = L.PrincipalComponents(2).fit(df)
    z = np.array(pca.transform(df).orderBy("row_id").toPandas()["components"].tolist())
    assert z.mean(axis=0) == pytest.approx([0, 0], abs=1e-9)
    values = np.linalg.eigvalsh(np.cov(x, rowvar=False))[::-1]
    assert z.var(axis=0, ddof=1) == pytest.approx(values[:2])
    assert pca.details["explained_variance_ratio"] == pytest.approx(list(values[:2] / values.sum()))
    with pytest.raises(ValueError):
        L.PrincipalComponents(9).fit(df)


def test_hmm_counts_by_enumeration():
    from itertools import product

    rng = np.random.default_rng(0)
    p = {"start": np.array([0.6, 0.4]), "trans": np.array([[0.7, 0.3], [0.2, 0.8]]),
         "mean": np.array([[0.0, 1.0], [2.0, -1.0]]), "var": np.array([[1.0, 0.5], [0.3, 2.0]])}
    x = rng.normal(size=(1, 3, 2))
    total, weight = 0.0, np.zeros(2)
    for path in product(range(2), repeat=3):
        w = p["start"][path[0]]
        for t, s in enumerate(path):
            w *= np.prod(np.exp(-0.5 * (x[0, t] - p["mean"][s]) ** 2 / p["var"][s]) / np.sqrt(2 * np.pi * p["var"][s]))
            w *= p["trans"][path[t - 1], s] if t else 1.0
        total += w
        for s in path:
            weight[s] += w
    assert sequence_scores(x, p)[0] == pytest.approx(np.log(total))
    assert expected_counts(x, p)["weight"] == pytest.approx(weight / total)


def test_hmm(spark):
    rng = np.random.default_rng(9)
    x = np.vstack([rng.normal(0, 1, (60, 10)), rng.normal(0, 1, (60, 10)) + np.repeat(np.arange(5), 2)])
    df = table(spark, x, ["flat"] * 60 + ["rising"] * 60)
    fitted = HiddenMarkov(3, 15).fit(df)
    assert evaluate("classifier", fitted.transform(df))["accuracy"] > 0.85
    with pytest.raises(ValueError):
        HiddenMarkov(3).fit(df.where("row_id < 62"))
    with pytest.raises(ValueError):
        HiddenMarkov(lookback=3).fit(df)


def test_validation_and_comparison(spark, three):
    _, _, df = three
    m = {r["metric"]: r for r in cv_metrics(df, LDA(), 4).collect()}
    assert m["accuracy"]["mean"] > 0.8 and m["roc_auc"]["folds"] == 4
    t, winner = compare_lda_qda(df, 4)
    assert winner in ("LDA", "QDA") and t.where("recommended").select("model").distinct().count() == 1
    report = analyze_suitability(df)
    assert report["can_compare"] and report["diagnostics"]["pooled_rank"] == 4
    flat = df.withColumn("features", F.concat("features", F.array(F.lit(1.0))))
    assert not analyze_suitability(flat)["lda_suitable"]
    with pytest.raises(ValueError):
        compare_lda_qda(flat, 4)
    numbers = df.withColumn("label", F.col("row_id").cast("double"))
    assert analyze_suitability(numbers)["target_kind"] == "regression_like"


def test_starts_see_rows_the_library_keeps_itself(spark):
    df = spark.range(20).select(F.array(F.col("id").cast("double")).alias("__vec"))
    seen = L.each_start(df, 3, lambda rows, i: (i, rows.storageLevel.useMemory, rows.count()))
    assert seen == [(0, False, 20), (1, False, 20), (2, False, 20)]
