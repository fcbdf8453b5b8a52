"""User models and library estimators in runs; every kind of fitted state saved and loaded without stored code."""

import json
from dataclasses import dataclass

import pytest
from pyspark.ml.classification import DecisionTreeClassifier, LinearSVC
from pyspark.ml.clustering import BisectingKMeans
from pyspark.ml.feature import PCA
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import functions as F

from tabulith.models.base import Fitted, Model, labels_of
from tabulith.plans.runs import MODELS, Spec, load_run, predict_run, register_estimator, register_model, save_run, train_run
from tabulith.plans.state import Reader, Writer
from tabulith.streaming.score import start_scoring


@dataclass
class FixedShares(Fitted):
    shares: tuple = ()

    def transform(self, df):
        best = self.classes[max(range(len(self.shares)), key=self.shares.__getitem__)]
        return df.withColumn("probability", F.array(*[F.lit(s) for s in self.shares])).withColumn("prediction", F.lit(best))


class MostFrequent(Model):
    key, name, model_type = "most_frequent", "Most Frequent Class", "classifier"

    def __init__(self, smoothing: float = 0.0):
        self.smoothing = smoothing

    def _fit(self, train, d):
        classes = labels_of(train)
        n = {r["label"]: r["count"] + self.smoothing for r in train.groupBy("label").count().collect()}
        return self._new(FixedShares, d, classes=classes, shares=tuple(n[c] / sum(n.values()) for c in classes))


@pytest.fixture(scope="module")
def registered():
    added = [
        register_model(MostFrequent), register_estimator("tree_ml", "Library Tree", "classifier", DecisionTreeClassifier(seed=1)),
        register_estimator("margin_ml", "Linear Margin", "classifier", LinearSVC(maxIter=5)),
        register_estimator("bisect_ml", "Bisecting Means", "clusterer", BisectingKMeans(k=2, seed=1)),
        register_estimator("pca_ml", "Library Components", "dimensionality_reducer", PCA(k=1)),
        register_estimator("boost_ml", "Boosted Regression", "regressor", GBTRegressor(maxIter=2, seed=1)),
    ]
    yield added
    for m in added:
        del MODELS[m.key]


@pytest.fixture(scope="module")
def source(spark):
    k = F.col("id")
    return spark.range(240).select(
        k.alias("key"), (k % 7 + F.pmod(F.xxhash64("id"), F.lit(100)) / 40.0).alias("x"), (k * 31 % 50).cast("double").alias("z"),
        F.when(k % 7 > 3, "yes").otherwise("no").alias("label"), (k % 7 * 2.5).alias("y"),
    )


def scores(run, key, new):
    return {r["row_id"]: r[1] for r in predict_run(run, key, new).collect()}


def test_registered_models_train_save_load_and_score(spark, registered, source, tmp_path):
    specs = [Spec("most_frequent", {"smoothing": 1.0}), Spec("tree_ml", {"maxDepth": 3}), Spec("margin_ml"), Spec("pca_ml")]
    run, _ = train_run(source.drop("y"), "key", "label", specs, run_id="own")
    assert not [r.error for r in run.results if r.error]
    assert run.result("tree_ml").metrics["accuracy"] > 0.9 and run.result("tree_ml").fitted.importance
    assert run.result("tree_ml").fitted.metadata()["hyperparameters"] == {"maxDepth": 3}
    save_run(run, str(tmp_path))
    back = load_run(spark, str(tmp_path), "own")
    new = source.drop("label", "y")
    for r in run.results:
        assert scores(run, r.model_key, new) == scores(back, r.model_key, new)
    new.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(new.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    for key in ("most_frequent", "tree_ml"):
        out = str(tmp_path / f"out-{key}")
        start_scoring(stream, back, key, out, f"own-{key}", once=True).awaitTermination()
        assert {r.row_id: r.prediction for r in spark.read.parquet(out).collect()} == scores(run, key, new)
    others, _ = train_run(source.drop("label"), "key", "y", [Spec("boost_ml")], "regression", run_id="reg")
    assert others.results[0].error is None and others.results[0].metrics["r2"] > 0.8
    groups, _ = train_run(source.drop("label", "y"), "key", None, [Spec("bisect_ml", {"k": 3})], run_id="clu")
    assert groups.results[0].error is None


def test_registration_is_checked(registered):
    with pytest.raises(ValueError, match="registered"):
        register_estimator("tree_ml", "Again", "classifier", DecisionTreeClassifier())
    with pytest.raises(ValueError):
        register_estimator("x", "X", "oracle", DecisionTreeClassifier())
    with pytest.raises(TypeError):
        register_model(dict)
    with pytest.raises(ValueError, match="no hyperparameter"):
        MODELS["tree_ml"](depth=3)


def test_every_state_goes_through_text(spark, source, tmp_path):
    """Each model's fitted state is JSON and scores alike after loading."""
    specs = [Spec("xgboost", {"n_estimators": 3, "max_depth": 2}), Spec("lda"), Spec("qda"), Spec("naive_bayes"), Spec("id3"), Spec("chaid"),
             Spec("oblique_tree", {"max_depth": 2}), Spec("svm", {"kernel": "poly", "folds": 2}), Spec("knn"), Spec("ann", {"epochs": 5})]
    run, _ = train_run(source.drop("y"), "key", "label", specs, run_id="all")
    assert not [r.error for r in run.results if r.error]
    save_run(run, str(tmp_path))
    rows = spark.read.parquet(str(tmp_path / "all/fitted"))
    assert dict(rows.dtypes)["state"] == "string" and all(json.loads(r.state) for r in rows.collect())
    back = load_run(spark, str(tmp_path), "all")
    new = source.drop("label", "y")
    for r in run.results:
        assert scores(run, r.model_key, new) == scores(back, r.model_key, new), r.model_key
        assert str(back.result(r.model_key).fitted.metadata()) == str(r.fitted.metadata())
    clusters, _ = train_run(source.drop("label", "y"), "key", None, [
        Spec("kmeans", {"n_clusters": 2}), Spec("gmm", {"n_components": 2}), Spec("dbscan", {"eps": 0.4}), Spec("hierarchical_clustering", {"micro": 8})], run_id="c")
    assert not [r.error for r in clusters.results if r.error]
    save_run(clusters, str(tmp_path))
    again = load_run(spark, str(tmp_path), "c")
    for r in clusters.results:
        assert scores(clusters, r.model_key, new) == scores(again, r.model_key, new), r.model_key


def test_unknown_classes_do_not_load(spark, tmp_path):
    import datetime
    from decimal import Decimal

    value = [None, 1.5, "a", (1, frozenset({2})), {3: datetime.date(2020, 1, 2), "t": datetime.datetime(2020, 1, 2, 3)}, Decimal("1.20")]
    assert Reader(spark, str(tmp_path)).value(Writer(str(tmp_path), "0").text(value)) == value
    with pytest.raises(TypeError):
        Writer(str(tmp_path), "0").text(object())
    with pytest.raises(ValueError, match="import its class"):
        Reader(spark, str(tmp_path)).value('{"~": "record", "class": "Popen", "fields": {}}')
