import pytest
from pyspark.sql import functions as F

from tabulith.operators.report import compare_models
from tabulith.plans.runs import MODELS, Spec, load_metrics, load_run, metrics_table, predict_run, report_tables, run_metadata, save_run, train_run
from tabulith.streaming.score import start_scoring


@pytest.fixture(scope="module")
def source(spark):
    k = F.col("id")
    return spark.range(300).select(
        k.alias("key"), (k % 7 + F.pmod(F.xxhash64("id"), F.lit(100)) / 40.0).alias("x"), (k * 31 % 50).cast("double").alias("z"),
        F.concat(F.lit("c"), k % 4).alias("kind"), F.when(k % 7 > 3, "yes").otherwise("no").alias("label"),
    )


@pytest.fixture(scope="module")
def run(source):
    specs = [Spec("naive_bayes"), Spec("logistic_regression"), Spec("cart"), Spec("svm", {"kernel": "rbf", "n_components": 20, "folds": 2}),
             Spec("knn"), Spec("random_forest", {"n_estimators": 5, "max_depth": 4}), Spec("pca"), Spec("hmm")]
    return train_run(source, "key", "label", specs, run_id="r1")


def test_failure_is_kept_apart(run):
    r, _ = run
    assert r.result("hmm").error and r.result("hmm").fitted is None
    assert all(x.fitted for x in r.results if x.model_key != "hmm")
    assert r.result("naive_bayes").metrics["accuracy"] > 0.7
    with pytest.raises(KeyError):
        r.result("lda")


def test_specs_are_checked_first(source):
    for bad in ([Spec("kmeans")], [Spec("nope")], [Spec("regression")], []):
        with pytest.raises(ValueError):
            train_run(source, "key", "label", bad)


def test_tables(spark, run, source):
    r, prepared = run
    meta = run_metadata(spark, r).collect()
    assert len(meta) == 8 and sum(m["error"] is not None for m in meta) == 1
    m = metrics_table(spark, [r])
    assert compare_models(m, [("r1", "cart"), ("r1", "knn")]).count() == 8
    tables = report_tables(spark, r, source, prepared.test, "source")
    assert tables["summary"].first()["n_rows"] == 300
    assert tables["dataset"].count() == 4 and tables["confusion_cart"].count() == 4
    assert tables["sample_knn"].count() == 25


def test_round_trip(spark, run, source, tmp_path):
    r, _ = run
    save_run(r, str(tmp_path))
    back = load_run(spark, str(tmp_path), "r1")
    assert load_metrics(spark, str(tmp_path), "r1").count() == metrics_table(spark, [r]).count()
    new = source.drop("label")
    for key in [x.model_key for x in r.results if x.fitted]:
        a = {x["row_id"]: x[1] for x in predict_run(r, key, new).collect()}
        b = {x["row_id"]: x[1] for x in predict_run(back, key, new).collect()}
        assert a == b and len(a) == 300
    assert "probability" not in predict_run(back, "pca", new).columns
    with pytest.raises(ValueError):
        predict_run(back, "hmm", new)


def test_stream_equals_batch(spark, run, source, tmp_path):
    r, _ = run
    new = source.drop("label")
    new.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(new.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    for key in ("naive_bayes", "cart", "random_forest"):
        out = str(tmp_path / f"out-{key}")
        start_scoring(stream, r, key, out, f"s-{key}", once=True).awaitTermination()
        a = sorted((x["row_id"], x["prediction"]) for x in spark.read.parquet(out).collect())
        b = sorted((x["row_id"], x["prediction"]) for x in predict_run(r, key, new).collect())
        assert a == b
    with pytest.raises(ValueError):
        start_scoring(stream.drop("z"), r, "cart", str(tmp_path / "x"), "bad", once=True)
    with pytest.raises(ValueError):
        start_scoring(new, r, "cart", str(tmp_path / "x"), "bad", once=True)


def test_regression_and_clustering(source):
    numbers = source.withColumn("label", F.col("x") * 2 + F.col("z"))
    r, _ = train_run(numbers, "key", "label", [Spec("regression")])
    assert r.problem_type == "regression" and r.results[0].metrics["r2"] > 0.99
    plain = source.select("key", "x", "z")
    c, _ = train_run(plain, "key", None, [Spec("kmeans", {"n_init": 1}), Spec("dbscan", {"eps": 0.6}), Spec("gmm"),
                                          Spec("hierarchical_clustering", {"micro": 16}), Spec("pca")])
    assert c.problem_type == "clustering" and not [x.error for x in c.results if x.error]
    assert set(c.result("kmeans").metrics) == {"inertia", "davies_bouldin_score", "silhouette_score"}


def test_registry():
    assert len(MODELS) == 21 and all(k == m.key for k, m in MODELS.items())
