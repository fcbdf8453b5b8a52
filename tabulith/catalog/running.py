"""Queries: whole runs, suitability, comparison and stream scoring."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..models.discriminant import NaiveBayes, suitability_rules
from ..operators.prepare import fit_prepare
from ..plans.runs import Result, Run, Spec, load_metrics, load_run, predict_run, run_metadata, save_run, train_run
from ..plans.validation import compare_lda_qda
from ..sources.tables import read_table
from ..streaming.score import start_scoring
from .common import DOCS_LONG, R, big, docs_prepared, docs_raw, naive_bayes_sql, query, rnd, scratch, stratified_sql, with_gaps
from .measuring import metrics_sql

_SPECS = [Spec("naive_bayes"), Spec("lda"), Spec("id3", {"max_depth": 2}), Spec("pca")]


def _run(spark, sf, specs=_SPECS):
    return train_run(docs_raw(spark, sf), "doc_id", "quality", specs, "classification", run_id="documents")[0]


@query("train_run")
def train_run_query(spark, sf):
    run = _run(spark, sf)
    rows = [(r.model_key, m, v) for r in run.results for m, v in r.metrics.items()]
    return spark.createDataFrame(rows, "model_key string, metric string, value double").withColumn("value", rnd("value"))


@query("run_metadata")
def run_metadata_query(spark, sf):
    return run_metadata(spark, _run(spark, sf)).drop("fit_seconds")


@query("run_roundtrip", f"""
WITH {DOCS_LONG},{naive_bayes_sql('docs_l', 'nb', 'l.is_test')},
cells AS (SELECT actual, prediction AS predicted, count(*) AS n FROM nb GROUP BY 1, 2),{metrics_sql('cells')}
SELECT 'naive_bayes' AS model_key, metric, {R('value')} AS value FROM (UNPIVOT metr ON accuracy, precision, recall, f1 INTO NAME metric VALUE value)""")
def run_roundtrip(spark, sf):
    path = scratch(spark, "runs")
    save_run(_run(spark, sf, [Spec("naive_bayes")]), path)
    return load_metrics(spark, path, "documents").select("model_key", "metric", rnd("value").alias("value"))


@query("predict_run", f"""
WITH {DOCS_LONG},
fresh AS (SELECT d.doc_id, CASE WHEN d.doc_id % 17 = 0 THEN NULL ELSE d.n_chars END AS n_chars,
  CASE WHEN d.doc_id % 13 = 0 THEN NULL ELSE d.lang END AS lang, d.source FROM documents d),
fx AS (SELECT t.doc_id AS row_id, (coalesce(CAST(t.n_chars AS DOUBLE), med) - mu) / sd AS f0, """ + ", ".join(
    f"CAST(coalesce(t.lang, mode) = langs[{i}] AS DOUBLE) AS f{i}" for i in range(1, 5)) + f""",
  CAST(coalesce(code, (SELECT count(*) FROM docs_codes)) AS DOUBLE) AS f5
  FROM fresh t LEFT JOIN docs_codes ON t.source = code_source, docs_med, docs_mode, docs_scale, docs_langs),
both_l AS (
  SELECT row_id, label, is_test, feature, x FROM docs_l WHERE NOT is_test
  UNION ALL SELECT row_id, NULL, TRUE, CAST(substr(name, 2) AS INTEGER), x FROM (UNPIVOT fx ON f0, f1, f2, f3, f4, f5 INTO NAME name VALUE x)),
{naive_bayes_sql('both_l', 'nb', 'l.is_test')}
SELECT row_id, CAST(prediction AS BIGINT) AS prediction, {R('p1')} AS p1 FROM nb""")
def predict_run_query(spark, sf):
    """Save a run, load it back and score every document with it."""
    path = scratch(spark, "runs")
    save_run(_run(spark, sf, [Spec("naive_bayes")]), path)
    run = load_run(spark, path, "documents")
    new = with_gaps(read_table(spark, sf, "documents").select("doc_id", "n_chars", "lang", "source"))
    out = predict_run(run, "naive_bayes", new)
    return out.select("row_id", big("prediction").alias("prediction"), rnd(F.col("probability")[1]).alias("p1"))


@query("suitability_summary")
def suitability_summary(spark, sf):
    """The rules of both discriminants over all labelled rows."""
    p = docs_prepared(spark, sf)
    return suitability_rules(p.train.unionByName(p.test), 5, 0.1).withColumn("value", rnd("value"))


@query("compare_lda_qda")
def compare_lda_qda_query(spark, sf):
    p = docs_prepared(spark, sf)
    t, _ = compare_lda_qda(p.train.unionByName(p.test), 5, 0.1, require_suitable=False)
    return t.withColumn("mean", rnd("mean")).withColumn("std", rnd("std"))


# --- stream scoring -----------------------------------------------------------------

def _events(df):
    """Whether the value inside ``props`` is high, from value and type."""
    k = F.get_json_object("props", "$.k").cast("int")
    return df.select("event_id", "value", "event_type", (k >= 50).cast("int").alias("high"))


_TYPES = ["click", "error", "purchase", "signup", "view"]


@query("score_stream", f"""
WITH ev AS (SELECT event_id, value, event_type, CAST(CAST(json_extract(props, '$.k') AS INTEGER) >= 50 AS INTEGER) AS high FROM events),
{stratified_sql('ev', 'event_id', 'high', 'ev_s')},
sc AS (SELECT avg(value) AS mu, stddev_pop(value) AS sd FROM ev_s WHERE NOT is_test),
ev_x AS (SELECT event_id AS row_id, high AS label, is_test, (value - mu) / sd AS f0, {', '.join(f"CAST(event_type = '{t}' AS DOUBLE) AS f{i + 1}" for i, t in enumerate(_TYPES))} FROM ev_s, sc),
ev_l AS (SELECT row_id, label, is_test, CAST(substr(name, 2) AS INTEGER) AS feature, x FROM (UNPIVOT ev_x ON f0, f1, f2, f3, f4, f5 INTO NAME name VALUE x)),
{naive_bayes_sql('ev_l', 'nb', 'TRUE')}
SELECT row_id, CAST(prediction AS BIGINT) AS prediction, {R('p1')} AS p1 FROM nb""")
def score_stream(spark, sf):
    """All events read as a file stream and scored by a model fitted on a batch."""
    batch = read_table(spark, sf, "events")
    p = fit_prepare(_events(batch), "event_id", "high", "classification")
    run = Run("events", "classification", "high", p.prep, 0.2, p.n_rows,
              [Result("naive_bayes", NaiveBayes().fit(p.train), {})])
    stream = spark.readStream.schema(batch.schema).option("pathGlobFilter", "events.parquet").parquet(sf)
    path = scratch(spark, "scores")
    job = start_scoring(_events(stream).drop("high"), run, "naive_bayes", path, path.rsplit("/", 1)[1], once=True)
    job.awaitTermination()
    scored = spark.read.schema("row_id bigint, prediction int, probability array<double>").parquet(path)
    return scored.select("row_id", big("prediction").alias("prediction"), rnd(F.col("probability")[1]).alias("p1"))
