"""Evaluation metrics per model type, as aggregates over prediction tables.

``pred`` is ``(row_id, label, prediction, probability)``; cluster tables carry
``features`` and an integer ``prediction`` where -1 is noise.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.ranking import running_sum
from ..functions.scalar import sum_text

MODEL_TYPES = ("classifier", "regressor", "clusterer", "dimensionality_reducer")
NOISE = -1


# --- classification --------------------------------------------------------

def confusion_counts(
    pred: DataFrame, actual: str = "label", predicted: str = "prediction", by: Sequence[str] = ()
) -> DataFrame:
    """Observed ``(actual, predicted, n)`` cells; everything else builds on it."""
    return pred.groupBy(
        *by,
        F.col(actual).cast("string").alias("actual"),
        F.col(predicted).cast("string").alias("predicted"),
    ).agg(F.count(F.lit(1)).alias("n"))


def confusion_matrix(pred: DataFrame, actual: str = "label", predicted: str = "prediction") -> DataFrame:
    """Dense matrix over the union of labels.

    Each label is paired with the whole (small) label list by explode, and
    absent cells are filled with zero.
    """
    cells = confusion_counts(pred, actual, predicted)
    labels = cells.select(F.col("actual").alias("l")).union(cells.select("predicted")).distinct()
    listed = labels.agg(F.array_sort(F.collect_list("l")).alias("labels"))
    frame = (
        listed.select("labels", F.explode("labels").alias("actual"))
        .select("actual", F.explode("labels").alias("predicted"))
    )
    return frame.join(cells, ["actual", "predicted"], "left").select(
        "actual", "predicted", F.coalesce("n", F.lit(0)).cast("bigint").alias("n")
    )


def class_scores(cells: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Support, precision, recall and F1 per label from confusion cells."""
    per = (
        cells.select(
            *by,
            F.explode(
                F.array(
                    F.struct(F.col("actual").alias("label"), F.col("n").alias("support"),
                             F.lit(0).cast("bigint").alias("called"),
                             F.when(F.col("actual") == F.col("predicted"), F.col("n"))
                             .otherwise(F.lit(0)).alias("hit")),
                    F.struct(F.col("predicted").alias("label"), F.lit(0).cast("bigint").alias("support"),
                             F.col("n").alias("called"), F.lit(0).cast("bigint").alias("hit")),
                )
            ).alias("r")
        )
        .select(*by, "r.*").groupBy(*by, "label")
        .agg(F.sum("support").alias("support"), F.sum("called").alias("called"), F.sum("hit").alias("hit"))
    )
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(F.lit(0.0))
    return per.select(
        *by, "label", "support",
        ratio(F.col("hit"), F.col("called")).alias("precision"),
        ratio(F.col("hit"), F.col("support")).alias("recall"),
        ratio(2 * F.col("hit"), F.col("called") + F.col("support")).alias("f1"),
        "hit",
    )


def classifier_metrics(
    pred: DataFrame, actual: str = "label", predicted: str = "prediction", by: Sequence[str] = ()
) -> DataFrame:
    """Accuracy and support-weighted precision, recall, F1; one row (per group)."""
    scores = class_scores(confusion_counts(pred, actual, predicted, by), by)
    weighted = lambda c: (F.sum(F.col(c) * F.col("support")) / F.sum("support"))
    return scores.groupBy(*by).agg(
        (F.sum("hit") / F.sum("support")).alias("accuracy"),
        weighted("precision").alias("precision"),
        weighted("recall").alias("recall"),
        weighted("f1").alias("f1"),
    )


def roc_auc(
    pred: DataFrame, classes: Sequence[str], actual: str = "label",
    probability: str = "probability", by: Sequence[str] = (),
) -> DataFrame:
    """Area under the ROC curve: binary, or one-vs-rest weighted by support.

    Rows are counted by distinct score first, so ties and copies collapse; the
    running rank is summed in ordered buckets of the score.
    """
    classes = [str(c) for c in classes]
    if len(classes) < 2:
        raise ValueError("At least two classes are required.")
    positions = [1] if len(classes) == 2 else list(range(len(classes)))
    long = pred.select(
        *by,
        F.explode(
            F.array(
                *[
                    F.struct(F.lit(classes[i]).alias("class"),
                             F.element_at(F.col(probability), i + 1).alias("score"),
                             (F.col(actual).cast("string") == F.lit(classes[i])).cast("bigint").alias("hit"))
                    for i in positions
                ]
            )
        ).alias("p")
    ).select(*by, "p.*")
    ties = long.groupBy(*by, "class", "score").agg(
        F.count(F.lit(1)).alias("n"), F.sum("hit").alias("positives")
    )
    ranked = running_sum(ties, [*by, "class"], "score", {"n": "upto"})
    # mean rank of a tie group of n rows ending at ``upto``
    mean_rank = F.col("upto") - (F.col("n") - 1) / 2.0
    per_class = ranked.groupBy(*by, "class").agg(
        F.sum(mean_rank * F.col("positives")).alias("rank_sum"),
        F.sum("positives").cast("double").alias("p"),
        F.sum(F.col("n") - F.col("positives")).cast("double").alias("q"),
    ).select(
        *by, "class", "p",
        F.when((F.col("p") > 0) & (F.col("q") > 0),
               (F.col("rank_sum") - F.col("p") * (F.col("p") + 1) / 2) / (F.col("p") * F.col("q"))).alias("auc"),
    )
    return per_class.groupBy(*by).agg((F.sum(F.col("auc") * F.col("p")) / F.sum("p")).alias("roc_auc"))


# --- regression ------------------------------------------------------------

def regressor_metrics(pred: DataFrame, actual: str = "label", predicted: str = "prediction") -> DataFrame:
    """mse, rmse, r2 and mae in one row; r2 of a constant target is 1 or 0."""
    y, p = F.col(actual).cast("double"), F.col(predicted).cast("double")
    base = pred.agg(
        F.avg((y - p) * (y - p)).alias("mse"),
        F.avg(F.abs(y - p)).alias("mae"),
        F.var_pop(y).alias("var"),
    )
    return base.select(
        "mse", F.sqrt("mse").alias("rmse"),
        F.when(F.col("var") > 0, 1 - F.col("mse") / F.col("var"))
        .when(F.col("mse") == 0, F.lit(1.0)).otherwise(F.lit(0.0)).alias("r2"),
        "mae",
    )


# --- clustering ------------------------------------------------------------

def _dim(df: DataFrame, features: str) -> int:
    row = df.select(F.size(features).alias("d")).first()
    if row is None:
        raise ValueError("The table is empty.")
    return row["d"]


def array_means(groups, features: str, d: int) -> list[Column]:
    return [F.avg(F.col(features)[j]).alias(f"m{j}") for j in range(d)]


def centroids(df: DataFrame, features: str = "features", label: str = "prediction") -> DataFrame:
    """``(label, n, centroid)`` by one partial aggregate."""
    d = _dim(df, features)
    return (
        df.groupBy(label)
        .agg(F.count(F.lit(1)).alias("n"), *array_means(None, features, d))
        .select(label, "n", F.array(*[F.col(f"m{j}") for j in range(d)]).alias("centroid"))
    )


def cluster_inertia(df: DataFrame, features: str = "features", label: str = "prediction") -> DataFrame:
    """Within-cluster squared distance, noise left out, NULL if all is noise."""
    d = _dim(df, features)
    spread = sum_text([f"var_pop({features}[{j}])" for j in range(d)])
    per = df.where(F.col(label) != NOISE).groupBy(label).agg(
        (F.expr(spread) * F.count(F.lit(1))).alias("ss")
    )
    return per.agg(F.sum("ss").alias("inertia"))


def _euclid(a: str, b: str) -> Column:
    return F.expr(
        f"sqrt(aggregate(zip_with({a}, {b}, (x, y) -> (x - y) * (x - y)), 0D, (s, v) -> s + v))"
    )


def davies_bouldin(df: DataFrame, features: str = "features", label: str = "prediction") -> DataFrame:
    """Mean over clusters of the worst (s_i + s_j) / d_ij; noise is a cluster.

    Only the centroid table is broadcast; its size is checked.  NULL unless
    2 <= clusters < rows.
    """
    centers = centroids(df, features, label)
    k = centers.count()
    if k > 20_000:
        raise ValueError("Davies-Bouldin compares all cluster pairs; more than 20 000 clusters given.")
    spread = (
        df.select(label, features).join(F.broadcast(centers), label)
        .withColumn("__d", _euclid(features, "centroid"))
        .groupBy(label)
        .agg(F.avg("__d").alias("s"), F.first("centroid").alias("centroid"), F.count(F.lit(1)).alias("n"))
    )
    left = spread.select(F.col(label).alias("i"), F.col("s").alias("si"), F.col("centroid").alias("ci"))
    listed = spread.agg(
        F.collect_list(F.struct(F.col(label).alias("j"), F.col("s").alias("sj"), F.col("centroid").alias("cj"))).alias("all"),
        F.sum("n").alias("rows"),
    )
    pairs = left.withColumn("o", F.explode(listed.select("all").scalar())).select(
        "i", "si", "ci", "o.j", "o.sj", "o.cj"
    ).where("i <> j")
    gap = _euclid("ci", "cj")
    ratio = F.when(gap > 0, (F.col("si") + F.col("sj")) / gap).otherwise(F.lit(0.0))
    worst = pairs.groupBy("i").agg(F.max(ratio).alias("worst"))
    rows = listed.select("rows").scalar()
    return worst.agg(F.avg("worst").alias("v"), F.count(F.lit(1)).alias("k")).select(
        F.when((F.col("k") >= 2) & (F.col("k") < rows), F.col("v")).alias("davies_bouldin_score")
    )


def silhouette_squared(df: DataFrame, features: str = "features", label: str = "prediction") -> DataFrame:
    """Silhouette under squared Euclidean distance, linear in the rows.

    The mean squared distance from a row to a cluster needs only the cluster's
    centroid and mean squared norm, so two aggregates suffice.
    """
    from pyspark.ml.evaluation import ClusteringEvaluator
    from pyspark.ml.functions import array_to_vector

    vectors = df.select(
        array_to_vector(F.col(features)).alias("features"), F.col(label).cast("double").alias("prediction")
    )
    value = ClusteringEvaluator(metricName="silhouette", distanceMeasure="squaredEuclidean").evaluate(vectors)
    return df.sparkSession.createDataFrame([(float(value),)], "silhouette_squared double")


def reducer_variance_ratio(
    df: DataFrame, features: str = "features", components: str = "components"
) -> DataFrame:
    """Variance of every output component over the total feature variance."""
    first = df.select(F.size(features).alias("d"), F.size(components).alias("k")).first()
    total = sum_text([f"var_pop({features}[{j}])" for j in range(first["d"])])
    row = df.agg(
        F.expr(total).alias("total"),
        *[F.var_pop(F.col(components)[j]).alias(f"v{j}") for j in range(first["k"])],
    )
    items = F.array(
        *[F.struct(F.lit(j).alias("component"), F.col(f"v{j}").alias("v")) for j in range(first["k"])]
    )
    return row.select("total", F.explode(items).alias("c")).select(
        "c.component", F.when(F.col("total") != 0, F.col("c.v") / F.col("total")).alias("ratio")
    )


def cluster_summary(df: DataFrame, label: str = "prediction") -> DataFrame:
    """Size of every cluster with the cluster and noise totals."""
    sizes = df.groupBy(F.col(label).alias("cluster")).agg(F.count(F.lit(1)).alias("n"))
    totals = sizes.agg(
        F.count_if(F.col("cluster") != NOISE).alias("k"),
        F.coalesce(F.sum(F.when(F.col("cluster") == NOISE, F.col("n"))), F.lit(0)).alias("noise"),
    )
    return sizes.withColumn("n_clusters", totals.select("k").scalar()).withColumn(
        "n_noise", totals.select("noise").scalar()
    )


# --- dispatch --------------------------------------------------------------

def evaluate(
    model_type: str, pred: DataFrame, classes: Sequence[str] | None = None,
    exact_silhouette: bool = True,
) -> dict[str, float | None]:
    """The scalar metrics of one model type.

    The exact silhouette compares every distinct point with every other one; without
    ``exact_silhouette`` the linear squared variant is reported under its own name.
    The number of rows never decides.
    """
    if model_type == "classifier":
        return classifier_metrics(pred).first().asDict()
    if model_type == "regressor":
        return regressor_metrics(pred).first().asDict()
    if model_type == "clusterer":
        from .distance import silhouette

        sizes = pred.groupBy("prediction").count().agg(
            F.count(F.lit(1)).alias("k"), F.sum("count").alias("n")
        ).first()
        result: dict[str, float | None] = {
            "inertia": cluster_inertia(pred).first()[0],
            "davies_bouldin_score": None, "silhouette_score": None,
        }
        if 2 <= sizes["k"] < sizes["n"]:
            result["davies_bouldin_score"] = davies_bouldin(pred).first()[0]
            if exact_silhouette:
                result["silhouette_score"] = silhouette(pred).first()[0]
            else:
                result["silhouette_squared"] = silhouette_squared(pred).first()[0]
        return result
    if model_type == "dimensionality_reducer":
        return {
            f"explained_variance_ratio_{r['component']}": r["ratio"]
            for r in reducer_variance_ratio(pred).collect()
        }
    raise ValueError(f"Unrecognised model_type: {model_type!r}")


# --- checks and alignment --------------------------------------------------

def align(pred: DataFrame, truth: DataFrame, key: str = "row_id") -> DataFrame:
    """Predictions next to the actual values, by key."""
    return truth.join(pred, key, "left")


def check_features(df: DataFrame, features: str, d: int, label: str | None = None) -> DataFrame:
    """Problem counts of a feature table in one pass."""
    x = F.col(features)
    bad = F.exists(x, lambda v: F.isnan(v) | (F.abs(v) == F.lit(float("inf"))))
    return df.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_if(x.isNull()).alias("null_features"),
        F.count_if(F.exists(x, lambda v: v.isNull())).alias("null_values"),
        F.count_if(F.coalesce(bad, F.lit(False))).alias("not_finite"),
        F.count_if(F.size(x) != d).alias("wrong_width"),
        (F.count_if(F.col(label).isNull()) if label else F.lit(0).cast("bigint")).alias("missing_label"),
    )


def audit_predictions(
    pred: DataFrame, truth: DataFrame, known_labels: DataFrame | None = None,
    second: DataFrame | None = None, tolerance: float = 1e-6,
) -> DataFrame:
    """Contract checks of a prediction table as one row of counts.

    ``pred`` and ``second`` carry ``row_id, prediction, probability``; ``truth``
    the expected ``row_id``; ``known_labels`` one column ``label``.
    """
    per_row = pred.groupBy("row_id").agg(F.count(F.lit(1)).alias("n_pred"))
    joined = truth.select("row_id").withColumn("__t", F.lit(1)).join(per_row, "row_id", "full")
    rows = joined.agg(
        F.count_if(F.col("n_pred").isNull()).alias("rows_without_prediction"),
        F.count_if(F.col("__t").isNull()).alias("unexpected_rows"),
        F.count_if(F.col("n_pred") > 1).alias("rows_predicted_twice"),
    )
    total = F.aggregate(F.col("probability"), F.lit(0.0), lambda a, v: a + v)
    probs = pred.agg(
        F.count_if(F.exists("probability", lambda v: v < 0)).alias("negative_probability"),
        F.count_if(F.abs(total - 1.0) > tolerance).alias("bad_probability_sum"),
    )
    out = rows.select(
        "*",
        probs.select("negative_probability").scalar().alias("negative_probability"),
        probs.select("bad_probability_sum").scalar().alias("bad_probability_sum"),
    )
    if known_labels is not None:
        unknown = pred.select(F.col("prediction").cast("string").alias("label")).join(
            known_labels.select(F.col("label").cast("string").alias("label")).distinct(), "label", "left_anti"
        ).agg(F.count(F.lit(1)))
        out = out.withColumn("unknown_labels", unknown.scalar())
    if second is not None:
        differs = (
            pred.select("row_id", F.col("prediction").alias("a"))
            .join(second.select("row_id", F.col("prediction").alias("b")), "row_id", "full")
            .agg(F.count_if(~F.col("a").eqNullSafe(F.col("b"))))
        )
        out = out.withColumn("fits_disagree", differs.scalar())
    return out
