import numpy as np
import pytest
from pyspark.sql import functions as F

from tabulith.functions.quantiles import quantiles
from tabulith.functions.ranking import prefix_scan, previous_value, running_sum, with_hash_rank
from tabulith.operators import prepare as P
from tabulith.operators import series as X


@pytest.fixture(scope="module")
def mixed(spark):
    """200 rows: numbers with gaps, a low and a high cardinality column."""
    k = F.col("id")
    return spark.range(200).select(
        k.alias("key"),
        F.when(k % 40 != 0, (k * 37 % 101) / 7.0).alias("num1"), (k * 13 % 89).cast("double").alias("num2"),
        F.when(k % 41 != 0, F.element_at(F.array(F.lit("a"), F.lit("b"), F.lit("c")), (k % 3 + 1).cast("int"))).alias("low"),
        F.concat(F.lit("cat"), k * 7 % 15).alias("high"), (k % 2).cast("int").alias("label"),
    )


def test_split_sizes_and_shares(mixed, spark):
    p = P.fit_prepare(mixed, "key", "label", "classification")
    assert (p.train.count(), p.test.count()) == (160, 40)
    skew = spark.range(500).select(F.col("id").alias("key"), (F.col("id") * 1.0).alias("x"),
                                   F.when(F.col("id") < 450, "neg").otherwise("pos").alias("y"))
    both = P.split(skew, "key", "y", "classification").groupBy("split").agg(F.avg((F.col("y") == "pos").cast("int"))).collect()
    assert all(abs(r[1] - 0.1) < 0.05 for r in both)


def test_split_is_exact_and_stable(spark):
    df = spark.range(1003).select(F.col("id").alias("key"), F.lit(1.0).alias("x"))
    first = {r[0] for r in P.split(df, "key").where("split = 'test'").select("key").collect()}
    again = {r[0] for r in P.split(df.repartition(7), "key").where("split = 'test'").select("key").collect()}
    assert len(first) == 201 and first == again
    other = {r[0] for r in P.split(df, "key", seed=7).where("split = 'test'").select("key").collect()}
    assert other != first


def test_split_errors(spark):
    one = spark.range(60).select(F.col("id").alias("key"), F.when(F.col("id") == 0, "a").otherwise("b").alias("y"))
    with pytest.raises(ValueError):
        P.split(one, "key", "y", "classification")
    with pytest.raises(ValueError):
        P.split(one, "key", test_size=1.5)


def test_features_and_scaling(mixed):
    p = P.fit_prepare(mixed, "key", "label", "classification")
    assert p.feature_names == ["num1", "num2", "low=a", "low=b", "low=c", "high"]
    x = np.array([r[0] for r in p.train.select("features").collect()])
    assert np.isfinite(x).all()
    assert np.allclose(x[:, :2].mean(axis=0), 0, atol=1e-9) and np.allclose(x[:, :2].std(axis=0), 1, atol=1e-9)
    assert set(np.unique(x[:, 2:5])) == {0.0, 1.0} and (x[:, 2:5].sum(axis=1) == 1).all()
    assert x[:, 5].max() == 14.0


def test_fitted_on_train_only(mixed):
    p = P.fit_prepare(mixed, "key", "label", "classification")
    test_keys = [r[0] for r in p.test.select("row_id").collect()]
    changed = mixed.withColumn("num1", F.when(F.col("key").isin(test_keys), F.lit(1e6)).otherwise(F.col("num1")))
    q = P.fit_prepare(changed, "key", "label", "classification")
    assert p.prep.to_json() == q.prep.to_json()


def test_new_rows(mixed):
    p = P.fit_prepare(mixed, "key", "label", "classification")
    new = mixed.drop("label").limit(5).withColumn("high", F.lit("never")).withColumn("low", F.lit("zz"))
    x = np.array([r["features"] for r in P.transform_new(new, p.prep).collect()])
    assert (x[:, 5] == 15).all() and (x[:, 2:5] == 0).all()
    with pytest.raises(ValueError, match="num2"):
        P.transform_new(mixed.drop("label", "num2"), p.prep)
    with pytest.raises(ValueError, match="extra"):
        P.transform_new(mixed.drop("label").withColumn("extra", F.lit(1)), p.prep)
    assert P.column_diff(["a", "b"], ["b", "c"]) == {"missing": ["a"], "unexpected": ["c"]}


def test_record_round_trip(mixed):
    prep = P.fit_prepare(mixed, "key", "label", "classification").prep
    assert P.FittedPrep.from_json(prep.to_json()).to_json() == prep.to_json()


def test_constant_and_missing_columns(spark):
    df = spark.range(60).select(F.col("id").alias("key"), F.lit(3.0).alias("c"))
    x = P.fit_prepare(df, "key", None, "clustering").train.select("features").first()[0]
    assert x == [0.0]
    with pytest.raises(ValueError):
        P.fit_prepare(df.select("key", F.lit(None).cast("double").alias("c")), "key", None, "clustering")
    with pytest.raises(ValueError):
        P.fit_prepare(df.select("key", "c"), "key", "c", "regression")


def test_large_code_table(spark):
    df = spark.range(700).select(F.col("id").alias("key"), F.format_string("n%04d", F.col("id")).alias("name"))
    p = P.fit_prepare(df, "key", None, "clustering")
    codes = sorted(r[0][0] for r in p.train.select("features").collect())
    assert codes == list(map(float, range(560)))
    assert {r[0][0] for r in p.test.select("features").collect()} == {560.0}
    spread = P.sorted_codes(df.select(F.lit("name").alias("column"), F.col("name").alias("value")), 700, one_task=100)
    got = {r["value"]: r["code"] for r in spread.collect()}
    assert got == {f"n{i:04d}": i for i in range(700)}


def test_quantiles_by_radix(spark):
    """Against numpy: signs, copies, outliers, tiny gaps, nulls, zeros of both signs."""
    rng = np.random.default_rng(3)
    n = 3000
    own = {
        "a": (np.arange(n) * 7919 % 3001 / 3.0), "b": np.where(np.arange(n) % 3 == 0, 5.0, np.arange(n)), "c": np.full(n, np.nan),
        "d": np.where(np.arange(n) % 10 != 0, -np.arange(n, dtype=float) ** 2, np.nan), "e": np.r_[1e300, -1e300, rng.normal(size=n - 2) * 1e-300],
        "f": 1.0 + rng.integers(0, 40, n) * 2.0 ** -52, "g": np.full(n, -7.25), "h": rng.choice([-0.0, 0.0, 1.0, -1.0], n),
    }
    rows = [[None if np.isnan(v) else float(v) for v in row] for row in zip(*own.values())]
    df = spark.createDataFrame(rows, ", ".join(f"{c} double" for c in own)).repartition(7)
    probs = [0.0, 0.1, 0.25, 0.5, 0.77, 1.0]
    got = quantiles(df, list(own), probs)
    assert got.pop("c") is None
    for c, levels in got.items():
        values = np.sort(own[c][~np.isnan(own[c])])
        at = np.array(probs) * (len(values) - 1)
        low, high = values[np.floor(at).astype(int)], values[np.ceil(at).astype(int)]
        assert levels == pytest.approx(list(low + (at - np.floor(at)) * (high - low)), rel=1e-15), c
    assert quantiles(df, [], probs) == {} and quantiles(df.limit(0), ["a"], probs) == {"a": None}
    whole = quantiles(spark.range(100_001), ["id"], [0.5, 0.123])
    assert whole["id"] == [50_000.0, 12_300.0]


@pytest.mark.parametrize("parts", [1, 5, 40])
def test_prefix_scan_over_any_borders(spark, parts):
    """Groups within, across and over several partitions, nulls, batches of a few rows."""
    rng = np.random.default_rng(parts)
    rows, t = [], 0
    for g in (None, "a", "b", "hot", "z"):
        for _ in range(400 if g == "hot" else int(rng.integers(1, 30))):
            t += 1
            rows.append((g, int(rng.integers(0, 2)), t, int(rng.integers(-9, 9)) if rng.random() < 0.8 else None, float(rng.normal()), f"s{t}"))
    df = spark.createDataFrame(rows, "g string, k int, t int, v int, x double, s string").repartition(3)
    old = {c: spark.conf.get(c) for c in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled", "spark.sql.execution.arrow.maxRecordsPerBatch")}
    try:
        for c, v in zip(old, (str(parts), "false", "7")):
            spark.conf.set(c, v)
        got = prefix_scan(df, ["g", "k"], "t", {"v": "sv", "x": "sx"}, {"s": "p", "v": "q"}, 3, {"s": "n", "t": "nt"}).collect()
    finally:
        for c, v in old.items():
            spark.conf.set(c, v)
    assert len(got) == len(rows)
    groups = {}
    for r in sorted(rows, key=lambda r: r[2]):
        groups.setdefault(r[:2], []).append(r)
    place = {r[2]: (own, i) for own in groups.values() for i, r in enumerate(own)}
    for r in got:
        own, i = place[r.t]
        values = [o[3] for o in own[: i + 1] if o[3] is not None]
        assert r.sv == (sum(values) if values else None) and r.sx == pytest.approx(sum(o[4] for o in own[: i + 1]))
        for k in (1, 2, 3):
            assert (r[f"p_{k}"], r[f"q_{k}"]) == ((own[i - k][5], own[i - k][3]) if i >= k else (None, None))
        assert (r.n, r.nt) == ((own[i + 1][5], own[i + 1][2]) if i + 1 < len(own) else (None, None))
    assert prefix_scan(df.limit(0), ["g"], "t", {"v": "sv"}).count() == 0


def test_scans_of_the_input(spark):
    """Reads of the input by the best threshold (at most 4) and the area under the curve (at most 3)."""
    from tabulith.operators.evaluate import roc_auc
    from tabulith.operators.report import best_threshold

    seen = spark.sparkContext.accumulator(0)

    def watch(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    df = spark.range(1000).selectExpr("id % 3 as g", "id % 97 as v", "id % 2 as y", "array(1 - (id % 89) / 100d, (id % 89) / 100d) as p")
    df = df.mapInArrow(watch, df.schema)
    assert best_threshold(df, ["g"], "v", "y", [0, 1]).count() == 3
    assert seen.value <= 4000
    seen.value = 0
    assert roc_auc(df, ["0", "1"], "y", "p").count() == 1
    assert seen.value <= 3000


def test_quantiles_scan_at_most_four_times(spark):
    seen = spark.sparkContext.accumulator(0)

    def watch(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    df = spark.range(1000).selectExpr("cast(id as double) / 7 as x", "cast(id as double) as y").mapInArrow(watch, "x double, y double")
    quantiles(df, ["x", "y"], [0.1, 0.5, 0.9])
    assert seen.value <= 4000


def test_ranks_and_running_sums_in_buckets(spark):
    df = spark.range(2000).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("g"), F.col("id") % 5)).alias("g"),
        F.col("id").alias("t"), (F.col("id") % 17).alias("v"), F.md5(F.col("id").cast("string")).alias("h"),
    )
    pdf = df.toPandas()
    ranked = with_hash_rank(df, ["g"], "h", "r", 2).toPandas().sort_values(["g", "h"])
    assert (ranked["r"] == ranked.groupby("g").cumcount() + 1).all()
    out = running_sum(df, ["g"], "t", {"v": "s"}).toPandas().sort_values(["g", "t"]).reset_index(drop=True)
    want = pdf.sort_values(["g", "t"]).reset_index(drop=True)
    assert (out["s"] == want.groupby("g")["v"].cumsum()).all()
    total = running_sum(df, [], "t", {"v": "s"}).toPandas().sort_values("t")
    assert (total["s"].to_numpy() == pdf.sort_values("t")["v"].cumsum().to_numpy()).all()
    lagged = previous_value(df, ["g"], "t", {"v": "p"}, 3).toPandas().sort_values(["g", "t"]).reset_index(drop=True)
    for k in (1, 2, 3):
        shifted = want.groupby("g")["v"].shift(k)
        assert ((lagged[f"p_{k}"] == shifted) | (lagged[f"p_{k}"].isna() & shifted.isna())).all()


def test_folds(spark):
    df = spark.range(103).select(F.col("id").alias("key"), (F.col("id") % 3).alias("y"))
    per = P.kfold(df, "key", "y", 5).groupBy("y", "fold").count().collect()
    for y in range(3):
        sizes = [r["count"] for r in per if r["y"] == y]
        assert len(sizes) == 5 and max(sizes) - min(sizes) <= 1
    with pytest.raises(ValueError):
        P.kfold(df.limit(4), "key", "y", 5)


def test_edges_and_bins(spark):
    df = spark.range(100).select((F.col("id") % 3).cast("double").alias("few"), F.col("id").cast("double").alias("many"), F.lit(1.0).alias("one"))
    edges = P.bin_edges(df, ["few", "many", "one"], 4)
    assert edges == {"few": [0.5, 1.5], "many": [24.75, 49.5, 74.25], "one": []}
    on_edge = spark.createDataFrame([(0.5,), (0.4,), (1.5,)], "few double")
    assert [r[1] for r in P.discretize(on_edge, {"few": edges["few"]}).collect()] == [1, 0, 2]


def test_poly(spark):
    df = spark.createDataFrame([([2.0, 3.0],)], "features array<double>")
    assert P.poly_features(df, "features", 2).first()["poly"] == [2.0, 3.0, 4.0, 6.0, 9.0]
    with pytest.raises(ValueError):
        P.poly_expressions("features", 200, 2)


def test_series(spark):
    rows = [("a", i, float(i * i), float(i)) for i in range(12)] + [("b", i, 5.0 + (-1) ** i, float(i)) for i in range(12)]
    df = spark.createDataFrame(rows, "s string, t bigint, y double, x double")
    r = {x["s"]: x for x in X.stationarity(df, ["s"], "t", "y").collect()}
    assert r["a"]["differenced"] and not r["b"]["differenced"]
    fit = X.fit_series(df, ["s"], "t", "x", "y")
    a = fit.where("s = 'a'").first()
    assert a["slope"] == pytest.approx(2.0) and a["intercept"] == pytest.approx(-1.0) and a["last_level"] == 121.0
    new = spark.createDataFrame([("a", 12, 12.0), ("a", 13, 13.0)], "s string, t bigint, x double")
    got = [x["prediction"] for x in X.predict_series(new, fit, ["s"], "t", "x").orderBy("t").collect()]
    assert got == pytest.approx([144.0, 169.0])
    look = X.lookback(df.where("s = 'a'"), ["s"], "t", ["y", "x"], 3).orderBy("t").collect()
    assert len(look) == 9 and look[0]["features"] == [0.0, 0.0, 1.0, 1.0, 4.0, 2.0]
