import pytest
from pyspark.sql import functions as F

from tabulith.operators import profile as P
from tabulith.sources.tables import make_blobs, normalize_missing, read_csv, with_row_key


def numeric(spark, n, columns=3):
    return spark.range(n).select(*[(F.col("id") * (j + 1) * 1.0).alias(f"c{j}") for j in range(columns)])


def rules(df):
    return sorted(r["rule"] for r in P.validate_table(df).collect())


def test_limits(spark):
    assert rules(numeric(spark, 49)) == ["min_rows"]
    assert rules(numeric(spark, 50, 100)) == []
    assert rules(numeric(spark, 60, 101)) == ["max_columns"]
    assert rules(spark.range(60).select(F.lit("x").alias("t"))) == ["numeric_columns"]
    with pytest.raises(ValueError):
        P.require_valid(numeric(spark, 10))


def test_boolean_is_categorical(spark):
    df = spark.range(60).select((F.col("id") % 2 == 0).alias("b"))
    assert rules(df) == ["numeric_columns"]
    assert P.column_kinds(df) == ([], ["b"])


def test_target_and_problem_type(spark):
    df = spark.range(60).select((F.col("id") % 3).alias("a"), F.col("id").alias("b"))
    assert P.resolve_target(df) == "b"
    assert P.resolve_target(df, has_target=False) is None
    assert P.infer_problem_type(df, "a") == "classification"
    assert P.infer_problem_type(df) == "regression"
    assert P.infer_problem_type(df, has_target=False) == "clustering"
    with pytest.raises(ValueError):
        P.resolve_target(df, "nope")
    with pytest.raises(ValueError):
        P.infer_problem_type(df.withColumn("k", F.lit(1)), "k")
    ten = spark.range(60).select((F.col("id") % 10).alias("a"))
    eleven = spark.range(60).select(F.concat(F.lit("v"), F.col("id") % 11).alias("a"))
    assert P.infer_problem_type(ten, "a") == "classification"
    assert P.infer_problem_type(eleven, "a") == "regression"


def test_numeric_profile(table):
    df = table([(1.0,), (2.0,), (3.0,), (10.0,), (None,), (float("nan"),)], "x double")
    row = P.profile_numeric(df).first()
    assert (row["missing_count"], row["unique_count"]) == (2, 4)
    assert row["median"] == 2.5 and row["mean"] == 4.0
    assert row["std"] == pytest.approx(4.08248290463863)
    single = P.profile_numeric(table([(5.0,)], "x double")).first()
    assert single["std"] is None and single["mean"] == 5.0


def test_all_missing_column(table):
    df = table([(None, 1), (None, 2)], "x double, y int")
    row = P.profile_numeric(df, ["x"]).first()
    assert row["mean"] is None and row["median"] is None and row["unique_count"] == 0


def test_histogram_edges(table):
    df = table([(float(i),) for i in range(11)], "x double")
    counts = [r["n"] for r in P.histogram(df).orderBy("bin").collect()]
    assert counts == [1] * 9 + [2]
    constant = P.histogram(table([(4.0,)] * 5, "x double")).orderBy("bin").collect()
    assert constant[0]["lower"] == 3.5 and constant[-1]["upper"] == 4.5
    assert sum(r["n"] for r in constant) == 5


def test_top_categories_and_other(table):
    rows = [(f"v{i:02d}",) for i in range(25) for _ in range(30 - i)]
    top = P.top_categories(table(rows, "c string")).orderBy("rank").collect()
    assert len(top) == 21 and top[0]["value"] == "v00" and top[-1]["value"] == "Other"
    assert top[-1]["n"] == sum(30 - i for i in range(20, 25))


@pytest.mark.parametrize("counts,flag", [((50, 50), False), ((95, 5), True), ((80, 20), False), ((81, 19), True), ((45, 45, 10), True)])
def test_imbalance_is_strict(table, counts, flag):
    rows = [(f"c{i}",) for i, n in enumerate(counts) for _ in range(n)] + [(None,)]
    out = P.class_imbalance(table(rows, "y string"), "y").collect()
    assert {r["is_imbalanced"] for r in out} == {flag}
    assert sum(r["n"] for r in out) == sum(counts)
    assert (out[0]["message"] is not None) == flag


def test_report_columns(spark):
    df = numeric(spark, 3, 25)
    shown = P.report_columns(df, "c24")
    assert shown.columns[0] == "c24" and len(shown.columns) == 20


def test_nested_columns_are_refused(spark):
    with pytest.raises(ValueError):
        P.column_kinds(spark.range(2).select(F.array("id").alias("a")))


def test_read_csv(spark, tmp_path):
    path = tmp_path / "t.csv"
    path.write_text("a,b,c,d\n1,x,1.5,true\nNA,,2,false\n3,N/A,null,true\n")
    df = read_csv(spark, str(path))
    assert [f.dataType.simpleString() for f in df.schema.fields] == ["bigint", "string", "double", "boolean"]
    assert [r["a"] for r in df.collect()] == [1, None, 3]
    assert [r["b"] for r in df.collect()] == ["x", None, None]
    bad = tmp_path / "bad.csv"
    bad.write_text("a,b\n1,2\n1,2,3\n")
    with pytest.raises(Exception):
        read_csv(spark, str(bad)).collect()


def test_row_keys(spark):
    df = spark.range(100).select((F.col("id") % 2).alias("a")).repartition(3)
    keys = with_row_key(df).select("row_id").distinct().count()
    assert keys == 100
    assert with_row_key(df, unique=False).select("row_id").distinct().count() == 2


def test_blobs_and_missing(spark):
    b = make_blobs(spark, 60, 3, 4)
    assert b.count() == 60 and b.select("blob").distinct().count() == 3
    df = spark.createDataFrame([(float("nan"), "x"), (1.0, None)], "a double, b string")
    assert normalize_missing(df).where("a is null").count() == 1
