import numpy as np
import pytest
from pyspark.sql import functions as F

from tabulith.models.density import DBSCAN, cut_merges, density_clusters, merge_clusters
from tabulith.operators import distance as D
from tabulith.operators.graph import connected_components


def rows(spark, x, **extra):
    names = list(extra)
    return spark.createDataFrame(
        [(i, [float(v) for v in r], *[extra[n][i] for n in names]) for i, r in enumerate(x)],
        "row_id bigint, features array<double>" + "".join(f", {n} string" for n in names),
    )


@pytest.fixture(scope="module")
def cloud():
    """Clumps, noise and one point that is a third of all rows."""
    rng = np.random.default_rng(5)
    return np.vstack([
        rng.normal(0, 0.4, (50, 2)), rng.normal(4, 0.4, (50, 2)), np.tile([[2.0, 2.0]], (60, 1)), rng.uniform(-3, 7, (25, 2)),
    ])


def distances(a, b):
    return np.sqrt(((a[:, None] - b[None]) ** 2).sum(axis=2))


@pytest.mark.parametrize("block,pivots", [(4096, 64), (16, 8)])
def test_knn(spark, cloud, block, pivots):
    t = rows(spark, cloud)
    got = {}
    for r in D.knn_join(t, t, 4, block_rows=block, pivots=pivots).collect():
        got[(r["query_id"], r["rank"])] = (r["train_id"], r["distance"])
    d = distances(cloud, cloud)
    assert len(got) == 4 * len(cloud)
    for i in range(len(cloud)):
        order = np.argsort(d[i], kind="stable")[:4]
        for k, j in enumerate(order):
            assert got[(i, k + 1)][0] == j and got[(i, k + 1)][1] == pytest.approx(d[i, j])


def test_knn_smaller_than_k_and_votes(spark):
    train = rows(spark, [[0.0], [1.0]], label=["b", "a"])
    near = D.knn_join(rows(spark, [[0.4], [1.0]]), train, 5, extra="label")
    assert near.count() == 4
    vote = {r["query_id"]: r["prediction"] for r in D.knn_vote(near, "label").collect()}
    assert vote == {0: "a", 1: "a"}                       # a tie goes to the smaller label
    weighted = {r["query_id"]: r["prediction"] for r in D.knn_vote(near, "label", "distance").collect()}
    assert weighted == {0: "b", 1: "a"}


@pytest.mark.parametrize("block", [4096, 16])
def test_radius(spark, cloud, block):
    t = rows(spark, cloud)
    d = distances(cloud, cloud)
    got = {r["query_id"]: r for r in D.radius_join(t, t, 0.7, block_rows=block).collect()}
    for i in range(len(cloud)):
        assert got[i]["n_within"] == (d[i] <= 0.7).sum()
        assert got[i]["nearest_distance"] == 0.0
    far = D.radius_join(rows(spark, [[50.0, 50.0]]), t, 0.7).first()
    assert far["n_within"] == 0 and far["nearest_id"] is None


def test_products_keep_order_of_near_copies():
    """Points far from the origin whose products lose the digits that tell them apart."""
    rng = np.random.default_rng(8)
    b = 1e6 + np.vstack([rng.normal(0, 1e-3, (300, 6)), rng.integers(0, 2, (300, 6)), np.full((50, 6), 0.5)])
    a = np.vstack([b[::7], 1e6 + rng.normal(0, 1, (40, 6))])
    d = distances(a, b)
    for k in (1, 3, 700):
        i, j, got = D.nearest_pairs(a, b, k)
        order = np.argsort(d, axis=1, kind="stable")[:, :k]
        assert (j.reshape(len(a), -1) == order).all() and (i == np.repeat(np.arange(len(a)), order.shape[1])).all()
        assert got == pytest.approx(d[i, j], rel=1e-12)
    weight = rng.integers(1, 4, len(b)).astype(float)
    to_b, to_a = D.distance_sums(a, b, np.ones(len(a)), weight, np.array([0, 10]), np.array([0, 5, 400]))
    want = d * weight
    assert to_b == pytest.approx(np.stack([want[:, :5].sum(1), want[:, 5:400].sum(1), want[:, 400:].sum(1)], axis=1))
    assert to_a == pytest.approx(np.stack([d[:10].sum(0), d[10:].sum(0)], axis=1))


def test_knn_rows_cross_once_with_the_list_of_cells(spark, cloud):
    """The question rows are copied for their cells by Spark, not inside a Python batch."""
    t = rows(spark, cloud)
    plan = D.knn_join(t, t, 2)._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInPandas" not in plan


def brute_dbscan(x, eps, m):
    near = distances(x, x) <= eps
    core = near.sum(axis=1) >= m
    label = np.full(len(x), -1)
    k = 0
    for i in range(len(x)):
        if not core[i] or label[i] >= 0:
            continue
        todo = [i]
        while todo:
            j = todo.pop()
            if label[j] >= 0:
                continue
            label[j] = k
            todo += [int(n) for n in np.flatnonzero(near[j] & core) if label[n] < 0]
        k += 1
    for i in np.flatnonzero(~core):
        touching = label[near[i] & core]
        label[i] = touching.min() if len(touching) else -1
    return label, core


@pytest.mark.parametrize("block", [4096, 12])
def test_dbscan(spark, cloud, block):
    want, core = brute_dbscan(cloud, 0.5, 4)
    out = density_clusters(rows(spark, cloud), 0.5, 4, block_rows=block).toPandas().sort_values("row_id")
    assert (out["prediction"].to_numpy() == want).all() and (out["is_core"].to_numpy() == core).all()


@pytest.mark.parametrize("block", [4096, 25])
def test_dbscan_crowded_cells(spark, block):
    """Dense clumps whose nearest points are not the outermost ones of a cell."""
    rng = np.random.default_rng(12)
    x = np.vstack([
        rng.normal(0, 0.05, (150, 2)), rng.uniform(0, 3, (120, 2)), rng.normal(1.0, 0.3, (80, 2)),
        np.column_stack([np.linspace(4, 6, 40), np.full(40, 0.3)]), np.column_stack([np.linspace(4, 6, 40), np.full(40, 0.82)]),
    ])
    for eps, m in ((0.2, 5), (0.5, 8), (0.53, 3)):
        want, core = brute_dbscan(x, eps, m)
        out = density_clusters(rows(spark, x), eps, m, block_rows=block).toPandas().sort_values("row_id")
        assert (out["is_core"].to_numpy() == core).all() and (out["prediction"].to_numpy() == want).all()


def test_dbscan_text_keys_and_high_dimension(spark):
    rng = np.random.default_rng(1)
    x = np.vstack([rng.normal(0, 0.05, (20, 5)), rng.normal(3, 0.05, (20, 5))])
    t = rows(spark, x).withColumn("row_id", F.format_string("k%03d", "row_id"))
    out = density_clusters(t, 0.8, 3).toPandas().sort_values("row_id")
    assert out["prediction"].tolist() == [0] * 20 + [1] * 20


def test_dbscan_all_noise_and_new_rows(spark, cloud):
    lonely = density_clusters(rows(spark, [[0.0, 0.0], [9.0, 9.0]]), 0.5, 2).collect()
    assert {r["prediction"] for r in lonely} == {-1}
    fitted = DBSCAN(0.5, 4).fit(rows(spark, cloud))
    new = rows(spark, [[2.0, 2.1], [100.0, 100.0]])
    got = {r["row_id"]: r["prediction"] for r in fitted.transform(new).collect()}
    want, _ = brute_dbscan(cloud, 0.5, 4)
    assert got == {0: want[100], 1: -1}
    with pytest.raises(ValueError):
        DBSCAN(metric="manhattan")


def test_components(spark):
    chain = [(i, i + 1) for i in range(200)] + [(1000, i) for i in range(1001, 1100)] + [(5000, 5000)]
    edges = spark.createDataFrame(chain, "src bigint, dst bigint")
    extra = spark.createDataFrame([(7777,), (3,)], "id bigint")
    got = {r["id"]: r["component"] for r in connected_components(edges).collect()}
    assert {got[i] for i in range(201)} == {0} and {got[i] for i in range(1000, 1100)} == {1000}
    alone = {r["id"]: r["component"] for r in connected_components(edges, extra).collect()}
    assert alone == {7777: 7777, 3: 0}


def test_merging():
    centres = np.array([[0.0], [0.1], [5.0], [5.2], [20.0]])
    sizes = np.ones(5)
    for linkage in ("ward", "single", "complete", "average"):
        merges = merge_clusters(centres, sizes, linkage)
        assert [m[:2] for m in merges[:2]] == [(0, 1), (2, 3)] and merges[-1][3] == 5
        assert cut_merges(5, merges, 3, None) == [0, 0, 1, 1, 2]
    merges = merge_clusters(centres, sizes, "single")
    assert cut_merges(5, merges, None, 0.15) == [0, 0, 1, 2, 3]
    assert merges[0][2] == pytest.approx(0.1)
