import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabulith.functions.node_edges import cut, node_edges
from tabulith.models import cuts
from tabulith.models import trees as T
from tabulith.models.contributions import ensemble_tables, mean_abs_contribution, tree_contributions, tree_shap
from tabulith.models.boosting import BoostedTrees
from tabulith.models.library import RandomForest
from tabulith.models.oblique import Oblique
from tabulith.operators.evaluate import classifier_metrics


def table(spark, x, y):
    kind = "string" if isinstance(y[0], str) else "int"
    return spark.createDataFrame(
        [(i, [float(v) for v in r], c if kind == "string" else int(c)) for i, (r, c) in enumerate(zip(x, y))],
        f"row_id int, features array<double>, label {kind}",
    ).repartition(4)


@pytest.fixture(scope="module")
def binary(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(240, 6))
    y = (0.9 * x[:, 0] - 0.7 * x[:, 1] + 0.4 * x[:, 2] + rng.normal(0, 0.1, 240) > 0).astype(int)
    return x, y, table(spark, x, y)


MODELS = [T.ID3(), T.CART(), T.CHAID(), Oblique()]


@pytest.mark.parametrize("model", MODELS, ids=lambda m: m.key)
def test_contract(binary, model):
    x, y, df = binary
    fitted = model.fit(df)
    out = fitted.transform(df).toPandas().sort_values("row_id")
    assert (out["prediction"].to_numpy() == y).mean() > 0.7
    p = np.array(out["probability"].tolist())
    assert (p >= 0).all() and np.allclose(p.sum(axis=1), 1)
    assert sum(fitted.importance.values()) == pytest.approx(1.0)
    assert fitted.nodes[0].n == 240
    for n in fitted.nodes:
        if not n.is_leaf:
            kids = {c for c in n.children if c >= 0}
            assert sum(fitted.nodes[c].n for c in kids) == n.n and all(c > n.id for c in kids)
    again = model.fit(df.repartition(3))
    assert [n.feature for n in again.nodes] == [n.feature for n in fitted.nodes]
    at = T.route(x, fitted.nodes, fitted.closed_left)
    assert (np.bincount(at, minlength=len(fitted.nodes)) == [n.n if n.is_leaf else 0 for n in fitted.nodes]).all()


def test_string_classes_and_tables(spark):
    rng = np.random.default_rng(2)
    names = ["high", "low", "mid"]
    y = [names[i % 3] for i in range(300)]
    x = np.array([rng.normal({"low": 0, "mid": 3, "high": 6}[c], 0.5, 5) for c in y])
    df = table(spark, x, y)
    for model in MODELS:
        fitted = model.fit(df)
        assert classifier_metrics(fitted.transform(df)).first()["accuracy"] > 0.9
        nodes, edges = T.tree_nodes(spark, fitted), T.tree_edges(spark, fitted)
        assert edges.count() == nodes.count() - 1
        rules = [r["rule"] for r in T.tree_rules(nodes).collect()]
        assert 0 < len(rules) <= 8 and all(len(r.split(" → ")) <= 3 for r in rules)
        assert "n_nodes" in T.tree_json(nodes, edges).first()["tree_structure"]
        shares = {r["feature"]: r["importance"] for r in T.tree_importance(nodes).collect()}
        for f, v in shares.items():
            assert fitted.importance[f"feature_{f}"] == pytest.approx(v)


def brute_best_gain(x, y):
    """Best Gini gain over all thresholds of all features."""
    def g(v):
        p = np.bincount(v, minlength=2) / len(v)
        return 1 - (p**2).sum()

    best = (-1.0, None, None)
    for f in range(x.shape[1]):
        values = np.unique(x[:, f])
        for t in (values[:-1] + values[1:]) / 2:
            left = x[:, f] <= t
            gain = g(y) - left.mean() * g(y[left]) - (~left).mean() * g(y[~left])
            if gain > best[0] + 1e-12:
                best = (gain, f, t)
    return best


def test_cart_root_is_the_exact_best(binary):
    x, y, df = binary
    fitted = T.CART(max_depth=1).fit(df)
    gain, feature, threshold = brute_best_gain(x, y)
    root = fitted.nodes[0]
    assert root.feature == feature and root.gain == pytest.approx(gain) and root.edges[0] == pytest.approx(threshold)


def skewed(n, seed):
    """Many distinct values, a far outlier, a heavy value, and a boundary no quantile meets."""
    rng = np.random.default_rng(seed)
    x = np.column_stack([rng.normal(size=n), rng.exponential(size=n) ** 5, np.where(rng.random(n) < 0.4, 2.0, rng.random(n) * 9)])
    x[0, :] = 1e12
    y = ((x[:, 1] > np.sort(x[:, 1])[int(n * 0.9031)]) | (rng.random(n) < 0.05)).astype(int)
    return x, y


@pytest.mark.parametrize("direct,finer", [(200_000, 256), (40, 16), (2, 4)])
@pytest.mark.parametrize("seed", [1, 2])
def test_cart_tries_every_value(spark, monkeypatch, direct, finer, seed):
    """More values than coarse edges; small limits force several rounds of narrowing."""
    monkeypatch.setattr(cuts, "DIRECT_ROWS", direct)
    monkeypatch.setattr(cuts, "FINER", finer)
    x, y = skewed(3000, seed)
    root = T.CART(max_depth=1, max_candidates=8).fit(table(spark, x, y)).nodes[0]
    gain, feature, threshold = brute_best_gain(x, y)
    assert (root.feature, root.edges[0]) == (feature, pytest.approx(threshold, rel=1e-12)) and root.gain == pytest.approx(gain, abs=1e-12)


def test_cart_levels_are_exact(spark):
    """Every inner node of a deeper tree has the best cut of its own rows, leaves of few rows kept."""
    x, y = skewed(1500, 3)
    y = y + 2 * (x[:, 0] > 0.3713)
    y[y == 3] = 2
    tree = T.CART(max_depth=3, min_samples_leaf=5, criterion="entropy", max_candidates=6).fit(table(spark, x, y))

    def rows_of(i):
        n = tree.nodes[i]
        if n.parent is None:
            return np.ones(len(x), bool)
        p = tree.nodes[n.parent]
        return rows_of(p.id) & ((x[:, p.feature] <= p.edges[0]) == (p.children[0] == i))

    for n in tree.nodes:
        own = rows_of(n.id)
        assert list(np.bincount(y[own], minlength=3)) == list(n.counts)
        if n.is_leaf:
            continue
        best = np.inf
        for f in range(3):
            for t in np.unique(x[own, f])[:-1]:
                left = x[own, f] <= t
                if 5 <= left.sum() <= len(left) - 5:
                    sides = [np.bincount(y[own][s], minlength=3) for s in (left, ~left)]
                    best = min(best, sum(s.sum() * T.impurity_of(s, "entropy")[0] for s in sides) / own.sum())
        assert n.impurity - n.gain == pytest.approx(best, abs=1e-12)


def test_oblique_tries_every_value(spark):
    """The plane's threshold is as cheap as any along its projection, far rows or not."""
    rng = np.random.default_rng(5)
    x = rng.normal(size=(2500, 2))
    y = (x[:, 0] + x[:, 1] > 0.2137).astype(int)
    x[0] = [300.0, 300.0]
    y[0] = 1
    root = Oblique(max_depth=1).fit(table(spark, x, y)).nodes[0]
    assert root.weights is not None
    v = x @ root.weights + root.intercept
    found = min(
        (left.mean() * T.impurity_of(np.bincount(y[left], minlength=2), "gini")[0] + (~left).mean() * T.impurity_of(np.bincount(y[~left], minlength=2), "gini")[0])
        for left in (v <= t for t in np.sort(v)[4:-5])
    )
    assert root.impurity - root.gain == pytest.approx(found, abs=1e-12)


def test_chaid_uses_the_strongest_feature(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(400, 5))
    y = (x[:, 4] > 0).astype(int)
    x[:, :4] += 0.3 * y[:, None]
    root = T.CHAID().fit(table(spark, x, y)).nodes[0]
    assert root.feature == 4 and root.log_p_adjusted < math.log(1e-20)


def test_stops(spark):
    pure = table(spark, np.arange(60.0)[:, None], [0] * 59 + [1])
    assert len(T.CHAID().fit(pure).nodes) == 1
    constant = table(spark, np.ones((60, 2)), [i % 2 for i in range(60)])
    for m in MODELS:
        assert len(m.fit(constant).nodes) == 1
    with pytest.raises(ValueError):
        T.ID3().fit(table(spark, np.ones((60, 2)), [1] * 60))
    with pytest.raises(ValueError):
        T.CART(criterion="other")


def test_unknown_bin_stays_at_the_last_node(spark):
    x = np.array([[i % 3 * 1.0, i % 2 * 1.0] for i in range(60)])
    y = [int(v[0] == 2) for v in x]
    fitted = T.ID3(max_depth=1).fit(table(spark, x, y))
    fitted.nodes[0].children = [c if b != 1 else -1 for b, c in enumerate(fitted.nodes[0].children)]
    out = fitted.transform(table(spark, np.array([[1.0, 0.0]]), [0])).first()
    share = fitted.nodes[0].counts / 60
    assert out["probability"] == pytest.approx(list(share))


def test_pruning(binary):
    _, _, df = binary
    full, small = T.CART(max_depth=5).fit(df), T.CART(max_depth=5, ccp_alpha=0.02).fit(df)
    assert 1 < len(small.nodes) < len(full.nodes)
    assert len(T.CART(ccp_alpha=1.0).fit(df).nodes) == 1


def test_nearest_groups():
    assert T.nearest_groups([0, 3], [0, 1], 5) == [0, 0, 1, 1, 1]


def test_edges_of_large_nodes(spark):
    rng = np.random.default_rng(8)
    x = np.column_stack([
        rng.normal(size=3000), rng.exponential(size=3000) ** 4, np.where(rng.random(3000) < 0.4, 7.0, rng.random(3000) * 9),
        rng.integers(0, 3, 3000), np.full(3000, 2.0),
    ])
    df = spark.createDataFrame([([float(v) for v in r],) for r in x], "features array<double>").repartition(5)
    place = lambda b: (b[:, 0] > 0).astype(int)
    sizes = {0: int((x[:, 0] <= 0).sum()), 1: int((x[:, 0] > 0).sum())}
    got = node_edges(df, 5, place, sizes, 10, direct=100)
    for k in sizes:
        own = x[place(x) == k]
        for f in range(5):
            assert got[k][f] == pytest.approx(cut(own[:, f], 10), rel=1e-12)


def brute_shap(x, trees):
    """Subset enumeration of the path-dependent game."""
    from itertools import combinations

    d, outputs = len(x), trees[0]["value"].shape[1]

    def value(tree, known, i=0):
        left, right = int(tree["left"][i]), int(tree["right"][i])
        if left < 0:
            return tree["value"][i]
        f = int(tree["feature"][i])
        if f in known:
            return value(tree, known, left if x[f] <= tree["threshold"][i] else right)
        a, b = tree["cover"][left], tree["cover"][right]
        return (a * value(tree, known, left) + b * value(tree, known, right)) / (a + b)

    phi = np.zeros((d, outputs))
    for f in range(d):
        rest = [j for j in range(d) if j != f]
        for size in range(d):
            w = math.factorial(size) * math.factorial(d - size - 1) / math.factorial(d)
            for s in combinations(rest, size):
                phi[f] += w * sum(value(t, {*s, f}) - value(t, set(s)) for t in trees)
    return phi


@pytest.mark.parametrize("classes", [2, 3])
@pytest.mark.parametrize("kind", ["forest", "boosting"])
def test_contributions(spark, classes, kind):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(150, 4))
    y = (x[:, 0] * x[:, 1] + x[:, 2] > 0).astype(int) + (classes - 2) * (x[:, 3] > 0.5)
    df = table(spark, x, y)
    model = RandomForest(5, 3) if kind == "forest" else BoostedTrees(4, 3)
    fitted = model.fit(df)
    trees = ensemble_tables(fitted)
    phi, base = tree_shap(x[:3], trees)
    for i in range(3):
        assert phi[i] == pytest.approx(brute_shap(x[i], trees), abs=1e-12)
    long = tree_contributions(df, fitted)
    summed = long.groupBy("row_id", "class").agg((F.sum("phi") + F.first("base")).alias("v")).toPandas()
    out = fitted.transform(df).select("row_id", "probability").toPandas().set_index("row_id")["probability"]
    for row, own in summed.groupby("row_id"):
        value = {int(c): v for c, v in zip(own["class"], own["v"])}
        if kind == "forest":
            got = [value[c] for c in range(classes)]
        elif classes == 2:
            got = [1 - 1 / (1 + math.exp(-value[1])), 1 / (1 + math.exp(-value[1]))]
        else:
            got = np.exp([value[c] for c in range(classes)])
            got = got / got.sum()
        assert list(out[row]) == pytest.approx(list(got), abs=1e-9)
    assert mean_abs_contribution(long).count() == 4 * (1 if kind == "boosting" and classes == 2 else classes)


class PlainBoosting:
    """Boosting of one table in memory, every cut tried."""

    def __init__(self, x, y, rounds, depth, rate, penalty, alpha, weight):
        k = int(y.max()) + 1
        self.margin = np.full((len(x), 1), math.log(y.mean() / (1 - y.mean()))) if k == 2 else np.zeros((len(x), k))
        self.gains = []
        shrink = lambda g: math.copysign(max(abs(g) - alpha, 0), g)
        for _ in range(rounds):
            if k == 2:
                p = 1 / (1 + np.exp(-self.margin))
                g, h = p - y[:, None], p * (1 - p)
            else:
                p = np.exp(self.margin) / np.exp(self.margin).sum(axis=1, keepdims=True)
                g, h = p - (y[:, None] == np.arange(k)), 2 * p * (1 - p)
            step = np.zeros_like(self.margin)
            for c in range(step.shape[1]):
                todo = [(np.arange(len(x)), 0)]
                while todo:
                    rows, level = todo.pop()
                    gt, ht = g[rows, c].sum(), h[rows, c].sum()
                    best = (1e-6, None, None)
                    for f in range(x.shape[1]) if level < depth else []:
                        for v in np.unique(x[rows, f])[:-1]:
                            left = x[rows, f] <= v
                            gl, hl = g[rows[left], c].sum(), h[rows[left], c].sum()
                            if hl < weight or ht - hl < weight:
                                continue
                            gain = 0.5 * (shrink(gl) ** 2 / (hl + penalty) + shrink(gt - gl) ** 2 / (ht - hl + penalty) - shrink(gt) ** 2 / (ht + penalty))
                            if gain > best[0] + 1e-12:
                                best = (gain, f, v)
                    if best[1] is None:
                        step[rows, c] = -rate * shrink(gt) / (ht + penalty)
                        continue
                    self.gains.append(best[0])
                    left = x[rows, best[1]] <= best[2]
                    todo += [(rows[left], level + 1), (rows[~left], level + 1)]
            self.margin = self.margin + step


@pytest.mark.parametrize("classes,alpha", [(2, 0.0), (3, 0.0), (3, 0.5)])
def test_boosting_equals_plain(spark, monkeypatch, classes, alpha):
    from tabulith.models import boosting

    monkeypatch.setattr(boosting, "KEEP", 2)   # margins are moved in between
    rng = np.random.default_rng(8)
    x = np.round(rng.normal(size=(160, 3)), 1)
    y = (x[:, 0] + x[:, 1] ** 2 > 0.8).astype(int) + (classes - 2) * (x[:, 2] > 0.4)
    model = BoostedTrees(n_estimators=5, max_depth=3, learning_rate=0.3, reg_lambda=0.7, reg_alpha=alpha, min_child_weight=1.5)
    fitted = model.fit(table(spark, x, y))
    plain = PlainBoosting(x, y, 5, 3, 0.3, 0.7, alpha, 1.5)
    got = {r.row_id: r["__margins"] for r in fitted.margins(table(spark, x, y)).collect()}
    assert np.array([got[i] for i in range(len(x))]) == pytest.approx(plain.margin, abs=1e-9)
    gains = [g for t in fitted.trees for f, g in zip(t.feature, t.gain) if f >= 0]
    assert sorted(gains) == pytest.approx(sorted(plain.gains), abs=1e-9)
    assert sum(fitted.importance.values()) == pytest.approx(1)


def test_boosting_samples_and_refuses(spark):
    rng = np.random.default_rng(9)
    x = rng.normal(size=(300, 6))
    y = (x[:, 0] > 0).astype(int)
    df = table(spark, x, y)
    fitted = BoostedTrees(6, 2, subsample=0.5, colsample_bytree=0.34).fit(df)
    assert all(len({f for f in t.feature if f >= 0}) <= 2 for t in fitted.trees)
    again = BoostedTrees(6, 2, subsample=0.5, colsample_bytree=0.34).fit(df)
    assert [t.feature for t in again.trees] == [t.feature for t in fitted.trees]
    assert fitted.trees[0].curvature[0] == pytest.approx(0.25 * 150, rel=0.2)
    assert fitted.transform(df).where("prediction <> label").count() <= 15
    free = BoostedTrees(1, 0, min_child_weight=0.0, reg_lambda=0.0, learning_rate=1.0).fit(df)   # depth 0: no limit
    assert free.transform(df).where("prediction <> label").count() == 0
    for bad in ({"n_estimators": 0}, {"learning_rate": 0}, {"subsample": 0}, {"reg_lambda": -1}, {"colsample_bytree": 2}):
        with pytest.raises(ValueError):
            BoostedTrees(**bad)


def test_contributions_by_cells_equal_those_by_rows(spark):
    """Looked-up results, those of trees with too many cells, and one row per input row out of Python."""
    from tabulith.models import contributions as C

    rng = np.random.default_rng(4)
    x = np.vstack([rng.normal(size=(300, 4)), [[np.inf, -np.inf, 0.0, 1.0]]])
    df = table(spark, x[:300], (x[:300, 0] > 0).astype(int) + (x[:300, 3] > 0.5))
    fitted = BoostedTrees(4, 3).fit(df)
    trees = ensemble_tables(fitted)
    want, base = tree_shap(x, trees)
    for most in (C.MOST_CELLS, 9, 0):
        kept, C.MOST_CELLS = C.MOST_CELLS, most
        try:
            tables = C.CellTables(trees, 4)
        finally:
            C.MOST_CELLS = kept
        assert tables(x) == pytest.approx(want, abs=1e-12) and tables.base == pytest.approx(base, abs=1e-12)
    plan = tree_contributions(df, fitted)._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate posexplode" in plan
