import itertools
import math
import time

import numpy as np
import pytest
from pyspark.ml.functions import vector_to_array

from cohortlab.functions import contract as k
from cohortlab.models import attribution as at, generalise, linear, prepare, split, trees


@pytest.fixture(scope="module")
def toy(spark):
    """Two informative numbers, one with gaps, a category, and a rare outcome."""
    rng = np.random.default_rng(5)
    rows = []
    for i in range(600):
        a, b = rng.normal(), rng.normal(3, 2)
        c = ["x", "y", "z", None][i % 4]
        p = 1 / (1 + math.exp(-(1.5 * a - 0.7 * (b - 3) + (1.0 if c == "y" else 0.0) - 1)))
        rows.append((i, float(a), None if i % 7 == 0 else float(b), 4.0, c, int(rng.random() < p)))
    return spark.createDataFrame(rows, "id long, a double, b double, same double, c string, y int").persist()


def test_split_shares_and_nesting(spark):
    df = spark.range(1003).selectExpr("id", "cast(id % 10 = 0 AS int) AS y")
    rows = split.study_split(df, "y", "id").collect()
    for y in (0, 1):
        n = sum(r.y == y for r in rows)
        test = sum(r.y == y and r.split == "test" for r in rows)
        inner = sum(r.y == y and r.is_validation for r in rows)
        assert test == math.floor(0.2 * n + 0.5)
        assert inner == math.floor(0.2 * (n - test) + 0.5)
        folds = [sum(r.y == y and r.fold == f for r in rows) for f in range(5)]
        assert sum(folds) == n - test and max(folds) - min(folds) <= 1
    assert all((r.fold is None) == (r.split == "test") for r in rows)
    assert not any(r.is_validation and r.split == "test" for r in rows)


def test_splits_keep_rows_without_a_label_or_key(spark):
    df = spark.range(40).selectExpr("CASE WHEN id = 7 THEN NULL ELSE id END AS id", "CASE WHEN id % 4 = 0 THEN NULL ELSE cast(id % 2 AS int) END AS y")
    rows = split.study_split(df, "y", "id").collect()
    assert len(rows) == 40 and sum(r.y is None for r in rows) == 10
    for y in (None, 0, 1):
        n = sum(r.y == y for r in rows)
        assert sum(r.y == y and r.split == "test" for r in rows) == math.floor(0.2 * n + 0.5)


def test_scaling_uses_true_median_and_population_spread(spark):
    df = spark.createDataFrame([(1.0, None), (2.0, None), (3.0, None), (4.0, None), (None, None)], "a double, e double")
    s = prepare.fit_scaling(df, ["a", "e"])
    filled = np.array([1, 2, 3, 4, 2.5])
    assert (s.median["a"], s.n_rows) == (2.5, 5)
    assert s.mean["a"] == pytest.approx(filled.mean()) and s.std["a"] == pytest.approx(filled.std())
    z = [(r.z_a, r.z_e) for r in s.stage().transform(df).collect()]
    assert np.allclose([a for a, _ in z], (filled - filled.mean()) / filled.std())
    assert {e for _, e in z} == {0.0}


def test_logistic_equals_newton_on_the_summed_loss(toy):
    columns = ["a", "b", "same"]
    model = linear.fit_logistic(toy, columns, "y")
    weights, intercept = linear.coefficients(model, columns)
    rows = model.transform(toy).select("features", "y").collect()
    x = np.column_stack([np.ones(len(rows)), np.array([r.features.toArray() for r in rows])])
    y = np.array([r.y for r in rows], dtype=float)
    w, ridge = np.zeros(4), np.diag([0.0, 1.0, 1.0, 1.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-x @ w))
        w -= np.linalg.solve((x.T * (p * (1 - p))) @ x + ridge, x.T @ (p - y) + ridge @ w)
    assert intercept == pytest.approx(w[0], abs=1e-4)
    assert [weights[c] for c in columns] == pytest.approx(w[1:], abs=1e-4)


def test_reasons_add_up_and_are_sorted(toy):
    s = prepare.fit_scaling(toy, ["a", "b", "same"])
    weights = {"a": 0.5, "b": -0.2, "same": 3.0}
    parts = {}
    for r in linear.contributions(toy, "id", s, weights).collect():
        parts.setdefault(r.id, {})[r.feature] = r.contribution
    for r in linear.scored_with_reasons(toy, "id", s, weights, -1.0, top=2).collect():
        total = -1.0 + sum(parts[r.id].values())
        assert r.p == pytest.approx(1 / (1 + math.exp(-total)))
        want = sorted(parts[r.id].items(), key=lambda kv: (-abs(kv[1]), kv[0]))[:2]
        assert [x.feature for x in r.reasons] == [f for f, _ in want]
        assert r.risk == ("Low risk" if r.p < 0.1 else "Moderate risk" if r.p < 0.25 else "High risk")


@pytest.fixture(scope="module")
def boosted(toy):
    preparation = trees.tree_preparation(toy, ["a", "b", "same"], ["c"])
    rows = trees.prepared(preparation, toy, "y", trees.positive_weight(toy, "y"), ["id", "y", "c"]).persist()
    config = trees.Boosting("small", rounds=6, learning_rate=0.3, leaves=8, min_rows=15)
    return trees.fit_boosted(rows, config, trees.category_count(toy, ["c"])), rows


def test_missing_category_has_its_own_index(boosted):
    _, rows = boosted
    index = {r.c: r.x[3] for r in rows.select("c", vector_to_array("features").alias("x")).collect()}
    assert len(set(index.values())) == 4


def test_attributions_add_up_to_the_log_odds(boosted):
    model, rows = boosted
    leaves = at.leaves_of(model)
    names = ["a", "b", "same", "c"]
    sums = {}
    for r in at.attributions(model, rows, "id", names, leaves).collect():
        sums[r.id] = sums.get(r.id, 0.0) + r.phi
    for r in model.transform(rows).select("id", "probability").collect():
        p = r.probability[1]
        assert at.base_value(leaves) + sums[r.id] == pytest.approx(math.log(p / (1 - p)), abs=1e-9)


def test_attributions_equal_the_shapley_definition(boosted):
    """Brute force: walk every tree for every coalition of features."""
    model, rows = boosted
    nodes = {t: g.set_index("id").to_dict("index") for t, g in trees.node_table(model).groupby("tree")}

    def worth(x, known):
        def walk(tree, at_id):
            n = tree[at_id]
            if n["left"] < 0:
                return n["prediction"]
            f = n["feature"]
            if f in known:
                left = x[f] in n["cut"] if n["categories"] >= 0 else x[f] <= n["cut"][0]
                return walk(tree, n["left"] if left else n["right"])
            return sum(tree[c]["cover"] / n["cover"] * walk(tree, c) for c in (n["left"], n["right"]))
        return 2 * sum(w * walk(nodes[t], 0) for t, w in enumerate(model.treeWeights))

    leaves = at.leaves_of(model)
    for r in rows.limit(8).select(vector_to_array("features").alias("x")).collect():
        x = np.array(r.x)
        phi = at.attribute(x[None, :], leaves)[0]
        for j in range(4):
            others = [i for i in range(4) if i != j]
            want = sum(
                math.factorial(n) * math.factorial(3 - n) / math.factorial(4) * (worth(x, {*s, j}) - worth(x, set(s)))
                for n in range(4) for s in itertools.combinations(others, n)
            )
            assert phi[j] == pytest.approx(want, abs=1e-9)


def test_a_leaf_ten_features_deep_equals_the_definition():
    rng = np.random.default_rng(4)
    m = 10
    leaf = at.Leaf(list(range(m)), [[("le", (0.0,), True)]] * m, rng.random(m) * (rng.random(m) > 0.2), 0.7)
    met = (rng.random((5, m)) < 0.6).astype(float)
    got = at.leaf_shapley(leaf, met)
    for row, phi in zip(met, got):
        for j in range(m):
            others = [i for i in range(m) if i != j]
            want = 0.0
            for n in range(m):
                w = math.factorial(n) * math.factorial(m - n - 1) / math.factorial(m)
                for s in itertools.combinations(others, n):
                    out = [i for i in others if i not in s]
                    want += w * leaf.value * math.prod(row[list(s)]) * math.prod(leaf.shares[out]) * (row[j] - leaf.shares[j])
            assert phi[j] == pytest.approx(want, abs=1e-12)


def test_deep_trees_add_up_in_seconds():
    """A full tree of depth 10 over ten features: 1,024 leaves, 2,000 rows."""
    nodes, rng = [], np.random.default_rng(6)

    def grow(depth, cover):
        at_id = len(nodes)
        nodes.append(None)
        if depth == 10:
            nodes[at_id] = (0, at_id, rng.normal(), cover, -1, -1, -1, [], -1)
            return at_id
        share = 0.2 + 0.6 * rng.random()
        left, right = grow(depth + 1, cover * share), grow(depth + 1, cover * (1 - share))
        nodes[at_id] = (0, at_id, 0.0, cover, left, right, depth, [float(rng.normal())], -1)
        return at_id

    grow(0, 1e6)
    import pandas as pd

    table = pd.DataFrame(nodes, columns=["tree", "id", "prediction", "cover", "left", "right", "feature", "cut", "categories"])
    leaves = at.leaves_from(table, [1.0])
    assert len(leaves) == 1024 and max(len(x.features) for x in leaves) == 10
    x = rng.normal(size=(2000, 10))
    start = time.perf_counter()
    phi = at.attribute(x, leaves)
    assert time.perf_counter() - start < 30
    by_id = table.set_index("id").to_dict("index")
    for row, got in zip(x[:50], phi):
        n = by_id[0]
        while n["left"] >= 0:
            n = by_id[n["left"] if row[n["feature"]] <= n["cut"][0] else n["right"]]
        assert at.base_value(leaves) + got.sum() == pytest.approx(2 * n["prediction"], abs=1e-9)


def test_importance_and_extremes(spark):
    phi = spark.createDataFrame(
        [(1, "a", 2.0), (1, "b", -3.0), (2, "a", 0.5), (2, "b", 0.0), (3, "a", 1.0), (3, "b", 1.0)],
        "id long, feature string, phi double")
    got = [tuple(r) for r in at.importance(phi).collect()]
    assert got == [("b", pytest.approx(4 / 3)), ("a", pytest.approx(3.5 / 3))]
    assert at.mean_attribution(phi).first().mean_phi == pytest.approx(1.5 / 6)
    scored = spark.createDataFrame([(1, 1.0, 0.9), (2, 0.0, 0.1), (3, 0.0, 0.9)], "id long, y_true double, p double")
    rows = at.extreme_reasons(phi, scored, "id", -1.0, top=1).collect()
    assert {(r.side, r.id, r.feature) for r in rows} == {("highest", 1, "b"), ("lowest", 2, "a")}


def test_leave_one_group_out(spark):
    rows = [("b", 1), ("b", 0), ("b", 0), ("a", 0), ("a", 0), ("c", 1), ("c", 0), (None, 1)]
    df = spark.createDataFrame(rows, "g string, y int").selectExpr("*", "cast(y AS double) AS score")
    seen = []

    def fit_and_score(train, test):
        seen.append((train.where("g IS NULL").count(), test.select("g").distinct().count()))
        return test.selectExpr("cast(y AS double) AS y_true", "score AS p")

    out = generalise.leave_one_group_out(df, "g", "y", fit_and_score).collect()
    got = [(r.held_out_category, r.n_train, r.n_train_deaths, r.n_test, r.n_test_deaths,
            r.test_mortality, r.test_roc_auc) for r in out]
    assert got == [
        ("a", 5, 2, 2, 0, "0.00%", None),
        ("b", 4, 1, 3, 1, "33.33%", 1.0),
        ("c", 5, 1, 2, 1, "50.00%", 1.0),
    ]
    assert seen == [(0, 1)] * 3
    frame = spark.createDataFrame(out)
    s = generalise.summary(frame, 0.9).first()
    assert (s.mean_roc_auc, s.std_roc_auc, s.n_categories, s.gap_points) == (1.0, 0.0, 2, -10.0)
    assert generalise.presentation(frame).columns[0] == "Held-out category"


def test_many_groups_and_a_walk_that_starts_again(spark, tmp_path):
    """More groups than any ceiling; groups done before are not done again."""
    df = spark.range(260).selectExpr("concat('it''s ', id % 130) AS g", "cast(id < 130 AS int) AS y")
    done, fail = [], {"it's 7"}

    def fit_and_score(train, test):
        held = test.first().g
        if held in fail:
            raise RuntimeError(held)
        done.append(held)
        return test.selectExpr("cast(y AS double) AS y_true", "cast(y AS double) AS p")

    folder = f"{tmp_path}/walk"
    with pytest.raises(RuntimeError):
        generalise.leave_one_group_out(df, "g", "y", fit_and_score, folder=folder)
    fail.clear()
    rows = generalise.leave_one_group_out(df, "g", "y", fit_and_score, folder=folder).collect()
    assert len(rows) == 130 and {r.test_roc_auc for r in rows} == {1.0} and {r.n_train for r in rows} == {258}
    assert sorted(done) == sorted(set(done)) and len(done) == 130


def test_sweep_settings():
    assert [(c.name, c.depth) for c in trees.SWEEP] == [
        ("default", 5), ("smaller_trees", 4), ("tiny_trees", 3), ("slow_learning", 4)]
    assert (trees.FINAL.rounds, trees.FINAL.depth, trees.FINAL.min_rows) == (56, 4, 30)
    assert set(k.DEMO_FEATURES) <= set(k.NUMERIC_FEATURES)
