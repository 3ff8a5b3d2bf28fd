"""Trees over quantised features, and how many jobs a search takes."""

import math

import numpy as np
import pytest

from cohortlab.models import growth, stepwise, trees

# (rows a block, bytes a task): one block, many blocks in one task, a job a level.
WAYS = {"one block": (1000, 10**6), "many blocks": (100, 10**6), "in step": (100, 0)}


@pytest.fixture(scope="module")
def rows(spark):
    """480 rows with gaps, two numbers and a category; (prepared rows, maxBins)."""
    rng = np.random.default_rng(21)
    data = []
    for i in range(480):
        a, b = rng.normal(), rng.normal(3, 2)
        c = ["x", "y", "z", None][i % 4]
        p = 1 / (1 + math.exp(-(1.5 * a - 0.7 * (b - 3) + (1.0 if c == "y" else 0.0) - 1)))
        data.append((i, float(a), None if i % 7 == 0 else float(b), c, int(rng.random() < p), i % 3))
    df = spark.createDataFrame(data, "id long, a double, b double, c string, y int, fold int")
    out, bins = stepwise.quantised(df, ["a", "b"], ["c"], "y", 2.0, ["id", "fold"])
    return out.persist(), bins


def jobs(spark, name, run):
    """How many jobs ``run`` takes, and what it gives."""
    spark.sparkContext.setJobGroup(name, name)
    try:
        out = run()
        return len(spark.sparkContext.statusTracker().getJobIdsForGroup(name)), out
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_jobs_of_a_sweep_do_not_grow_with_its_rounds(spark, rows):
    data, bins = rows
    configs = tuple(trees.Boosting(f"c{i}", 12, 0.1, 8, 15 + i) for i in range(2))
    n, table = jobs(spark, "sweep", lambda: stepwise.sweep(data, configs, 99, bins, folds=3).collect())
    assert [r.n_rounds for r in table] == [12, 12]
    assert n < 40  # six series; with a fit a series and round there were more than 72


def test_jobs_over_many_blocks_do_not_grow_with_the_rounds(spark, rows):
    data, bins = rows
    series = stepwise.fold_series(trees.Boosting("own", 12, 0.1, 8, 15), 3)
    n, grown = jobs(spark, "blocks", lambda: stepwise.grow(data, series, 99, bins, *WAYS["many blocks"]))
    assert grown.stops["own"].round == 12
    assert n < 30  # with a fit a series and round there were more than 36


def test_gradient_is_the_same_in_parts(monkeypatch):
    rng = np.random.default_rng(9)
    y, m = rng.integers(0, 2, 500).astype(float), rng.normal(size=500)
    whole = growth.gradient(y, m, False)
    monkeypatch.setattr(growth, "AT_ONCE", 7)
    assert (growth.gradient(y, m, False) == whole).all()
    np.testing.assert_allclose(whole, 4 * (2 * y - 1) / (1 + np.exp(2 * (2 * y - 1) * m)), rtol=1e-12)
    assert (growth.gradient(y, m, True) == 2 * y - 1).all()


def test_a_round_over_many_blocks_is_a_job_a_level(spark, rows):
    data, bins = rows
    series = stepwise.fold_series(trees.Boosting("own", 2, 0.1, 8, 15), 3)
    n, grown = jobs(spark, "levels", lambda: stepwise.grow(data, series, 99, bins, *WAYS["in step"]))
    assert grown.stops["own"].round == 2
    assert n < 30  # a pass over the blocks is two jobs to the scheduler, and there are seven


@pytest.mark.parametrize("way", WAYS)
def test_margins_equal_sparks_own_boosting(rows, way):
    data, bins = rows
    config = trees.Boosting("own", rounds=3, learning_rate=0.3, leaves=8, min_rows=15)
    grown = stepwise.grow(data, stepwise.fold_series(config, 3), 99, bins, *WAYS[way])
    margins = {r.id: r.margin_at_best for r in grown.rows.select("id", "margin_at_best").collect()}
    best = grown.stops["own"].best
    assert grown.stops["own"].round == 3 and len(grown.history) == 9
    cut = trees.Boosting("own", rounds=best, learning_rate=0.3, leaves=8, min_rows=15)
    model = trees.fit_boosted(data.where("fold != 1"), cut, bins - 2)
    for r in model.transform(data).select("id", "rawPrediction").collect():
        assert margins[r.id][1] == pytest.approx(r.rawPrediction[1], abs=1e-9)


def test_every_way_gives_the_same_history(rows):
    data, bins = rows
    # Limits that differ: one configuration ends by its limit, the other by patience.
    configs = (trees.Boosting("short", 1, 0.3, 4, 30), trees.Boosting("long", 4, 0.5, 8, 30))
    series = [s for c in configs for s in stepwise.fold_series(c, 3)]
    found = {way: stepwise.grow(data, series, 2, bins, *of) for way, of in WAYS.items()}
    want = sorted(found["one block"].history)
    assert found["one block"].stops["short"].round == 1 and found["one block"].stops["long"].round > 2
    for way in ("many blocks", "in step"):
        assert [h[:3] for h in sorted(found[way].history)] == [h[:3] for h in want]
        assert [h[3] for h in found[way].history] == pytest.approx([h[3] for h in found["one block"].history], abs=1e-12)
        for name, stop in found["one block"].stops.items():
            assert (found[way].stops[name].best, found[way].stops[name].round) == (stop.best, stop.round)


def test_ranking_in_parts_is_exact(rows, monkeypatch):
    data, bins = rows
    series = stepwise.fold_series(trees.Boosting("own", 2, 0.3, 8, 15), 3)
    whole = stepwise.grow(data, series, 99, bins, *WAYS["in step"]).history
    monkeypatch.setattr(stepwise, "RANKED_ROWS", 20)
    assert stepwise.grow(data, series, 99, bins, *WAYS["in step"]).history == whole


def test_exp_is_that_of_sql(spark):
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.normal(0, s, 3000) for s in (1e-9, 0.1, 0.4, 1, 5, 100, 400)] + [[0.0, -0.0, 710, -746, 1e-300, math.inf, -math.inf]])
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate(x)], "i int, x double")
    want = [r.e for r in df.selectExpr("i", "exp(x) AS e").orderBy("i").collect()]
    assert growth.strict_exp(x).tolist() == want


@pytest.mark.parametrize("kinds", [(1.0, 3.7), (1.0, 3.7, 0.3)])
def test_bundles_count_as_single_features_do(kinds):
    rng = np.random.default_rng(5)
    x = np.vstack([rng.integers(0, 32, (5, 40_000)), rng.integers(0, 2, (7, 40_000))]).astype(np.uint8)
    weight, y = rng.choice(kinds, 40_000), rng.normal(size=40_000)
    part = np.flatnonzero(rng.random(40_000) < 0.7)
    want = growth.histograms(x[:, part], weight[part], y[part], np.zeros(len(part), int), [0], 32)[0]
    bundles = growth.Bundles(lambda f: x[f], 12, 32)
    got = bundles.histogram(part, growth.Weights(weight), weight * y)
    assert len(bundles.codes) < 12 and (got[3] == want[3]).all()
    np.testing.assert_allclose(got[:2], want[:2], atol=1e-8)
    tree, ends = bundles.fitted(part, growth.Weights(weight), y, 4, {}, 20)
    same = growth.fitted(np.ascontiguousarray(x[:, part]), weight[part], y[part], 4, 32, {}, 20)
    assert tree.feature.tolist() == same.feature.tolist()
    np.testing.assert_allclose(tree.value, same.value, atol=1e-9)
    leaves = np.zeros(40_000, int)
    for node, own in ends:
        leaves[own] = node
    assert (leaves[part] == same.leaves(x[:, part])).all()


def test_area_counts_ties_half_and_needs_both_classes():
    y, s = np.array([0, 1, 1, 0, 2.0]), np.array([0.1, 0.1, 0.9, 0.3, 9.0])
    assert growth.area(y, s) == (0.5 + 1 + 1) / 4
    assert growth.area(np.ones(3), s[:3]) is None and growth.area(y[:0], s[:0]) is None


def test_unfit_rows_are_refused(spark, rows):
    data, bins = rows
    series = stepwise.fold_series(trees.Boosting("own", 2, 0.3, 8, 15), 3)
    for broken in ("CAST(NULL AS DOUBLE)", "label"):
        bad = data.selectExpr("id", "fold", "features", f"{broken} AS label", "weight")
        with pytest.raises(Exception, match="NULL" if "NULL" in broken else "whole numbers"):
            stepwise.grow(bad, series, 2, bins if "NULL" in broken else 2)
    with pytest.raises(Exception, match="no row to learn from"):
        stepwise.grow(data, [stepwise.Series(series[0].config, "false", "true")], 2, bins)
