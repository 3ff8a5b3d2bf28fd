"""Boosting in step: against Spark's own boosting, and where it stops."""

import math

import numpy as np
import pytest
from pyspark.ml.functions import vector_to_array

from cohortlab.models import stepwise, trees
from cohortlab.operators.metrics import ranking_quality

KEEP = ["id", "y", "fold", "split", "is_validation"]


@pytest.fixture(scope="module")
def rows(spark):
    """600 rows with gaps and a category; (prepared rows, maxBins)."""
    rng = np.random.default_rng(8)
    data = []
    for i in range(600):
        a, b = rng.normal(), rng.normal(3, 2)
        c = ["x", "y", "z", None][i % 4]
        p = 1 / (1 + math.exp(-(1.5 * a - 0.7 * (b - 3) + (1.0 if c == "y" else 0.0) - 1)))
        data.append((i, float(a), None if i % 7 == 0 else float(b), 4.0, c, int(rng.random() < p), i % 3 if i < 480 else None,
                     "train" if i < 480 else "test", i < 480 and i % 5 == 0))
    df = spark.createDataFrame(data, "id long, a double, b double, same double, c string, y int, fold int, split string, is_validation boolean")
    out, bins = stepwise.quantised(df, ["a", "b", "same"], ["c"], "y", 2.0, KEEP)
    return out.persist(), bins


def test_bins_follow_the_quantiles(rows):
    got = rows[0].select("id", vector_to_array("features").alias("x")).collect()
    first = [r.x[0] for r in got]
    counts = np.bincount(np.array(first, int))
    assert counts[0] == 0 and len(counts) == 32 and counts[1:].max() <= 2 * 600 / 31
    assert {r.x[1] == 0 for r in got if r.id % 7 == 0} == {True}  # missing
    assert not any(r.x[1] == 0 for r in got if r.id % 7)
    assert len({r.x[3] for r in got}) == 4 and len({r.x[2] for r in got}) == 1


def test_margins_equal_sparks_own_boosting(rows):
    data, bins = rows
    config = trees.Boosting("own", rounds=5, learning_rate=0.3, leaves=8, min_rows=15)
    series = stepwise.fold_series(config, 3)
    grown = stepwise.grow(data.where("fold IS NOT NULL"), series, patience=99, max_bins=bins)
    margins = {r.id: r.margin_at_best for r in grown.rows.select("id", "margin_at_best").collect()}
    best = grown.stops["own"].best
    assert 1 <= best <= 5 and grown.stops["own"].round == 5
    for i in range(3):
        cut = trees.Boosting("own", rounds=best, learning_rate=0.3, leaves=8, min_rows=15)
        model = trees.fit_boosted(data.where(f"fold != {i}"), cut, bins - 2)
        for r in model.transform(data.where("fold IS NOT NULL")).select("id", "rawPrediction").collect():
            assert margins[r.id][i] == pytest.approx(r.rawPrediction[1], abs=1e-9)


def test_rounds_end_by_patience_and_are_judged_on_held_rows(rows):
    data, bins = rows
    config = trees.Boosting("stop", rounds=400, learning_rate=0.5, leaves=8, min_rows=15)
    series = stepwise.fold_series(config, 3)
    grown = stepwise.grow(data.where("fold IS NOT NULL"), series, patience=4, max_bins=bins)
    stop = grown.stops["stop"]
    assert stop.round == stop.best + 4 < 400
    means = [np.mean([a for _, _, n, a in grown.history if n == at]) for at in range(1, stop.round + 1)]
    assert len(grown.history) == 3 * stop.round
    assert int(np.argmax(means)) + 1 == stop.best and stop.mean == pytest.approx(max(means))
    for i in range(3):
        held = grown.rows.where(f"fold = {i}").selectExpr("label AS y_true", f"margin_at_best[{i}] AS p")
        want = next(a for _, s, n, a in grown.history if (s, n) == (i, stop.best))
        assert ranking_quality(held).first().roc_auc == pytest.approx(want, abs=1e-12)


def test_sweep_stops_each_configuration_by_itself(rows):
    data, bins = rows
    configs = (trees.Boosting("fast", 300, 0.5, 8, 15), trees.Boosting("short", 2, 0.1, 4, 15))
    table = {r.config: r for r in stepwise.sweep(data.where("split = 'train'"), configs, 3, bins, folds=3).collect()}
    assert table["short"].n_rounds == 2 and table["fast"].n_rounds == table["fast"].n_trees + 3
    assert sum(r.is_best for r in table.values()) == 1
    best = max(table.values(), key=lambda r: r.auc_mean)
    assert best.is_best
    alone = stepwise.sweep(data.where("split = 'train'"), configs[:1], 3, bins, folds=3).first()
    assert (alone.n_trees, alone.auc_mean) == (table["fast"].n_trees, table["fast"].auc_mean)


def test_early_stop_scores_the_test_rows_with_the_stopped_model(rows):
    data, bins = rows
    config = trees.Boosting("early", 300, 0.4, 8, 15)
    r = stepwise.early_stopped(data, config, 3, bins).first()
    assert r.n_rounds == r.n_trees + 3 and r.n_test == 120
    cut = trees.Boosting("early", r.n_trees, 0.4, 8, 15)
    model = trees.fit_boosted(data.where("split = 'train' AND NOT is_validation"), cut, bins - 2)

    def auc(part):
        return ranking_quality(trees.score_boosted(model, data.where(part), [])).first()

    assert r.validation_roc_auc == pytest.approx(auc("is_validation").roc_auc, abs=1e-12)
    assert (r.roc_auc, r.pr_auc) == pytest.approx((auc("split = 'test'").roc_auc, auc("split = 'test'").average_precision), abs=1e-12)


def test_stop_takes_the_first_of_equal_rounds():
    stop = stepwise.Stop(limit=10, patience=3)
    assert [stop.see([x]) for x in (0.5, 0.7, 0.7, 0.6)] == [True, True, False, False]
    assert not stop.over and not stop.see([0.7]) and stop.over and stop.best == 2
    with pytest.raises(ValueError):
        stop.see([])


@pytest.mark.parametrize("means, patience, want", [
    ([0.5, 0.7, 0.6, 0.6, 0.9], 3, (5, 5)),
    ([0.5, 0.7, 0.6, 0.6, 0.9], 2, (2, 4)),
    ([0.7, 0.7, 0.7], 5, (1, 3)),
    ([0.1, 0.2, 0.3], 1, (3, 3)),
])
def test_picked_round(spark, means, patience, want):
    rows = [(f, i + 1, m + (0.1 if f else -0.1)) for i, m in enumerate(means) for f in (0, 1)] + [(2, 1, None)]
    r = stepwise.picked(spark.createDataFrame(rows, "series int, round int, roc_auc double"), len(means), patience).first()
    assert (r.n_trees, r.n_rounds) == want
    assert r.auc_mean == pytest.approx(means[want[0] - 1]) and r.auc_std == pytest.approx(0.1)
