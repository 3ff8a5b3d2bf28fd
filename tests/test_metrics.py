import math

import numpy as np
import pytest
from pyspark.ml.evaluation import BinaryClassificationEvaluator

from cohortlab.operators import metrics as m, ordered


def sample(n=400, seed=1, digits=2):
    rng = np.random.default_rng(seed)
    y = (rng.random(n) < 0.3).astype(int)
    p = np.round(np.clip(rng.random(n) * 0.7 + 0.3 * y * rng.random(n), 0, 1), digits)
    p[: n // 3] = 0.4  # a third of the rows share one score
    return y, p


def frame(spark, y, p):
    rows = [(i, int(a), float(b)) for i, (a, b) in enumerate(zip(y, p))]
    return spark.createDataFrame(rows, "id long, y_true int, p double")


def curve(y, p):
    """Counts at or above each distinct score, from the highest down."""
    levels = sorted(set(p.tolist()), reverse=True)
    return [(t, int(y[p >= t].sum()), int((1 - y)[p >= t].sum())) for t in levels]


def thinned(y, p):
    c = curve(y, p)
    steps = np.diff(np.array([(0, 0)] + [(a, b) for _, a, b in c]), axis=0)
    keep = [i for i in range(len(c)) if i in (0, len(c) - 1) or (steps[i] != steps[i + 1]).any()]
    pos, neg = y.sum(), (1 - y).sum()
    return [(math.inf, 0.0, 0.0)] + [(c[i][0], c[i][2] / neg, c[i][1] / pos) for i in keep]


@pytest.fixture(scope="module", params=[(400, 2), (1500, 6)])
def sampled(request, spark):
    n, digits = request.param
    y, p = sample(n, digits=digits)
    return y, p, frame(spark, y, p).persist()


@pytest.fixture(params=["one bucket", "buckets"])
def data(request, sampled, monkeypatch):
    """The same rows through one bucket and through many."""
    if request.param == "buckets":
        monkeypatch.setattr(ordered, "ONE_BUCKET", 0)
    return sampled


def test_auc_and_average_precision(data):
    y, p, df = data
    r = m.ranking_quality(df).first()
    pairs = [(a > b) + 0.5 * (a == b) for a in p[y == 1] for b in p[y == 0]]
    assert r.roc_auc == pytest.approx(np.mean(pairs), abs=1e-12)
    last, ap = 0.0, 0.0
    for _, tp, fp in curve(y, p):
        recall = tp / y.sum()
        ap += (recall - last) * tp / (tp + fp)
        last = recall
    assert r.average_precision == pytest.approx(ap, abs=1e-12)
    assert (r.n, r.n_pos) == (len(y), y.sum())


def test_auc_equals_the_stock_evaluator(data):
    _, _, df = data
    stock = BinaryClassificationEvaluator(rawPredictionCol="p", labelCol="label", numBins=0)
    other = stock.evaluate(df.selectExpr("p", "cast(y_true AS double) AS label"))
    assert m.ranking_quality(df).first().roc_auc == pytest.approx(other, abs=1e-9)


def test_roc_points_are_thinned(data):
    y, p, df = data
    got = sorted(((r.threshold, r.fpr, r.tpr) for r in m.roc_points(df).collect()), reverse=True)
    assert np.allclose(got, thinned(y, p), atol=1e-12)
    assert m.roc_points(df, thin=False).count() == len(set(p.tolist())) + 1


def test_pr_points(data):
    y, p, df = data
    got = {r.threshold: (r.precision, r.recall) for r in m.pr_points(df).collect()}
    assert got.pop(None) == (1.0, 0.0)
    assert got == {t: pytest.approx((tp / (tp + fp), tp / y.sum())) for t, tp, fp in curve(y, p)}


def test_calibration(data):
    y, p, df = data
    edges = np.percentile(p, np.linspace(0, 100, 11))
    bins = np.searchsorted(edges[1:-1], p)
    want = {b: (int((bins == b).sum()), p[bins == b].mean(), y[bins == b].mean()) for b in set(bins.tolist())}
    got = {r.bin: (r.n, r.prob_pred, r.prob_true) for r in m.calibration(df).collect()}
    assert got.keys() == want.keys()
    for b in want:
        assert got[b] == pytest.approx(want[b])


def test_thresholds(data):
    y, p, df = data
    roc = thinned(y, p)
    j = [t - f for _, f, t in roc]
    near = [abs(t - 0.8) for _, _, t in roc]
    grid = np.linspace(0.01, 0.99, 100)
    f1 = []
    for t in grid:
        hit = p >= t
        tp, fp, fn = (hit & (y == 1)).sum(), (hit & (y == 0)).sum(), (~hit & (y == 1)).sum()
        f1.append(2 * tp / (2 * tp + fp + fn) if tp + fp + fn else 0.0)
    want = {
        "Youden's J": roc[int(np.argmax(j))][0],
        "80% sensitivity": roc[int(np.argmin(near))][0],
        "Max F1": grid[int(np.argmax(f1))],
    }
    table = {r.strategy: r for r in m.threshold_table(df).collect()}
    assert {s: r.threshold for s, r in table.items()} == pytest.approx(want)
    for s, t in want.items():
        hit = p >= t
        tp, fp, fn, tn = ((hit & (y == 1)).sum(), (hit & (y == 0)).sum(),
                          (~hit & (y == 1)).sum(), (~hit & (y == 0)).sum())
        assert table[s].sensitivity == pytest.approx(tp / (tp + fn))
        assert table[s].specificity == pytest.approx(tn / (tn + fp))
    best = m.youden(df).first()
    assert best.threshold == want["Youden's J"]
    assert m.max_f1(df).first().threshold == pytest.approx(want["Max F1"])


def test_grid_matches_numpy():
    assert m.threshold_grid() == np.linspace(0.01, 0.99, 100).tolist()


def test_grid_counts_cover_all_rows(data):
    y, p, df = data
    for r in m.grid_counts(df, [0.1, 0.4, 0.9]).collect():
        hit = p >= r.threshold
        assert (r.tp, r.fp) == ((hit & (y == 1)).sum(), (hit & (y == 0)).sum())
        assert r.tn + r.fp + r.fn + r.tp == len(y)


@pytest.mark.parametrize("label", [0, 1])
def test_one_class_has_no_quality(spark, label):
    df = frame(spark, [label] * 3, [0.1, 0.2, 0.2])
    r = m.ranking_quality(df).first()
    assert r.roc_auc is None and r.average_precision is None


def test_all_scores_equal(spark):
    df = frame(spark, [0, 1, 1, 0], [0.5] * 4)
    assert m.ranking_quality(df).first().roc_auc == 0.5
    assert m.roc_points(df).count() == 2
    assert [(r.bin, r.n) for r in m.calibration(df).collect()] == [(0, 4)]


def test_classification_report(spark):
    counts = spark.createDataFrame([(50, 10, 5, 35)], "tn long, fp long, fn long, tp long")
    rows = {r.label: r for r in m.classification_report(counts).collect()}
    assert rows["dead"].precision == pytest.approx(35 / 45) and rows["dead"].recall == pytest.approx(35 / 40)
    assert rows["alive"].f1 == pytest.approx(100 / 115)
    assert rows["accuracy"].f1 == pytest.approx(0.85) and rows["macro avg"].support == 100
    assert rows["weighted avg"].recall == pytest.approx(0.85)


def test_report_with_an_empty_prediction_class(spark):
    counts = spark.createDataFrame([(3, 0, 2, 0)], "tn long, fp long, fn long, tp long")
    rows = {r.label: r for r in m.classification_report(counts).collect()}
    assert (rows["dead"].precision, rows["dead"].recall, rows["dead"].f1) == (0.0, 0.0, 0.0)


# --- rows that can't be judged ---

def gapped(spark):
    nan = float("nan")
    rows = [(1, 0.9, "a"), (0, 0.1, "a"), (1, None, "a"), (0, nan, "b"), (None, 0.5, "a"), (2, 0.5, "a"), (1, 0.7, None),
            (None, None, "b"), (0, 0.8, "a"), (1, 0.3, "b"), (0, 0.3, "b")]
    return spark.createDataFrame(rows, "y_true int, p double, g string")


def test_rows_without_score_or_label_are_refused_and_counted(spark):
    table = m.score_table(gapped(spark), by=["g"])
    assert table.refused == {"null_score": 2, "nan_score": 1, "null_label": 1, "other_label": 1, "null_group": 1, "taken": 5}
    got = {r.g: (r.n, r.n_pos, r.roc_auc) for r in m.ranking_quality(table, by=["g"]).collect()}
    assert got == {"a": (3, 1, 1.0), "b": (2, 1, 0.5)}


def test_every_metric_refuses_the_same_rows(spark):
    df = gapped(spark)
    clean = df.where("p IS NOT NULL AND NOT isnan(p) AND y_true IN (0, 1)")
    for f in (m.ranking_quality, m.roc_points, m.pr_points, m.calibration, m.youden, m.max_f1, m.thresholds, m.threshold_table,
              lambda d: m.grid_counts(d, [0.2, 0.5])):
        assert sorted(map(tuple, f(df).collect()), key=str) == sorted(map(tuple, f(clean).collect()), key=str)


def test_scored_rows_are_read_once(spark):
    """Three strategies, their confusion and their rates from one pass over the rows."""
    seen = spark.sparkContext.accumulator(0)

    def watch(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    y, p = sample(300)
    df = frame(spark, y, p)
    m.threshold_table(df.mapInArrow(watch, df.schema)).collect()
    assert seen.value == 300


def test_parts_add_up_to_the_whole(spark):
    y, p = sample(300)
    df = frame(spark, y, p)
    parts = [m.score_counts(df.where(f"id % 2 = {i}")) for i in (0, 1)]
    added = parts[0].union(parts[1]).groupBy("threshold").sum("tp", "fp").collect()
    assert sorted(map(tuple, added)) == sorted(map(tuple, m.score_counts(df).drop("refused").collect()))


def test_no_rows_give_no_quality(spark):
    r = m.ranking_quality(frame(spark, [], []).where("true")).first()
    assert (r.n, r.roc_auc) == (0, None)
