"""Evaluation of scored rows: curves, areas, thresholds, calibration.

Everything starts from a written table of one row per distinct score with its positives
and negatives, so tied scores move together, as the definitions ask, and the scored rows
are read once however many metrics follow.

One rule holds for all of them: a row whose score is NULL or NaN, whose label is not 0 or
1, or whose group is NULL is refused and counted, and enters no metric.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame, functions as F

from cohortlab.functions.columns import exprs, lines, number, quoted, ratio_or_zero
from cohortlab.operators.ordered import bits_for, exact_quantiles, running_totals
from cohortlab.session import Written

# The candidate grid for the F1 sweep and the sensitivity target.
F1_GRID_START, F1_GRID_STOP, F1_GRID_SIZE = 0.01, 0.99, 100
TARGET_SENSITIVITY = 0.80
STRATEGIES = ("Youden's J", "80% sensitivity", "Max F1")


#: Why a scored row is refused; the first that holds counts. A refused row enters no metric.
REFUSALS = {
    "null_score": "_p IS NULL",
    "nan_score": "isnan(_p)",
    "null_label": "_y IS NULL",
    "other_label": "_y NOT IN (0, 1)",
    "null_group": "_g",
}


@dataclass(frozen=True)
class ScoreTable:
    """What every metric derives from: one row per group and distinct score, with the true
    (tp) and false (fp) positives it adds, and one row per reason for the rows refused.
    Tables of parts add up to that of the whole."""

    written: Written
    by: tuple[str, ...] = ()

    @property
    def counts(self) -> DataFrame:
        return self.written.rows.where("refused IS NULL").drop("refused")

    @property
    def refused(self) -> dict[str, int]:
        """Rows refused by reason, and rows taken: counted in the pass that wrote the table."""
        found = self.written.rows.groupBy(F.expr("coalesce(refused, 'taken') AS reason")).agg(F.expr("sum(tp + fp) AS n"))
        return dict.fromkeys([*REFUSALS, "taken"], 0) | {r["reason"]: r["n"] for r in found.collect()}

    def drop(self) -> None:
        """Removes the written table; nothing that reads it may run afterwards."""
        self.written.drop()


def score_counts(scored: DataFrame, label: str = "y_true", score: str = "p", by: Sequence[str] = ()) -> DataFrame:
    """(by, threshold, refused, tp, fp): one row per group and distinct score, and one per
    reason (without group and score, in fp) for the rows that have no score, no label of 0
    or 1, or no group.

    The refused are counted as rows of this aggregate, not by ``DataFrame.observe``: a
    session that has observed once can't run freshly fitted logistic models any more,
    whose summaries take the session into their closures.
    """
    group = " OR ".join(f"{c} IS NULL" for c in by) or "false"
    reason = "CASE " + " ".join(f"WHEN {test} THEN {quoted(name)}" for name, test in REFUSALS.items()) + " END"
    rows = scored.selectExpr(*by, f"cast({score} AS double) AS _p", f"cast({label} AS double) AS _y", f"({group}) AS _g")
    rows = rows.selectExpr("*", f"{reason} AS refused").selectExpr(
        *[f"CASE WHEN refused IS NULL THEN {c} END AS {c}" for c in by],
        "CASE WHEN refused IS NULL THEN _p END AS threshold", "refused",
        "CASE WHEN refused IS NULL THEN cast(_y AS bigint) ELSE 0L END AS _y",
    )
    return rows.groupBy(*by, "threshold", "refused").agg(*exprs(["sum(_y) AS tp", "sum(1 - _y) AS fp"]))


def score_table(scored: DataFrame | ScoreTable, label: str = "y_true", score: str = "p", by: Sequence[str] = ()) -> ScoreTable:
    """The written table of score counts: the one pass over the scored rows."""
    if isinstance(scored, ScoreTable):
        if tuple(by) != scored.by:
            raise ValueError(f"the table is by {scored.by}, not by {tuple(by)}")
        return scored
    return ScoreTable(Written.of(score_counts(scored, label, score, by), "score-counts"), tuple(by))


def cumulative_counts(
    scored: DataFrame | ScoreTable, label: str = "y_true", score: str = "p", by: Sequence[str] = ()
) -> DataFrame:
    """Score counts with running and overall totals from the highest score down."""
    counts = score_table(scored, label, score, by).counts
    return running_totals(counts, "threshold", ["tp", "fp"], by=by, bits=bits_for(counts))


def ranking_quality(
    scored: DataFrame | ScoreTable, label: str = "y_true", score: str = "p", by: Sequence[str] = ()
) -> DataFrame:
    """ROC-AUC (ties count half) and average precision, per ``by`` group.

    Average precision is the step sum over scores of recall gained times
    precision. Both are NULL when only one class is present.
    """
    sums = cumulative_counts(scored, label, score, by).groupBy(*by).agg(*exprs([
        "sum(fp * (cum_tp - tp + tp / 2)) AS _pairs",
        "sum(tp * cum_tp / (cum_tp + cum_fp)) AS _steps",
        "coalesce(sum(tp), 0) AS n_pos",
        "coalesce(sum(fp), 0) AS n_neg",
    ]))
    both = "n_pos > 0 AND n_neg > 0"
    return sums.selectExpr(
        *by,
        "n_pos + n_neg AS n",
        "n_pos",
        f"CASE WHEN {both} THEN _pairs / (cast(n_pos AS double) * n_neg) END AS roc_auc",
        f"CASE WHEN {both} THEN _steps / n_pos END AS average_precision",
    )


def roc_points(scored: DataFrame | ScoreTable, label: str = "y_true", score: str = "p", thin: bool = True) -> DataFrame:
    """(threshold, fpr, tpr), with the (inf, 0, 0) start point.

    ``thin`` drops inner points on a straight run: those whose counts equal the
    counts of the next lower score. First and last scores always stay.
    """
    c = cumulative_counts(scored, label, score)
    if thin:
        first = "(cum_tp = tp AND cum_fp = fp)"
        c = c.where(f"{first} OR next_tp IS NULL OR next_tp != tp OR next_fp != fp")
    points = c.selectExpr(
        "threshold",
        "try_divide(cum_fp, total_fp) AS fpr",
        "try_divide(cum_tp, total_tp) AS tpr",
    )
    start = c.sparkSession.range(1).selectExpr(
        "double('Infinity') AS threshold", "0.0D AS fpr", "0.0D AS tpr"
    )
    return points.unionByName(start)


def pr_points(scored: DataFrame | ScoreTable, label: str = "y_true", score: str = "p") -> DataFrame:
    """(threshold, precision, recall, prevalence), plus the (recall 0, precision 1) end point."""
    table = score_table(scored, label, score)
    points = cumulative_counts(table).selectExpr(
        "threshold",
        "cum_tp / (cum_tp + cum_fp) AS precision",
        "try_divide(cum_tp, total_tp) AS recall",
        "total_tp / (total_tp + total_fp) AS prevalence",
    )
    end = table.counts.agg(F.expr("sum(tp) / sum(tp + fp) AS prevalence")).selectExpr(
        "cast(NULL AS double) AS threshold", "1.0D AS precision", "0.0D AS recall", "prevalence"
    )
    return points.unionByName(end)


def calibration(scored: DataFrame | ScoreTable, label: str = "y_true", score: str = "p", bins: int = 10) -> DataFrame:
    """Mean score and observed rate per quantile bin; empty bins do not appear.

    Inner edges are interpolated percentiles; a score's bin is the number of
    inner edges strictly below it, so equal scores share a bin.
    """
    table = score_table(scored, label, score).counts
    counts = table.selectExpr("threshold", "tp", "tp + fp AS n")
    shares = [i / bins for i in range(1, bins)]
    edges = exact_quantiles(counts, "threshold", shares, bits=bits_for(table), weight="n").select("quantiles").scalar()
    binned = counts.withColumn("_edges", edges).selectExpr(
        "size(filter(_edges, e -> e < threshold)) AS bin", "threshold * n AS _p", "tp", "n"
    )
    return binned.groupBy("bin").agg(
        *exprs(["sum(n) AS n", "sum(_p) / sum(n) AS prob_pred", "sum(tp) / sum(n) AS prob_true"])
    )


def _roc_pick(scored: DataFrame | ScoreTable, label: str, score: str, best: str) -> DataFrame:
    point = "struct(threshold, tpr, fpr)"
    return roc_points(scored, label, score).agg(F.expr(f"{best.format(point=point)} AS b")).selectExpr(
        "b.threshold AS threshold", "b.tpr AS sensitivity", "1 - b.fpr AS specificity"
    )


def youden(scored: DataFrame | ScoreTable, label: str = "y_true", score: str = "p") -> DataFrame:
    """The threshold with the largest tpr - fpr; the highest one on ties."""
    return _roc_pick(scored, label, score, "max_by({point}, struct(tpr - fpr, threshold))")


def target_sensitivity(
    scored: DataFrame | ScoreTable, label: str = "y_true", score: str = "p", target: float = TARGET_SENSITIVITY
) -> DataFrame:
    """The thinned ROC point whose tpr is nearest the target; the highest on ties."""
    gap = f"abs(tpr - {number(target)})"
    return _roc_pick(scored, label, score, "min_by({point}, struct(" + gap + ", -threshold))")


def threshold_grid(start: float = F1_GRID_START, stop: float = F1_GRID_STOP, size: int = F1_GRID_SIZE) -> list[float]:
    """Evenly spaced thresholds, both ends included."""
    step = (stop - start) / (size - 1)
    return [start + i * step for i in range(size - 1)] + [stop]


def grid_counts(
    scored: DataFrame | ScoreTable, grid: Sequence[float], label: str = "y_true", score: str = "p"
) -> DataFrame:
    """Confusion counts at every grid threshold (predict 1 where p >= threshold).

    Each score is binned once by the number of thresholds at or below it; the counts are
    suffix sums over one row per bin. No score meets every threshold.
    """
    counts = score_table(scored, label, score).counts
    splits = [-math.inf, *grid, math.inf]
    binned = Bucketizer(splits=splits, inputCol="threshold", outputCol="_at").transform(counts)
    per_bin = binned.groupBy("_at").agg(*exprs(["sum(tp) AS tp", "sum(fp) AS fp"]))
    # One row, with an array of at most len(grid) + 1 bins.
    totals = per_bin.agg(*exprs([
        "collect_list(struct(_at, tp, fp)) AS _bins",
        "coalesce(sum(tp), 0) AS n_pos",
        "coalesce(sum(fp), 0) AS n_neg",
    ]))
    values = ", ".join(number(t) for t in grid)
    at = totals.selectExpr("_bins", "n_pos", "n_neg", f"posexplode(array({values})) AS (i, threshold)")
    reached = "aggregate(filter(_bins, b -> b._at > i), 0L, (acc, b) -> acc + b.{0})"
    return at.selectExpr(
        "threshold", "n_pos", "n_neg", f"{reached.format('tp')} AS tp", f"{reached.format('fp')} AS fp"
    ).selectExpr("threshold", "n_neg - fp AS tn", "fp", "n_pos - tp AS fn", "tp")


def max_f1(scored: DataFrame | ScoreTable, label: str = "y_true", score: str = "p") -> DataFrame:
    """The grid threshold with the best F1; the lowest one on ties."""
    f1 = ratio_or_zero("(2 * tp)", "(2 * tp + fp + fn)")
    judged = grid_counts(scored, threshold_grid(), label, score).selectExpr("threshold", f"{f1} AS f1")
    best = "max_by(struct(threshold, f1), struct(f1, -threshold)) AS b"
    return judged.agg(F.expr(best)).selectExpr("b.threshold AS threshold", "b.f1 AS f1")


def confusion(
    scored: DataFrame | ScoreTable, thresholds: DataFrame, label: str = "y_true", score: str = "p",
    names: Sequence[str] = STRATEGIES,
) -> DataFrame:
    """tn, fp, fn, tp at each named threshold, in one pass over the score counts.

    ``thresholds`` holds (strategy, threshold); ``names`` lists its strategies.
    """
    by_name = thresholds.agg(F.expr("map_from_entries(collect_list(struct(strategy, threshold))) AS m"))
    picked = ", ".join(f"_m[{quoted(n)}]" for n in names)
    counts = score_table(scored, label, score).counts.withColumn("_m", by_name.scalar())
    sums = {"tn": "fp", "fp": "fp", "fn": "tp", "tp": "tp"}
    side = {"tn": "<", "fp": ">=", "fn": "<", "tp": ">="}
    counted = counts.selectExpr("threshold", "tp", "fp", f"array({picked}) AS _t").agg(*exprs([
        "max(_t) AS _t",
        *[
            f"coalesce(sum(CASE WHEN threshold {side[c]} _t[{i}] THEN {of} END), 0) AS {c}{i}"
            for i in range(len(names)) for c, of in sums.items()
        ],
    ]))
    return counted.selectExpr(lines(
        {"strategy": quoted(n), "threshold": f"_t[{i}]", **{c: f"{c}{i}" for c in sums}}
        for i, n in enumerate(names)
    ))


def thresholds(scored: DataFrame | ScoreTable, label: str = "y_true", score: str = "p") -> DataFrame:
    """(strategy, threshold) of the three ways to choose a threshold.

    They are chosen on the rows they are later judged on. The two ROC choices
    share one pass over the curve.
    """
    scored = score_table(scored, label, score)
    gap = f"struct(abs(tpr - {number(TARGET_SENSITIVITY)}), -threshold)"
    both = roc_points(scored, label, score).agg(*exprs([
        "max_by(threshold, struct(tpr - fpr, threshold)) AS j", f"min_by(threshold, {gap}) AS s"
    ]))
    curve = both.selectExpr(lines([
        {"strategy": quoted(STRATEGIES[0]), "threshold": "j"},
        {"strategy": quoted(STRATEGIES[1]), "threshold": "s"},
    ]))
    return curve.unionByName(
        max_f1(scored, label, score).selectExpr(f"{quoted(STRATEGIES[2])} AS strategy", "threshold")
    )


def threshold_table(scored: DataFrame | ScoreTable, label: str = "y_true", score: str = "p") -> DataFrame:
    """Sensitivity, specificity, precision and F1 of each strategy."""
    scored = score_table(scored, label, score)
    rates = confusion(scored, thresholds(scored, label, score), label, score).selectExpr(
        "strategy",
        "threshold",
        f"{ratio_or_zero('tp', '(tp + fn)')} AS sensitivity",
        f"{ratio_or_zero('tn', '(tn + fp)')} AS specificity",
        f"{ratio_or_zero('tp', '(tp + fp)')} AS precision",
    )
    f1 = ratio_or_zero("(2 * precision * sensitivity)", "(precision + sensitivity)")
    return rates.selectExpr("*", f"{f1} AS f1")


def classification_report(counts: DataFrame, names: Sequence[str] = ("alive", "dead")) -> DataFrame:
    """Precision, recall, F1 and support per class, with accuracy and averages.

    ``counts`` is one row of tn, fp, fn, tp.
    """
    def rates(tag: str, hit: str, called: str, actual: str) -> list[str]:
        return [
            f"{ratio_or_zero(hit, f'({called})')} AS {tag}_precision",
            f"{ratio_or_zero(hit, f'({actual})')} AS {tag}_recall",
            f"{ratio_or_zero(f'(2 * {hit})', f'({called} + {actual})')} AS {tag}_f1",
            f"{actual} AS {tag}_support",
        ]

    measures = ("precision", "recall", "f1")
    wide = counts.selectExpr(
        *rates("a", "tn", "tn + fn", "tn + fp"),
        *rates("d", "tp", "tp + fp", "tp + fn"),
        f"{ratio_or_zero('(tn + tp)', '(tn + fp + fn + tp)')} AS accuracy",
        "tn + fp + fn + tp AS n",
    )
    weighted = "(a_{m} * a_support + d_{m} * d_support)"
    table = [
        {"label": quoted(names[0]), **{m: f"a_{m}" for m in measures}, "support": "a_support"},
        {"label": quoted(names[1]), **{m: f"d_{m}" for m in measures}, "support": "d_support"},
        {"label": "'accuracy'", **{m: "accuracy" for m in measures}, "support": "n"},
        {"label": "'macro avg'", **{m: f"(a_{m} + d_{m}) / 2" for m in measures}, "support": "n"},
        {"label": "'weighted avg'",
         **{m: ratio_or_zero(weighted.format(m=m), "n") for m in measures}, "support": "n"},
    ]
    return wide.selectExpr(lines(table))


def model_comparison(scored: DataFrame | ScoreTable, baseline: str, model: str = "model") -> DataFrame:
    """AUC and average precision per model, with differences from the baseline.

    ``scored`` is long: (model, y_true, p). The window runs over one row per model.
    """
    def base(metric: str) -> str:
        return f"max(CASE WHEN {model} = {quoted(baseline)} THEN {metric} END) OVER ()"

    return ranking_quality(scored, by=[model]).selectExpr(
        model,
        "roc_auc",
        "average_precision",
        f"roc_auc - {base('roc_auc')} AS roc_auc_delta",
        f"average_precision - {base('average_precision')} AS average_precision_delta",
    )


def align_predictions(first: DataFrame, second: DataFrame, key: str, names: Sequence[str], score: str = "p") -> DataFrame:
    """Two prediction tables joined on their key, as long (key, y_true, model, p)."""
    joined = first.selectExpr(key, "y_true", f"{score} AS _a").join(second.selectExpr(key, f"{score} AS _b"), key)
    return joined.selectExpr(key, "y_true", lines([
        {"model": quoted(names[0]), "p": "_a"}, {"model": quoted(names[1]), "p": "_b"}
    ]))
