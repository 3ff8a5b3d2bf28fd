"""Every runnable query by name: callables of (spark, folder of test tables)."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from cohortlab.functions import contract as k
from cohortlab.functions.columns import died, exprs, lines, nan_to_null, percent_text, quoted
from cohortlab.models import attribution, generalise, linear, prepare, split, stepwise, trees
from cohortlab.models.split import FOLDS
from cohortlab.operators import audit, cohort as co, metrics, rates
from cohortlab.operators.readings import first_day, restrict
from cohortlab.plans import features as fe, reports
from cohortlab.plans.study import GROUP, Study, fold_summary, quality_row
from cohortlab.session import fresh_path, materialise
from cohortlab.sources import readers, schemas, sinks, standin
from cohortlab.sources.readers import Tables

# Weights (log-odds per standard deviation) of the scoring example.
REASON_INTERCEPT = -2.6
REASON_WEIGHTS = {
    "age": 0.45, "gender_male": 0.05, "bmi": -0.08, "gcs_mean": -0.52, "hr_mean": 0.31,
    "sbp_mean": -0.24, "map_mean": -0.11, "rr_mean": 0.27, "spo2_mean": -0.19, "temp_mean": -0.22,
    "bun_max": 0.38, "creatinine_max": 0.09, "glucose_min": 0.07, "wbc_mean": 0.16,
}
# The limits and patience of the boosting searches.
EARLY = trees.Boosting("early", 500, 0.05, 31, 20)
EARLY_PATIENCE, SEARCH_PATIENCE = 30, 50

# Two small trees over (age, hr_mean, bun_max), as
# (tree, id, prediction, cover, left, right, feature, cut, categories), and their weights.
FIXED_FEATURES = ("age", "hr_mean", "bun_max")
FIXED_NODES = (
    (0, 0, 0.0, 100.0, 1, 2, 0, [65.0], -1), (0, 1, 0.0, 60.0, 3, 4, 1, [90.0], -1), (0, 2, 0.0, 40.0, 5, 6, 2, [30.0], -1),
    (0, 3, -0.6, 35.0, -1, -1, -1, [], -1), (0, 4, 0.1, 25.0, -1, -1, -1, [], -1), (0, 5, 0.0, 25.0, 7, 8, 1, [100.0], -1),
    (0, 6, 0.9, 15.0, -1, -1, -1, [], -1), (0, 7, 0.2, 15.0, -1, -1, -1, [], -1), (0, 8, 0.5, 10.0, -1, -1, -1, [], -1),
    (1, 0, 0.0, 100.0, 1, 2, 2, [20.0], -1), (1, 1, 0.0, 70.0, 3, 4, 2, [10.0], -1), (1, 2, 0.0, 30.0, 5, 6, 0, [50.0], -1),
    (1, 3, -0.4, 30.0, -1, -1, -1, [], -1), (1, 4, -0.1, 40.0, -1, -1, -1, [], -1), (1, 5, 0.3, 10.0, -1, -1, -1, [], -1),
    (1, 6, 0.8, 20.0, -1, -1, -1, [], -1),
)
FIXED_TREE_WEIGHTS = (1.0, 0.1)
TWO_FEATURES = ("age", "gcs_mean")

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
_STUDIES: dict[tuple[str, str], Study] = {}


def study(spark: SparkSession, sf_dir: str) -> Study:
    """The study over one folder, kept for the life of the Spark application."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _STUDIES:
        _STUDIES[key] = Study(spark, standin.tables(spark, sf_dir))
    return _STUDIES[key]


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def rounded(df: DataFrame, *columns: str) -> DataFrame:
    """Means and ratios to six decimals: sums depend on the order of addition.

    Rounded to nine first, so that a tie at the sixth decimal falls the same way
    whatever that order was.
    """
    return df.selectExpr(*[f"round(round({c}, 9), 6) AS {c}" if c in columns else c for c in df.columns])


def doubles(df: DataFrame) -> list[str]:
    return [name for name, kind in df.dtypes if kind == "double"]


def _members(t: Tables) -> DataFrame:
    return co.cohort(t.patient)


# --- dataset and cohort reports ---------------------------------------------

@query
def dataset_scale(spark, sf_dir):
    return reports.dataset_scale(standin.tables(spark, sf_dir).patient)


@query
def hospital_reference_count(spark, sf_dir):
    return reports.hospital_count(standin.tables(spark, sf_dir).hospital)


@query
def discharge_distribution(spark, sf_dir):
    patient = standin.tables(spark, sf_dir).patient
    return rates.share_of_total(patient, "hospitaldischargestatus", "discharge_status")


@query
def hospital_by_teaching(spark, sf_dir):
    return reports.hospital_mix(standin.tables(spark, sf_dir).hospital, "teachingstatus", "teaching_status")


@query
def hospital_by_beds(spark, sf_dir):
    return reports.hospital_mix(standin.tables(spark, sf_dir).hospital, "numbedscategory", "bed_category")


@query
def hospital_by_region(spark, sf_dir):
    return reports.hospital_mix(standin.tables(spark, sf_dir).hospital, "region", "region")


@query
def cohort(spark, sf_dir):
    return co.register_cohort(standin.tables(spark, sf_dir).patient)


@query
def cohort_latest(spark, sf_dir):
    """The other reading of the offset's sign: the largest one marks the first stay."""
    return co.cohort(standin.tables(spark, sf_dir).patient, pick="max").select(k.STAY_ID, k.PATIENT_ID)


@query
def cohort_one_stay(spark, sf_dir):
    return co.cohort(standin.tables(spark, sf_dir).patient, strict_one=True).select(k.STAY_ID, k.PATIENT_ID)


@query
def cohort_check(spark, sf_dir):
    return co.cohort_check(_members(standin.tables(spark, sf_dir)))


@query
def attrition(spark, sf_dir):
    return co.attrition(standin.tables(spark, sf_dir).patient)


@query
def attrition_drops(spark, sf_dir):
    return co.attrition_drops(co.attrition(standin.tables(spark, sf_dir).patient))


@query
def demographics_overview(spark, sf_dir):
    return reports.demographics_overview(_members(standin.tables(spark, sf_dir)))


@query
def outcome_by_age_case(spark, sf_dir):
    return reports.outcome_by_age(_members(standin.tables(spark, sf_dir)))


@query
def outcome_by_age_cut(spark, sf_dir):
    return reports.outcome_by_age_bin(_members(standin.tables(spark, sf_dir)))


@query
def outcome_by_gender(spark, sf_dir):
    return reports.outcome_by_gender(_members(standin.tables(spark, sf_dir)))


@query
def outcome_by_beds(spark, sf_dir):
    t = standin.tables(spark, sf_dir)
    return reports.outcome_by_beds(_members(t), t.hospital)


@query
def outcome_by_apache(spark, sf_dir):
    t = standin.tables(spark, sf_dir)
    return reports.outcome_by_severity(_members(t), t.apachepatientresult)


@query
def outcome_by_hr_missing(spark, sf_dir):
    t = standin.tables(spark, sf_dir)
    vitals = fe.vitals_features(t, _members(t)).select(k.STAY_ID, "hr_missing")
    target = _members(t).selectExpr(k.STAY_ID, f"{died()} AS {k.TARGET}")
    return reports.outcome_by_hr_missing(vitals.join(target, k.STAY_ID))


@query
def outcome_by_bed_feature(spark, sf_dir):
    """Rate per bed category of the feature table, with the rate also as text."""
    t = standin.tables(spark, sf_dir)
    rows = reports.outcome_by_bed_feature(fe.demographics(_members(t), t.hospital))
    text = percent_text("deaths / n_patients")
    return rows.selectExpr("numbedscategory", "n_patients", "deaths", f"{text} AS mortality_text")


@query
def discover_temperature(spark, sf_dir):
    t = standin.tables(spark, sf_dir)
    return reports.discover_chart_labels(t.nursecharting, _members(t), k.TEMPERATURE_WORDS, 10, False)


@query
def discover_gcs(spark, sf_dir):
    t = standin.tables(spark, sf_dir)
    return reports.discover_chart_labels(t.nursecharting, _members(t), k.COMA_WORDS, 15, True)


@query
def top_labs(spark, sf_dir):
    t = standin.tables(spark, sf_dir)
    return reports.top_labs(t.lab, _members(t))


@query
def lab_result_counts(spark, sf_dir):
    t = standin.tables(spark, sf_dir)
    return reports.lab_result_counts(t.lab, _members(t))


# --- features ----------------------------------------------------------------

@query
def features_demographics(spark, sf_dir):
    t = standin.tables(spark, sf_dir)
    return rounded(fe.demographics(_members(t), t.hospital), "bmi", "admissionweight")


@query
def hr_first_pass(spark, sf_dir):
    t = standin.tables(spark, sf_dir)
    df = fe.heart_rate_first_pass(t.vitalperiodic, _members(t))
    return rounded(df, *doubles(df))


def _variable_block(build):
    def run(spark, sf_dir):
        t = standin.tables(spark, sf_dir)
        df = build(t, _members(t))
        return rounded(df, *doubles(df))
    return run


for _name, _build in {
    "vitals_features": fe.vitals_features,
    "bp_features": fe.pressure_features,
    "temp_features": fe.temperature_features,
    "lab_features": fe.lab_features,
    "gcs_features": fe.coma_features,
}.items():
    QUERIES[_name] = _variable_block(_build)


@query
def features_final(spark, sf_dir):
    df = fe.feature_table(standin.tables(spark, sf_dir))
    return rounded(df, *doubles(df))


@query
def feature_contract(spark, sf_dir):
    return audit.contract(fe.feature_table(standin.tables(spark, sf_dir)), k.role)


# --- audits ------------------------------------------------------------------

@query
def extreme_bmi(spark, sf_dir):
    t = standin.tables(spark, sf_dir)
    columns = [k.STAY_ID, "admissionheight", "admissionweight", "bmi"]
    df = audit.extremes(fe.raw_demographics(_members(t), t.hospital), "bmi", columns, k.STAY_ID)
    return rounded(df, "bmi", "admissionweight")


MEAN_COLUMNS = [f"{p}_mean" for p in k.VITAL_PREFIXES]


@query
def describe_vitals(spark, sf_dir):
    """Per-stay means of the seven vitals, one row per variable."""
    features = materialise(fe.feature_table(standin.tables(spark, sf_dir)).select(MEAN_COLUMNS), "means")
    df = audit.describe(audit.to_long(features, MEAN_COLUMNS), len(MEAN_COLUMNS))
    return rounded(df, *doubles(df))


@query
def describe_hr_readings(spark, sf_dir):
    """The heart-rate readings themselves, before the plausibility filter."""
    t = standin.tables(spark, sf_dir)
    readings = restrict(fe.heart_rate_readings(t.vitalperiodic), _members(t))
    df = audit.describe(audit.to_long(readings, ["heartrate"]), 1)
    return rounded(df, *doubles(df))


@query
def readings_per_stay(spark, sf_dir):
    """Heart-rate readings per stay, described."""
    t = standin.tables(spark, sf_dir)
    per_stay = fe.heart_rate_readings(t.vitalperiodic).groupBy(k.STAY_ID).agg(F.expr("count(*) AS readings"))
    df = audit.describe(audit.to_long(restrict(per_stay, _members(t)), ["readings"]), 1)
    return rounded(df, *doubles(df))


@query
def range_audit_vitals(spark, sf_dir):
    t = standin.tables(spark, sf_dir)
    readings = first_day(t.vitalperiodic, "observationoffset")
    return audit.range_audit(readings, _members(t), k.STAY_ID, k.VITAL_RANGES)


@query
def range_audit_labs(spark, sf_dir):
    t = standin.tables(spark, sf_dir)
    readings = first_day(t.lab, "labresultoffset").where("labresult IS NOT NULL")
    return audit.range_audit_long(readings, _members(t), k.STAY_ID, "labname", "labresult", k.LAB_RANGES)


@query
def range_audit_bmi(spark, sf_dir):
    """The same audit over the unchecked body-mass index of the cohort."""
    t = standin.tables(spark, sf_dir)
    members = _members(t)
    return audit.range_audit(fe.raw_demographics(members, t.hospital), members, k.STAY_ID, {"bmi": k.BMI_RANGE})


@query
def vital_coverage(spark, sf_dir):
    t = standin.tables(spark, sf_dir)
    readings = first_day(t.vitalperiodic, "observationoffset")
    return audit.non_null_coverage(readings, _members(t), k.STAY_ID, list(k.VITAL_RANGES))


@query
def cuff_coverage(spark, sf_dir):
    t = standin.tables(spark, sf_dir)
    readings = first_day(t.vitalaperiodic, "observationoffset")
    return audit.non_null_coverage(readings, _members(t), k.STAY_ID, list(k.CUFF_COLUMNS))


@query
def null_audit(spark, sf_dir):
    return audit.null_audit(fe.feature_table(standin.tables(spark, sf_dir)))


@query
def feature_coverage(spark, sf_dir):
    return audit.flag_coverage(fe.feature_table(standin.tables(spark, sf_dir)), k.VARIABLES)


@query
def complete_vitals(spark, sf_dir):
    return audit.complete_rows(fe.feature_table(standin.tables(spark, sf_dir)), k.VITAL_PREFIXES)


@query
def source_gain(spark, sf_dir):
    """Stays with pressure or temperature from one source, and from both together."""
    t = standin.tables(spark, sf_dir)
    members = _members(t)
    periodic = fe.periodic_by_stay(t.vitalperiodic, ("pressure", "temp"))
    frames = [fe.aperiodic_by_stay(t.vitalaperiodic), fe.charting_by_stay(t.nursecharting, ("temp",))]
    joined = members.select(k.STAY_ID).join(periodic, k.STAY_ID, "left")
    for frame in frames:
        joined = joined.join(frame, k.STAY_ID, "left")
    pairs = {p: (f"line_{p}", f"cuff_{p}") for p in fe.PRESSURE_RANGES} | {"temp": ("probe_temp", "chart_temp")}
    one = {p: f"coalesce({a}_count > 0, false)" for p, (a, _) in pairs.items()}
    other = {p: f"coalesce({b}_count > 0, false)" for p, (_, b) in pairs.items()}
    counts = joined.agg(*exprs(
        text for p in pairs for text in (
            f"count_if({one[p]}) AS {p}_first", f"count_if({one[p]} OR {other[p]}) AS {p}_both"
        )
    ))
    return counts.selectExpr(lines(
        {"variable": quoted(p), "n_first_source": f"{p}_first", "n_both_sources": f"{p}_both"} for p in pairs
    ))


@query
def feature_defaults(spark, sf_dir):
    """Median of each numeric feature, mode of each category."""
    features = materialise(fe.feature_table(standin.tables(spark, sf_dir)), "features")
    return rounded(audit.feature_defaults(features, k.NUMERIC_FEATURES, k.CATEGORICAL), "median")


@query
def defaults_document(spark, sf_dir):
    """The same defaults, written as a JSON document and read back from it."""
    defaults = audit.feature_defaults(study(spark, sf_dir).features, k.NUMERIC_FEATURES, k.CATEGORICAL)
    path = fresh_path(spark, "defaults")
    sinks.write_defaults(defaults.selectExpr("feature", "coalesce(cast(median AS string), mode) AS default_value"), path)
    named = ", ".join(quoted(c) for c in k.CATEGORICAL)
    back = readers.read_defaults(spark, path).selectExpr(
        "feature",
        f"CASE WHEN feature NOT IN ({named}) THEN try_cast(default_value AS double) END AS median",
        f"CASE WHEN feature IN ({named}) THEN default_value END AS mode",
    )
    return rounded(back, "median")


# --- splits ------------------------------------------------------------------

def _labelled(t: Tables) -> DataFrame:
    return _members(t).selectExpr(k.STAY_ID, f"{died()} AS {k.TARGET}")


@query
def split_train_test(spark, sf_dir):
    df = split.train_test_split(_labelled(standin.tables(spark, sf_dir)), k.TARGET, k.STAY_ID)
    return split.nested_validation(df, k.TARGET, k.STAY_ID)


@query
def folds5(spark, sf_dir):
    df = split.train_test_split(_labelled(standin.tables(spark, sf_dir)), k.TARGET, k.STAY_ID)
    return split.train_folds(df, k.TARGET, k.STAY_ID).where("fold IS NOT NULL").drop("split")


@query
def class_balance(spark, sf_dir):
    return rounded(rates.class_balance(_labelled(standin.tables(spark, sf_dir)), k.TARGET), "imbalance_ratio")


# --- evaluation of the scored rows --------------------------------------------

@query
def roc_auc(spark, sf_dir):
    df = metrics.ranking_quality(standin.scores(spark, sf_dir))
    return rounded(df.select("n", "n_pos", "roc_auc"), "roc_auc")


@query
def average_precision(spark, sf_dir):
    df = metrics.ranking_quality(standin.scores(spark, sf_dir))
    return rounded(df.select("n", "n_pos", "average_precision"), "average_precision")


@query
def auc_guard(spark, sf_dir):
    """Quality per day group; a group with one class gives NULL, not an error."""
    scored = standin.scores(spark, sf_dir)
    grouped = scored.selectExpr("*", "CASE WHEN y_true = 1 THEN id % 3 ELSE id % 4 END AS grp")
    return rounded(metrics.ranking_quality(grouped, by=["grp"]), "roc_auc", "average_precision")


@query
def roc_points(spark, sf_dir):
    return rounded(metrics.roc_points(standin.scores(spark, sf_dir)), "fpr", "tpr")


@query
def pr_points(spark, sf_dir):
    df = metrics.pr_points(standin.scores(spark, sf_dir))
    return rounded(df, "precision", "recall", "prevalence")


@query
def calibration(spark, sf_dir):
    return rounded(metrics.calibration(standin.scores(spark, sf_dir)), "prob_pred", "prob_true")


def _gated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores with many distinct values, of which some rows can't be judged."""
    return standin.scores(spark, sf_dir).selectExpr(
        "id",
        "CASE WHEN id % 23 = 0 THEN NULL WHEN id % 29 = 0 THEN 2 ELSE y_true END AS y_true",
        "CASE WHEN id % 17 = 0 THEN NULL WHEN id % 19 = 0 THEN double('NaN') ELSE p + id * 0.000000001D END AS p",
    )


@query
def gated_quality(spark, sf_dir):
    """Area and average precision, with the rows refused by reason."""
    table = metrics.score_table(_gated(spark, sf_dir))
    refused = {c: n for c, n in table.refused.items() if c not in ("taken", "null_group")}
    df = metrics.ranking_quality(table).selectExpr("*", *[f"{n}L AS {c}" for c, n in refused.items()])
    return rounded(df, "roc_auc", "average_precision")


@query
def gated_calibration(spark, sf_dir):
    return rounded(metrics.calibration(_gated(spark, sf_dir)), "prob_pred", "prob_true")


@query
def gated_thresholds(spark, sf_dir):
    df = metrics.threshold_table(_gated(spark, sf_dir))
    return rounded(df, *doubles(df))


@query
def youden(spark, sf_dir):
    return rounded(metrics.youden(standin.scores(spark, sf_dir)), "sensitivity", "specificity")


@query
def sens80(spark, sf_dir):
    return rounded(metrics.target_sensitivity(standin.scores(spark, sf_dir)), "sensitivity", "specificity")


@query
def max_f1(spark, sf_dir):
    return rounded(metrics.max_f1(standin.scores(spark, sf_dir)), "threshold", "f1")


@query
def f1_sweep(spark, sf_dir):
    """Confusion counts at each of the 100 grid thresholds."""
    df = metrics.grid_counts(standin.scores(spark, sf_dir), metrics.threshold_grid())
    return rounded(df, "threshold")


@query
def confusion(spark, sf_dir):
    scored = metrics.score_table(standin.scores(spark, sf_dir))
    return rounded(metrics.confusion(scored, metrics.thresholds(scored)), "threshold")


@query
def classification_report(spark, sf_dir):
    scored = metrics.score_table(standin.scores(spark, sf_dir))
    name = metrics.STRATEGIES[0]
    best = metrics.youden(scored).selectExpr(f"{quoted(name)} AS strategy", "threshold")
    df = metrics.classification_report(metrics.confusion(scored, best, names=[name]))
    return rounded(df, "precision", "recall", "f1")


@query
def threshold_table(spark, sf_dir):
    df = metrics.threshold_table(standin.scores(spark, sf_dir))
    return rounded(df, "threshold", "sensitivity", "specificity", "precision", "f1")


@query
def model_comparison(spark, sf_dir):
    """Two score columns of the same rows, aligned by id."""
    first = standin.scores(spark, sf_dir)
    events = nan_to_null(standin.tables(spark, sf_dir).source("events"))
    second = events.selectExpr("event_id AS id", "round(value / (value + 80 + event_id % 7), 3) AS p")
    both = metrics.align_predictions(first, second, "id", ("baseline", "challenger"))
    df = metrics.model_comparison(both, "baseline")
    return rounded(df, *doubles(df))


# --- preparation and scoring with fixed weights ---------------------------------

@query
def impute_scale(spark, sf_dir):
    """The 14 form features, imputed and scaled from the train rows."""
    s = study(spark, sf_dir)
    scaling = prepare.fit_scaling(s.train, k.DEMO_FEATURES)
    scaled = scaling.stage().transform(s.rows)
    names = [prepare.scaled_name(c) for c in k.DEMO_FEATURES]
    return rounded(scaled.select(k.STAY_ID, "split", *names), *names)


@query
def linear_reasons(spark, sf_dir):
    """Contribution of each feature to each test row, at the fixed weights."""
    s = study(spark, sf_dir)
    scaling = prepare.fit_scaling(s.train, k.DEMO_FEATURES)
    return rounded(linear.contributions(s.test, k.STAY_ID, scaling, REASON_WEIGHTS), "contribution")


@query
def batch_score_bands(spark, sf_dir):
    """Probability, risk band and the three largest reasons of every row."""
    s = study(spark, sf_dir)
    scaling = prepare.fit_scaling(s.train, k.DEMO_FEATURES)
    scored = linear.scored_with_reasons(s.rows, k.STAY_ID, scaling, REASON_WEIGHTS, REASON_INTERCEPT)
    reasons = [f"reasons[{i}].feature AS reason_{i + 1}" for i in range(3)]
    return rounded(scored.selectExpr(k.STAY_ID, "p", "risk", *reasons), "p")


# --- fitted models --------------------------------------------------------------

@query
def lr_train_eval(spark, sf_dir):
    s = study(spark, sf_dir)
    df = quality_row(s.logistic_predictions(), "logistic regression")
    return rounded(df, *doubles(df))


@query
def lr_thresholds(spark, sf_dir):
    """The three threshold strategies on the fitted model's test predictions."""
    df = metrics.threshold_table(study(spark, sf_dir).logistic_predictions())
    return rounded(df, *doubles(df))


@query
def lr_cv(spark, sf_dir):
    df = fold_summary(study(spark, sf_dir).logistic_folds(), "logistic regression, 14 features")
    return rounded(df, *doubles(df))


@query
def demo_model(spark, sf_dir):
    s = study(spark, sf_dir)
    df = quality_row(s.demo_predictions(), "logistic regression, 14 features")
    return rounded(df, *doubles(df))


@query
def gbt_train_eval(spark, sf_dir):
    """The boosted model beside the linear one, on the same test rows."""
    s = study(spark, sf_dir)
    both = metrics.align_predictions(
        s.logistic_predictions(), s.boosted_predictions(), k.STAY_ID, ("logistic", "boosted")
    )
    df = metrics.model_comparison(both, "logistic")
    return rounded(df, *doubles(df))


@query
def gbt_early_stop(spark, sf_dir):
    """The round to stop at by the AUC of the nested validation rows, and the stopped model's test figures."""
    rows, bins = study(spark, sf_dir).matrix
    df = stepwise.early_stopped(rows, EARLY, EARLY_PATIENCE, bins)
    return rounded(df, "validation_roc_auc", "roc_auc", "pr_auc")


@query
def gbt_rounds(spark, sf_dir):
    """The number of trees by cross-validated AUC."""
    rows, bins = study(spark, sf_dir).matrix
    df = stepwise.sweep(rows.where("split = 'train'"), trees.SWEEP[:1], SEARCH_PATIENCE, bins, FOLDS)
    return rounded(df.select("n_trees", "n_rounds", "auc_mean", "auc_std"), "auc_mean", "auc_std")


@query
def gbt_sweep(spark, sf_dir):
    """Four configurations by cross-validated AUC, grown in step over one matrix."""
    rows, bins = study(spark, sf_dir).matrix
    df = stepwise.sweep(rows.where("split = 'train'"), trees.SWEEP, SEARCH_PATIENCE, bins, FOLDS)
    return rounded(df, "auc_mean", "auc_std")


@query
def gbt_round_picker(spark, sf_dir):
    """The stopping rule on given margins: five folds and twenty rounds that get worse after the eighth."""
    rounds = 20
    staged = standin.scores(spark, sf_dir).selectExpr(
        "y_true", "cast(id % 5 AS int) AS series", f"explode(sequence(1, {rounds})) AS round", "id", "p"
    ).selectExpr("y_true", "series", "round", "round(1000 * p) * 8 + ((id * 7919 * round) % 1009) * abs(round - 8) AS p")
    judged = metrics.ranking_quality(staged, by=["series", "round"])
    return rounded(stepwise.picked(judged, rounds, patience=4), "auc_mean", "auc_std")


@query
def attributions(spark, sf_dir):
    return rounded(study(spark, sf_dir).attributions, "phi")


@query
def importance(spark, sf_dir):
    return rounded(attribution.importance(study(spark, sf_dir).attributions, top=20), "mean_abs_shap")


@query
def extreme_reasons(spark, sf_dir):
    s = study(spark, sf_dir)
    df = attribution.extreme_reasons(s.attributions, s.boosted_predictions(), k.STAY_ID, s.base_value)
    return rounded(df, "p", "base_value", "phi")


@query
def leave_one_group_out(spark, sf_dir):
    return rounded(study(spark, sf_dir).cross_group, "test_roc_auc", "test_pr_auc")


@query
def generalisation_summary(spark, sf_dir):
    s = study(spark, sf_dir)
    inside = metrics.ranking_quality(s.boosted_predictions()).first()["roc_auc"]
    df = generalise.summary(s.cross_group, inside)
    return rounded(df, "mean_roc_auc", "std_roc_auc", "in_distribution_roc_auc")


@query
def generalisation_report(spark, sf_dir):
    return generalise.presentation(study(spark, sf_dir).cross_group)


# --- the same operators on fixed models, which SQL can follow ---------------------

def _fixed_leaves() -> list[attribution.Leaf]:
    columns = ["tree", "id", "prediction", "cover", "left", "right", "feature", "cut", "categories"]
    return attribution.leaves_from(pd.DataFrame(list(FIXED_NODES), columns=columns), FIXED_TREE_WEIGHTS)


def _fixed_phi(s: Study) -> DataFrame:
    cells = ", ".join(f"coalesce(cast({c} AS double), {trees.FILL_VALUE}D)" for c in FIXED_FEATURES)
    vectors = s.features.selectExpr(k.STAY_ID, f"array({cells}) AS x")
    return attribution.leaf_attributions(vectors, k.STAY_ID, FIXED_FEATURES, _fixed_leaves())


@query
def fixed_attributions(spark, sf_dir):
    """Attributions of two given trees on every stay."""
    return rounded(_fixed_phi(study(spark, sf_dir)), "phi")


@query
def fixed_importance(spark, sf_dir):
    """Mean absolute attribution per feature, beside the overall mean."""
    phi = materialise(_fixed_phi(study(spark, sf_dir)), "fixed-phi")
    df = attribution.importance(phi).withColumn("mean_phi", attribution.mean_attribution(phi).scalar())
    return rounded(df, "mean_abs_shap", "mean_phi")


@query
def fixed_extreme_reasons(spark, sf_dir):
    """The contributions of the stays with the highest and the lowest probability."""
    s = study(spark, sf_dir)
    phi = materialise(_fixed_phi(s), "fixed-phi")
    base = attribution.base_value(_fixed_leaves())
    margin = phi.groupBy(k.STAY_ID).agg(F.expr(f"round({base!r}D + sum(phi), 9) AS z"))
    scored = margin.join(s.features, k.STAY_ID).selectExpr(k.STAY_ID, f"{k.TARGET} AS y_true", "1 / (1 + exp(-z)) AS p")
    return rounded(attribution.extreme_reasons(phi, scored, k.STAY_ID, base, top=2), "p", "base_value", "phi")


@query
def attribution_reload(spark, sf_dir):
    """Attributions written by feature and read back."""
    phi = materialise(_fixed_phi(study(spark, sf_dir)), "fixed-phi")
    path = fresh_path(spark, "attributions")
    sinks.write_attributions(phi, path)
    again = spark.read.schema(phi.schema).parquet(path)
    return sinks.reload_check(phi, path, again).selectExpr("'attributions' AS sink", "*")


def _unit_rates(train: DataFrame, test: DataFrame) -> DataFrame:
    """A scorer in closed form: the train rate of the unit type, and a little for age."""
    rates = train.groupBy("unittype").agg(F.expr(f"avg({k.TARGET}) AS rate")).withColumnRenamed("unittype", "_unit")
    joined = test.join(F.broadcast(rates), F.expr("unittype <=> _unit"), "left")  # one row a unit type
    return joined.selectExpr(f"cast({k.TARGET} AS double) AS y_true", "coalesce(rate, 0D) + coalesce(cast(age AS double), 0D) / 1000D AS p")


def _fixed_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return generalise.leave_one_group_out(study(spark, sf_dir).features, GROUP, k.TARGET, _unit_rates)


@query
def fixed_group_out(spark, sf_dir):
    return rounded(_fixed_groups(spark, sf_dir), "test_roc_auc", "test_pr_auc")


@query
def fixed_group_summary(spark, sf_dir):
    df = generalise.summary(materialise(_fixed_groups(spark, sf_dir), "fixed-groups"), 0.8)
    return rounded(df, "mean_roc_auc", "std_roc_auc")


@query
def fixed_group_report(spark, sf_dir):
    return generalise.presentation(_fixed_groups(spark, sf_dir))


@query
def lr_two_features(spark, sf_dir):
    """The weights of a fitted pipeline on two features."""
    s = study(spark, sf_dir)
    weights, intercept = linear.coefficients(linear.fit_logistic(s.train, TWO_FEATURES, k.TARGET), TWO_FEATURES)
    rows = [("intercept", intercept), *weights.items()]
    return spark.createDataFrame(rows, "feature string, weight double").selectExpr("feature", "round(weight, 5) AS weight")


@query
def lr_two_feature_scores(spark, sf_dir):
    """Probabilities of the test rows by the same pipeline."""
    s = study(spark, sf_dir)
    model = linear.fit_logistic(s.train, TWO_FEATURES, k.TARGET)
    return linear.score(model, s.test, k.STAY_ID, k.TARGET).selectExpr(k.STAY_ID, "y_true", "round(p, 5) AS p")


@query
def gbt_first_split(spark, sf_dir):
    """Leaf values and sizes of a tree of one split, as the boosting loop grows its first."""
    rows, bins = study(spark, sf_dir).matrix
    stump = trees.Boosting("stump", 1, 0.05, 2, 20)
    grown = stepwise.grow(rows.where("split = 'train'"), [stepwise.Series(stump, "true", "true")], 1, bins).rows
    leaves = grown.groupBy(F.expr("round(margin_at_best[0], 6) AS leaf")).agg(*exprs(["count(*) AS n", "cast(sum(label) AS bigint) AS n_pos"]))
    return leaves


# --- sinks ----------------------------------------------------------------------

@query
def sink_reload(spark, sf_dir):
    """Write each product, read it back, and compare counts, columns and every value."""
    s = study(spark, sf_dir)
    checks = []

    def check(name: str, df: DataFrame, path: str) -> None:
        checks.append(sinks.reload_check(df, path).selectExpr(f"'{name}' AS sink", "*"))

    path = fresh_path(spark, "features-final")
    sinks.write_table(s.features, path, schemas.feature_table())
    check("features", s.features, path)

    path = fresh_path(spark, "model")
    sinks.save_model(s.demo, path)
    again = linear.score(sinks.load_model(path), s.test, k.STAY_ID, k.TARGET)
    predictions = again.selectExpr(k.STAY_ID, "y_true", "p AS y_pred_proba")
    path = fresh_path(spark, "predictions")
    sinks.write_table(predictions, path, schemas.PREDICTIONS)
    check("predictions of the reloaded model", predictions, path)

    thresholds = metrics.thresholds(s.demo_predictions())
    path = fresh_path(spark, "thresholds")
    sinks.write_table(thresholds, path)
    check("thresholds", thresholds, path)
    out = checks[0]
    for other in checks[1:]:
        out = out.unionByName(other)
    return out
