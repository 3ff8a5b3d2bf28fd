"""The descriptive reports over patients, hospitals and the cohort."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from cohortlab.functions import contract as k
from cohortlab.functions.bands import age_band, age_bin, listed_rank, severity_band
from cohortlab.functions.columns import bmi, contains_any, died, exprs, percent, quoted
from cohortlab.operators.rates import outcome_rate, value_counts
from cohortlab.operators.readings import first_day, top_labels

CHART_LABELS = ["nursingchartcelltypevallabel", "nursingchartcelltypevalname"]


def dataset_scale(patient: DataFrame) -> DataFrame:
    return patient.agg(*exprs([
        f"count(DISTINCT {k.PATIENT_ID}) AS unique_patients",
        f"count(DISTINCT {k.STAY_ID}) AS unique_icu_stays",
        "count(DISTINCT hospitalid) AS hospitals_with_patients",
    ]))


def hospital_count(hospital: DataFrame) -> DataFrame:
    return hospital.agg(F.expr("count(*) AS hospitals_in_reference_table"))


def hospital_mix(hospital: DataFrame, column: str, label: str) -> DataFrame:
    return value_counts(hospital, column, label, "hospital_count")


def demographics_overview(members: DataFrame) -> DataFrame:
    """Age, gender and body-mass row; here the index has no plausibility filter."""
    return members.agg(*exprs([
        "round(avg(age_numeric), 1) AS mean_age",
        "round(stddev_samp(age_numeric), 1) AS sd_age",
        "min(age_numeric) AS min_age",
        "max(age_numeric) AS max_age",
        "count_if(gender = 'Male') AS n_male",
        "count_if(gender = 'Female') AS n_female",
        "count_if(gender NOT IN ('Male', 'Female') OR gender IS NULL) AS n_other_unknown",
        f"round(avg({bmi('admissionweight', 'admissionheight')}), 1) AS mean_bmi",
    ]))


def outcome_by_age(members: DataFrame) -> DataFrame:
    return outcome_rate(members, age_band("age_numeric"), "age_group").orderBy("age_group")


def outcome_by_age_bin(members: DataFrame) -> DataFrame:
    """Half-open bins; ages outside them fall away."""
    rates = outcome_rate(members, age_bin("age_numeric"), "age_group")
    return rates.where("age_group IS NOT NULL")


def outcome_by_gender(members: DataFrame) -> DataFrame:
    """All genders are rated; only the two named ones are shown."""
    rates = outcome_rate(members, "gender", "gender")
    return rates.where("gender IN ('Male', 'Female')").orderBy("gender")


def outcome_by_beds(members: DataFrame, hospital: DataFrame) -> DataFrame:
    """Outcome by bed category, in size order.

    Stays are counted per hospital before the join, so a hospital with a third
    of all stays joins as one row.
    """
    per_hospital = members.groupBy("hospitalid").agg(*exprs(["count(*) AS n", f"sum({died()}) AS deaths"]))
    sized = hospital.where("numbedscategory IS NOT NULL")
    joined = per_hospital.join(sized, "hospitalid")
    counted = joined.groupBy(F.col("numbedscategory").alias("bed_category")).agg(
        *exprs(["sum(n) AS n_patients", "sum(deaths) AS deaths"])
    )
    return counted.selectExpr("*", f"{percent('deaths', 'n_patients')} AS mortality_pct").orderBy(
        F.expr(listed_rank("bed_category", k.BED_CATEGORIES))
    )


def outcome_by_severity(members: DataFrame, apache: DataFrame) -> DataFrame:
    """Outcome by severity band; unscored stays keep a band of their own.

    Scores are counted per (stay, band) before the join: a stay with very many
    score rows still counts once per row, without many rows on one key.
    """
    scored = (
        apache.where(f"apacheversion = {quoted(k.SEVERITY_VERSION)}")
        .groupBy(k.STAY_ID, F.expr(severity_band("apachescore")).alias("_band"))
        .agg(F.expr("count(*) AS _rows"))
    )
    joined = members.select(k.STAY_ID, "hospitaldischargestatus").join(scored, k.STAY_ID, "left")
    band = f"coalesce(_band, {quoted(k.NO_SEVERITY_LABEL)})"
    return outcome_rate(joined, band, "apache_group", weight="coalesce(_rows, 1)").orderBy("apache_group")


def outcome_by_hr_missing(features: DataFrame) -> DataFrame:
    return outcome_rate(features, "hr_missing", "hr_missing", event=k.TARGET).orderBy("hr_missing")


def outcome_by_bed_feature(features: DataFrame) -> DataFrame:
    """Rate by bed category over the feature table, NULL included."""
    return outcome_rate(features, "numbedscategory", "numbedscategory", event=k.TARGET)


def discover_chart_labels(nursecharting: DataFrame, members: DataFrame, words: tuple[str, ...], n: int,
                          by_patients: bool) -> DataFrame:
    readings = first_day(nursecharting, "nursingchartoffset").where(contains_any(CHART_LABELS, words))
    return top_labels(readings, members, CHART_LABELS, "n_readings", n, "n_patients" if by_patients else None)


def top_labs(lab: DataFrame, members: DataFrame, n: int = 30) -> DataFrame:
    return top_labels(first_day(lab, "labresultoffset"), members, ["labname"], "n_results", n, "n_patients")


def lab_result_counts(lab: DataFrame, members: DataFrame) -> DataFrame:
    """Results and stays of the ten chosen labs, non-null results only."""
    listed = ", ".join(quoted(n) for n in k.LAB_PREFIXES)
    readings = first_day(lab, "labresultoffset").where(f"labname IN ({listed}) AND labresult IS NOT NULL")
    return top_labels(readings, members, ["labname"], "n_results", None, "n_patients")
