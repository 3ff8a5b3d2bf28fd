"""First stays, the inclusion rules, the cohort and its attrition table."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from cohortlab.functions import contract as k
from cohortlab.functions.columns import age_years, died, exprs, known_text, lines, percent, quoted

OFFSET = "hospitaladmitoffset"

# The inclusion rules after the first-stay rule; each is true or false, never NULL.
ADULT = f"coalesce(age_numeric >= {k.MIN_AGE}, false)"
OUTCOME_KNOWN = known_text("hospitaldischargestatus")
LONG_STAY = f"coalesce(unitdischargeoffset >= {k.MIN_STAY_MINUTES}, false)"


def with_age(patient: DataFrame) -> DataFrame:
    return patient.selectExpr("*", f"{age_years('age')} AS age_numeric")


def first_stays(
    stays: DataFrame,
    key: str = k.PATIENT_ID,
    offset: str = OFFSET,
    pick: str = "min",
    strict_one: bool = False,
) -> DataFrame:
    """Stays at the smallest (or largest) offset of their patient.

    Ties keep every tied stay unless ``strict_one``, which keeps the smallest
    stay id. A NULL key or offset never matches.

    The group extreme is map-side combined, and the join back runs on (key,
    offset): one busy patient spreads over as many tasks as it has offsets. A
    window over the key would hold all rows of that patient in one task.
    """
    if pick not in ("min", "max"):
        raise ValueError("pick is 'min' or 'max'")
    keyed = stays.where(f"{key} IS NOT NULL AND {offset} IS NOT NULL")
    if not strict_one:
        firsts = keyed.groupBy(key).agg(F.expr(f"{pick}({offset}) AS {offset}"))
        return stays.join(firsts, [key, offset], "left_semi")
    sign = "" if pick == "min" else "-"
    best = f"min(named_struct('o', {sign}{offset}, 's', {k.STAY_ID})) AS best"
    firsts = keyed.groupBy(key).agg(F.expr(best)).selectExpr(
        key, f"{sign}best.o AS {offset}", f"best.s AS {k.STAY_ID}"
    )
    return stays.join(firsts, [key, offset, k.STAY_ID], "left_semi")


def cohort(patient: DataFrame, pick: str = "min", strict_one: bool = False) -> DataFrame:
    """First stay over all stays, then adults with a known outcome and a full first day."""
    stays = with_age(patient)
    chosen = first_stays(stays, pick=pick, strict_one=strict_one)
    return chosen.where(f"{ADULT} AND {OUTCOME_KNOWN} AND {LONG_STAY}").select(stays.columns)


def register_cohort(patient: DataFrame) -> DataFrame:
    """The cohort, also as temp view ``cohort`` (replaced if it exists)."""
    df = cohort(patient)
    df.createOrReplaceTempView("cohort")
    return df


def cohort_check(members: DataFrame) -> DataFrame:
    return members.agg(*exprs([
        "count(*) AS cohort_size",
        f"sum({died()}) AS deaths",
        "count(DISTINCT hospitalid) AS hospitals_represented",
    ])).selectExpr(
        "cohort_size",
        "deaths",
        f"{percent('deaths', 'cohort_size')} AS mortality_rate_pct",
        "hospitals_represented",
    )


def attrition(patient: DataFrame) -> DataFrame:
    """Row counts per inclusion step, in step order, from one scan.

    Steps 1-3 count patients with any qualifying stay; step 4 counts cohort rows.
    Rows collapse first by (patient, offset), then by patient, so the distinct
    counts become plain sums and no step reads the table again.
    """
    known = f"({ADULT} AND {OUTCOME_KNOWN})"
    visits = with_age(patient).groupBy(k.PATIENT_ID, OFFSET).agg(*exprs([
        "count(*) AS n_stays",
        f"max({ADULT}) AS adult",
        f"max({known}) AS known",
        f"count_if({known} AND {LONG_STAY}) AS n_included",
    ]))
    patients = visits.groupBy(k.PATIENT_ID).agg(*exprs([
        "sum(n_stays) AS n_stays",
        "max(adult) AS adult",
        "max(known) AS known",
        f"min_by(n_included, {OFFSET}) AS n_included",
    ]))
    has_key = f"{k.PATIENT_ID} IS NOT NULL"
    counts = patients.agg(*exprs([
        "coalesce(sum(n_stays), 0) AS s0",
        f"count({k.PATIENT_ID}) AS s1",
        f"count_if({has_key} AND adult) AS s2",
        f"count_if({has_key} AND known) AS s3",
        f"coalesce(sum(CASE WHEN {has_key} THEN n_included END), 0) AS s4",
    ]))
    steps = lines(
        {"sort_order": str(i), "step": quoted(step), "n_patients": f"s{i}"}
        for i, step in enumerate(k.ATTRITION_STEPS)
    )
    return counts.selectExpr(steps).orderBy("sort_order").select("step", "n_patients")


def attrition_drops(steps: DataFrame) -> DataFrame:
    """Adds the rows lost at each step; the step table has five rows."""
    before = F.lag("n_patients").over(Window.orderBy("step"))
    return steps.withColumn("n_dropped", before - F.col("n_patients")).orderBy("step")
