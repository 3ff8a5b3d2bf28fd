import pytest

from cohortlab.operators import cohort as co
from cohortlab.plans import reports

SCHEMA = (
    "patientunitstayid long, patienthealthsystemstayid long, hospitalid long, hospitaladmitoffset int,"
    "age string, hospitaldischargestatus string, unitdischargeoffset int"
)
ROWS = [
    (1, 10, 1, -50, "40", "Alive", 2000),     # first by minimum, tied with 2
    (2, 10, 1, -50, "40", "Expired", 1440),   # tie: kept
    (3, 10, 1, -10, "40", "Alive", 2000),     # later stay
    (4, 11, 1, -5, "17", "Alive", 2000),      # minor
    (5, 12, 2, -5, "> 89", "Alive", 1439),    # too short
    (6, 13, 2, -5, "70", "", 2000),           # blank outcome
    (7, 14, 2, -5, "70", None, 2000),         # no outcome
    (8, 15, 2, -9, "16", "Alive", 2000),      # first stay fails, so the patient is out
    (9, 15, 2, -1, "30", "Alive", 2000),      # ... although a later stay would pass
    (10, None, 2, -9, "50", "Alive", 2000),   # no patient key
    (11, 16, 2, None, "50", "Alive", 2000),   # no offset
    (12, 17, 2, 0, "", "Alive", 2000),        # no age
    (13, 18, 3, 0, "> 89", "Expired", 5000),
]


@pytest.fixture(scope="module")
def patient(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


def ids(df):
    return sorted(r[0] for r in df.select("patientunitstayid").collect())


def test_ties_kept_and_rules_apply_after_first_stay(patient):
    assert ids(co.cohort(patient)) == [1, 2, 13]


def test_strict_keeps_one(patient):
    assert ids(co.cohort(patient, strict_one=True)) == [1, 13]


def test_latest_reading_of_the_offset(patient):
    assert ids(co.cohort(patient, pick="max")) == [3, 9, 13]
    assert ids(co.cohort(patient, pick="max", strict_one=True)) == [3, 9, 13]


def test_pick_is_checked(patient):
    with pytest.raises(ValueError):
        co.first_stays(patient, pick="mean")


def test_attrition_counts(patient):
    steps = [r.n_patients for r in co.attrition(patient).collect()]
    by_hand = [
        len(ROWS),
        9,   # distinct known patients
        7,   # 10, 12, 13, 14, 15, 16, 18
        5,   # without 13 and 14
        3,   # cohort rows, the tie counted twice
    ]
    assert steps == by_hand
    drops = [r.n_dropped for r in co.attrition_drops(co.attrition(patient)).collect()]
    assert drops == [None, 4, 2, 2, 2]


def test_attrition_of_no_rows(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert [r.n_patients for r in co.attrition(empty).collect()] == [0, 0, 0, 0, 0]


def test_check_row(patient):
    r = co.cohort_check(co.cohort(patient)).first()
    assert (r.cohort_size, r.deaths, r.mortality_rate_pct, r.hospitals_represented) == (3, 2, 66.67, 2)


def test_view_is_replaced(spark, patient):
    co.register_cohort(patient)
    co.register_cohort(patient.where("hospitalid = 3"))
    assert spark.sql("SELECT count(*) AS n FROM cohort").first().n == 1


def test_severity_fan_out_and_unscored(spark, patient):
    scores = spark.createDataFrame(
        [(1, "IVa", 20), (1, "IVa", 25), (1, "IVa", 95), (1, "IV", 70), (2, "IV", 40), (13, "IVa", None)],
        "patientunitstayid long, apacheversion string, apachescore int")
    got = {r.apache_group[0]: (r.n_patients, r.deaths) for r in
           reports.outcome_by_severity(co.cohort(patient), scores).collect()}
    assert got == {"1": (2, 0), "4": (1, 0), "5": (2, 2)}


def test_beds_skip_unknown_category_and_keep_size_order(spark, patient):
    hospital = spark.createDataFrame(
        [(1, ">= 500"), (2, None), (3, "<100")], "hospitalid long, numbedscategory string")
    rows = reports.outcome_by_beds(co.cohort(patient), hospital).collect()
    assert [(r.bed_category, r.n_patients, r.deaths, r.mortality_pct) for r in rows] == [
        ("<100", 1, 1, 100.0), (">= 500", 2, 1, 50.0)]
