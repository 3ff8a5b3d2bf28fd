"""The feature build on hand-made readings, and its invariants on the test tables."""

import pytest

from cohortlab.functions import contract as k
from cohortlab.plans import features as fe
from cohortlab.sources import standin
from cohortlab.sources.readers import Tables
from cohortlab.sources.schemas import TABLES, assert_schema, feature_table


def table(spark, name, rows):
    return spark.createDataFrame(rows, TABLES[name])


@pytest.fixture(scope="module")
def tables(spark):
    patient = [
        (s, 100 + s, 1, 0, "50", g, 180.0, 81.0, "ICU", "Alive", 2000)
        for s, g in ((1, "Male"), (2, "Female"), (3, None))
    ] + [(4, 104, 9, 0, "50", "Male", 99.0, 20.0, None, "Expired", 2000)]
    vital = [
        # stay, offset, hr, sbp, dbp, map, rr, spo2, temp
        (1, 0, 20.0, 120.0, 60.0, 80.0, 4.0, 50.0, 28.0),
        (1, 1440, 300.0, 300.0, 200.0, 200.0, 60.0, 100.0, 43.0),
        (1, 1441, 60.0, 100.0, 70.0, 90.0, 10.0, 90.0, 37.0),
        (1, -1, 60.0, 100.0, 70.0, 90.0, 10.0, 90.0, 37.0),
        (1, 5, 19.9, None, None, None, 60.1, 49.9, 43.1),
        (2, 10, None, 120.0, 10.0, 80.0, None, None, None),   # one bad component drops the row
        (2, 11, 300.1, 130.0, None, 85.0, None, None, None),  # a missing component does not
        (7, 10, 80.0, 120.0, 60.0, 80.0, 15.0, 97.0, 37.0),   # not in the cohort
    ]
    cuff = [(1, 30, 100.0, 50.0, 70.0), (2, 30, 39.0, 50.0, 70.0), (2, 40, None, 55.0, None)]
    chart = [
        (1, 0, "Temperature", "Temperature (C)", "36."),
        (1, 1, "Temperature", "Temperature (C)", "-1"),
        (1, 2, "Temperature", "Temperature (C)", "unable"),
        (1, 3, "Temperature", "Temperature (F)", "40"),
        (2, 1440, "Temperature", "Temperature (C)", "38.5"),
        (1, 5, "Glasgow", "GCS Total", "3"),
        (1, 6, "Glasgow", "GCS Total", "15"),
        (1, 7, "Glasgow", "GCS Total", "16"),
        (1, 8, "Glasgow", "GCS Motor", "6"),
        (2, 9, "Glasgow", "GCS Total", "-5"),
    ]
    lab = [
        (1, 0, "sodium", 110.0), (1, 1, "sodium", 140.0), (1, 2, "sodium", 109.9), (1, 3, "sodium", None),
        (1, 4, "BUN", 250.0), (1, 5, "magnesium", 2.0), (2, 1441, "potassium", 4.0), (2, 6, "potassium", 9.0),
    ]
    return Tables(
        patient=table(spark, "patient", patient),
        hospital=table(spark, "hospital", [(1, "<100", True, "West"), (2, None, None, None)]),
        apachepatientresult=table(spark, "apachepatientresult", []),
        vitalperiodic=table(spark, "vitalperiodic", vital),
        vitalaperiodic=table(spark, "vitalaperiodic", cuff),
        nursecharting=table(spark, "nursecharting", chart),
        lab=table(spark, "lab", lab),
    )


@pytest.fixture(scope="module")
def rows(tables):
    return {r[k.STAY_ID]: r.asDict() for r in fe.feature_table(tables).collect()}


def stats(row, p):
    return tuple(row[f"{p}_{s}"] for s in k.STATS)


NOTHING = (None, None, None, None, True)


def test_window_and_range_ends_are_inclusive(rows):
    assert stats(rows[1], "hr") == (20.0, 300.0, 160.0, 2, False)
    assert stats(rows[1], "rr") == (4.0, 60.0, 32.0, 2, False)
    assert stats(rows[1], "spo2") == (50.0, 100.0, 75.0, 2, False)


def test_pressure_joins_both_sources_and_drops_bad_rows(rows):
    assert stats(rows[1], "sbp") == (100.0, 300.0, pytest.approx(520 / 3), 3, False)
    assert stats(rows[2], "sbp") == (130.0, 130.0, 130.0, 1, False)
    assert stats(rows[2], "dbp") == (55.0, 55.0, 55.0, 1, False)
    assert stats(rows[2], "map") == (85.0, 85.0, 85.0, 1, False)


def test_temperature_joins_probe_and_chart(rows):
    assert stats(rows[1], "temp") == (28.0, 43.0, pytest.approx(107 / 3), 3, False)
    assert stats(rows[2], "temp") == (38.5, 38.5, 38.5, 1, False)


def test_labs_and_coma(rows):
    assert stats(rows[1], "na") == (110.0, 140.0, 125.0, 2, False)
    assert stats(rows[1], "bun") == (250.0, 250.0, 250.0, 1, False)
    assert stats(rows[2], "k") == (9.0, 9.0, 9.0, 1, False)
    assert stats(rows[1], "gcs") == (3.0, 15.0, 9.0, 2, False)
    assert stats(rows[2], "gcs") == NOTHING


def test_stay_without_readings_is_null_not_zero(rows):
    assert all(stats(rows[3], p) == NOTHING for p in k.VARIABLES)


def test_demographics(rows):
    assert rows[1]["bmi"] == pytest.approx(25.0) and rows[1]["bmi_missing"] is False
    assert [rows[i]["gender_male"] for i in (1, 2, 3)] == [1, 0, 0]
    # Index from the raw body measures, which are then removed as implausible.
    assert rows[4]["bmi"] == pytest.approx(20 / 0.99**2) and rows[4]["bmi_missing"] is False
    assert rows[4]["admissionheight"] is None and rows[4]["admissionweight"] is None
    assert rows[4]["region"] is None and rows[4]["teaching_hospital"] is None
    assert rows[1]["teaching_hospital"] == 1.0 and rows[4][k.TARGET] == 1


def test_heart_rate_first_pass(tables):
    from cohortlab.operators.cohort import cohort

    got = fe.heart_rate_first_pass(tables.vitalperiodic, cohort(tables.patient)).collect()
    assert [tuple(r) for r in got] == [(1, 20.0, 300.0, 160.0, 2)]


def test_schema_is_the_contract(tables):
    assert_schema(fe.feature_table(tables).schema, feature_table())


def test_invariants_on_the_test_tables(spark, small):
    df = fe.feature_table(standin.tables(spark, small)).persist()
    assert df.count() == df.select(k.STAY_ID).distinct().count() == 93
    for p in k.VARIABLES:
        bad = df.where(
            f"{p}_missing != ({p}_mean IS NULL) OR {p}_missing != ({p}_count IS NULL)"
            f" OR {p}_min > {p}_mean + 1e-9 OR {p}_mean > {p}_max + 1e-9 OR {p}_count <= 0"
        )
        assert bad.count() == 0, p
    df.unpersist()
