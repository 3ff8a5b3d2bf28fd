"""What the physical plans must and must not contain."""

import itertools
import re

import pytest
from pyspark.sql import functions as F

from cohortlab.plans import features as fe
from cohortlab.plans.catalog import QUERIES
from cohortlab.operators import cohort as co, metrics, ordered
from cohortlab.sources.readers import Tables
from cohortlab.sources.schemas import TABLES

RELATIONAL = [
    "attrition", "cohort", "outcome_by_beds", "outcome_by_apache", "top_labs", "discover_gcs",
    "features_final", "range_audit_vitals", "split_train_test", "roc_auc", "roc_points",
    "calibration", "f1_sweep", "batch_score_bands",
]


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def no_broadcast(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


@pytest.mark.parametrize("name", RELATIONAL)
def test_no_python_and_no_product(spark, small, no_broadcast, name):
    text = plan(QUERIES[name](spark, small))
    for banned in ("BatchEvalPython", "ArrowEvalPython", "MapInPandas", "CartesianProduct",
                   "BroadcastNestedLoopJoin", "BroadcastHashJoin"):
        assert banned not in text, banned


def stored_tables(spark):
    return Tables(**{n: spark.createDataFrame([], s) for n, s in TABLES.items()})


def test_each_source_is_aggregated_before_any_join(spark, small, no_broadcast, tmp_path):
    """Four measurement scans, each directly under a partial aggregate on the stay."""
    from cohortlab.sources import readers

    folder = str(tmp_path)
    for name, schema in TABLES.items():
        spark.createDataFrame([], schema).write.parquet(f"{folder}/{name}.parquet")
    text = plan(fe.feature_table(readers.read_parquet_tables(spark, folder)))
    for name in ("vitalperiodic", "vitalaperiodic", "nursecharting", "lab"):
        assert len(re.findall(rf"/{name}\.parquet\]", text)) == 1
    lines = text.split("\n")
    for i, line in enumerate(lines):
        if re.search(r"/(vital\w+|nursecharting|lab)\.parquet\]", line):
            above = [x for x in lines[:i] if "Exchange" in x or "HashAggregate" in x or "Join" in x]
            assert "partial_" in above[-1] and "Exchange" in above[-2]


def test_one_busy_patient_does_not_fill_one_task(spark, no_broadcast):
    """A patient with a third of all stays: correct cohort, rows spread by offset."""
    rows = spark.range(9000).selectExpr(
        "id AS patientunitstayid", "CASE WHEN id % 3 = 0 THEN 1 ELSE id END AS patienthealthsystemstayid",
        "id % 7 AS hospitalid", "cast(id % 900 AS int) AS hospitaladmitoffset", "'50' AS age",
        "'Alive' AS hospitaldischargestatus", "2000 AS unitdischargeoffset")
    members = co.cohort(rows)
    busy = members.where("patienthealthsystemstayid = 1")
    # Offsets of the busy patient: 0 is its minimum, at every 900th stay.
    assert busy.count() == rows.where("patienthealthsystemstayid = 1 AND hospitaladmitoffset = 0").count() == 10
    assert members.count() == 10 + 6000 - 1 + (0 if busy.where("patientunitstayid = 1").count() else 0)
    steps = [r.n_patients for r in co.attrition(rows).collect()]
    assert steps[0] == 9000 and steps[-1] == members.count()


def test_a_third_of_the_scores_on_one_value(spark):
    rows = spark.range(30000).selectExpr(
        "id", "cast(id % 4 = 0 AS int) AS y_true", "CASE WHEN id % 3 = 0 THEN 0.5D ELSE rand(7) END AS p").persist()
    r = metrics.ranking_quality(rows).first()
    stock = rows.groupBy("p").agg(F.sum("y_true").alias("t"), F.sum(1 - F.col("y_true")).alias("f")).orderBy(
        F.desc("p")).toPandas()
    above = stock["t"].cumsum() - stock["t"]
    want = (stock["f"] * (above + stock["t"] / 2)).sum() / (stock["t"].sum() * stock["f"].sum())
    assert r.roc_auc == pytest.approx(want, abs=1e-12)


@pytest.mark.parametrize("name", ["describe_vitals", "feature_defaults", "readings_per_stay", "roc_auc", "calibration"])
def test_sketches_are_merged_in_levels(spark, small, monkeypatch, name):
    """No task takes in the sketches of all map tasks: below an exchange to one partition
    sketches have met twice already."""
    monkeypatch.setattr(ordered, "ONE_BUCKET", 0)
    lines = plan(QUERIES[name](spark, small)).split("\n")
    assert not any("percentile_approx" in x for x in lines)
    single = [i for i, x in enumerate(lines) if "SinglePartition" in x and "kll" in lines[i + 1]]
    assert single
    for i in single:
        depth = len(lines[i]) - len(lines[i].lstrip(" :+-"))
        below = itertools.takewhile(lambda x: len(x) - len(x.lstrip(" :+-")) > depth, lines[i + 1:])
        assert sum("kll_sketch_agg_double" in x or "kll_merge_agg_double" in x for x in below if "Exchange" not in x) >= 5
