"""Declared schemas of the input tables and of the written products."""

from __future__ import annotations

from pyspark.sql.types import (
    BooleanType, DoubleType, IntegerType, LongType, StringType, StructField, StructType,
)

from cohortlab.functions import contract as k

_TYPES = {
    "long": LongType(), "int": IntegerType(), "double": DoubleType(),
    "string": StringType(), "boolean": BooleanType(),
}


def _schema(text: str) -> StructType:
    pairs = (part.split() for part in text.split(","))
    return StructType([StructField(name, _TYPES[kind]) for name, kind in pairs])


TABLES = {
    "patient": _schema(
        "patientunitstayid long, patienthealthsystemstayid long, hospitalid long,"
        "hospitaladmitoffset int, age string, gender string, admissionheight double,"
        "admissionweight double, unittype string, hospitaldischargestatus string,"
        "unitdischargeoffset int"
    ),
    "hospital": _schema(
        "hospitalid long, numbedscategory string, teachingstatus boolean, region string"
    ),
    "apachepatientresult": _schema(
        "patientunitstayid long, apacheversion string, apachescore int"
    ),
    "vitalperiodic": _schema(
        "patientunitstayid long, observationoffset int, heartrate double,"
        "systemicsystolic double, systemicdiastolic double, systemicmean double,"
        "respiration double, sao2 double, temperature double"
    ),
    "vitalaperiodic": _schema(
        "patientunitstayid long, observationoffset int, noninvasivesystolic double,"
        "noninvasivediastolic double, noninvasivemean double"
    ),
    "nursecharting": _schema(
        "patientunitstayid long, nursingchartoffset int, nursingchartcelltypevallabel string,"
        "nursingchartcelltypevalname string, nursingchartvalue string"
    ),
    "lab": _schema(
        "patientunitstayid long, labresultoffset int, labname string, labresult double"
    ),
}

SCORES = _schema("id long, y_true int, p double")
PREDICTIONS = _schema(f"{k.STAY_ID} long, y_true double, y_pred_proba double")


def feature_table() -> StructType:
    """The 102-column feature table, in contract order."""
    kinds = {k.STAY_ID: "long", k.TARGET: "int", "age": "int", "gender_male": "int"}
    fields = []
    for name in k.FEATURE_TABLE:
        if name in kinds:
            kind = kinds[name]
        elif name in k.CATEGORICAL:
            kind = "string"
        elif name.endswith("_missing"):
            kind = "boolean"
        elif name.endswith("_count"):
            kind = "long"
        else:
            kind = "double"
        fields.append(StructField(name, _TYPES[kind]))
    return StructType(fields)


def assert_schema(actual: StructType, expected: StructType) -> None:
    """Names, order and types must agree; nullability is not compared."""
    have = [(f.name, f.dataType) for f in actual]
    want = [(f.name, f.dataType) for f in expected]
    if have != want:
        odd = [(h, w) for h, w in zip(have, want) if h != w]
        raise ValueError(f"schema differs ({len(have)} vs {len(want)} columns): {odd[:5]}")
