"""The feature-table contract: names, order, ranges and label lists."""

from __future__ import annotations

# ---------------------------------------------------------------------------
# Source names, ranges (inclusive) and labels results depend on.
# ---------------------------------------------------------------------------
WINDOW_START = 0
WINDOW_END = 1440
MIN_AGE = 18
MIN_STAY_MINUTES = 1440
AGE_TOP_CODE = "> 89"
AGE_TOP_VALUE = 90
EVENT_STATUS = "Expired"
SEVERITY_VERSION = "IVa"
MISSING_LABEL = "(missing)"
NO_SEVERITY_LABEL = "5. (no Apache score)"

VITAL_RANGES = {
    "heartrate": (20, 300),
    "systemicsystolic": (40, 300),
    "systemicdiastolic": (20, 200),
    "systemicmean": (30, 200),
    "respiration": (4, 60),
    "sao2": (50, 100),
    "temperature": (28, 43),
}
ARTERIAL_COLUMNS = {"systemicsystolic": "sbp", "systemicdiastolic": "dbp", "systemicmean": "map"}
CUFF_COLUMNS = {"noninvasivesystolic": "sbp", "noninvasivediastolic": "dbp", "noninvasivemean": "map"}
LAB_RANGES = {
    "sodium": (110, 180),
    "potassium": (1.5, 9.0),
    "glucose": (20, 1500),
    "creatinine": (0.1, 25),
    "BUN": (1, 250),
    "Hgb": (3, 25),
    "WBC x 1000": (0.1, 200),
    "platelets x 1000": (1, 2000),
    "bicarbonate": (5, 50),
    "total bilirubin": (0.1, 50),
}
LAB_PREFIXES = {
    "sodium": "na",
    "potassium": "k",
    "glucose": "glucose",
    "creatinine": "creatinine",
    "BUN": "bun",
    "Hgb": "hgb",
    "WBC x 1000": "wbc",
    "platelets x 1000": "platelets",
    "bicarbonate": "hco3",
    "total bilirubin": "bilirubin",
}
COMA_RANGE = (3, 15)
BMI_RANGE = (12, 60)
HEIGHT_RANGE = (100, 220)
WEIGHT_RANGE = (30, 300)
CHART_TEMPERATURE = "Temperature (C)"
CHART_COMA = "GCS Total"
TEMPERATURE_WORDS = ("temp",)
COMA_WORDS = ("gcs", "glasgow")
BED_CATEGORIES = ("<100", "100 - 249", "250 - 499", ">= 500")
RISK_CUTS = (0.10, 0.25)
ATTRITION_STEPS = (
    "Step 0: All patient stays",
    "Step 1: First ICU stay per patient only",
    "Step 2: Adult patients (age >= 18 or > 89)",
    "Step 3: Non-missing discharge status",
    "Step 4: ICU stay >= 24 hours (final cohort)",
)
DEMO_FEATURES = (
    "age", "gender_male", "bmi", "gcs_mean", "hr_mean", "sbp_mean", "map_mean",
    "rr_mean", "spo2_mean", "temp_mean", "bun_max", "creatinine_max",
    "glucose_min", "wbc_mean",
)
STAY_ID = "patientunitstayid"
PATIENT_ID = "patienthealthsystemstayid"
TARGET = "in_hospital_mortality"
DEMOGRAPHIC_FEATURES = (
    "age", "gender_male", "admissionheight", "admissionweight", "bmi",
    "bmi_missing", "unittype", "numbedscategory", "teaching_hospital", "region",
)
CATEGORICAL = ("unittype", "numbedscategory", "region")
VITAL_PREFIXES = ("hr", "rr", "spo2", "sbp", "dbp", "map", "temp")
# ---------------------------------------------------------------------------

STATS = ("min", "max", "mean", "count", "missing")
VARIABLES = (*VITAL_PREFIXES, *LAB_PREFIXES.values(), "gcs")


def stat_columns(prefix: str) -> list[str]:
    return [f"{prefix}_{stat}" for stat in STATS]


FEATURES = [*DEMOGRAPHIC_FEATURES, *(c for p in VARIABLES for c in stat_columns(p))]
NUMERIC_FEATURES = [c for c in FEATURES if c not in CATEGORICAL]
FEATURE_TABLE = [STAY_ID, TARGET, *FEATURES]


def role(name: str) -> str:
    """Role of a feature-table column: id, target, categorical or numeric."""
    if name == STAY_ID:
        return "id"
    if name == TARGET:
        return "target"
    return "categorical" if name in CATEGORICAL else "numeric"
