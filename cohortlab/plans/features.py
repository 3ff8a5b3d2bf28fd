"""The first-day feature table: one row per stay, 102 columns.

Each measurement table is read once and reduced by stay in one wide aggregate
with map-side partials, so a stay with very many readings costs no more in the
shuffle than any other. The left joins onto the cohort come last and do the
cohort restriction too: no raw reading is ever shuffled for a join. All
aggregates and the base hash on the stay id, so the joins add one exchange, for
the base.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame

from cohortlab.functions import contract as k
from cohortlab.functions.columns import (
    bmi, died, exprs, in_range, indicator, keep_in_range, number_from_text, quoted,
)
from cohortlab.operators.cohort import cohort
from cohortlab.operators.readings import (
    combine4, contract_columns, first_day, partial4, restrict, stats4,
)
from cohortlab.sources.readers import Tables

DIRECT_VITALS = {"heartrate": "hr", "respiration": "rr", "sao2": "spo2"}
PRESSURE_RANGES = {prefix: k.VITAL_RANGES[source] for source, prefix in k.ARTERIAL_COLUMNS.items()}
LABS = list(k.LAB_PREFIXES.values())


def raw_demographics(members: DataFrame, hospital: DataFrame) -> DataFrame:
    """Cohort with hospital columns and the unchecked body-mass index."""
    joined = members.join(hospital, "hospitalid", "left")
    return joined.selectExpr("*", f"{bmi('admissionweight', 'admissionheight')} AS bmi")


def demographics(members: DataFrame, hospital: DataFrame) -> DataFrame:
    """Twelve columns per stay; implausible body measures become NULL.

    The index comes from the raw height and weight, before those are cleaned.
    """
    male = "gender = 'Male'"
    return raw_demographics(members, hospital).selectExpr(
        k.STAY_ID,
        "age_numeric AS age",
        f"{indicator(male)} AS gender_male",
        f"{keep_in_range('admissionheight', k.HEIGHT_RANGE)} AS admissionheight",
        f"{keep_in_range('admissionweight', k.WEIGHT_RANGE)} AS admissionweight",
        f"{keep_in_range('bmi', k.BMI_RANGE)} AS bmi",
        f"NOT coalesce({in_range('bmi', k.BMI_RANGE)}, false) AS bmi_missing",
        "unittype",
        "numbedscategory",
        "cast(teachingstatus AS double) AS teaching_hospital",
        "region",
        f"{died()} AS {k.TARGET}",
    )


def heart_rate_readings(vitalperiodic: DataFrame) -> DataFrame:
    """The first, heart-rate-only pull: positive readings of the first day."""
    return first_day(vitalperiodic, "observationoffset").where("heartrate > 0")


def heart_rate_first_pass(vitalperiodic: DataFrame, members: DataFrame) -> DataFrame:
    kept = heart_rate_readings(vitalperiodic).where(in_range("heartrate", k.VITAL_RANGES["heartrate"]))
    return restrict(kept.groupBy(k.STAY_ID).agg(*exprs(stats4("heartrate", "hr"))), members)


def pressure_partials(sources: Mapping[str, str], tag: str) -> list[str]:
    """Every component of a row is in range or missing; one bad value drops the row."""
    ok = " AND ".join(f"({c} IS NULL OR {in_range(c, PRESSURE_RANGES[p])})" for c, p in sources.items())
    return [text for c, p in sources.items() for text in partial4(c, f"{tag}_{p}", ok)]


def periodic_by_stay(vitalperiodic: DataFrame, blocks: Sequence[str] = ("direct", "pressure", "temp")) -> DataFrame:
    """Every statistic that comes from the continuous vitals, in one pass."""
    parts: list[str] = []
    if "direct" in blocks:
        for column, prefix in DIRECT_VITALS.items():
            parts += stats4(column, prefix, in_range(column, k.VITAL_RANGES[column]))
    if "pressure" in blocks:
        parts += pressure_partials(k.ARTERIAL_COLUMNS, "line")
    if "temp" in blocks:
        parts += partial4("temperature", "probe_temp", in_range("temperature", k.VITAL_RANGES["temperature"]))
    return first_day(vitalperiodic, "observationoffset").groupBy(k.STAY_ID).agg(*exprs(parts))


def aperiodic_by_stay(vitalaperiodic: DataFrame) -> DataFrame:
    readings = first_day(vitalaperiodic, "observationoffset")
    return readings.groupBy(k.STAY_ID).agg(*exprs(pressure_partials(k.CUFF_COLUMNS, "cuff")))


def charting_by_stay(nursecharting: DataFrame, blocks: Sequence[str] = ("temp", "gcs")) -> DataFrame:
    """Charted temperature and coma score, parsed from text, in one pass."""
    name, text = "nursingchartcelltypevalname", "nursingchartvalue"
    chosen = {"temp": k.CHART_TEMPERATURE, "gcs": k.CHART_COMA}
    listed = ", ".join(quoted(chosen[b]) for b in blocks)
    charted = first_day(nursecharting, "nursingchartoffset").where(f"{name} IN ({listed})").selectExpr(
        k.STAY_ID,
        f"CASE WHEN {name} = {quoted(chosen['temp'])} THEN {number_from_text(text)} END AS _temp",
        f"CASE WHEN {name} = {quoted(chosen['gcs'])} THEN {number_from_text(text, signed=False)} END AS _gcs",
    )
    parts: list[str] = []
    if "temp" in blocks:
        parts += partial4("_temp", "chart_temp", in_range("_temp", k.VITAL_RANGES["temperature"]))
    if "gcs" in blocks:
        parts += stats4("_gcs", "gcs", in_range("_gcs", k.COMA_RANGE))
    return charted.groupBy(k.STAY_ID).agg(*exprs(parts))


def labs_by_stay(lab: DataFrame) -> DataFrame:
    """The ten labs, long to wide; the list of names is fixed, so no pivot pass."""
    listed = ", ".join(quoted(n) for n in k.LAB_PREFIXES)
    chosen = first_day(lab, "labresultoffset").where(f"labname IN ({listed}) AND labresult IS NOT NULL")
    parts = []
    for name, prefix in k.LAB_PREFIXES.items():
        keep = f"labname = {quoted(name)} AND {in_range('labresult', k.LAB_RANGES[name])}"
        parts += stats4("labresult", prefix, keep)
    return chosen.groupBy(k.STAY_ID).agg(*exprs(parts))


def _plain(prefixes: Sequence[str]) -> list[str]:
    return [f"{p}_{s}" for p in prefixes for s in k.STATS[:4]]


def pressure_variables() -> list[str]:
    return [text for p in PRESSURE_RANGES for text in combine4(p, f"line_{p}", f"cuff_{p}")]


def _block(members: DataFrame, frames: Sequence[DataFrame], variables: Sequence[str], prefixes: Sequence[str]) -> DataFrame:
    """Aggregates left-joined onto the members; five contract columns per variable."""
    joined = members.select(k.STAY_ID)
    for frame in frames:
        joined = joined.join(frame, k.STAY_ID, "left")
    flags = [text for p in prefixes for text in contract_columns(p)]
    return joined.selectExpr(k.STAY_ID, *variables).selectExpr(k.STAY_ID, *flags)


def vitals_features(t: Tables, members: DataFrame) -> DataFrame:
    """Heart rate, respiration and saturation: 15 columns per stay."""
    prefixes = list(DIRECT_VITALS.values())
    return _block(members, [periodic_by_stay(t.vitalperiodic, ("direct",))], _plain(prefixes), prefixes)


def pressure_features(t: Tables, members: DataFrame) -> DataFrame:
    """Arterial and cuff pressure together: 15 columns per stay."""
    frames = [periodic_by_stay(t.vitalperiodic, ("pressure",)), aperiodic_by_stay(t.vitalaperiodic)]
    return _block(members, frames, pressure_variables(), list(PRESSURE_RANGES))


def temperature_features(t: Tables, members: DataFrame) -> DataFrame:
    """Continuous and charted temperature together: 5 columns per stay."""
    frames = [periodic_by_stay(t.vitalperiodic, ("temp",)), charting_by_stay(t.nursecharting, ("temp",))]
    return _block(members, frames, combine4("temp", "probe_temp", "chart_temp"), ["temp"])


def lab_features(t: Tables, members: DataFrame) -> DataFrame:
    """Ten labs: 50 columns per stay."""
    return _block(members, [labs_by_stay(t.lab)], _plain(LABS), LABS)


def coma_features(t: Tables, members: DataFrame) -> DataFrame:
    """Charted coma score: 5 columns per stay."""
    return _block(members, [charting_by_stay(t.nursecharting, ("gcs",))], _plain(["gcs"]), ["gcs"])


def feature_table(t: Tables, members: DataFrame | None = None) -> DataFrame:
    """All 102 columns in contract order."""
    members = cohort(t.patient) if members is None else members
    joined = demographics(members, t.hospital)
    for frame in (
        periodic_by_stay(t.vitalperiodic),
        aperiodic_by_stay(t.vitalaperiodic),
        charting_by_stay(t.nursecharting),
        labs_by_stay(t.lab),
    ):
        joined = joined.join(frame, k.STAY_ID, "left")
    base = [k.STAY_ID, k.TARGET, *k.DEMOGRAPHIC_FEATURES]
    combined = joined.selectExpr(
        *base,
        *_plain([*DIRECT_VITALS.values(), *LABS, "gcs"]),
        *pressure_variables(),
        *combine4("temp", "probe_temp", "chart_temp"),
    )
    return combined.selectExpr(*base, *[text for p in k.VARIABLES for text in contract_columns(p)])
