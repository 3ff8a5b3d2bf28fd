"""Reference SQL for the checks, written for DuckDB on the raw test tables.

Only the stand-in table definitions are shared with the package. The rest is
written on its own, in other forms: correlated subqueries, QUALIFY, global
windows, list functions.
"""

from __future__ import annotations

from cohortlab.sources.standin import CELLS, select_text

_COHORT = """
select p.*, try_cast(case when age = '> 89' then '90'
                          when regexp_full_match(age, '[0-9]+') then age end as integer) as age_numeric
from patient p
where p.hospitaladmitoffset = (select min(q.hospitaladmitoffset) from patient q
                               where q.patienthealthsystemstayid = p.patienthealthsystemstayid)
  and (age = '> 89' or (regexp_full_match(age, '[0-9]+') and try_cast(age as integer) >= 18))
  and length(hospitaldischargestatus) > 0 and unitdischargeoffset >= 1440
"""

_DEMO = """
select c.patientunitstayid, age_numeric as age, (case when gender = 'Male' then 1 else 0 end)::int as gender_male,
       case when admissionheight >= 100 and admissionheight <= 220 then admissionheight end as admissionheight,
       case when admissionweight >= 30 and admissionweight <= 300 then admissionweight end as admissionweight,
       case when b >= 12 and b <= 60 then b end as bmi,
       (b is null or b < 12 or b > 60) as bmi_missing,
       unittype, numbedscategory,
       case teachingstatus when true then 1.0::double when false then 0.0::double end as teaching_hospital,
       region, (case when hospitaldischargestatus = 'Expired' then 1 else 0 end)::int as in_hospital_mortality
from (select *, admissionweight / nullif((admissionheight / 100.0::double) * (admissionheight / 100.0::double), 0) as b
      from cohort) c left join hospital h on c.hospitalid = h.hospitalid
"""

_LABS = [
    ("sodium", "na", 110, 180), ("potassium", "k", 1.5, 9), ("glucose", "glucose", 20, 1500),
    ("creatinine", "creatinine", 0.1, 25), ("BUN", "bun", 1, 250), ("Hgb", "hgb", 3, 25),
    ("WBC x 1000", "wbc", 0.1, 200), ("platelets x 1000", "platelets", 1, 2000),
    ("bicarbonate", "hco3", 5, 50), ("total bilirubin", "bilirubin", 0.1, 50),
]
_VITALS = [
    ("heartrate", 20, 300), ("systemicsystolic", 40, 300), ("systemicdiastolic", 20, 200),
    ("systemicmean", 30, 200), ("respiration", 4, 60), ("sao2", 50, 100), ("temperature", 28, 43),
]
_ORDER = ["hr", "rr", "spo2", "sbp", "dbp", "map", "temp", *(x[1] for x in _LABS), "gcs"]
_CATEGORIES = ["unittype", "numbedscategory", "region"]
_DEMO_FEATURES = [
    "age", "gender_male", "bmi", "gcs_mean", "hr_mean", "sbp_mean", "map_mean", "rr_mean",
    "spo2_mean", "temp_mean", "bun_max", "creatinine_max", "glucose_min", "wbc_mean",
]


def _long_values() -> str:
    """Every accepted reading as (stay, variable, value), one branch per source."""
    parts = []
    for column, prefix, lo, hi in (("heartrate", "hr", 20, 300), ("respiration", "rr", 4, 60), ("sao2", "spo2", 50, 100)):
        parts.append(
            f"select patientunitstayid as s, '{prefix}' as var, {column} as v from vitalperiodic"
            f" where observationoffset between 0 and 1440 and {column} between {lo} and {hi}"
        )
    bp = (
        "select patientunitstayid as s, observationoffset as o, systemicsystolic as sbp,"
        " systemicdiastolic as dbp, systemicmean as map from vitalperiodic union all"
        " select patientunitstayid, observationoffset, noninvasivesystolic, noninvasivediastolic,"
        " noninvasivemean from vitalaperiodic"
    )
    ok = (
        "o between 0 and 1440 and coalesce(sbp between 40 and 300, true)"
        " and coalesce(dbp between 20 and 200, true) and coalesce(map between 30 and 200, true)"
    )
    for c in ("sbp", "dbp", "map"):
        parts.append(f"select s, '{c}' as var, {c} as v from ({bp}) where {ok} and {c} is not null")
    parts.append(
        "select patientunitstayid, 'temp', temperature from vitalperiodic"
        " where observationoffset between 0 and 1440 and temperature between 28 and 43"
    )
    chart = (
        "select patientunitstayid as s, '{var}' as var, try_cast(nursingchartvalue as double) as v from nursecharting"
        " where nursingchartoffset between 0 and 1440 and nursingchartcelltypevalname = '{name}'"
        " and regexp_full_match(nursingchartvalue, '{pattern}')"
        " and try_cast(nursingchartvalue as double) between {lo} and {hi}"
    )
    parts.append(chart.format(var="temp", name="Temperature (C)", pattern="-?[0-9]+[.]?[0-9]*", lo=28, hi=43))
    parts.append(chart.format(var="gcs", name="GCS Total", pattern="[0-9]+[.]?[0-9]*", lo=3, hi=15))
    for name, prefix, lo, hi in _LABS:
        parts.append(
            f"select patientunitstayid, '{prefix}', labresult from lab where labresultoffset between 0 and 1440"
            f" and labname = '{name}' and labresult between {lo} and {hi}"
        )
    return " union all ".join(parts)


def _block(prefixes: list[str], base: str = "cohort", extra: str = "") -> str:
    cells = []
    for p in prefixes:
        for stat, f in (("min", "min"), ("max", "max"), ("mean", "avg")):
            cells.append(f"round(round({f}(v) filter (where var = '{p}'), 9), 6) as {p}_{stat}")
        cells.append(f"nullif(count(v) filter (where var = '{p}'), 0) as {p}_count")
        cells.append(f"count(v) filter (where var = '{p}') = 0 as {p}_missing")
    return (
        f"select b.patientunitstayid{extra}, {', '.join(cells)} from {base} b left join readings r"
        f" on r.s = b.patientunitstayid group by b.patientunitstayid{extra}"
    )


def _features(round_means: bool = True) -> str:
    names = "in_hospital_mortality age gender_male admissionheight admissionweight bmi bmi_missing" \
            " unittype numbedscategory teaching_hospital region".split()
    if round_means:
        cells = [f"round({n}, 6) as {n}" if n in ("bmi", "admissionweight") else n for n in names]
        inner = f"(select patientunitstayid, {', '.join(cells)} from demo)"
    else:
        inner = "demo"
    text = _block(_ORDER, inner, "".join(f", b.{n}" for n in names))
    if not round_means:
        text = text.replace("round(", "(").replace(", 9)", ")").replace(", 6)", ")")
    return text


_CTE = {
    **{t: select_text(t).replace("float", "double") for t in CELLS},
    "cohort": _COHORT,
    "demo": _DEMO,
    "readings": _long_values(),
    "features": _features(),
    "raw_features": _features(False),
}
_NEEDS = {
    "cohort": ["patient"],
    "demo": ["cohort", "hospital"],
    "readings": ["vitalperiodic", "vitalaperiodic", "nursecharting", "lab"],
    "features": ["demo", "readings"],
    "raw_features": ["demo", "readings"],
}


def _closure(names: list[str]) -> list[str]:
    out: list[str] = []
    for n in names:
        for m in [*_closure(_NEEDS.get(n, [])), n]:
            if m not in out:
                out.append(m)
    return out


def _with(names: str, body: str, extra: str = "") -> str:
    ctes = [f"{n} as ({_CTE[n]})" for n in _closure(names.split())]
    if extra:
        ctes.append(extra)
    return f"with {', '.join(ctes)} {body}"


_RATE = (
    "count(*) as n_patients, sum(case when {e} then 1 else 0 end)::bigint as deaths,"
    " round(100.0 * sum(case when {e} then 1 else 0 end) / count(*), 2)::double as mortality_pct"
)
_DIED = _RATE.format(e="hospitaldischargestatus = 'Expired'")


def _mix(column: str, label: str) -> str:
    return _with("hospital", f"""select coalesce({column}::varchar, '(missing)') as {label},
        count(*) as hospital_count from hospital group by {column}""")


_ATTRITION = """
select 0 as i, 'Step 0: All patient stays' as step, count(*) as n_patients from patient
union all select 1, 'Step 1: First ICU stay per patient only', count(distinct patienthealthsystemstayid) from patient
union all select 2, 'Step 2: Adult patients (age >= 18 or > 89)', count(distinct patienthealthsystemstayid) from patient
  where age = '> 89' or (regexp_full_match(age, '[0-9]+') and try_cast(age as int) >= 18)
union all select 3, 'Step 3: Non-missing discharge status', count(distinct patienthealthsystemstayid) from patient
  where (age = '> 89' or (regexp_full_match(age, '[0-9]+') and try_cast(age as int) >= 18))
    and hospitaldischargestatus is not null and hospitaldischargestatus != ''
union all select 4, 'Step 4: ICU stay >= 24 hours (final cohort)', count(*) from cohort
"""


def _discover(words: list[str], order: str, patients: str, n: int) -> str:
    likes = " or ".join(
        f"lower({c}) like '%{w}%'" for w in words
        for c in ("nursingchartcelltypevallabel", "nursingchartcelltypevalname")
    )
    return _with("cohort nursecharting", f"""
        select nursingchartcelltypevallabel, nursingchartcelltypevalname, count(*) as n_readings{patients}
        from nursecharting nc join cohort c using (patientunitstayid)
        where nursingchartoffset between 0 and 1440 and ({likes})
        group by all order by {order}, 1, 2 limit {n}""")


def _describe(values: str, names: str, extra: str = "") -> str:
    return _with(names, f"""
        select variable, count(v) as count, round(round(avg(v), 9), 6) as mean, round(round(stddev_samp(v), 9), 6) as std,
               round(min(v), 6) as min, round(round(quantile_cont(v, 0.25), 9), 6) as p25,
               round(round(quantile_cont(v, 0.5), 9), 6) as p50, round(round(quantile_cont(v, 0.75), 9), 6) as p75,
               round(max(v), 6) as max
        from ({values}) where v is not null group by variable""", extra)


def _range_rows(column: str, variable: str, lo: float, hi: float, source: str) -> str:
    return f"""select '{variable}' as variable, count(*) filter (where {column} < {lo}) as too_low,
        count(*) filter (where {column} > {hi}) as too_high,
        count(*) filter (where {column} >= {lo} and {column} <= {hi}) as in_range,
        count(*) filter (where {column} is null) as missing,
        coalesce(round(100.0 * count(*) filter (where {column} >= {lo} and {column} <= {hi})
                 / nullif(count({column}), 0), 2), 0)::double as pct_in_range from ({source})"""


_PERIODIC = "select v.* from vitalperiodic v semi join cohort c using (patientunitstayid) where observationoffset between 0 and 1440"
_CUFF = "select v.* from vitalaperiodic v semi join cohort c using (patientunitstayid) where observationoffset between 0 and 1440"
_LABROWS = "select l.* from lab l semi join cohort c using (patientunitstayid) where labresultoffset between 0 and 1440"


def _coverage(columns: list[str], source: str, names: str) -> str:
    return _with(names, " union all ".join(
        f"select '{c}' as variable, count({c}) as n_non_null,"
        f" round(100.0 * count({c}) / count(*), 1)::double as pct from ({source})" for c in columns
    ))


def _dtype(name: str) -> str:
    if name == "patientunitstayid" or name.endswith("_count"):
        return "bigint"
    if name in ("in_hospital_mortality", "age", "gender_male"):
        return "int"
    if name in _CATEGORIES:
        return "string"
    return "boolean" if name.endswith("_missing") else "double"


_FEATURE_COLUMNS = [
    "patientunitstayid", "in_hospital_mortality", "age", "gender_male", "admissionheight", "admissionweight",
    "bmi", "bmi_missing", "unittype", "numbedscategory", "teaching_hospital", "region",
    *(f"{p}_{s}" for p in _ORDER for s in ("min", "max", "mean", "count", "missing")),
]
_NUMERIC = [c for c in _FEATURE_COLUMNS[2:] if c not in _CATEGORIES]


def _role(name: str) -> str:
    fixed = {"patientunitstayid": "id", "in_hospital_mortality": "target"}
    return fixed.get(name, "categorical" if name in _CATEGORIES else "numeric")


# --- splits ---
_LABELLED = "select patientunitstayid, (hospitaldischargestatus is not distinct from 'Expired')::int as in_hospital_mortality from cohort"
_SPLIT = f"""labelled as ({_LABELLED}),
splitted as (select *, case when row_number() over (partition by in_hospital_mortality
        order by md5('42:' || patientunitstayid), patientunitstayid)
      <= floor(0.2::double * count(*) over (partition by in_hospital_mortality) + 0.5::double)
    then 'test' else 'train' end as split from labelled),
validated as (select *, split = 'train' and row_number() over (partition by split, in_hospital_mortality
        order by md5('42/validation:' || patientunitstayid), patientunitstayid)
      <= floor(0.2::double * count(*) over (partition by split, in_hospital_mortality) + 0.5::double)
    as is_validation from splitted)"""

# --- scores: cumulative counts over all rows at once ---
_CURVE = """levels as (select p as threshold, sum(y_true) as tp, sum(1 - y_true) as fp from scores group by p),
curve as (select *, sum(tp) over (order by threshold desc) as ctp, sum(fp) over (order by threshold desc) as cfp,
    sum(tp) over () as np, sum(fp) over () as nn, lead(tp) over (order by threshold desc) as ntp,
    lead(fp) over (order by threshold desc) as nfp, row_number() over (order by threshold desc) as rn from levels),
roc as (select 'Infinity'::double as threshold, 0.0::double as fpr, 0.0::double as tpr
    union all select threshold, cfp::double / nn, ctp::double / np from curve
    where rn = 1 or ntp is null or ntp <> tp or nfp <> fp),
youden as (select * from roc order by tpr - fpr desc, threshold desc limit 1),
sens as (select * from roc order by abs(tpr - 0.8::double), threshold desc limit 1),
grid as (select case when i = 99 then 0.99::double else 0.01::double + i * ((0.99::double - 0.01::double) / 99) end as t
    from range(100) r(i)),
swept as (select t, sum((p < t and y_true = 0)::int) as tn, sum((p >= t and y_true = 0)::int) as fp,
    sum((p < t and y_true = 1)::int) as fn, sum((p >= t and y_true = 1)::int) as tp from grid, scores group by t),
f1 as (select t as threshold, coalesce(2 * tp::double / nullif(2 * tp + fp + fn, 0), 0) as f1 from swept
    order by f1 desc, t limit 1),
picked as (select 'Youden''s J' as strategy, threshold from youden
    union all select '80% sensitivity', threshold from sens union all select 'Max F1', threshold from f1),
confused as (select strategy, threshold, count(*) filter (where p < threshold and y_true = 0) as tn,
    count(*) filter (where p >= threshold and y_true = 0) as fp,
    count(*) filter (where p < threshold and y_true = 1) as fn,
    count(*) filter (where p >= threshold and y_true = 1) as tp from picked, scores group by strategy, threshold)"""


def _auc(source: str, by: str = "", digits: int = 6) -> str:
    """Rank form: mean rank of the positives against all rows, ties averaged."""
    part = f"partition by {by}" if by else ""
    sel = f"{by}, " if by else ""
    group = f"group by {by}" if by else ""
    return f"""select {sel}count(*) as n, sum(y_true)::bigint as n_pos,
        case when sum(y_true) > 0 and sum(1 - y_true) > 0 then
          round((sum(case when y_true = 1 then r end) - sum(y_true) * (sum(y_true) + 1) / 2.0)::double
            / (sum(y_true)::double * sum(1 - y_true)), {digits}) end as roc_auc,
        case when sum(y_true) > 0 and sum(1 - y_true) > 0 then
          round(sum(case when y_true = 1 then pr end) / sum(y_true), {digits}) end as average_precision
      from (select *, rank() over ({part} order by p) + (count(*) over (partition by {by + ', ' if by else ''}p) - 1) / 2.0 as r,
              avg(y_true) over ({part} order by p desc range between unbounded preceding and current row) as pr
            from ({source})) {group}"""


_REPORT = """one as (select * from confused where strategy = 'Youden''s J'),
cls as (select 'alive' as label, tn::double as hit, (tn + fn)::double as called, (tn + fp)::double as actual from one
        union all select 'dead', tp, tp + fp, tp + fn from one),
per as (select label, coalesce(hit / nullif(called, 0), 0) as precision, coalesce(hit / nullif(actual, 0), 0) as recall,
        coalesce(2 * hit / nullif(called + actual, 0), 0) as f1, actual as support, hit from cls)"""

ORACLE: dict[str, str] = {
    "dataset_scale": _with("patient", """select count(distinct patienthealthsystemstayid) as unique_patients,
        count(distinct patientunitstayid) as unique_icu_stays,
        count(distinct hospitalid) as hospitals_with_patients from patient"""),
    "hospital_reference_count": _with("hospital", "select count(*) as hospitals_in_reference_table from hospital"),
    "discharge_distribution": _with("patient", """select coalesce(hospitaldischargestatus, '(missing)') as discharge_status,
        count(*) as n, round(100.0 * count(*) / sum(count(*)) over (), 2)::double as percentage
        from patient group by hospitaldischargestatus"""),
    "hospital_by_teaching": _mix("teachingstatus", "teaching_status"),
    "hospital_by_beds": _mix("numbedscategory", "bed_category"),
    "hospital_by_region": _mix("region", "region"),
    "cohort": _with("cohort", "select * from cohort"),
    "cohort_latest": _with("patient", f"""select patientunitstayid, patienthealthsystemstayid from
        ({_COHORT.replace('select min(', 'select max(')})"""),
    "cohort_one_stay": _with("patient", """select patientunitstayid, patienthealthsystemstayid from
        (select * from patient where patienthealthsystemstayid is not null and hospitaladmitoffset is not null
         qualify row_number() over (partition by patienthealthsystemstayid
                                    order by hospitaladmitoffset, patientunitstayid) = 1)
        where (age = '> 89' or (regexp_full_match(age, '[0-9]+') and try_cast(age as int) >= 18))
          and length(hospitaldischargestatus) > 0 and unitdischargeoffset >= 1440"""),
    "cohort_check": _with("cohort", """select count(*) as cohort_size,
        count(*) filter (where hospitaldischargestatus = 'Expired') as deaths,
        round(100.0 * count(*) filter (where hospitaldischargestatus = 'Expired') / count(*), 2)::double as mortality_rate_pct,
        count(distinct hospitalid) as hospitals_represented from cohort"""),
    "attrition": _with("cohort", f"select step, n_patients from ({_ATTRITION})"),
    "attrition_drops": _with("cohort", f"""select step, n_patients,
        lag(n_patients) over (order by i) - n_patients as n_dropped from ({_ATTRITION})"""),
    "demographics_overview": _with("cohort", """select round(avg(age_numeric), 1) as mean_age,
        round(stddev(age_numeric), 1) as sd_age, min(age_numeric) as min_age, max(age_numeric) as max_age,
        sum((gender = 'Male')::int)::bigint as n_male, sum((gender = 'Female')::int)::bigint as n_female,
        count(*) - count(*) filter (where gender in ('Male', 'Female')) as n_other_unknown,
        round(avg(admissionweight / nullif((admissionheight / 100.0::double) * (admissionheight / 100.0::double), 0)), 1)
          as mean_bmi from cohort"""),
    "outcome_by_age_case": _with("cohort", f"""select case when age_numeric < 40 then '1. <40'
        when age_numeric < 55 then '2. 40-54' when age_numeric < 70 then '3. 55-69'
        when age_numeric < 85 then '4. 70-84' else '5. 85+' end as age_group, {_DIED} from cohort group by 1"""),
    "outcome_by_age_cut": _with("cohort", f"""select b.label as age_group, {_DIED} from cohort join
        (values (0, 40, '<40'), (40, 55, '40-54'), (55, 70, '55-69'), (70, 85, '70-84'), (85, 100, '85+')) b(lo, hi, label)
        on age_numeric >= lo and age_numeric < hi group by 1"""),
    "outcome_by_gender": _with("cohort", f"select gender, {_DIED} from cohort group by 1 having gender in ('Male', 'Female')"),
    "outcome_by_beds": _with("cohort hospital", f"""select numbedscategory as bed_category, {_DIED}
        from cohort join hospital using (hospitalid) where numbedscategory is not null group by 1"""),
    "outcome_by_apache": _with("cohort apachepatientresult", f"""select case when apachescore < 30 then '1. <30 (low)'
        when apachescore < 60 then '2. 30-59 (moderate)' when apachescore < 90 then '3. 60-89 (high)'
        when apachescore is not null then '4. 90+ (very high)' else '5. (no Apache score)' end as apache_group, {_DIED}
        from cohort c left join apachepatientresult a
          on c.patientunitstayid = a.patientunitstayid and a.apacheversion = 'IVa' group by 1"""),
    "outcome_by_hr_missing": _with("cohort vitalperiodic", f"""select not exists (select 1 from vitalperiodic v
          where v.patientunitstayid = c.patientunitstayid and v.observationoffset between 0 and 1440
            and v.heartrate between 20 and 300) as hr_missing, {_DIED} from cohort c group by 1"""),
    "outcome_by_bed_feature": _with("cohort hospital", """select numbedscategory, count(*) as n_patients,
        sum((hospitaldischargestatus = 'Expired')::int)::bigint as deaths,
        printf('%.2f%%', 100.0 * avg((hospitaldischargestatus = 'Expired')::int)) as mortality_text
        from cohort left join hospital using (hospitalid) group by 1"""),
    "discover_temperature": _discover(["temp"], "n_readings desc", "", 10),
    "discover_gcs": _discover(["gcs", "glasgow"], "n_patients desc", ", count(distinct nc.patientunitstayid) as n_patients", 15),
    "top_labs": _with("cohort lab", f"""select labname, count(*) as n_results, count(distinct patientunitstayid) as n_patients
        from ({_LABROWS}) group by 1 order by n_patients desc, 1 limit 30"""),
    "lab_result_counts": _with("cohort lab", f"""select labname, count(labresult) as n_results,
        count(distinct patientunitstayid) as n_patients from ({_LABROWS})
        where labresult is not null and labname in ({', '.join(f"'{x[0]}'" for x in _LABS)}) group by 1"""),
    "features_demographics": _with("demo", """select * replace (round(bmi, 6) as bmi,
        round(admissionweight, 6) as admissionweight) from demo"""),
    "hr_first_pass": _with("cohort vitalperiodic", """select patientunitstayid, round(min(heartrate), 6) as hr_min,
        round(max(heartrate), 6) as hr_max, round(round(avg(heartrate), 9), 6) as hr_mean, count(*) as hr_count
        from cohort join vitalperiodic using (patientunitstayid)
        where observationoffset between 0 and 1440 and heartrate > 0 and heartrate between 20 and 300 group by 1"""),
    "vitals_features": _with("cohort readings", _block(["hr", "rr", "spo2"])),
    "bp_features": _with("cohort readings", _block(["sbp", "dbp", "map"])),
    "temp_features": _with("cohort readings", _block(["temp"])),
    "lab_features": _with("cohort readings", _block([x[1] for x in _LABS])),
    "gcs_features": _with("cohort readings", _block(["gcs"])),
    "features_final": _with("features", "select * from features"),
    "feature_contract": _with("features", " union all ".join(
        f"select {i} as position, '{c}' as name, '{_role(c)}' as role, count({c}) as n_present from features"
        for i, c in enumerate(_FEATURE_COLUMNS)
    )).replace("features as (", "features as materialized (", 1),
    "extreme_bmi": _with("cohort", """select side, patientunitstayid, admissionheight,
        round(admissionweight, 6) as admissionweight, round(bmi, 6) as bmi from (
          select *, unnest([case when hi <= 5 then 'largest' end, case when lo <= 5 then 'smallest' end]) as side from (
            select *, row_number() over (order by bmi desc, patientunitstayid) as hi,
                   row_number() over (order by bmi, patientunitstayid) as lo from (
              select patientunitstayid, admissionheight, admissionweight, admissionweight
                / nullif((admissionheight / 100.0::double) * (admissionheight / 100.0::double), 0) as bmi from cohort)
            where bmi is not null)) where side is not null"""),
    "describe_vitals": _describe(
        " union all ".join(f"select '{p}_mean' as variable, {p}_mean as v from raw_features" for p in _ORDER[:7]), "raw_features"
    ).replace("raw_features as (", "raw_features as materialized (", 1),
    "describe_hr_readings": _describe(
        f"select 'heartrate' as variable, heartrate as v from ({_PERIODIC}) where heartrate > 0", "cohort vitalperiodic"),
    "readings_per_stay": _describe(
        f"""select 'readings' as variable, count(*)::double as v from ({_PERIODIC})
            where heartrate > 0 group by patientunitstayid""", "cohort vitalperiodic"),
    "range_audit_vitals": _with("cohort vitalperiodic", " union all ".join(
        _range_rows(c, c, lo, hi, _PERIODIC) for c, lo, hi in _VITALS)),
    "range_audit_labs": _with("cohort lab", "select * from (" + " union all ".join(
        _range_rows("labresult", n, lo, hi, _LABROWS + f" and labname = '{n}' and labresult is not null")
        for n, _, lo, hi in _LABS) + ") where too_low + too_high + in_range > 0"),
    "range_audit_bmi": _with("cohort", _range_rows("b", "bmi", 12, 60, """select admissionweight
        / nullif((admissionheight / 100.0::double) * (admissionheight / 100.0::double), 0) as b from cohort""")),
    "vital_coverage": _coverage([v[0] for v in _VITALS], _PERIODIC, "cohort vitalperiodic"),
    "cuff_coverage": _coverage(
        ["noninvasivesystolic", "noninvasivediastolic", "noninvasivemean"], _CUFF, "cohort vitalaperiodic"),
    "null_audit": _with("features", " union all ".join(
        f"select {i} as position, '{c}' as column_name, '{_dtype(c)}' as dtype,"
        f" count(*) filter (where {c} is null) as n_missing from features" for i, c in enumerate(_FEATURE_COLUMNS)
    )).replace("features as (", "features as materialized (", 1),
    "feature_coverage": _with("cohort readings", " union all ".join(
        f"""select '{p}' as variable, count(distinct patientunitstayid) as n_present,
            round(100.0 * count(distinct patientunitstayid) / (select count(*) from cohort), 1)::double as pct
            from cohort join readings on s = patientunitstayid where var = '{p}'""" for p in _ORDER)),
    "complete_vitals": _with("cohort readings", f"""select count(*) filter (where n = 7) as n_complete, count(*) as n_rows
        from (select patientunitstayid, count(distinct var) filter (where var in ({', '.join(f"'{p}'" for p in _ORDER[:7])})) as n
              from cohort left join readings on s = patientunitstayid group by 1)"""),
    "source_gain": _with("cohort vitalperiodic vitalaperiodic nursecharting", """
        select variable, count(distinct s) filter (where src = 1) as n_first_source,
               count(distinct s) as n_both_sources from (
          select s, src, unnest(['sbp', 'dbp', 'map']) as variable, unnest([sbp, dbp, map]) as v from (
            select patientunitstayid as s, 1 as src, systemicsystolic as sbp, systemicdiastolic as dbp, systemicmean as map
            from vitalperiodic where observationoffset between 0 and 1440
            union all
            select patientunitstayid, 2, noninvasivesystolic, noninvasivediastolic, noninvasivemean
            from vitalaperiodic where observationoffset between 0 and 1440)
          where coalesce(sbp between 40 and 300, true) and coalesce(dbp between 20 and 200, true)
            and coalesce(map between 30 and 200, true)
        ) semi join cohort on s = patientunitstayid where v is not null group by 1
        union all
        select 'temp', count(distinct s) filter (where src = 1), count(distinct s) from (
          select patientunitstayid as s, 1 as src, temperature as v from vitalperiodic where observationoffset between 0 and 1440
          union all
          select patientunitstayid, 2, try_cast(nursingchartvalue as double) from nursecharting
          where nursingchartoffset between 0 and 1440 and nursingchartcelltypevalname = 'Temperature (C)'
            and regexp_full_match(nursingchartvalue, '-?[0-9]+[.]?[0-9]*')
        ) semi join cohort on s = patientunitstayid where v between 28 and 43"""),
    "feature_defaults": _with("raw_features", " union all ".join([
        *(f"select '{c}' as feature, round(round(median({c}::double), 9), 6) as median, null::varchar as mode from raw_features"
          f" having count({c}) > 0" if not c.endswith("_missing") else
          f"select '{c}' as feature, round(median({c}::int::double), 6) as median, null::varchar as mode from raw_features"
          for c in _NUMERIC),
        *(f"(select '{c}', null::double, {c} from raw_features where {c} is not null"
          f" group by {c} order by count(*) desc, {c} limit 1)" for c in _CATEGORIES),
    ])).replace("raw_features as (", "raw_features as materialized (", 1),
    "split_train_test": _with("cohort", "select * from validated", _SPLIT),
    "folds5": _with("cohort", """select patientunitstayid, in_hospital_mortality, ((row_number() over (
        partition by in_hospital_mortality order by md5('42/folds:' || patientunitstayid), patientunitstayid) - 1) % 5)::int as fold
        from splitted where split = 'train'""", _SPLIT),
    "class_balance": _with("cohort", f"""select count(*) filter (where in_hospital_mortality = 0) as n_neg,
        count(*) filter (where in_hospital_mortality = 1) as n_pos,
        round(count(*) filter (where in_hospital_mortality = 0) / count(*) filter (where in_hospital_mortality = 1), 6)
          as imbalance_ratio from ({_LABELLED})"""),
    "roc_auc": _with("scores", f"select n, n_pos, roc_auc from ({_auc('select * from scores')})"),
    "average_precision": _with("scores", f"select n, n_pos, average_precision from ({_auc('select * from scores')})"),
    "auc_guard": _with("scores", _auc(
        "select *, case when y_true = 1 then id % 3 else id % 4 end as grp from scores", "grp")),
    "roc_points": _with("scores", "select threshold, round(fpr, 6) as fpr, round(tpr, 6) as tpr from roc", _CURVE),
    "pr_points": _with("scores", """select threshold, round(ctp::double / (ctp + cfp), 6) as precision,
        round(ctp::double / np, 6) as recall, round(np::double / (np + nn), 6) as prevalence from curve
        union all select null, 1.0, 0.0, round(avg(y_true), 6) from scores""", _CURVE),
    "calibration": _with("scores", """select list_count(list_filter(e, lambda x: x < p))::int as bin, count(*) as n,
        round(round(avg(p), 9), 6) as prob_pred, round(round(avg(y_true), 9), 6) as prob_true
        from scores, (select quantile_cont(p, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]) as e from scores) group by 1"""),
    "youden": _with("scores", """select threshold, round(tpr, 6) as sensitivity, round(1 - fpr, 6) as specificity
        from youden""", _CURVE),
    "sens80": _with("scores", """select threshold, round(tpr, 6) as sensitivity, round(1 - fpr, 6) as specificity
        from sens""", _CURVE),
    "max_f1": _with("scores", "select round(threshold, 6) as threshold, round(f1, 6) as f1 from f1", _CURVE),
    "f1_sweep": _with("scores", """select round(t, 6) as threshold, tn::bigint as tn, fp::bigint as fp,
        fn::bigint as fn, tp::bigint as tp from swept""", _CURVE),
    "confusion": _with("scores", "select * replace (round(threshold, 6) as threshold) from confused", _CURVE),
    "classification_report": _with("scores", """select label, round(precision, 6) as precision, round(recall, 6) as recall,
        round(f1, 6) as f1, support::bigint as support from (
          select label, precision, recall, f1, support from per
          union all select 'accuracy', sum(hit) / sum(support), sum(hit) / sum(support), sum(hit) / sum(support), sum(support) from per
          union all select 'macro avg', avg(precision), avg(recall), avg(f1), sum(support) from per
          union all select 'weighted avg', sum(precision * support) / sum(support), sum(recall * support) / sum(support),
            sum(f1 * support) / sum(support), sum(support) from per)""", _CURVE + ", " + _REPORT),
    "threshold_table": _with("scores", """select strategy, round(threshold, 6) as threshold,
        round(tp / (tp + fn), 6) as sensitivity, round(tn / (tn + fp), 6) as specificity,
        round(coalesce(tp / nullif(tp + fp, 0), 0), 6) as precision,
        round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 6) as f1 from confused""", _CURVE),
    "model_comparison": _with("scores", f"""select m.model, round(m.roc_auc, 6) as roc_auc,
        round(m.average_precision, 6) as average_precision, round(m.roc_auc - b.roc_auc, 6) as roc_auc_delta,
        round(m.average_precision - b.average_precision, 6) as average_precision_delta
        from ({_auc('''select 'baseline' as model, y_true, p from scores union all
            select 'challenger', y_true, round(value / (value + 80 + event_id % 7), 3)
            from scores join events on id = event_id''', 'model', 15)}) m, ({_auc('select * from scores', digits=15)}) b"""),
    "gbt_round_picker": _with("scores", """select best as n_trees, n_rounds, round(best_m, 6) as auc_mean, round(best_s, 6) as auc_std
        from tracked join stopped on round = n_rounds""", f"""staged as (select y_true, (id % 5)::int as series, r as round,
      round(1000 * p) * 8 + ((id * 7919 * r) % 1009) * abs(r - 8) as p from scores, range(1, 21) t(r)),
    judged as ({_auc('select * from staged', 'series, round', 15)}),
    means as (select round, avg(roc_auc) as m, stddev_pop(roc_auc) as s from judged where roc_auc is not null group by round),
    running as (select *, max(m) over (order by round) as best_m from means),
    tracked as (select round::int as round, best_m, (select min(x.round) from means x where x.m = r.best_m)::int as best,
      (select x.s from means x where x.m = r.best_m order by x.round limit 1) as best_s from running r),
    stopped as (select coalesce(min(round) filter (where round - best >= 4), max(round))::int as n_rounds from tracked)"""),
}

# --- scores with gaps: what can't be judged is refused and counted ---
_GATED = f"""raw as ({_CTE['scores']}), gated as (select id,
    case when id % 23 = 0 then null when id % 29 = 0 then 2 else y_true end as y_true,
    case when id % 17 = 0 then null when id % 19 = 0 then 'nan'::double else p + id * 0.000000001::double end as p from raw),
scores as (select * from gated where p is not null and not isnan(p) and y_true in (0, 1))"""
ORACLE |= {
    "gated_quality": f"""with {_GATED} select * from ({_auc('select * from scores')}), (
        select count(*) filter (where p is null) as null_score, count(*) filter (where isnan(p)) as nan_score,
          count(*) filter (where not isnan(p) and y_true is null) as null_label,
          count(*) filter (where not isnan(p) and y_true not in (0, 1)) as other_label from gated)""",
    "gated_calibration": f"""with {_GATED} select list_count(list_filter(e, lambda x: x < p))::int as bin, count(*) as n,
        round(round(avg(p), 9), 6) as prob_pred, round(round(avg(y_true), 9), 6) as prob_true
        from scores, (select quantile_cont(p, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]) as e from scores) group by 1""",
    "gated_thresholds": f"""with {_GATED}, {_CURVE} select strategy, round(threshold, 6) as threshold,
        round(tp / (tp + fn), 6) as sensitivity, round(tn / (tn + fp), 6) as specificity,
        round(coalesce(tp / nullif(tp + fp, 0), 0), 6) as precision,
        round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 6) as f1 from confused""",
}


# --- preparation and scoring at fixed weights ---
_WEIGHTS = {
    "age": 0.45, "gender_male": 0.05, "bmi": -0.08, "gcs_mean": -0.52, "hr_mean": 0.31,
    "sbp_mean": -0.24, "map_mean": -0.11, "rr_mean": 0.27, "spo2_mean": -0.19, "temp_mean": -0.22,
    "bun_max": 0.38, "creatinine_max": 0.09, "glucose_min": 0.07, "wbc_mean": 0.16,
}


def _scaled() -> str:
    """Train medians, then train mean and population spread of the filled columns."""
    med = ", ".join(f"coalesce(median({c}::double) filter (where split = 'train'), 0) over () as med_{c}" for c in _DEMO_FEATURES)
    med = med.replace("filter (where split = 'train'), 0) over ()", "filter (where split = 'train') over (), 0)")
    fill = ", ".join(f"coalesce({c}::double, med_{c}) as f_{c}" for c in _DEMO_FEATURES)
    z = ", ".join(
        f"(f_{c} - avg(f_{c}) filter (where split = 'train') over ())"
        f" / case when stddev_pop(f_{c}) filter (where split = 'train') over () > 0"
        f" then stddev_pop(f_{c}) filter (where split = 'train') over () else 1 end as z_{c}" for c in _DEMO_FEATURES
    )
    return (
        f"{_SPLIT}, m as (select raw_features.*, split, {med} from raw_features"
        f" join splitted using (patientunitstayid)), f as (select patientunitstayid, split, {fill} from m),"
        f" z as (select patientunitstayid, split, {z} from f)"
    )


_LONG_Z = " union all ".join(
    f"select patientunitstayid, split, '{c}' as feature, {w}::double * z_{c} as contribution from z" for c, w in _WEIGHTS.items()
)
ORACLE["impute_scale"] = _with("cohort raw_features", "select patientunitstayid, split, " + ", ".join(
    f"round(round(z_{c}, 9), 6) as z_{c}" for c in _DEMO_FEATURES) + " from z", _scaled())
ORACLE["linear_reasons"] = _with(
    "cohort raw_features",
    f"select patientunitstayid, feature, round(round(contribution, 9), 6) as contribution from ({_LONG_Z}) where split = 'test'",
    _scaled())
ORACLE["batch_score_bands"] = _with("cohort raw_features", f"""
    select patientunitstayid, round(round(p, 9), 6) as p,
           case when p < 0.10 then 'Low risk' when p < 0.25 then 'Moderate risk' else 'High risk' end as risk,
           r[1] as reason_1, r[2] as reason_2, r[3] as reason_3
    from (select patientunitstayid, 1 / (1 + exp(-(-2.6 + sum(contribution)))) as p,
                 list(feature order by abs(contribution) desc, feature) as r
          from ({_LONG_Z}) group by 1)""", _scaled())
ORACLE["defaults_document"] = ORACLE["feature_defaults"]


# --- fixed trees: every coalition of three features, node by node ---
_COALITIONS = """x as (select patientunitstayid, coalesce(age::double, -1) as a, coalesce(hr_mean, -1) as h,
    coalesce(bun_max, -1) as b, in_hospital_mortality as y from raw_features),
worth as (select x.*, ka, kh, kb,
    case when kh = 1 then case when h <= 100 then 0.2::double else 0.5::double end else 0.32::double end as n5,
    case when kb = 1 then case when b <= 30 then n5 else 0.9::double end else 0.625::double * n5 + 0.375::double * 0.9 end as n2,
    case when kh = 1 then case when h <= 90 then -0.6::double else 0.1::double end
      else (35 * -0.6::double + 25 * 0.1::double) / 60 end as n1,
    case when ka = 1 then case when a <= 65 then n1 else n2 end else 0.6::double * n1 + 0.4::double * n2 end as t0,
    case when kb = 1 then case when b <= 10 then -0.4::double else -0.1::double end
      else (30 * -0.4::double + 40 * -0.1::double) / 70 end as m1,
    case when ka = 1 then case when a <= 50 then 0.3::double else 0.8::double end
      else (10 * 0.3::double + 20 * 0.8::double) / 30 end as m2,
    case when kb = 1 then case when b <= 20 then m1 else m2 end else 0.7::double * m1 + 0.3::double * m2 end as t1,
    2 * (t0 + 0.1::double * t1) as v
  from x, range(2) r1(ka), range(2) r2(kh), range(2) r3(kb)),
phi as (
  select patientunitstayid, 'age' as feature, sum((2 * ka - 1) * v / case when kh + kb = 1 then 6 else 3 end) as phi from worth group by 1
  union all select patientunitstayid, 'hr_mean', sum((2 * kh - 1) * v / case when ka + kb = 1 then 6 else 3 end) from worth group by 1
  union all select patientunitstayid, 'bun_max', sum((2 * kb - 1) * v / case when ka + kh = 1 then 6 else 3 end) from worth group by 1),
base as (select any_value(v) as base from worth where ka + kh + kb = 0),
scored as (select patientunitstayid, y, 1 / (1 + exp(-round(v, 9))) as p from worth where ka + kh + kb = 3),
ends as ((select 'highest' as side, * from scored order by p desc, patientunitstayid limit 1)
  union all (select 'lowest', * from scored order by p, patientunitstayid limit 1))"""
ORACLE["fixed_attributions"] = _with("raw_features", "select patientunitstayid, feature, round(phi, 6) as phi from phi", _COALITIONS)
ORACLE["fixed_importance"] = _with("raw_features", """select feature, round(avg(abs(phi)), 6) as mean_abs_shap,
    round((select avg(phi) from phi), 6) as mean_phi from phi group by feature""", _COALITIONS)
ORACLE["fixed_extreme_reasons"] = _with("raw_features", """select side, e.patientunitstayid, y as y_true, round(p, 6) as p,
    round(base, 6) as base_value, feature, round(phi, 6) as phi,
    row_number() over (partition by side order by abs(round(phi, 9)) desc, feature)::int as rank
    from ends e join phi using (patientunitstayid), base qualify rank <= 2""", _COALITIONS)
ORACLE["attribution_reload"] = _with("cohort", """select 'attributions' as sink, 3 * count(*) as n_written, 3 * count(*) as n_reloaded,
    3 as columns_written, 3 as columns_reloaded, true as same_rows from cohort""")
ORACLE["sink_reload"] = _with("cohort", f"""select *, n_written as n_reloaded, columns_written as columns_reloaded, true as same_rows from (
    select 'features' as sink, count(*) as n_written, {len(_FEATURE_COLUMNS)} as columns_written from cohort
    union all select 'predictions of the reloaded model', count(*), 3 from splitted where split = 'test'
    union all select 'thresholds', 3, 2)""", _SPLIT)

# --- leave one group out with a scorer in closed form ---
_GROUPS = f"""d as (select patientunitstayid, numbedscategory as g, unittype, age, in_hospital_mortality as y from demo),
held as (select distinct g from d where g is not null),
scored as (select held.g as held_out_category, d.y as y_true, coalesce((select avg(t.y) from d t where t.g is not null and t.g <> held.g
      and t.unittype is not distinct from d.unittype), 0) + coalesce(d.age::double, 0) / 1000::double as p
    from held join d using (g)),
quality as ({_auc('select * from scored', 'held_out_category', 15)}),
results as (select q.held_out_category, (select count(*) from d where g <> q.held_out_category) as n_train,
    (select sum(y) from d where g <> q.held_out_category)::bigint as n_train_deaths, n as n_test, n_pos as n_test_deaths,
    printf('%.2f%%', 100.0 * n_pos / n) as test_mortality, roc_auc as test_roc_auc, average_precision as test_pr_auc from quality q)"""
ORACLE["fixed_group_out"] = _with("demo", """select * replace (round(test_roc_auc, 6) as test_roc_auc, round(test_pr_auc, 6) as test_pr_auc)
    from results""", _GROUPS)
ORACLE["fixed_group_summary"] = _with("demo", """select round(avg(test_roc_auc), 6) as mean_roc_auc,
    round(stddev_samp(test_roc_auc), 6) as std_roc_auc, count(test_roc_auc) as n_categories, 0.8::double as in_distribution_roc_auc,
    round(100 * (0.8::double - avg(test_roc_auc)), 1) as gap_points from results""", _GROUPS)
ORACLE["fixed_group_report"] = _with("demo", """select held_out_category as "Held-out category", n_train as "N train",
    n_train_deaths as "Train deaths", n_test as "N test", n_test_deaths as "Test deaths", test_mortality as "Test mortality",
    round(test_roc_auc, 3) as "ROC-AUC", round(test_pr_auc, 3) as "PR-AUC" from results""", _GROUPS)


# --- logistic regression on two features: Newton steps, one table each ---
def _newton(columns: list[str], steps: int = 12) -> str:
    """Weights it<steps> of the summed log loss with half the squared weights as penalty; the
    system of three equations is solved by elimination, column by column."""
    a, b = (f"z_{c}" for c in columns)
    parts = ["train as (select z.*, in_hospital_mortality as y from z join labelled using (patientunitstayid) where split = 'train')",
             "it0 as (select 0.0::double as w0, 0.0::double as w1, 0.0::double as w2)"]
    for i in range(steps):
        parts.append(f"""it{i + 1} as (
          with p as (select {a} as a, {b} as b, y, 1 / (1 + exp(-(w0 + w1 * {a} + w2 * {b}))) as p from train, it{i}),
          h as (select sum(p * (1 - p)) as h00, sum(p * (1 - p) * a) as h01, sum(p * (1 - p) * b) as h02, sum(p * (1 - p) * a * a) + 1 as h11,
              sum(p * (1 - p) * a * b) as h12, sum(p * (1 - p) * b * b) + 1 as h22,
              sum(p - y) as g0, sum((p - y) * a) as s1, sum((p - y) * b) as s2 from p),
          e as (select *, s1 + w1 as g1, s2 + w2 as g2, h11 - h01 * h01 / h00 as k11, h12 - h01 * h02 / h00 as k12,
              h22 - h02 * h02 / h00 as k22, g1 - h01 * g0 / h00 as r1, g2 - h02 * g0 / h00 as r2 from h, it{i}),
          d as (select *, (r2 - k12 * r1 / k11) / (k22 - k12 * k12 / k11) as d2, (r1 - k12 * d2) / k11 as d1,
              (g0 - h01 * d1 - h02 * d2) / h00 as d0 from e)
          select w0 - d0 as w0, w1 - d1 as w1, w2 - d2 as w2 from d)""")
    return ", ".join(parts)


_TWO = f"{_scaled()}, {_newton(['age', 'gcs_mean'])}"
ORACLE["lr_two_features"] = _with("cohort raw_features", """select 'intercept' as feature, round(w0, 5) as weight from it12
    union all select 'age', round(w1, 5) from it12 union all select 'gcs_mean', round(w2, 5) from it12""", _TWO)
ORACLE["lr_two_feature_scores"] = _with("cohort raw_features", """select patientunitstayid, in_hospital_mortality::double as y_true,
    round(1 / (1 + exp(-(w0 + w1 * z_age + w2 * z_gcs_mean))), 5) as p
    from z join labelled using (patientunitstayid), it12 where split = 'test'""", _TWO)


# --- the first split of boosting: every cut of every quantised feature ---
_CUTS = ", ".join(f"{i} / 31.0::double" for i in range(1, 31))
_STUMP = f"""{_SPLIT},
t as (select raw_features.*, 2 * raw_features.in_hospital_mortality - 1 as y from raw_features join splitted using (patientunitstayid)
    where split = 'train'),
weighted as (select patientunitstayid as id, y, case when y = 1 then
    (select count(*) filter (where y = -1)::double / count(*) filter (where y = 1) from t) else 1 end as w from t),
long as ({" union all ".join(f"select patientunitstayid as id, '{c}' as f, {c}::int::double as v from t" if c.endswith("_missing") else
    f"select patientunitstayid as id, '{c}' as f, {c}::double as v from t" for c in _NUMERIC)}),
edges as (select f, list_distinct(quantile_cont(v, [{_CUTS}])) as e from long group by f),
cells as (select id, f, case when v is null then 0 else 1 + len(list_filter(e, lambda x: x < v)) end::varchar as bin, true as is_number
      from long join edges using (f)
    {" ".join(f"union all select patientunitstayid, '{c}', coalesce({c}, '(null)'), false from t" for c in _CATEGORIES)}),
groups as (select f, bin, count(*) as n, count(*) filter (where y = 1) as p, sum(w) as sw, sum(w * y) as sy,
    case when any_value(is_number) then any_value(bin)::double else sum(w * y) / sum(w) end as place
  from cells join weighted using (id) group by f, bin, is_number),
cut as (select f, sum(n) over upto as n, sum(p) over upto as p, sum(sw) over upto as sw, sum(sy) over upto as sy,
    sum(n) over whole as tn, sum(p) over whole as tp, sum(sw) over whole as tw, sum(sy) over whole as ty
  from groups window upto as (partition by f order by place, bin rows unbounded preceding), whole as (partition by f)),
best as (select * from cut where n >= 20 and tn - n >= 20 order by sy * sy / sw + (ty - sy) * (ty - sy) / (tw - sw) desc limit 1)"""
ORACLE["gbt_first_split"] = _with("cohort raw_features", """select round(sy / sw, 6) as leaf, n::bigint as n, p::bigint as n_pos from best
    union all select round((ty - sy) / (tw - sw), 6), (tn - n)::bigint, (tp - p)::bigint from best""", _STUMP)


def _decimal_ties(sql: str) -> str:
    """``round(x, 6)`` by way of a nine-digit decimal, as the queries round, so ties agree."""
    out, at = [], 0
    while (start := sql.find("round(", at)) >= 0:
        depth, end = 0, start + len("round")
        while True:
            depth += {"(": 1, ")": -1}.get(sql[end], 0)
            end += 1
            if depth == 0:
                break
        body = _decimal_ties(sql[start + len("round("):end - 1])
        head, _, digits = body.rpartition(",")
        if digits.strip() == "6":
            text = f"round(cast({head} as decimal(28, 9)), 6)::double"
        else:
            text = f"round({body})"
        out += [sql[at:start], text]
        at = end
    return "".join(out) + sql[at:]


ORACLE = {name: _decimal_ties(sql) for name, sql in ORACLE.items()}
