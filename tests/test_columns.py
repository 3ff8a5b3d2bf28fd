import math

from cohortlab.functions import bands, columns as c, contract as k


def values(spark, rows, schema, text):
    return [r[0] for r in spark.createDataFrame(rows, schema).selectExpr(f"{text} AS v").collect()]


def test_age_text(spark):
    rows = [("> 89",), ("17",), ("018",), ("",), (None,), ("> 90",), ("4 2",), ("42\n",), ("-5",), ("99999999999",)]
    assert values(spark, rows, "a string", c.age_years("a")) == [90, 17, 18, None, None, None, None, None, None, None]


def test_charted_numbers(spark):
    rows = [("36.",), ("36.5",), ("-1",), ("unable",), (".5",), ("1e3",), ("",), (None,), ("12\n",)]
    assert values(spark, rows, "t string", c.number_from_text("t")) == [
        36.0, 36.5, -1.0, None, None, None, None, None, None]
    assert values(spark, rows, "t string", c.number_from_text("t", signed=False))[2] is None


def test_range_is_inclusive_and_null_fails(spark):
    rows = [(12.0,), (60.0,), (11.999,), (60.001,), (None,)]
    assert values(spark, rows, "x double", c.keep_in_range("x", k.BMI_RANGE)) == [12.0, 60.0, None, None, None]


def test_bmi_guards_zero_height(spark):
    rows = [(80.0, 200.0), (80.0, 0.0), (80.0, None), (None, 200.0)]
    assert values(spark, rows, "w double, h double", c.bmi("w", "h")) == [20.0, None, None, None]


def test_indicator_gives_zero_for_null_and_others(spark):
    rows = [("Male",), ("Female",), ("Unknown",), (None,)]
    assert values(spark, rows, "g string", c.indicator("g = 'Male'")) == [1, 0, 0, 0]


def test_safe_ratio_percent_and_text(spark):
    rows = [(1, 3), (1, 0), (0, 5)]
    assert values(spark, rows, "a int, b int", c.ratio_or_zero("a", "b")) == [1 / 3, 0.0, 0.0]
    assert values(spark, rows, "a int, b int", c.percent("a", "b")) == [33.33, None, 0.0]
    assert values(spark, [(0.08286,)], "x double", c.percent_text("x")) == ["8.29%"]


def test_substring_search_folds_case_and_ignores_null(spark):
    rows = [("Body TEMP", None), (None, "temperature"), (None, None), ("a", "b")]
    text = c.contains_any(["x", "y"], ["temp"])
    assert [bool(v) for v in values(spark, rows, "x string, y string", text)] == [True, True, False, False]


def test_nan_becomes_null(spark):
    df = c.nan_to_null(spark.createDataFrame([(1, math.nan), (2, 1.5)], "i int, x double"))
    assert [r.x for r in df.orderBy("i").collect()] == [None, 1.5]


def test_quoting(spark):
    text = "it's a \\ back"
    assert spark.range(1).selectExpr(f"{c.quoted(text)} AS t").first().t == text


def test_age_bands_and_bins(spark):
    rows = [(39,), (40,), (84,), (85,), (100,), (-1,), (None,)]
    assert values(spark, rows, "a int", bands.age_band("a")) == [
        "1. <40", "2. 40-54", "4. 70-84", "5. 85+", "5. 85+", "1. <40", "5. 85+"]
    assert values(spark, rows, "a int", bands.age_bin("a")) == ["<40", "40-54", "70-84", "85+", None, None, None]


def test_severity_and_risk_bands(spark):
    rows = [(29,), (30,), (89,), (90,), (None,)]
    got = values(spark, rows, "s int", bands.severity_band("s"))
    assert [g[0] for g in got] == ["1", "2", "3", "4", "5"]
    risks = values(spark, [(0.0999,), (0.10,), (0.25,)], "p double", bands.risk_band("p"))
    assert risks == ["Low risk", "Moderate risk", "High risk"]


def test_feature_contract_shape():
    assert len(k.FEATURE_TABLE) == 102 and len(k.FEATURES) == 100 and len(k.NUMERIC_FEATURES) == 97
    assert k.FEATURES[10] == "hr_min" and k.FEATURES[-1] == "gcs_missing"
