"""Data-quality audits. Wide inputs give one row per column."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, functions as F

from cohortlab.functions.columns import exprs, lines, number, percent, quoted
from cohortlab.operators.ordered import exact_quantiles
from cohortlab.operators.readings import restrict

QUARTILES = (0.25, 0.5, 0.75)


def to_long(df: DataFrame, columns: Sequence[str], name: str = "variable", value: str = "value") -> DataFrame:
    """(variable, value) rows of the listed columns, as doubles, without NULLs."""
    pairs = lines({name: quoted(c), value: f"cast({c} AS double)"} for c in columns)
    return df.selectExpr(pairs).where(f"{value} IS NOT NULL")


def describe(long: DataFrame, groups: int, name: str = "variable", value: str = "value") -> DataFrame:
    """count, mean, std, min, quartiles (interpolated) and max per variable."""
    basic = long.groupBy(name).agg(*exprs([
        f"count({value}) AS count",
        f"avg({value}) AS mean",
        f"stddev_samp({value}) AS std",
        f"min({value}) AS min",
        f"max({value}) AS max",
    ]))
    quantiles = exact_quantiles(long, value, QUARTILES, by=[name], groups=groups)
    return basic.join(quantiles.drop("n"), name).selectExpr(
        name, "count", "mean", "std", "min",
        "quantiles[0] AS p25", "quantiles[1] AS p50", "quantiles[2] AS p75", "max",
    )


_RANGE_COLUMNS = (
    "variable",
    "low AS too_low",
    "high AS too_high",
    "n - low - high AS in_range",
    "rows - n AS missing",
    f"CASE WHEN n > 0 THEN {percent('(n - low - high)', 'n')} ELSE 0.0D END AS pct_in_range",
)


def range_audit(
    readings: DataFrame, members: DataFrame, key: str, ranges: Mapping[str, tuple[float, float]]
) -> DataFrame:
    """Readings below, above and within the plausible range, per wide column.

    Counted per key first, so the join with the cohort moves one row per key.
    """
    per_key = readings.groupBy(key).agg(*exprs([
        "count(*) AS rows",
        *[
            text
            for c, (lo, hi) in ranges.items()
            for text in (
                f"count_if({c} < {number(lo)}) AS {c}_low",
                f"count_if({c} > {number(hi)}) AS {c}_high",
                f"count({c}) AS {c}_n",
            )
        ],
    ]))
    names = ["rows", *(f"{c}_{s}" for c in ranges for s in ("low", "high", "n"))]
    totals = restrict(per_key, members, key).agg(*exprs(f"coalesce(sum({n}), 0) AS {n}" for n in names))
    return totals.selectExpr(lines(
        {"variable": quoted(c), "low": f"{c}_low", "high": f"{c}_high", "n": f"{c}_n", "rows": "rows"}
        for c in ranges
    )).selectExpr(*_RANGE_COLUMNS)


def range_audit_long(
    readings: DataFrame, members: DataFrame, key: str, name: str, value: str,
    ranges: Mapping[str, tuple[float, float]],
) -> DataFrame:
    """:func:`range_audit` for long (name, value) readings; names without rows do not appear."""
    def bound(i: int) -> str:
        cases = " ".join(f"WHEN {quoted(n)} THEN {number(b[i])}" for n, b in ranges.items())
        return f"(CASE {name} {cases} END)"

    listed = ", ".join(quoted(n) for n in ranges)
    per_key = readings.where(f"{name} IN ({listed})").groupBy(key, name).agg(*exprs([
        f"count_if({value} < {bound(0)}) AS low",
        f"count_if({value} > {bound(1)}) AS high",
        f"count({value}) AS n",
        "count(*) AS rows",
    ]))
    totals = restrict(per_key, members, key).groupBy(F.col(name).alias("variable")).agg(
        *exprs(f"sum({c}) AS {c}" for c in ("low", "high", "n", "rows"))
    )
    return totals.selectExpr(*_RANGE_COLUMNS)


def non_null_coverage(readings: DataFrame, members: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """Non-null readings per column, and their share of all readings."""
    per_key = readings.groupBy(key).agg(*exprs(["count(*) AS _all", *(f"count({c}) AS {c}" for c in columns)]))
    totals = restrict(per_key, members, key).agg(
        *exprs(f"coalesce(sum({c}), 0) AS {c}" for c in ("_all", *columns))
    )
    return totals.selectExpr(lines(
        {"variable": quoted(c), "n_non_null": c, "pct": percent(c, "_all", 1)} for c in columns
    ))


def null_audit(df: DataFrame) -> DataFrame:
    """(position, column, dtype, n_missing) for every column of the table."""
    fields = df.schema.fields
    counts = df.agg(*exprs(["count(*) AS _all", *(f"count({f.name}) AS {f.name}" for f in fields)]))
    return counts.selectExpr(lines(
        {
            "position": str(i), "column_name": quoted(f.name),
            "dtype": quoted(f.dataType.simpleString()), "n_missing": f"_all - {f.name}",
        }
        for i, f in enumerate(fields)
    ))


def flag_coverage(features: DataFrame, prefixes: Sequence[str]) -> DataFrame:
    """Rows that have a value, per variable, from its ``_missing`` flag."""
    counts = features.agg(*exprs(
        ["count(*) AS _all", *(f"count_if(NOT {p}_missing) AS {p}" for p in prefixes)]
    ))
    return counts.selectExpr(lines(
        {"variable": quoted(p), "n_present": p, "pct": percent(p, "_all", 1)} for p in prefixes
    ))


def complete_rows(features: DataFrame, prefixes: Sequence[str]) -> DataFrame:
    """Rows with none of the variables missing."""
    gap = " OR ".join(f"{p}_missing" for p in prefixes)
    return features.agg(*exprs([f"count_if(NOT ({gap})) AS n_complete", "count(*) AS n_rows"]))


def extremes(df: DataFrame, value: str, columns: Sequence[str], tie: str, n: int = 5) -> DataFrame:
    """The n largest and n smallest non-null values, with a side label."""
    rows = df.where(f"{value} IS NOT NULL")
    sides = [
        rows.orderBy(order, tie).limit(n).select(F.lit(side).alias("side"), *columns)
        for side, order in (("largest", F.desc(value)), ("smallest", F.asc(value)))
    ]
    return sides[0].unionByName(sides[1])


def medians(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(feature, median) of each column over its non-null values, interpolated."""
    long = to_long(df, columns, "feature")
    found = exact_quantiles(long, "value", [0.5], by=["feature"], groups=len(columns))
    return found.selectExpr("feature", "quantiles[0] AS median")


def modes(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(feature, mode) of each text column; the smallest value wins a tie."""
    pairs = lines({"feature": quoted(c), "value": c} for c in columns)
    counts = df.selectExpr(pairs).where("value IS NOT NULL").groupBy("feature", "value").agg(
        F.expr("count(*) AS n")
    )
    return counts.groupBy("feature").agg(F.expr("min_by(value, struct(-n, value)) AS mode"))


def feature_defaults(df: DataFrame, numeric: Sequence[str], text: Sequence[str]) -> DataFrame:
    """The fill-in value of every feature: a median, or for text the mode."""
    m = medians(df, numeric).selectExpr("feature", "median", "cast(NULL AS string) AS mode")
    return m.unionByName(modes(df, text).selectExpr("feature", "cast(NULL AS double) AS median", "mode"))


def contract(df: DataFrame, role) -> DataFrame:
    """(position, name, role, n_present) of the feature table's columns."""
    counts = df.agg(*exprs(f"count({c}) AS {c}" for c in df.columns))
    return counts.selectExpr(lines(
        {"position": str(i), "name": quoted(c), "role": quoted(role(c)), "n_present": c}
        for i, c in enumerate(df.columns)
    ))
