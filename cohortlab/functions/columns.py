"""Scalar expressions as Spark SQL text.

Feature tables are wide, and a wide plan built call by call spends seconds in the
Python gateway before Spark sees it. Text is parsed once per column in the JVM and
gives the same built-in expressions, inside code generation.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import DoubleType, FloatType

from cohortlab.functions import contract as k


def exprs(texts: Iterable[str]) -> list[Column]:
    return [F.expr(t) for t in texts]


def quoted(text: str) -> str:
    """A SQL string literal."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def number(x: float) -> str:
    """A SQL double literal with every digit of ``x``."""
    return f"{float(x)!r}D"


def nan_to_null(df: DataFrame) -> DataFrame:
    """Missing means NULL from here on: a NaN would pass ``> x`` and win ``max``."""
    def cell(f) -> str:
        name = f"`{f.name}`"
        if isinstance(f.dataType, (DoubleType, FloatType)):
            return f"CASE WHEN NOT isnan({name}) THEN {name} END AS {name}"
        return name

    return df.selectExpr(*[cell(f) for f in df.schema.fields])


def age_years(age: str) -> str:
    """Text age to years; the top code counts as 90, other text as NULL."""
    return (
        f"CASE WHEN {age} = {quoted(k.AGE_TOP_CODE)} THEN {k.AGE_TOP_VALUE}"
        f" WHEN {age} RLIKE r'\\A[0-9]+\\z' THEN try_cast({age} AS int) END"
    )


def number_from_text(text: str, signed: bool = True) -> str:
    """Plain decimal text to double; anything else is NULL."""
    sign = "-?" if signed else ""
    return f"CASE WHEN {text} RLIKE r'\\A{sign}[0-9]+\\.?[0-9]*\\z' THEN try_cast({text} AS double) END"


def in_range(c: str, bounds: tuple[float, float]) -> str:
    return f"({c} BETWEEN {number(bounds[0])} AND {number(bounds[1])})"


def keep_in_range(c: str, bounds: tuple[float, float]) -> str:
    """The value where it lies within ``bounds`` (inclusive), else NULL."""
    return f"CASE WHEN {in_range(c, bounds)} THEN {c} END"


def known_text(c: str) -> str:
    return f"({c} IS NOT NULL AND {c} != '')"


def or_missing(c: str) -> str:
    return f"coalesce(cast({c} AS string), {quoted(k.MISSING_LABEL)})"


def indicator(condition: str) -> str:
    """1 where the condition holds; false and NULL both give 0."""
    return f"CASE WHEN {condition} THEN 1 ELSE 0 END"


def died(status: str = "hospitaldischargestatus") -> str:
    return indicator(f"{status} = {quoted(k.EVENT_STATUS)}")


def bmi(weight: str, height_cm: str) -> str:
    metres = f"({height_cm} / 100.0D)"
    return f"try_divide({weight}, {metres} * {metres})"


def percent(part: str, whole: str, digits: int = 2) -> str:
    return f"cast(round(try_divide(100.0D * {part}, {whole}), {digits}) AS double)"


def ratio_or_zero(a: str, b: str) -> str:
    return f"coalesce(try_divide(cast({a} AS double), cast({b} AS double)), 0.0D)"


def percent_text(share: str) -> str:
    return f"format_string('%.2f%%', 100.0D * ({share}))"


def contains_any(columns: Iterable[str], words: Iterable[str]) -> str:
    """Case-folded substring search for any word in any of the columns."""
    words = tuple(words)
    return "(" + " OR ".join(f"contains(lower({c}), {quoted(w)})" for c in columns for w in words) + ")"


def lines(rows: Iterable[Mapping[str, str]]) -> str:
    """A generator over literal rows: ``{column: expression}`` for each line."""
    structs = []
    for row in rows:
        fields = ", ".join(f"{quoted(name)}, {text}" for name, text in row.items())
        structs.append(f"named_struct({fields})")
    return f"inline(array({', '.join(structs)}))"
