"""Counts, shares and outcome rates by group."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from cohortlab.functions.columns import died, exprs, or_missing, percent


def value_counts(df: DataFrame, column: str, label: str, count: str) -> DataFrame:
    """Rows per value, largest first; NULL is a group of its own, under a label."""
    groups = df.groupBy(column).agg(F.expr(f"count(*) AS {count}"))
    return groups.selectExpr(f"{or_missing(column)} AS {label}", count).orderBy(F.desc(count), label)


def share_of_total(df: DataFrame, column: str, label: str) -> DataFrame:
    """Value counts with their percentage of all rows.

    The total is a window over the grouped rows, one per distinct label.
    """
    groups = df.groupBy(column).agg(F.expr("count(*) AS n"))
    share = percent("n", "sum(n) OVER ()")
    return groups.selectExpr(f"{or_missing(column)} AS {label}", "n", f"{share} AS percentage").orderBy(
        F.desc("n"), label
    )


def outcome_rate(
    df: DataFrame, by: str, name: str, event: str | None = None, weight: str = "1"
) -> DataFrame:
    """(group, n, deaths, rate) per value of the expression ``by``.

    ``event`` is a 0/1 expression; ``weight`` says how many rows each row stands for.
    """
    event = died() if event is None else event
    rows = df.selectExpr(
        f"{by} AS {name}",
        f"cast({weight} AS bigint) AS _n",
        f"cast(({event}) * ({weight}) AS bigint) AS _deaths",
    )
    sums = exprs(["sum(_n) AS n_patients", "sum(_deaths) AS deaths"])
    return rows.groupBy(name).agg(*sums).selectExpr(
        name, "n_patients", "deaths", f"{percent('deaths', 'n_patients')} AS mortality_pct"
    )


def class_balance(df: DataFrame, label: str) -> DataFrame:
    counts = exprs([f"count_if({label} = 0) AS n_neg", f"count_if({label} = 1) AS n_pos"])
    return df.agg(*counts).selectExpr("n_neg", "n_pos", "try_divide(n_neg, n_pos) AS imbalance_ratio")
