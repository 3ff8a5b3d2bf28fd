"""Readings in the first-day window: restriction, statistics and pivots."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from cohortlab.functions import contract as k
from cohortlab.functions.columns import exprs


def first_day(df: DataFrame, offset: str, lo: int = k.WINDOW_START, hi: int = k.WINDOW_END) -> DataFrame:
    """Rows with ``lo <= offset <= hi``; a plain comparison, so scans push it down."""
    return df.where(f"{offset} BETWEEN {lo} AND {hi}")


def restrict(df: DataFrame, members: DataFrame, key: str = k.STAY_ID) -> DataFrame:
    """Rows of ``df`` whose key is in ``members``.

    No broadcast hint: the cohort grows with the data. Spark broadcasts it when
    its measured size is under the threshold, and otherwise sort-merges with
    skewed partitions split.
    """
    return df.join(members.select(key), key, "left_semi")


def _kept(value: str, keep: str | None) -> str:
    return value if keep is None else f"CASE WHEN {keep} THEN {value} END"


def stats4(value: str, prefix: str, keep: str | None = None) -> list[str]:
    """min, max, mean and count of the kept, non-null values."""
    v = _kept(value, keep)
    return [
        f"min({v}) AS {prefix}_min",
        f"max({v}) AS {prefix}_max",
        f"avg({v}) AS {prefix}_mean",
        f"count({v}) AS {prefix}_count",
    ]


def partial4(value: str, prefix: str, keep: str | None = None) -> list[str]:
    """Like :func:`stats4` with a sum in place of the mean, to be combined later."""
    v = _kept(value, keep)
    return [
        f"min({v}) AS {prefix}_min",
        f"max({v}) AS {prefix}_max",
        f"sum({v}) AS {prefix}_sum",
        f"count({v}) AS {prefix}_count",
    ]


def combine4(prefix: str, first: str, second: str) -> list[str]:
    """Final statistics of one variable from the partials of two sources.

    A source with no row for the stay is NULL; ``least`` and ``greatest`` skip it.
    """
    total = f"(coalesce({first}_sum, 0.0D) + coalesce({second}_sum, 0.0D))"
    n = f"(coalesce({first}_count, 0L) + coalesce({second}_count, 0L))"
    return [
        f"least({first}_min, {second}_min) AS {prefix}_min",
        f"greatest({first}_max, {second}_max) AS {prefix}_max",
        f"CASE WHEN {n} > 0 THEN {total} / {n} END AS {prefix}_mean",
        f"{n} AS {prefix}_count",
    ]


def contract_columns(prefix: str) -> list[str]:
    """The five contract columns of a variable; a zero count reads as no data."""
    return [
        f"{prefix}_min",
        f"{prefix}_max",
        f"{prefix}_mean",
        f"nullif({prefix}_count, 0L) AS {prefix}_count",
        f"{prefix}_mean IS NULL AS {prefix}_missing",
    ]


def top_labels(
    readings: DataFrame,
    members: DataFrame,
    labels: Sequence[str],
    count: str,
    n: int | None,
    patients: str | None = None,
) -> DataFrame:
    """Rows (and stays) per label, within the cohort, commonest first.

    Readings collapse to one row per (label, stay) before they meet the cohort,
    so the join moves counts, and the stays per label are a plain count.
    Ties are ordered by label.
    """
    per_stay = readings.groupBy(*labels, k.STAY_ID).agg(F.expr("count(*) AS _n"))
    groups = restrict(per_stay, members).groupBy(*labels)
    counted = groups.agg(*exprs([f"sum(_n) AS {count}", "count(*) AS _stays"]))
    ranked = counted.orderBy(F.desc("_stays" if patients else count), *labels)
    if n is not None:
        ranked = ranked.limit(n)
    stays = [f"_stays AS {patients}"] if patients else []
    return ranked.selectExpr(*labels, count, *stays)
