"""Bands and custom sort ranks as CASE text."""

from __future__ import annotations

from collections.abc import Sequence

from cohortlab.functions import contract as k
from cohortlab.functions.columns import quoted


def below(value: str, steps: Sequence[tuple[float, str]], otherwise: str) -> str:
    """The label of the first step above ``value``; NULL takes ``otherwise``."""
    chain = " ".join(f"WHEN {value} < {limit} THEN {quoted(label)}" for limit, label in steps)
    return f"CASE {chain} {otherwise} END"


def age_band(age: str) -> str:
    """Report bands; the last one takes NULL too."""
    steps = [(40, "1. <40"), (55, "2. 40-54"), (70, "3. 55-69"), (85, "4. 70-84")]
    return below(age, steps, "ELSE '5. 85+'")


def half_open(value: str, edges: Sequence[float], labels: Sequence[str]) -> str:
    """``[edge, next edge)`` bins; values outside all of them are NULL."""
    chain = " ".join(
        f"WHEN {value} >= {lo} AND {value} < {hi} THEN {quoted(label)}"
        for lo, hi, label in zip(edges, edges[1:], labels)
    )
    return f"CASE {chain} END"


def age_bin(age: str) -> str:
    return half_open(age, [0, 40, 55, 70, 85, 100], ["<40", "40-54", "55-69", "70-84", "85+"])


def severity_band(score: str) -> str:
    steps = [(30, "1. <30 (low)"), (60, "2. 30-59 (moderate)"), (90, "3. 60-89 (high)")]
    rest = f"WHEN {score} IS NOT NULL THEN '4. 90+ (very high)' ELSE {quoted(k.NO_SEVERITY_LABEL)}"
    return below(score, steps, rest)


def risk_band(p: str) -> str:
    low, high = k.RISK_CUTS
    return below(p, [(low, "Low risk"), (high, "Moderate risk")], "ELSE 'High risk'")


def listed_rank(c: str, order: Sequence[str]) -> str:
    """Position of a label in ``order``, for ORDER BY; unknown labels are NULL."""
    chain = " ".join(f"WHEN {quoted(label)} THEN {i}" for i, label in enumerate(order, start=1))
    return f"CASE {c} {chain} END"
