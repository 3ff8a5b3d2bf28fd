"""Imputation and scaling as one SQL stage, so that a fitted pipeline is plain Spark ML."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.ml.feature import SQLTransformer
from pyspark.sql import DataFrame

from cohortlab.functions.columns import exprs, number
from cohortlab.operators.audit import medians


def scaled_name(column: str) -> str:
    return f"z_{column}"


@dataclass(frozen=True)
class Scaling:
    """Fitted medians, means and population standard deviations."""

    median: Mapping[str, float]
    mean: Mapping[str, float]
    std: Mapping[str, float]
    n_rows: int

    def imputed(self, c: str) -> str:
        return f"coalesce(cast({c} AS double), {number(self.median[c])})"

    def scaled(self, c: str) -> str:
        """A constant column keeps scale 1, so it becomes zero."""
        spread = self.std[c] if self.std[c] > 0 else 1.0
        return f"({self.imputed(c)} - {number(self.mean[c])}) / {number(spread)}"

    def stage(self) -> SQLTransformer:
        cells = ", ".join(f"{self.scaled(c)} AS {scaled_name(c)}" for c in self.median)
        return SQLTransformer(statement=f"SELECT *, {cells} FROM __THIS__")


def fit_scaling(train: DataFrame, columns: Sequence[str]) -> Scaling:
    """Medians per column, then mean and spread of the imputed columns.

    A column without any value imputes to zero: it is constant, so it carries no
    weight. Two small results reach the driver: one row per column, and one row.
    """
    median = {r["feature"]: r["median"] for r in medians(train, columns).collect()}
    median = {c: median.get(c, 0.0) for c in columns}
    filled = [f"coalesce(cast({c} AS double), {number(median[c])})" for c in columns]
    row = train.agg(*exprs([
        "count(*) AS n",
        *[f"avg({x}) AS m{i}" for i, x in enumerate(filled)],
        *[f"stddev_pop({x}) AS s{i}" for i, x in enumerate(filled)],
    ])).first()
    return Scaling(
        median=median,
        mean={c: row[f"m{i}"] for i, c in enumerate(columns)},
        std={c: row[f"s{i}"] for i, c in enumerate(columns)},
        n_rows=row["n"],
    )
