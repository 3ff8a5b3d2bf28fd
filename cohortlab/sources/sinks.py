"""Sinks: Parquet tables, default-value documents, attributions, models."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import StructType

from cohortlab.functions.columns import exprs
from cohortlab.sources.schemas import assert_schema


def write_table(df: DataFrame, path: str, schema: StructType | None = None) -> None:
    if schema is not None:
        assert_schema(df.schema, schema)
    df.write.mode("overwrite").parquet(path)


def fingerprint(df: DataFrame) -> DataFrame:
    """One row (n, low, high) that depends on the rows as a multiset: not on their order or
    partitions, but on every value, on which cells are NULL, and on how often a row occurs.

    Two hashes of a row, each added up without overflow; map-side sums, one small row.
    """
    names = [f"`{c}`" for c in df.columns]
    nulls = ", ".join(f"{c} IS NULL" for c in names)
    row = f"{nulls}, {', '.join(names)}"
    return df.selectExpr(f"xxhash64({row}) AS a", f"xxhash64('second', {row}) AS b").agg(*exprs([
        "count(*) AS n", "sum(cast(a AS decimal(20, 0))) AS low", "sum(cast(b AS decimal(20, 0))) AS high",
    ]))


def reload_check(df: DataFrame, path: str, again: DataFrame | None = None) -> DataFrame:
    """Reread a written table; one row with both row counts, both widths, and whether the
    rows agree value by value. Columns are compared by name, in the order of ``df``."""
    again = df.sparkSession.read.parquet(path) if again is None else again
    again = again.select(*[F.col(f"`{c}`") for c in df.columns], *[c for c in again.columns if c not in df.columns])
    assert_schema(again.schema, df.schema)
    ours, theirs = (fingerprint(x).selectExpr(f"n AS n_{tag}", f"struct(n, low, high) AS {tag}") for x, tag in ((df, "written"), (again, "reloaded")))
    both = theirs.withColumns({"n_written": ours.select("n_written").scalar(), "written": ours.select("written").scalar()})
    return both.select(
        "n_written",
        "n_reloaded",
        F.lit(len(df.columns)).alias("columns_written"),
        F.lit(len(again.columns)).alias("columns_reloaded"),
        F.expr("written <=> reloaded").alias("same_rows"),
    )


def write_defaults(defaults: DataFrame, path: str) -> None:
    """``(feature, default_value)`` rows as one JSON object.

    One row per model feature, so the number of rows is the width of a schema.
    """
    entries = F.collect_list(F.struct("feature", "default_value"))
    document = defaults.where(F.col("default_value").isNotNull()).agg(
        F.to_json(F.map_from_entries(entries)).alias("value")
    )
    document.write.mode("overwrite").text(path)


def write_attributions(attributions: DataFrame, path: str) -> None:
    """Long attributions by feature: readers of one feature open one folder."""
    attributions.write.mode("overwrite").partitionBy("feature").parquet(path)


def save_model(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)
