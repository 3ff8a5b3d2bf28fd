"""Readers: Parquet, JDBC and the JSON config documents."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

from cohortlab.functions.columns import nan_to_null
from cohortlab.sources.schemas import TABLES


@dataclass(frozen=True)
class Tables:
    """The seven input tables of a study."""

    patient: DataFrame
    hospital: DataFrame
    apachepatientresult: DataFrame
    vitalperiodic: DataFrame
    vitalaperiodic: DataFrame
    nursecharting: DataFrame
    lab: DataFrame

    def register(self) -> None:
        """Name every table as a temp view; a second call replaces the views."""
        for name in TABLES:
            getattr(self, name).createOrReplaceTempView(name)


def read_parquet(spark: SparkSession, path: str, table: str) -> DataFrame:
    return nan_to_null(spark.read.schema(TABLES[table]).parquet(path))


def read_parquet_tables(spark: SparkSession, folder: str) -> Tables:
    """Read ``<folder>/<table>.parquet`` for each table with its declared schema."""
    return Tables(**{t: read_parquet(spark, f"{folder}/{t}.parquet", t) for t in TABLES})


def jdbc_options(
    url: str,
    table: str,
    bounds: tuple[int, int],
    partitions: int,
    user: str | None = None,
    password: str | None = None,
    column: str | None = None,
    fetch_size: int = 10_000,
) -> dict[str, str]:
    """Options for a partitioned read of ``table``, split on its key.

    Comparison filters and column lists reach the database; ``bounds`` only set
    the stride of the splits, they drop no rows.
    """
    if bounds[0] >= bounds[1] or partitions < 1:
        raise ValueError("bounds must be increasing and partitions positive")
    options = {
        "url": url,
        "dbtable": table,
        "partitionColumn": column or TABLES[table].names[0],
        "lowerBound": str(bounds[0]),
        "upperBound": str(bounds[1]),
        "numPartitions": str(partitions),
        "fetchsize": str(fetch_size),
    }
    if user is not None:
        options["user"] = user
    if password is not None:
        options["password"] = password
    return options


def read_jdbc(spark: SparkSession, table: str, options: dict[str, str]) -> DataFrame:
    return nan_to_null(spark.read.format("jdbc").options(**options).load())


def read_defaults(spark: SparkSession, path: str, key: str | None = None) -> DataFrame:
    """A JSON document ``{feature: default}`` as ``(feature, default_value)`` rows.

    ``key`` names an inner object, as in ``{"features": [...], "medians": {...}}``.
    """
    document = spark.read.text(path, wholetext=True).select("value")
    if key is not None:
        document = document.select(F.get_json_object("value", f"$.{key}").alias("value"))
    parsed = F.from_json("value", "map<string,string>")
    return document.select(F.explode(parsed).alias("feature", "default_value"))


def read_feature_list(spark: SparkSession, path: str, key: str = "features") -> DataFrame:
    """The ordered feature names of a config document, as ``(position, feature)``."""
    document = spark.read.text(path, wholetext=True)
    names = F.from_json(F.get_json_object("value", f"$.{key}"), "array<string>")
    return document.select(F.posexplode(names).alias("position", "feature"))
