"""Leave one category out, and the summary of how well models carry over."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, functions as F

from cohortlab.functions.columns import exprs, percent_text
from cohortlab.models.trees import in_parallel
from cohortlab.operators.metrics import ScoreTable, ranking_quality, score_counts
from cohortlab.session import Written, exists, fresh_path


def categories(df: DataFrame, column: str) -> list[str]:
    """Distinct non-null categories in text order; each one costs a model fit."""
    rows = df.where(f"{column} IS NOT NULL").select(F.col(column).cast("string").alias("c")).distinct().orderBy("c")
    return [r["c"] for r in rows.collect()]


def leave_one_group_out(
    df: DataFrame, column: str, label: str,
    fit_and_score: Callable[[DataFrame, DataFrame], DataFrame],
    width: int = 4, folder: str | None = None,
) -> DataFrame:
    """Train on all other categories, test on the one held out, for each category.

    ``fit_and_score(train, test)`` gives (y_true, p) rows; ``width`` categories run side by
    side, whatever their number. Each leaves its score counts in ``folder`` when done, and
    a walk that starts again there goes on with those that are missing. All are then
    judged together; AUC and average precision are NULL where the held-out rows have one
    class or none could be scored.
    """
    known = df.where(f"{column} IS NOT NULL")
    spark = df.sparkSession
    folder = folder or fresh_path(spark, "held-out")

    def run(item: tuple[int, str]) -> None:
        i, held = item
        path = f"{folder}/part={i}"
        if exists(spark, f"{path}/_SUCCESS"):
            return
        own = F.col(column).cast("string") == F.lit(held)
        scored = fit_and_score(known.where(~own), known.where(own))
        counts = score_counts(scored.select(F.lit(held).alias("held_out_category"), "y_true", "p"), by=["held_out_category"])
        counts.write.mode("overwrite").parquet(path)

    found = list(enumerate(categories(df, column)))
    in_parallel(run, found, width)
    schema = "held_out_category string, threshold double, refused string, tp bigint, fp bigint"
    counts = spark.read.schema(schema).parquet(*[f"{folder}/part={i}" for i, _ in found]) if found else spark.createDataFrame([], schema)
    quality = ranking_quality(ScoreTable(Written(folder, counts), ("held_out_category",)), by=["held_out_category"])
    sizes = known.groupBy(F.col(column).cast("string").alias("held_out_category")).agg(*exprs([
        "count(*) AS n_test", f"cast(sum({label}) AS bigint) AS n_test_deaths"
    ])).selectExpr(
        "held_out_category",
        "sum(n_test) OVER () - n_test AS n_train",
        "sum(n_test_deaths) OVER () - n_test_deaths AS n_train_deaths",
        "n_test",
        "n_test_deaths",
    )
    return sizes.join(quality, "held_out_category", "left").selectExpr(
        "held_out_category", "n_train", "n_train_deaths", "n_test", "n_test_deaths",
        f"{percent_text('n_test_deaths / n_test')} AS test_mortality",
        "roc_auc AS test_roc_auc",
        "average_precision AS test_pr_auc",
    ).orderBy("held_out_category")


def summary(results: DataFrame, in_distribution: float) -> DataFrame:
    """Mean and sample spread of the held-out AUC, and the gap to the usual split."""
    return results.agg(*exprs([
        "avg(test_roc_auc) AS mean_roc_auc",
        "stddev_samp(test_roc_auc) AS std_roc_auc",
        "count(test_roc_auc) AS n_categories",
    ])).selectExpr(
        "mean_roc_auc", "std_roc_auc", "n_categories",
        f"{float(in_distribution)!r}D AS in_distribution_roc_auc",
        f"round(100 * ({float(in_distribution)!r}D - mean_roc_auc), 1) AS gap_points",
    )


def presentation(results: DataFrame) -> DataFrame:
    """Rounded, with report headings."""
    names = {
        "held_out_category": "Held-out category", "n_train": "N train", "n_train_deaths": "Train deaths",
        "n_test": "N test", "n_test_deaths": "Test deaths", "test_mortality": "Test mortality",
        "test_roc_auc": "ROC-AUC", "test_pr_auc": "PR-AUC",
    }
    rounded = results.selectExpr(*[
        f"round({c}, 3) AS {c}" if c in ("test_roc_auc", "test_pr_auc") else c for c in names
    ])
    return rounded.withColumnsRenamed(names)
