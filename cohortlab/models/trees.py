"""Boosted trees: preparation, training and scores."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from typing import TypeVar

import numpy as np
import pandas as pd
from pyspark.ml import PipelineModel
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import SQLTransformer, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.util import inheritable_thread_target

from cohortlab.functions.columns import exprs
from cohortlab.session import fresh_path

# The final configuration and the four of the sweep. Spark grows
# trees by level, so a leaf limit becomes the depth that holds as many leaves.
FILL_VALUE = -1.0


@dataclass(frozen=True)
class Boosting:
    name: str = "final"
    rounds: int = 56
    learning_rate: float = 0.05
    leaves: int = 15
    min_rows: int = 30
    seed: int = 42

    @property
    def depth(self) -> int:
        return max(1, int(np.ceil(np.log2(self.leaves))))


FINAL = Boosting()
SWEEP = (
    Boosting("default", 1000, 0.05, 31, 20),
    Boosting("smaller_trees", 1000, 0.05, 15, 30),
    Boosting("tiny_trees", 1000, 0.05, 7, 40),
    Boosting("slow_learning", 1000, 0.02, 15, 30),
)
T = TypeVar("T")
R = TypeVar("R")


def in_parallel(f: Callable[[T], R], items: Iterable[T], width: int = 4) -> list[R]:
    """Run independent fits side by side; each fit is itself a distributed job."""
    with ThreadPoolExecutor(max_workers=width) as pool:
        return list(pool.map(inheritable_thread_target(SparkSession.active())(f), items))


def category_count(df: DataFrame, categorical: Sequence[str]) -> int:
    """The largest number of distinct values among the categorical columns."""
    row = df.agg(*exprs(f"count(DISTINCT {c}) AS {c}" for c in categorical)).first()
    return max(row[c] for c in categorical)


def tree_preparation(df: DataFrame, numeric: Sequence[str], categorical: Sequence[str]) -> PipelineModel:
    """Index the categories (NULL gets an index of its own) and assemble.

    Missing numbers take a value below every plausible range; their flags stay.
    The indexer is fitted on the rows given: pass all of them, so that a held-out
    category has its index too.
    """
    fills = ", ".join(
        f"coalesce(cast({c} AS double), {FILL_VALUE}D) AS n_{c}" for c in numeric
    )
    fill = SQLTransformer(statement=f"SELECT *, {fills} FROM __THIS__")
    index = StringIndexer(
        inputCols=list(categorical), outputCols=[f"i_{c}" for c in categorical],
        handleInvalid="keep", stringOrderType="alphabetAsc",
    ).fit(df.select(*categorical))
    inputs = [f"n_{c}" for c in numeric] + [f"i_{c}" for c in categorical]
    return PipelineModel(stages=[fill, index, VectorAssembler(inputCols=inputs, outputCol="features")])


def positive_weight(df: DataFrame, label: str) -> float:
    """Negatives per positive; 1 when there is no positive row."""
    row = df.agg(*exprs([f"count_if({label} = 0) AS n", f"count_if({label} = 1) AS p"])).first()
    return row["n"] / row["p"] if row["p"] else 1.0


def prepared(preparation: PipelineModel, df: DataFrame, label: str, weight: float, keep: Sequence[str]) -> DataFrame:
    """Features, label and weight, with the columns to keep."""
    return preparation.transform(df).selectExpr(
        *keep, "features", f"cast({label} AS double) AS label",
        f"CASE WHEN {label} = 1 THEN {float(weight)!r}D ELSE 1.0D END AS weight",
    )


def fit_boosted(rows: DataFrame, config: Boosting = FINAL, max_categories: int = 0) -> GBTClassificationModel:
    """Boosted trees on prepared rows, all of the configuration's rounds."""
    learner = GBTClassifier(
        featuresCol="features", labelCol="label", weightCol="weight", maxIter=config.rounds,
        stepSize=config.learning_rate, maxDepth=config.depth, minInstancesPerNode=config.min_rows,
        maxBins=max(32, max_categories + 2), seed=config.seed,
    )
    return learner.fit(rows)


def score_boosted(model: GBTClassificationModel, rows: DataFrame, keep: Sequence[str]) -> DataFrame:
    out = model.transform(rows)
    return out.select(*keep, out["label"].alias("y_true"), vector_to_array(out["probability"])[1].alias("p"))


def node_table(model: GBTClassificationModel) -> pd.DataFrame:
    """Every node of every tree. Rows are bounded by rounds x 2**(depth + 1)."""
    spark = SparkSession.active()
    path = fresh_path(spark, "trees")
    model.write().save(path)
    nodes = spark.read.parquet(f"{path}/data").selectExpr(
        "treeID AS tree", "nodeData.id AS id", "nodeData.prediction AS prediction",
        "nodeData.rawCount AS cover", "nodeData.leftChild AS left", "nodeData.rightChild AS right",
        "nodeData.split.featureIndex AS feature", "nodeData.split.leftCategoriesOrThreshold AS cut",
        "nodeData.split.numCategories AS categories",
    )
    return nodes.toPandas().sort_values(["tree", "id"]).reset_index(drop=True)
