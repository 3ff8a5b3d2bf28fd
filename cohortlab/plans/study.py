"""One study: the written feature table, its split, and the models fitted on it."""

from __future__ import annotations

from functools import cached_property

from pyspark.ml import PipelineModel
from pyspark.ml.classification import GBTClassificationModel
from pyspark.sql import DataFrame, SparkSession, functions as F

from cohortlab.functions import contract as k
from cohortlab.functions.columns import exprs, number
from cohortlab.models import generalise, linear, stepwise, trees
from cohortlab.models.attribution import attributions, base_value, leaves_of
from cohortlab.models.split import FOLDS, study_split
from cohortlab.operators.metrics import ranking_quality
from cohortlab.plans.features import feature_table
from cohortlab.session import materialise
from cohortlab.sources.readers import Tables

GROUP = "numbedscategory"


class Study:
    """Everything a model run shares. Each part is made on first use and kept.

    The feature table is written once and read back by every fit, the way the
    split is drawn once and stored beside it, never recreated.
    """

    def __init__(self, spark: SparkSession, tables: Tables):
        self.spark = spark
        self.tables = tables

    @cached_property
    def features(self) -> DataFrame:
        return materialise(feature_table(self.tables), "features")

    @cached_property
    def rows(self) -> DataFrame:
        """Features with ``split``, ``is_validation`` and ``fold``."""
        parts = study_split(self.features.select(k.STAY_ID, k.TARGET), k.TARGET, k.STAY_ID)
        return materialise(self.features.join(parts.drop(k.TARGET), k.STAY_ID), "study")

    @property
    def train(self) -> DataFrame:
        return self.rows.where("split = 'train'")

    @property
    def test(self) -> DataFrame:
        return self.rows.where("split = 'test'")

    # --- linear ---

    @cached_property
    def logistic(self) -> PipelineModel:
        return linear.fit_logistic(self.train, k.NUMERIC_FEATURES, k.TARGET)

    @cached_property
    def demo(self) -> PipelineModel:
        return linear.fit_logistic(self.train, k.DEMO_FEATURES, k.TARGET)

    def logistic_predictions(self) -> DataFrame:
        return linear.score(self.logistic, self.test, k.STAY_ID, k.TARGET)

    def demo_predictions(self) -> DataFrame:
        return linear.score(self.demo, self.test, k.STAY_ID, k.TARGET)

    def logistic_folds(self, columns=k.DEMO_FEATURES) -> DataFrame:
        """(fold, n, n_pos, roc_auc, average_precision): one fit per fold."""
        def run(i: int) -> DataFrame:
            model = linear.fit_logistic(self.train.where(f"fold != {i}"), columns, k.TARGET)
            return linear.score(model, self.train.where(f"fold = {i}"), k.STAY_ID, k.TARGET, ["fold"])

        parts = trees.in_parallel(run, range(FOLDS), width=FOLDS)
        scored = parts[0]
        for other in parts[1:]:
            scored = scored.unionByName(other)
        return ranking_quality(scored, by=["fold"])

    # --- trees ---

    @cached_property
    def preparation(self) -> PipelineModel:
        return trees.tree_preparation(self.rows, k.NUMERIC_FEATURES, k.CATEGORICAL)

    @cached_property
    def max_categories(self) -> int:
        return trees.category_count(self.rows, k.CATEGORICAL)

    def prepared(self, rows: DataFrame, weight: float) -> DataFrame:
        keep = [k.STAY_ID, k.TARGET, GROUP, "split", "is_validation", "fold"]
        return trees.prepared(self.preparation, rows, k.TARGET, weight, keep)

    @cached_property
    def train_weight(self) -> float:
        return trees.positive_weight(self.train, k.TARGET)

    def train_rows(self) -> DataFrame:
        return self.prepared(self.train, self.train_weight)

    def test_rows(self) -> DataFrame:
        return self.prepared(self.test, self.train_weight)

    @cached_property
    def boosted(self) -> GBTClassificationModel:
        return trees.fit_boosted(self.train_rows(), trees.FINAL, self.max_categories)

    def boosted_predictions(self) -> DataFrame:
        return trees.score_boosted(self.boosted, self.test_rows(), [k.STAY_ID])

    @cached_property
    def matrix(self) -> tuple[DataFrame, int]:
        """The quantised features of all rows, written once for every search, and maxBins."""
        rows, bins = stepwise.quantised(
            self.rows, k.NUMERIC_FEATURES, k.CATEGORICAL, k.TARGET, self.train_weight,
            [k.STAY_ID, "split", "is_validation", "fold"], learn="split = 'train'",
        )
        return materialise(rows, "matrix"), bins

    # --- explanation and generalisation ---

    @cached_property
    def tree_leaves(self):
        return leaves_of(self.boosted)

    @property
    def base_value(self) -> float:
        return base_value(self.tree_leaves)

    @cached_property
    def attributions(self) -> DataFrame:
        names = [*k.NUMERIC_FEATURES, *k.CATEGORICAL]
        found = attributions(self.boosted, self.test_rows(), k.STAY_ID, names, leaves=self.tree_leaves)
        return materialise(found, "attributions")

    @cached_property
    def cross_group(self) -> DataFrame:
        return materialise(self.held_out_groups(), "cross-group")

    def held_out_groups(self, weight_from: str = "all") -> DataFrame:
        """Leave-one-group-out results. The class weight comes from all rows, as the published
        figures do it, or with ``weight_from="train"`` from each round's own train rows."""
        if weight_from not in ("all", "train"):
            raise ValueError(weight_from)
        known = self.rows.where(f"{GROUP} IS NOT NULL")
        overall = trees.positive_weight(known, k.TARGET) if weight_from == "all" else 1.0
        rows = self.prepared(known, overall)

        def fit_and_score(train: DataFrame, test: DataFrame) -> DataFrame:
            if weight_from == "train":
                own = trees.positive_weight(train, k.TARGET)
                train = train.selectExpr("* EXCEPT (weight)", f"CASE WHEN label = 1 THEN {number(own)} ELSE 1.0D END AS weight")
            model = trees.fit_boosted(train, trees.FINAL, self.max_categories)
            return trees.score_boosted(model, test, [k.STAY_ID])

        return generalise.leave_one_group_out(rows, GROUP, k.TARGET, fit_and_score)


def quality_row(scored: DataFrame, model: str) -> DataFrame:
    """One row: sizes, prevalence, AUC and average precision."""
    return ranking_quality(scored).selectExpr(
        f"'{model}' AS model", "n AS n_test", "n_pos AS n_test_deaths", "n_pos / n AS prevalence",
        "roc_auc", "average_precision AS pr_auc",
    )


def fold_summary(per_fold: DataFrame, model: str) -> DataFrame:
    return per_fold.agg(*exprs([
        "count(*) AS n_folds", "avg(roc_auc) AS auc_mean", "stddev_pop(roc_auc) AS auc_std"
    ])).select(F.lit(model).alias("model"), "n_folds", "auc_mean", "auc_std")
