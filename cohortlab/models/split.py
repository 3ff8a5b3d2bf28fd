"""Stratified splits and folds, exact per class and repeatable from the seed."""

from __future__ import annotations

from pyspark.sql import DataFrame

from cohortlab.operators.ordered import class_rank, first_share

SEED = 42
TEST_SHARE = 0.2
FOLDS = 5


def train_test_split(
    df: DataFrame, label: str, key: str, share: float = TEST_SHARE, seed: int | str = SEED
) -> DataFrame:
    """Adds ``split``: the first ``share`` of each class in seeded order is 'test'."""
    cut = first_share(df, label, key, seed, share, "_in_share")
    return cut.selectExpr(*df.columns, "CASE WHEN _in_share THEN 'test' ELSE 'train' END AS split")


def nested_validation(df: DataFrame, label: str, key: str, share: float = TEST_SHARE, seed: int | str = SEED) -> DataFrame:
    """Adds ``is_validation``: a stratified share of the train rows only."""
    return first_share(df, label, key, f"{seed}/validation", share, "is_validation", among="split = 'train'")


def train_folds(df: DataFrame, label: str, key: str, folds: int = FOLDS, seed: int | str = SEED) -> DataFrame:
    """Adds ``fold`` 0..folds-1 on the train rows, NULL on the test rows."""
    classed = df.selectExpr("*", f"concat(split, '/', cast({label} AS string)) AS _class")
    ranked = class_rank(classed, "_class", key, f"{seed}/folds")
    fold = f"CASE WHEN split = 'train' THEN cast((class_rank - 1) % {folds} AS int) END AS fold"
    return ranked.selectExpr(*df.columns, fold)


def study_split(df: DataFrame, label: str, key: str) -> DataFrame:
    """Test split, nested validation part and folds together."""
    return train_folds(nested_validation(train_test_split(df, label, key), label, key), label, key)
