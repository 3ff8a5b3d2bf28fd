"""Exact path-dependent Shapley attributions of a boosted tree model.

A leaf is reached through a few features. A coalition's worth at a leaf is its value
times, for each member, 1 or 0 (condition met or not) and, for each other feature, the
share of training rows that pass. The Shapley value of a feature is then an integral
over t from 0 to 1 of the product of share * (1 - t) + met * t over the other features: a
polynomial of a degree below the number of features, which a Gauss rule of half as many
points integrates exactly. So a leaf costs its depth squared, not a power of two, and
nothing but the leaves themselves is worked out on the driver. They travel by broadcast;
rows never leave their partition.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.ml.classification import GBTClassificationModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, functions as F

from cohortlab.functions.columns import exprs, lines
from cohortlab.models.trees import node_table

# Workers get these functions by value, so the package need not be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# A margin counts twice in Spark's log-odds: p = 1 / (1 + exp(-2 * margin)).
LOG_ODDS = 2.0


@dataclass
class Leaf:
    """A leaf's features, the conditions on each, the share of rows that pass each, its value."""

    features: list[int]
    conditions: list[list[tuple]]
    shares: np.ndarray
    value: float

    @property
    def base(self) -> float:
        return self.value * float(np.prod(self.shares))


def leaf_shapley(leaf: Leaf, met: np.ndarray) -> np.ndarray:
    """Shapley values of the leaf's features for rows of met conditions (0 or 1)."""
    m = len(leaf.features)
    points, weights = np.polynomial.legendre.leggauss((m + 1) // 2 or 1)
    phi = np.zeros(met.shape)
    for t, w in zip((points + 1) / 2, weights / 2):
        factors = leaf.shares * (1 - t) + met * t
        # Products of all but one, without a division: a share may be zero.
        left = np.cumprod(np.hstack([np.ones((len(met), 1)), factors[:, :-1]]), axis=1)
        right = np.cumprod(np.hstack([np.ones((len(met), 1)), factors[:, :0:-1]]), axis=1)[:, ::-1]
        phi += w * left * right
    return leaf.value * (met - leaf.shares) * phi


def leaves_of(model: GBTClassificationModel) -> list[Leaf]:
    """All leaves of a fitted model, in log-odds."""
    return leaves_from(node_table(model), model.treeWeights)


def leaves_from(nodes: pd.DataFrame, weights: Sequence[float]) -> list[Leaf]:
    """All leaves of a node table (tree, id, prediction, cover, left, right, feature, cut,
    categories), in log-odds; ``weights`` by tree."""
    found: list[Leaf] = []
    for tree, own in nodes.groupby("tree"):
        by_id = own.set_index("id").to_dict("index")
        stack: list[tuple[int, dict, dict]] = [(0, {}, {})]
        while stack:
            at, tests, shares = stack.pop()
            node = by_id[at]
            if node["left"] < 0:
                value = LOG_ODDS * weights[tree] * node["prediction"]
                found.append(Leaf(list(tests), list(tests.values()), np.array([shares[f] for f in tests]), value))
                continue
            f = node["feature"]
            cut = tuple(node["cut"])
            for child, goes_left in ((node["left"], True), (node["right"], False)):
                test = ("in" if node["categories"] >= 0 else "le", cut, goes_left)
                share = by_id[child]["cover"] / node["cover"]
                stack.append((child, {**tests, f: [*tests.get(f, []), test]}, {**shares, f: shares.get(f, 1.0) * share}))
    return found


def base_value(leaves: Sequence[Leaf]) -> float:
    """The expected log-odds over the training rows."""
    return sum(leaf.base for leaf in leaves)


def _meets(x: np.ndarray, test: tuple) -> np.ndarray:
    kind, cut, goes_left = test
    left = np.isin(x, cut) if kind == "in" else x <= cut[0]
    return left if goes_left else ~left


def attribute(matrix: np.ndarray, leaves: Sequence[Leaf]) -> np.ndarray:
    """Attributions of a batch: rows x features. Rows that meet the same conditions of a leaf
    share its values, so each pattern that occurs is worked out once."""
    phi = np.zeros_like(matrix, dtype=float)
    for leaf in leaves:
        if not leaf.features:
            continue
        met = np.column_stack([
            np.logical_and.reduce([_meets(matrix[:, f], t) for t in tests]) for f, tests in zip(leaf.features, leaf.conditions)
        ])
        pattern = np.ascontiguousarray(np.packbits(met, axis=1))
        _, first, back = np.unique(pattern.view([("", pattern.dtype)] * pattern.shape[1]).ravel(), return_index=True, return_inverse=True)
        phi[:, leaf.features] += leaf_shapley(leaf, met[first].astype(float))[back.ravel()]
    return phi


def attributions(
    model: GBTClassificationModel, rows: DataFrame, key: str, names: Sequence[str],
    leaves: Sequence[Leaf] | None = None,
) -> DataFrame:
    """(key, feature, phi) for every row and feature, in log-odds."""
    leaves = leaves_of(model) if leaves is None else leaves
    return leaf_attributions(rows.select(key, vector_to_array("features").alias("x")), key, names, leaves)


def leaf_attributions(rows: DataFrame, key: str, names: Sequence[str], leaves: Sequence[Leaf]) -> DataFrame:
    """(key, feature, phi) from (key, x), where x is the array of a row's features."""
    names = list(names)
    shared = rows.sparkSession.sparkContext.broadcast(list(leaves))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch) == 0:
                continue
            phi = attribute(np.stack(batch["x"].to_list()), shared.value)
            yield pd.DataFrame({
                key: np.repeat(batch[key].to_numpy(), len(names)),
                "feature": np.tile(np.array(names, dtype=object), len(batch)),
                "phi": phi.ravel(),
            })

    return rows.mapInPandas(run, f"{key} long, feature string, phi double")


def importance(phi: DataFrame, top: int | None = None) -> DataFrame:
    """Mean absolute attribution per feature, largest first."""
    ranked = phi.groupBy("feature").agg(F.expr("avg(abs(phi)) AS mean_abs_shap")).orderBy(
        F.desc("mean_abs_shap"), "feature"
    )
    return ranked if top is None else ranked.limit(top)


def mean_attribution(phi: DataFrame) -> DataFrame:
    """The overall mean, a sanity figure that should be near zero."""
    return phi.agg(F.expr("avg(phi) AS mean_phi"))


def extreme_reasons(
    phi: DataFrame, scored: DataFrame, key: str, base: float, top: int = 15
) -> DataFrame:
    """The largest contributions of the rows with the highest and lowest p.

    Two keys are picked by a one-row aggregate; the window sees their rows only.
    """
    picked = scored.agg(*exprs([
        f"max_by(struct({key}, y_true, p), struct(p, -{key})) AS hi",
        f"min_by(struct({key}, y_true, p), struct(p, {key})) AS lo",
    ])).selectExpr(lines([
        {"side": f"'{side}'", key: f"{c}.{key}", "y_true": f"{c}.y_true", "p": f"{c}.p"}
        for side, c in (("highest", "hi"), ("lowest", "lo"))
    ]))
    joined = phi.join(F.broadcast(picked), key)  # two rows
    rank = "row_number() OVER (PARTITION BY side ORDER BY abs(phi) DESC, feature)"
    return joined.selectExpr(
        "side", key, "y_true", "p", f"{float(base)!r}D AS base_value", "feature", "phi", f"{rank} AS rank"
    ).where(f"rank <= {top}")
