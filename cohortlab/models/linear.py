"""L2 logistic regression: fit, score, and per-row reasons."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.ml import PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame

from cohortlab.functions.bands import risk_band
from cohortlab.functions.columns import lines, number, quoted
from cohortlab.models.prepare import Scaling, fit_scaling, scaled_name


def fit_logistic(
    train: DataFrame, columns: Sequence[str], label: str, c: float = 1.0, max_iter: int = 1000, tol: float = 1e-10
) -> PipelineModel:
    """Impute, scale, classify.

    The penalty is that of a summed loss with strength 1/c; Spark averages the
    loss over the rows, hence the division by their number.
    """
    scaling = fit_scaling(train, columns)
    scale = scaling.stage()
    assemble = VectorAssembler(inputCols=[scaled_name(x) for x in columns], outputCol="features")
    learner = LogisticRegression(
        featuresCol="features",
        labelCol="label",
        regParam=1.0 / (c * scaling.n_rows),
        elasticNetParam=0.0,
        standardization=False,
        maxIter=max_iter,
        tol=tol,
    )
    rows = assemble.transform(scale.transform(train.selectExpr("*", f"cast({label} AS double) AS label")))
    return PipelineModel(stages=[scale, assemble, learner.fit(rows.select("features", "label"))])


def score(model: PipelineModel, df: DataFrame, key: str, label: str, extra: Sequence[str] = ()) -> DataFrame:
    """(key, extra, y_true, p): one probability per row."""
    out = model.transform(df)
    return out.select(
        key, *extra, out[label].cast("double").alias("y_true"),
        vector_to_array(out["probability"])[1].alias("p"),
    )


def coefficients(model: PipelineModel, columns: Sequence[str]) -> tuple[dict[str, float], float]:
    """Weights by feature, and the intercept, of a fitted pipeline."""
    fitted = model.stages[-1]
    return dict(zip(columns, (float(w) for w in fitted.coefficients))), float(fitted.intercept)


def contributions(df: DataFrame, key: str, scaling: Scaling, weights: Mapping[str, float]) -> DataFrame:
    """(key, feature, contribution) in log-odds, one row per row and feature."""
    return df.selectExpr(key, lines(
        {"feature": quoted(c), "contribution": f"{number(w)} * {scaling.scaled(c)}"} for c, w in weights.items()
    ))


def scored_with_reasons(
    df: DataFrame, key: str, scaling: Scaling, weights: Mapping[str, float], intercept: float, top: int = 3
) -> DataFrame:
    """Probability, risk band and the largest contributions of every row.

    The reasons are sorted inside the row's own array, so nothing is shuffled.
    """
    structs = ", ".join(
        f"named_struct('feature', {quoted(c)}, 'contribution', {number(w)} * {scaling.scaled(c)})"
        for c, w in weights.items()
    )
    order = (
        "CASE WHEN abs(a.contribution) > abs(b.contribution) THEN -1"
        " WHEN abs(a.contribution) < abs(b.contribution) THEN 1"
        " WHEN a.feature < b.feature THEN -1 WHEN a.feature > b.feature THEN 1 ELSE 0 END"
    )
    return (
        df.selectExpr(key, f"array({structs}) AS _parts")
        .selectExpr(
            key,
            f"{number(intercept)} + aggregate(_parts, 0.0D, (acc, x) -> acc + x.contribution) AS _z",
            f"array_sort(_parts, (a, b) -> {order}) AS _parts",
        )
        .selectExpr(key, "1.0D / (1.0D + exp(-_z)) AS p", f"slice(_parts, 1, {top}) AS reasons")
        .selectExpr(key, "p", f"{risk_band('p')} AS risk", "reasons")
    )
