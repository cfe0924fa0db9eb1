"""Tabular mean-and-variance models on Spark ML."""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.ml.base import Model
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressionModel, GBTRegressor, LinearRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronoweave.functions.links import nan_to_null
from chronoweave.session import pin

VARIANCE_OFFSET = 1e-2


@dataclass(frozen=True)
class LeafVariances:
    """The mean squared residual of every leaf of every tree times the tree's weight, as one table of trees x leaves."""

    table: tuple[tuple[float, ...], ...]
    scale: float = 1.0

    def of(self, leaves: Column) -> Column:
        """The sum over all trees of what the table has for the row's leaf."""
        cells = F.from_json(F.lit(json.dumps(self.table)), "array<array<double>>")
        found = F.transform(leaves, lambda leaf, tree: F.element_at(F.element_at(cells, tree + 1), leaf.cast("int") + 1))
        return F.aggregate(found, F.lit(0.0), lambda a, x: a + x) * F.lit(self.scale)


@dataclass(frozen=True)
class MeanVariance:
    """A fitted mean model and, for the gaussian task, a fitted variance model."""

    inputs: tuple[str, ...]
    mean: Model
    variance: Model | LeafVariances | None
    name: str

    def predict(self, df: DataFrame) -> DataFrame:
        """Add `mu` and, for the gaussian task, `sigma`; a negative predicted variance gives NULL."""
        kept = df.columns
        out = self.mean.transform(features(df, self.inputs)).withColumnRenamed("_mean", "mu")
        if self.variance is None:
            return out.select(*kept, "mu")
        if isinstance(self.variance, LeafVariances):
            out = out.withColumn("_variance", self.variance.of(vector_to_array("_leaves")))
        else:
            out = self.variance.transform(out)
        return out.select(*kept, "mu", F.when(F.col("_variance") >= 0, F.sqrt("_variance")).alias("sigma"))


def features(df: DataFrame, inputs) -> DataFrame:
    """Assemble inputs into a vector with missing values set to 0."""
    filled = [F.coalesce(nan_to_null(F.col(c).cast("double")), F.lit(0.0)).alias(f"_in_{c}") for c in inputs]
    names = [f"_in_{c}" for c in inputs]
    wide = df.select("*", *filled)
    return VectorAssembler(inputCols=names, outputCol="_features").transform(wide).drop(*names)


def _squared_error(label: str) -> Column:
    return F.pow(F.col(label) - F.col("_mean"), 2)


def fit_linear(df: DataFrame, inputs, label: str = "target", task: str = "gaussian") -> MeanVariance:
    """Least squares for the mean and, for the gaussian task, again for the squared residual plus 1e-2."""
    data = features(df.filter(F.col(label).isNotNull()), inputs)

    def ols(target: str, out: str) -> LinearRegression:
        return LinearRegression(
            featuresCol="_features", labelCol=target, predictionCol=out, solver="normal", regParam=0.0
        )

    mean = ols(label, "_mean").fit(data)
    variance = None
    if task == "gaussian":
        residuals = mean.transform(data).withColumn("_sq", _squared_error(label) + F.lit(VARIANCE_OFFSET))
        variance = ols("_sq", "_variance").fit(residuals)
    return MeanVariance(tuple(inputs), mean, variance, "LinearModel")


def leaf_variances(model: GBTRegressionModel, scored: DataFrame, label: str) -> LeafVariances:
    """Average the squared residual over the rows of every leaf.

    Trees count by the square of how much of the squared residuals' spread lies between their leaves; alike if none does.
    `scored` has the model's `_mean` and `_leaves`. A leaf that no row reaches takes its tree's mean. The table has at most
    eight cells per tree and comes to the driver; rows meet it in map-side aggregates, never in one place.
    """
    leaf = F.posexplode(vector_to_array("_leaves")).alias("_tree", "_leaf")
    rows = scored.select(_squared_error(label).alias("_sq"), leaf)
    cells = rows.groupBy("_tree", "_leaf").agg(F.sum("_sq").alias("sq"), F.count(F.lit(1)).alias("n")).collect()
    table, weights = [], []
    for tree in range(model.getNumTrees):
        own = {int(c["_leaf"]): c for c in cells if c["_tree"] == tree}
        overall = sum(c["sq"] for c in own.values()) / max(sum(c["n"] for c in own.values()), 1)
        leaves = (model.trees[tree].numNodes + 1) // 2
        table.append([own[i]["sq"] / own[i]["n"] if i in own else overall for i in range(leaves)])
        weights.append(sum(c["n"] * (c["sq"] / c["n"] - overall) ** 2 for c in own.values()) ** 2)
    total = sum(weights)
    shares = [w / total if total else 1 / len(weights) for w in weights]
    return LeafVariances(tuple(tuple(v * share for v in row) for row, share in zip(table, shares)))


def fit_trees(
    df: DataFrame,
    inputs,
    label: str = "target",
    task: str = "gaussian",
    validation: str | None = None,
    rounds: int = 10_000,
    seed: int = 0,
    depth: int = 3,
    rate: float = 0.1,
    tolerance: float = 0.01,
) -> MeanVariance:
    """Boosted trees; rows with a true `validation` column decide when to stop and how wide forecasts are, and fit no tree.

    Without such rows all `rounds` are run. The variance of a row is the mean, over the trees, of the squared residuals of
    the training rows in its leaf (see `leaf_variances`). Training rows lie closer to their own model than others do, so the variances are scaled
    so that the validation rows' squared residuals are, on average, once their variance. The original library has one loss for both, so numbers differ by
    design.
    """
    data = features(df.filter(F.col(label).isNotNull()), inputs)
    boost = GBTRegressor(
        featuresCol="_features", labelCol=label, predictionCol="_mean", leafCol="_leaves", maxDepth=depth, stepSize=rate, maxIter=rounds,
        seed=seed, validationTol=tolerance,
    )
    if validation:
        data = pin(data.withColumn(validation, F.coalesce(F.col(validation), F.lit(False))))
        boost = boost.setValidationIndicatorCol(validation)
    mean = boost.fit(data)
    if task != "gaussian":
        return MeanVariance(tuple(inputs), mean, None, "BoostedTrees")
    scored = mean.transform(data)
    variance = leaf_variances(mean, scored.filter(~F.col(validation)) if validation else scored, label)
    if validation:
        told = variance.of(vector_to_array("_leaves"))
        scale = scored.filter(F.col(validation)).agg(F.avg(F.when(told > 0, _squared_error(label) / told))).first()[0]
        variance = LeafVariances(variance.table, scale or 1.0)
    return MeanVariance(tuple(inputs), mean, variance, "BoostedTrees")
