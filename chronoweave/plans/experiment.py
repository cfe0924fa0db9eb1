"""Train, predict and score per fold, and over a grid of settings.

The driver loops over folds and settings only; every fit, prediction and score is a Spark job.
"""

from __future__ import annotations

from dataclasses import replace
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoweave.functions.links import exp_link, log_link
from chronoweave.operators.entities import fold_by_entity, split_by_entity
from chronoweave.operators.features import lag_features, lag_names
from chronoweave.operators.least_squares import fit_folds, store_for_fits
from chronoweave.operators.models import MeanVariance, fit_trees
from chronoweave.operators.scoring import score, score_points
from chronoweave.operators.summaries import tagged_union
from chronoweave.roles import Roles
from chronoweave.session import pin
from chronoweave.sources.runs import append_metrics, save_predictions


def with_folds(df: DataFrame, roles: Roles, k: int, seed: int = 0) -> DataFrame:
    """`fold` per row: k contiguous folds, or for k = 1 one 80/20 split where fold 0 is the test side."""
    if k > 1:
        return fold_by_entity(df, k, roles.id)
    split = split_by_entity(df, 0.2, seed, roles.id, "_test")
    return split.withColumn("fold", F.when(F.col("_test"), 0).otherwise(-1)).drop("_test")


def fit_tree_model(df: DataFrame, roles: Roles, task: str, **settings) -> MeanVariance:
    inputs = ["delta_t", *lag_names(roles.timevarying), *roles.model_inputs]
    held = split_by_entity(df, 0.1, settings.pop("split_seed", 0), roles.id, "_validation")
    return fit_trees(held, inputs, "target", task, "_validation", **settings)


def run_folds(
    df: DataFrame,
    roles: Roles,
    model: str = "LinearModel",
    k: int = 3,
    task: str = "gaussian",
    seed: int = 0,
    predictions_path: str | None = None,
    metrics_path: str | None = None,
    **settings,
) -> tuple[DataFrame, DataFrame]:
    """Predictions (`rn, mu[, sigma], target, model, fold`) and one metric row per fold.

    Each fold's model is fitted on the other folds' unmasked rows; linear ones of all folds together. Lag features, which a tree model uses, look
    only at the row's own entity, so they can be made once before the split.
    """
    data = df
    if model != "LinearModel":
        data = lag_features(
            data, roles.timevarying, roles.id, roles.time_vars, order=[roles.time_vars[0], roles.key]
        )
    data = data.filter(F.col(roles.target_mask) == 0).withColumn("target", log_link(F.col(roles.target)))
    data = with_folds(data, roles, k, seed)
    outputs = ["mu", "sigma"] if task == "gaussian" else ["mu"]

    def predicted(df: DataFrame, name: str) -> DataFrame:
        return df.select(F.col(roles.key).alias("rn"), *outputs, "target", F.lit(name).alias("model"), "fold")

    if model == "LinearModel":
        data, seen = store_for_fits(data, roles.model_inputs)
        fitted = fit_folds(data, seen, roles.model_inputs, list(range(k)), task=task)
        predictions = predicted(fitted.predict(data.filter(F.col("fold") >= 0)), fitted.name)
    else:
        data, parts = pin(data), []  # every fold's fit and prediction reads the same rows
        for fold in range(k):
            fitted = fit_tree_model(data.filter(F.col("fold") != fold), roles, task, **dict(settings))
            parts.append(predicted(fitted.predict(data.filter(F.col("fold") == fold)), fitted.name))
        predictions = reduce(DataFrame.unionByName, parts)
    by = ["model", "fold"]
    scores = score(predictions.na.drop(), by, exp_link) if task == "gaussian" else score_points(predictions, by, exp_link)
    if predictions_path:
        save_predictions(predictions, predictions_path)
    if metrics_path:
        append_metrics(scores, metrics_path)
    return predictions, scores


def run_grid(df: DataFrame, roles: Roles, grid: list[dict], param: str, **fixed) -> DataFrame:
    """Scores for every setting in `grid`, stacked, with the parameter's name and value (a number if all values are)."""
    values = [setting[param] for setting in grid]
    numeric = all(isinstance(v, (int, float)) and not isinstance(v, bool) for v in values)
    results = {}
    for setting, value in zip(grid, values):
        _, scores = run_folds(df, roles, **{**fixed, **setting})
        results[float(value) if numeric else str(value)] = scores
    return tagged_union(results, "value").withColumn("param", F.lit(param))


def run_sweep(df: DataFrame, roles: Roles, sweeps: dict[str, dict[str, list]], **fixed) -> DataFrame:
    """Scores of models x parameters x values: `sweeps` has, per model, the values to try of each of its parameters.

    A parameter is any setting of `run_folds` or of the model (`task`, `k`, `rounds`, ...), or `roles`, whose values are names
    of `roles_of`: "all", "without_interventions", or a list of inputs. Values may be numbers, texts, flags or lists;
    `value` is their text, and `number` the number where it is one. The others keep what `fixed` says.
    """
    parts = []
    for model, params in sweeps.items():
        for param, values in params.items():
            for value in values:
                setting = {**fixed, "model": model, **({} if param == "roles" else {param: value})}
                own = roles_of(roles, value) if param == "roles" else roles
                _, scores = run_folds(df, own, **setting)
                number = float(value) if isinstance(value, (int, float)) and not isinstance(value, bool) else None
                text = "+".join(value) if isinstance(value, (list, tuple)) else str(value)
                parts.append(
                    scores.select(
                        "*", F.lit(param).alias("param"), F.lit(text).alias("value"), F.lit(number).cast("double").alias("number")
                    )
                )
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def roles_of(roles: Roles, which: str | list[str]) -> Roles:
    """The roles with all inputs, without interventions, or with the named inputs alone."""
    if which == "all":
        return roles
    if which == "without_interventions":
        return roles.without_interventions()
    return replace(roles, inputs=tuple(c for c in roles.model_inputs if c in which))
