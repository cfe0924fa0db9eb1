"""Scores of probabilistic and point forecasts, as plain grouped aggregates."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronoweave.functions.gaussian import normal_cdf, normal_log_density, normal_pdf, normal_quantile
from chronoweave.functions.links import exp_link, identity, log_link, nan_to_null
from chronoweave.operators.quantiles import stored_median
from chronoweave.operators.splits import same_keys
from chronoweave.session import pin_measured, rows_per_split

Link = Callable[[Column], Column]
SIGMA_CAP = 2.0
UPDATE_OFFSET = 1e-5


def prepare_forecasts(
    predictions: DataFrame,
    rows: DataFrame,
    key: str = "rn",
    target: str = "glc_next",
    mask: str = "msk",
    g: Link = log_link,
    cap: float | None = SIGMA_CAP,
    where: Column | None = None,
    by: tuple[str, ...] = ("model", "fold"),
) -> DataFrame:
    """Join predictions to their rows, transform the target, cap sigma, keep scored and complete rows.

    `where` keeps a stratum of the rows, e.g. treated ones.
    """
    joined = predictions.join(rows, key, "left").filter(F.col(mask) == 0)
    if where is not None:
        joined = joined.filter(where)
    sigma = nan_to_null(F.col("sigma"))
    if cap is not None:
        sigma = F.when(sigma > cap, F.lit(cap)).otherwise(sigma)
    out = joined.select(
        *by, nan_to_null(F.col("mu")).alias("mu"), sigma.alias("sigma"), g(F.col(target)).alias("target")
    )
    return out.na.drop("any")


def _edges(ginv: Link, alpha: float) -> tuple[Column, Column]:
    q = F.lit(normal_quantile(1 - alpha / 2))
    return ginv(F.col("mu") - q * F.col("sigma")), ginv(F.col("mu") + q * F.col("sigma"))


def score(
    df: DataFrame, by: list[str], ginv: Link = identity, alpha: float = 0.05, rows: int | None = None
) -> DataFrame:
    """Eight scores per group of rows with `mu`, `sigma` and `target` (both on the modelling scale).

    `ginv` takes values back to the original scale for the interval scores and the error. The median width is
    exact. The forecasts are stored once, which also counts them.
    """
    df, seen = pin_measured(df.select(*by, "mu", "sigma", "target"), n=F.count(F.lit(1)))
    y, mu, sigma = F.col("target"), F.col("mu"), F.col("sigma")
    low, high = _edges(ginv, alpha)
    z = F.try_divide(y - mu, sigma)
    cdf = normal_cdf(z)
    width, at = F.col("_high") - F.col("_low"), F.col("_y")
    points = df.select(
        *by,
        cdf.alias("_pit"),
        (sigma * (z * (F.lit(2.0) * cdf - 1) + F.lit(2.0) * normal_pdf(z) - F.lit(1 / math.sqrt(math.pi)))).alias(
            "_crps"
        ),
        F.when(sigma > 0, normal_log_density(y, mu, sigma)).alias("_ig"),
        low.alias("_low"),
        high.alias("_high"),
        ginv(y).alias("_y"),
        ginv(mu).alias("_mu"),
    )
    penalty = F.lit(2 / alpha)
    missed = F.when(at < F.col("_low"), F.col("_low") - at).when(at > F.col("_high"), at - F.col("_high")).otherwise(0.0)
    # one heavy group would put all its widths into one task: exact medians then have their own way
    rows = rows or rows_per_split(df.sparkSession)
    apart = seen["n"] > rows
    scores = points.groupBy(*by).agg(
        F.avg("_crps").alias("crps_mean"),
        F.avg("_ig").alias("ig_mean"),
        F.avg(width + penalty * missed).alias("int_score_mean"),
        F.var_pop("_pit").alias("var_pit"),
        F.avg(F.when((F.col("_low") < at) & (F.col("_high") > at), 1.0).otherwise(0.0)).alias("int_coverage"),
        F.avg(width).alias("int_av_width"),
        *([] if apart else [F.median(width).alias("int_med_width")]),
        F.sqrt(F.avg(F.pow(F.col("_mu") - at, 2))).alias("rmse"),
    )
    if not apart:
        return scores
    medians = stored_median(df, by, high - low, seen["n"], "int_med_width", rows)
    if not by:
        return scores.withColumn("int_med_width", medians.scalar())
    names = [f"_m_{k}" for k in by]
    medians = medians.toDF(*names, "int_med_width")
    return scores.join(medians, same_keys([scores[k] for k in by], [F.col(n) for n in names])).drop(*names)


def score_points(df: DataFrame, by: list[str], ginv: Link = identity) -> DataFrame:
    """Root mean squared error of a point forecast on the original scale."""
    gap = ginv(F.col("mu")) - ginv(F.col("target"))
    return df.groupBy(*by).agg(F.sqrt(F.avg(F.pow(gap, 2))).alias("rmse"))


def score_losses(df: DataFrame, by: list[str], error: float = 0.01, ginv: Link = exp_link) -> DataFrame:
    """Training losses as sums: negative log-likelihood, squared error and update divergence.

    The divergence compares the forecast with a narrow normal of deviation `error` around the observed value;
    `nll_update` is the likelihood term used in its place, with the deviation kept off zero.
    """
    y, mu, sigma = F.col("target"), F.col("mu"), F.col("sigma")
    density = F.when(sigma > 0, normal_log_density(y, mu, sigma))
    own = -math.log(math.sqrt(2 * math.pi)) - math.log(error)
    squared = F.pow(ginv(mu) - ginv(y), 2)
    return df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(-density).alias("nll"),
        F.avg(-density).alias("nll_mean"),
        F.sum(-normal_log_density(y, mu, sigma + F.lit(UPDATE_OFFSET))).alias("nll_update"),
        F.sum(squared).alias("sse"),
        F.sqrt(F.avg(squared)).alias("rmse"),
        F.sum(F.lit(math.exp(own)) * (F.lit(own) - density)).alias("update_divergence"),
        F.sum(F.pow(mu - y, 2)).alias("sse_link"),
    )


