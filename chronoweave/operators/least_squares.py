"""Least squares for all folds at once.

A fold's model is fitted on all rows but its own. The sums that least squares needs (products of inputs with each other and
with the label) add up over rows, so one scan gives a block of them per fold, and a fold's fit is the total less its own
block. The variance fits have a label per fold (its model's squared residual) but the same inputs, so one more scan gives
theirs. Blocks are as large as the inputs are many; only they come to the driver.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronoweave.functions.links import nan_to_null
from chronoweave.session import pin_measured

VARIANCE_OFFSET = 1e-2
SINGULAR = 1e-12  #: inputs that others explain to this share of their spread get the smallest weights that fit


def filled(c: str) -> Column:
    """An input with missing values set to 0."""
    return F.coalesce(nan_to_null(F.col(c).cast("double")), F.lit(0.0))


def _weighted(inputs: list[str], weights: np.ndarray) -> Column:
    total = F.lit(float(weights[0]))
    for c, w in zip(inputs, weights[1:]):
        total = total + filled(c) * F.lit(float(w))
    return total


@dataclass(frozen=True)
class FoldFits:
    """Weights per fold, the constant first; None where no other fold has a row."""

    inputs: tuple[str, ...]
    fold: str
    mean: dict[int, np.ndarray | None]
    variance: dict[int, np.ndarray | None] | None
    name: str = "LinearModel"

    def _of_fold(self, weights: dict[int, np.ndarray | None]) -> Column:
        out = F
        for f, w in weights.items():
            out = out.when(F.col(self.fold) == f, F.lit(None) if w is None else _weighted(list(self.inputs), w))
        return out.cast("double")

    def predict(self, df: DataFrame) -> DataFrame:
        """Add `mu` and, for the gaussian task, `sigma` by the row's own fold; a negative variance gives NULL."""
        out = df.withColumn("mu", self._of_fold(self.mean))
        if self.variance is None:
            return out
        variance = self._of_fold(self.variance)
        return out.withColumn("sigma", F.when(variance >= 0, F.sqrt(variance)))


def store_for_fits(df: DataFrame, inputs: list[str]) -> tuple[DataFrame, dict]:
    """The stored rows, and each input's mean and deviation, which come with the write."""
    measures = {}
    for n, c in enumerate(inputs):
        measures |= {f"mean{n}": F.avg(filled(c)), f"spread{n}": F.stddev_pop(filled(c))}
    return pin_measured(df, n=F.count(F.lit(1)), **measures)


def fit_folds(
    stored: DataFrame, seen: dict, inputs: list[str], folds: list[int], label: str = "target", fold: str = "fold", task: str = "gaussian"
) -> FoldFits:
    """Fit every fold's mean and, for the gaussian task, its squared residual plus 1e-2, each on the rows of the other folds.

    `stored` and `seen` come from `store_for_fits`. Rows without a label are left out.
    """
    inputs = list(inputs)
    centre = np.array([seen[f"mean{n}"] or 0.0 for n in range(len(inputs))])
    spread = np.array([seen[f"spread{n}"] or 0.0 for n in range(len(inputs))])
    varies = spread > 1e-12 * (1 + np.abs(centre))
    # sums are made of inputs brought to mean 0 and deviation 1, so that they lose nothing by subtracting
    scaled = [
        ((filled(c) - F.lit(float(m))) / F.lit(float(s)) if v else F.lit(0.0)).alias(f"_z{n + 1}")
        for n, (c, m, s, v) in enumerate(zip(inputs, centre, spread, varies))
    ]
    p = len(inputs) + 1
    y = F.col(label).cast("double")
    rows = stored.filter(y.isNotNull()).select(F.col(fold).alias("_fold"), y.alias("_y"), F.lit(1.0).alias("_z0"), *scaled)
    pairs = [(i, j) for i in range(p) for j in range(i, p)]
    blocks = rows.groupBy("_fold").agg(
        *[F.sum(F.col(f"_z{i}") * F.col(f"_z{j}")).alias(f"_g{i}_{j}") for i, j in pairs],
        *[F.sum(F.col(f"_z{i}") * F.col("_y")).alias(f"_b{i}") for i in range(p)],
    )
    gram, moment = {}, {}
    for row in blocks.collect():  # a row per fold
        g = np.zeros((p, p))
        for i, j in pairs:
            g[i, j] = g[j, i] = row[f"_g{i}_{j}"]
        gram[row["_fold"]], moment[row["_fold"]] = g, np.array([row[f"_b{i}"] for i in range(p)])
    nothing = np.zeros((p, p))
    rest = {f: sum(gram.values(), nothing) - gram.get(f, nothing) for f in folds}

    def solved(f: int, b: np.ndarray) -> np.ndarray | None:
        """Weights of the scaled inputs."""
        return np.linalg.pinv(rest[f], rcond=SINGULAR, hermitian=True) @ b if rest[f][0, 0] > 0.5 else None

    def plain(w: np.ndarray | None) -> np.ndarray | None:
        """The same weights for the inputs as they are."""
        if w is None:
            return None
        own = np.where(varies, w[1:] / np.where(varies, spread, 1.0), 0.0)
        return np.concatenate([[w[0] - own @ centre], own])

    mean = {f: solved(f, sum(moment.values(), np.zeros(p)) - moment.get(f, np.zeros(p))) for f in folds}
    variance = None
    if task == "gaussian":
        known = {f: w for f, w in mean.items() if w is not None}
        errors = {}
        for f, w in known.items():
            fitted = F.lit(float(w[0]))
            for i in range(1, p):
                fitted = fitted + F.col(f"_z{i}") * F.lit(float(w[i]))
            errors[f"_e{f}"] = F.when(F.col("_fold") != f, F.pow(F.col("_y") - fitted, 2) + F.lit(VARIANCE_OFFSET))
        sums = [F.sum(F.col(f"_e{f}") * F.col(f"_z{i}")).alias(f"_b{f}_{i}") for f in known for i in range(p)]
        found = rows.withColumns(errors).agg(*sums).first() if sums else None
        variance = {f: solved(f, np.array([found[f"_b{f}_{i}"] for i in range(p)])) if f in known else None for f in folds}
    return FoldFits(
        tuple(inputs), fold, {f: plain(w) for f, w in mean.items()}, variance and {f: plain(w) for f, w in variance.items()}
    )
