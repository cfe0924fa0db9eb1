"""Lag features and feature scaling."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronoweave.functions.links import guarded_log_link
from chronoweave.operators.ordered import with_neighbours
from chronoweave.operators.splits import Splits
from chronoweave.roles import Roles


def lag_names(columns, n_shift: int = 5) -> list[str]:
    return [f"{c}_s{k}" for c in columns for k in range(1, n_shift + 1)]


def lag_features(
    df: DataFrame,
    columns,
    id: str = "stay_id",
    time_vars=("timer_d", "timer_next_d"),
    n_shift: int = 5,
    order: list | None = None,
    splits: Splits | None = None,
) -> DataFrame:
    """Add `delta_t` and, per column, its value 1 to `n_shift` rows earlier in the entity."""
    lagged = with_neighbours(
        df,
        [id],
        order or [time_vars[0]],
        n_shift,
        lambda w: {f"{c}_s{k}": F.lag(c, k).over(w) for c in columns for k in range(1, n_shift + 1)},
        splits,
    )
    return lagged.withColumn("delta_t", F.col(time_vars[1]) - F.col(time_vars[0]))


def fit_scaler(df: DataFrame, roles: Roles) -> dict[str, tuple[float | None, float]]:
    """Mean and population deviation per scaled column, NULLs left out; a constant column gets deviation 1."""
    if not roles.scaled:
        return {}
    aggregates = []
    for c in roles.scaled:
        aggregates += [F.avg(c).alias(f"{c}_m"), F.stddev_pop(c).alias(f"{c}_s")]
    row = df.agg(*aggregates).first()
    return {c: (row[f"{c}_m"], row[f"{c}_s"] or 1.0) for c in roles.scaled}


def apply_scaler(
    df: DataFrame,
    stats: dict[str, tuple[float | None, float]],
    roles: Roles,
    transform: Callable[[Column], Column] = guarded_log_link,
) -> DataFrame:
    """Log link on the target and first input, fixed divisors, then scaling with NULL set to 0 afterwards."""
    new = {c: transform(F.col(c)) for c in dict.fromkeys([roles.target, roles.timevarying[0]])}
    for c, divisor in roles.features_divider.items():
        new[c] = new.get(c, F.col(c)) / F.lit(float(divisor))
    for c, (mean, deviation) in stats.items():
        new[c] = F.coalesce((F.col(c) - F.lit(mean)) / F.lit(deviation), F.lit(0.0))
    return df.withColumns(new)
