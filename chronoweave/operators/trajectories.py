"""Forecast trajectories: time grids, flattened step predictions, observed series and fan-chart bands."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronoweave.functions.links import exp_link
from chronoweave.operators.ordered import Running, scan
from chronoweave.operators.splits import Splits


def even_grid(start: Column, end: Column, points: int) -> Column:
    """`points` evenly spaced values from start to end, both included."""
    steps = F.sequence(F.lit(0), F.lit(points - 1))
    return F.transform(steps, lambda i: start + (end - start) * i / F.lit(float(max(points - 1, 1))))


def time_grid(df: DataFrame, nsteps: int, start: str = "t0", end: str = "t1") -> DataFrame:
    """Expand each step into `nsteps + 1` times; `k` numbers them from 0."""
    grid = even_grid(F.col(start), F.col(end), nsteps + 1)
    return df.select("*", F.posexplode(grid).alias("k", "ts"))


def flatten_steps(df: DataFrame, steps: str = "steps") -> DataFrame:
    """Array of steps, each an array of structs, to one row per point numbered by `step` and `k`."""
    others = [c for c in df.columns if c != steps]
    outer = df.select(*others, F.posexplode(steps).alias("step", "_points"))
    return outer.select(*others, "step", F.posexplode("_points").alias("k", "_p")).select(*others, "step", "k", "_p.*")


def observed_series(
    df: DataFrame, id: str, value: str, target: str, start: str, end: str, splits: Splits | None = None
) -> DataFrame:
    """Per entity: its first input at the first start, then every target at its end; `k` is the position."""
    steps = scan(df, [id], [start], {"k": Running(F.lit(1))}, splits)
    point = F.struct(F.col("k"), F.col(end).alias("t"), F.col(target).alias("y"))
    opening = F.struct(F.lit(0).cast("long").alias("k"), F.col(start).alias("t"), F.col(value).alias("y"))
    points = F.when(F.col("k") == 1, F.array(opening, point)).otherwise(F.array(point))
    return steps.select(id, F.inline(points))


def fan_levels(low: float = 0.1, high: float = 1.96, n: int = 5) -> list[float]:
    return [low + (high - low) * i / (n - 1) for i in range(n)]


def fan_bands(
    df: DataFrame,
    ginv: Callable[[Column], Column] = exp_link,
    levels: list[float] | None = None,
    maxtime: float = 24.0,
    time: str = "ts",
) -> DataFrame:
    """One row per point and level with the band's lower and upper edge, for times before `maxtime`."""
    levels = levels or fan_levels()
    spread = F.posexplode(F.array(*[F.lit(x) for x in levels])).alias("band", "level")
    reach = F.col("level") * F.col("sigma")
    return (
        df.filter(F.col(time) < maxtime)
        .select("*", spread)
        .withColumns({"lower": ginv(F.col("mu") - reach), "upper": ginv(F.col("mu") + reach)})
    )
