"""Summaries of metric tables over folds, runs and swept values."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronoweave.functions import codes


def summarise(df: DataFrame, by: list[str], columns=codes.METRICS) -> DataFrame:
    """Mean and sample deviation of each metric, as `<metric>_mean` and `<metric>_std`."""
    aggregates = []
    for c in columns:
        aggregates += [F.avg(c).alias(f"{c}_mean"), F.stddev_samp(c).alias(f"{c}_std")]
    return df.groupBy(*by).agg(*aggregates)


def melt_metrics(df: DataFrame, ids: list[str], columns=codes.METRICS) -> DataFrame:
    """Long form: one row per metric, named `measurement`, with its `value`."""
    return df.unpivot(ids, list(columns), "measurement", "value")


def display_names(
    df: DataFrame, names: dict[str, str] | None = None, code: str = "model", name: str = "model_name"
) -> DataFrame:
    """Add the display name of a code; an unknown code is an error."""
    table = F.create_map(*[F.lit(x) for pair in (names or codes.DISPLAY_NAMES).items() for x in pair])
    unknown = F.raise_error(F.concat(F.lit("unknown code: "), F.coalesce(F.col(code), F.lit("NULL"))))
    return df.withColumn(name, F.coalesce(F.try_element_at(table, F.col(code)), unknown.cast("string")))


def tagged_union(frames: dict, tag: str) -> DataFrame:
    """Stack frames, each with its tag value; a column some lack becomes NULL there."""
    tagged = [df.withColumn(tag, F.lit(value)) for value, df in frames.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)


def last_metric(df: DataFrame, by: list[str], step: str = "step") -> DataFrame:
    """The row with the highest step per group."""
    others = [c for c in df.columns if c not in by]
    return df.groupBy(*by).agg(F.max_by(F.struct(*others), F.col(step)).alias("_last")).select(*by, "_last.*")


def select_prefixes(df: DataFrame, *prefixes: str) -> DataFrame:
    return df.select(*[c for c in df.columns if c.startswith(prefixes)])


def drop_empty(df: DataFrame, columns=codes.METRICS, how: str = "all") -> DataFrame:
    return df.na.drop(how, subset=list(columns))


def rescale(df: DataFrame, **changes: Column) -> DataFrame:
    """Column arithmetic by name, e.g. `N1=F.col('N') / 1000` or `ig_mean=-F.col('ig_mean')`."""
    return df.withColumns(changes)
