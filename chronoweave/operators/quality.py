"""Checks that return the rows violating an invariant."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def check_duplicate_readings(df: DataFrame) -> DataFrame:
    """Readings that occur more than once with the same stay, time, value and source."""
    keys = ["stay_id", "glctimer", "glc", "glcsource"]
    return (
        df.filter(F.col("glctimer").isNotNull())
        .groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("n"))
        .filter(F.col("n") > 1)
    )


def check_stay_known(df: DataFrame) -> DataFrame:
    return df.filter(F.col("stay_id").isNull())


def check_timer_known(df: DataFrame) -> DataFrame:
    return df.filter(F.col("timer").isNull())


def check_unpaired(df: DataFrame) -> DataFrame:
    """Treatments that no rule paired; some are expected."""
    return df.filter(F.col("insulintype").isNotNull() & F.col("rule").isNull())


def audit(df: DataFrame) -> DataFrame:
    """One row: rows, rows without a target, zero time gaps and rows without a value."""
    return df.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_if(F.col("glc_next").isNull()).alias("no_target"),
        F.count_if(F.col("delta_t") == 0).alias("zero_gap"),
        F.count_if(F.col("glc").isNull()).alias("no_value"),
    )
