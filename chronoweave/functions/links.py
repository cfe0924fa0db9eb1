"""The link between the original scale and the modelling scale."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed value: the glucose level that maps to zero
CENTRE = 140.0
LOG_CENTRE = math.log(CENTRE)


def log_link(x: Column) -> Column:
    """ln x - ln 140; NULL where x <= 0."""
    return F.when(x > 0, F.ln(x) - F.lit(LOG_CENTRE))


def exp_link(x: Column) -> Column:
    """Inverse of `log_link`."""
    return F.exp(x + F.lit(LOG_CENTRE))


def guarded_log_link(x: Column) -> Column:
    """`log_link` for x > 0; every other value stays as it is."""
    return F.when(x > 0, F.ln(x) - F.lit(LOG_CENTRE)).otherwise(x)


def identity(x: Column) -> Column:
    return x


def nan_to_null(x: Column) -> Column:
    return F.when(~F.isnan(x), x)
