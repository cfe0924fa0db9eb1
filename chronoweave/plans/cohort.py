"""The modelling cohort in the order the steps depend on each other."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoweave.operators import cohort as c
from chronoweave.operators.entities import split_by_entity
from chronoweave.operators.ordered import add_row_id, as_columns
from chronoweave.operators.splits import PART, Splits, find_splits
from chronoweave.operators.timeline import wide_order
from chronoweave.sources.tables import write_csv


def modelling_cohort(wide: DataFrame, splits: Splits | None = None) -> DataFrame:
    """Known stays with two readings or more, from the first reading to the last known target, made ready to fit.

    Row ids are given after the trailing and before the leading trim, so the leading trim leaves gaps in them.
    All windows along the stay come first and share one shuffle; giving row ids then stores the table, and
    what follows reads the stored columns it needs.
    """
    df = c.lower_names(wide).filter(F.col("stay_id").isNotNull())
    splits = splits or find_splits(df, ["stay_id"], "timer")
    order = wide_order(df)
    df = c.keep_usable(splits.place(df, as_columns(order[1:])), order=order, splits=splits)
    df = c.mark_and_fill(df, order=order, splits=splits).drop(PART)
    df = c.drop_leading(add_row_id(df, ["stay_id", *order]))
    df = c.replace_outliers(df)
    return c.fill_zero(c.add_masks_and_clocks(c.add_gap(df)))


def save_cohort(df: DataFrame, main: str, validation: str, share: float = 0.1, seed: int = 0) -> None:
    """Hold out a share of the stays and write both sides as CSV."""
    marked = split_by_entity(df, share, seed)
    first = ["rn", *[x for x in df.columns if x != "rn"]]
    write_csv(marked.filter(~F.col("held_out")).select(*first), main)
    write_csv(marked.filter(F.col("held_out")).select(*first), validation)
