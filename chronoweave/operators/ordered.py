"""Windows along a timeline that also hold when one entity is over-full."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from chronoweave.operators.splits import HALO, PART, Splits, row_hash, same_keys, splits_for
from chronoweave.session import pin


def as_columns(order: list[str | Column]) -> list[Column]:
    return [F.col(c) if isinstance(c, str) else c for c in order]


def with_neighbours(
    df: DataFrame,
    keys: list[str],
    order: list[str | Column],
    reach: int,
    build: Callable[[WindowSpec], dict[str, Column]],
    splits: Splits | None = None,
) -> DataFrame:
    """Add lag/lead columns of at most `reach` rows; `order[0]` must be the name of the clock column."""
    splits = splits_for(df, keys, order[0], splits)
    order = as_columns(order)
    forward = [c.asc_nulls_first() for c in order]
    if not splits.any:
        return df.withColumns(build(Window.partitionBy(*keys).orderBy(*forward)))
    window = Window.partitionBy(*keys, PART).orderBy(*forward)
    out = splits.widen(df, order, reach).withColumns(build(window)).filter(~F.col(HALO)).drop(HALO)
    return out if PART in df.columns else out.drop(PART)


_AGGREGATES = {"sum": F.sum, "max": F.max, "min": F.min}


@dataclass(frozen=True)
class Running:
    """`how` ('sum', 'max', 'min') of the non-NULL `expr` from the first row to this one."""

    expr: Column
    how: str = "sum"


@dataclass(frozen=True)
class Remaining:
    """`how` of the non-NULL `expr` from this row to the last one."""

    expr: Column
    how: str = "sum"


@dataclass(frozen=True)
class LastSeen:
    """The latest non-NULL `expr` at or before this row."""

    expr: Column


@dataclass(frozen=True)
class NextSeen:
    """The earliest non-NULL `expr` at or after this row."""

    expr: Column


@dataclass(frozen=True)
class Whole:
    """`how` of the non-NULL `expr` over all rows of the entity."""

    how: str
    expr: Column


Scan = Running | Remaining | LastSeen | NextSeen | Whole


def _merge(how: str, here: Column, carry: Column) -> Column:
    """The aggregate over this part and the parts it continues; either may be NULL."""
    if how == "sum":
        return F.coalesce(here + carry, here, carry)
    return F.greatest(here, carry) if how == "max" else F.least(here, carry)


def scan(
    df: DataFrame,
    keys: list[str],
    order: list[str | Column],
    wanted: dict[str, Scan],
    splits: Splits | None = None,
) -> DataFrame:
    """Add running and whole-timeline columns.

    With no over-full entity this is one window per direction over one shuffle. Otherwise each part is
    worked alone and corrected by per-part totals: one small row per part, sent to every task.
    """
    splits = splits_for(df, keys, order[0], splits)
    order = as_columns(order)
    base = splits.place(df, order[1:])
    whole = Window.partitionBy(*keys, *([PART] if splits.any else []))
    # "from here to the end" is written as "from the end to here": Spark's frame that starts at the current
    # row works through the rest of the partition again for every row
    up = whole.orderBy(*[c.asc_nulls_first() for c in order]).rowsBetween(Window.unboundedPreceding, 0)
    down = whole.orderBy(*[c.desc_nulls_last() for c in order]).rowsBetween(Window.unboundedPreceding, 0)
    local: dict[str, Column] = {}
    for name, w in wanted.items():
        if isinstance(w, LastSeen):
            local[name] = F.last(w.expr, ignorenulls=True).over(up)
        elif isinstance(w, NextSeen):
            local[name] = F.last(w.expr, ignorenulls=True).over(down)
        else:
            frame = {Running: up, Remaining: down, Whole: whole}[type(w)]
            local[name] = _AGGREGATES[w.how](w.expr).over(frame)
    if not splits.any:
        return df.withColumns(local)

    rank = F.struct(*[F.struct(c.isNotNull(), c) for c in order])
    totals, across = [], {}
    before = Window.partitionBy(*keys).orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)
    after = Window.partitionBy(*keys).orderBy(F.desc(PART)).rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy(*keys)
    for name, w in wanted.items():
        total, carry = f"_t_{name}", f"_c_{name}"
        if isinstance(w, LastSeen):
            totals.append(F.max_by(w.expr, F.when(w.expr.isNotNull(), rank)).alias(total))
            across[carry] = F.last(total, ignorenulls=True).over(before)
        elif isinstance(w, NextSeen):
            totals.append(F.min_by(w.expr, F.when(w.expr.isNotNull(), rank)).alias(total))
            across[carry] = F.last(total, ignorenulls=True).over(after)
        else:
            frame = {Running: before, Remaining: after, Whole: every}[type(w)]
            totals.append(_AGGREGATES[w.how](w.expr).alias(total))
            across[carry] = _AGGREGATES[w.how](total).over(frame)
    names = [f"_k_{k}" for k in keys]
    # stored: the totals are a pass over the input, which the rows below are another pass over
    carried = (
        pin(splits.only_hot(base).groupBy(*keys, PART).agg(*totals))
        .withColumns(across)
        .select(*[F.col(k).alias(n) for k, n in zip(keys, names)], F.col(PART).alias("_k_part"), *across)
    )
    done = base.withColumns(local)
    done = done.join(
        F.broadcast(carried),
        same_keys([done[k] for k in keys], [F.col(n) for n in names]) & (done[PART] == F.col("_k_part")),
        "left",
    )
    merged = {}
    for name, w in wanted.items():
        carry = F.col(f"_c_{name}")
        if isinstance(w, (Running, Remaining)):
            merged[name] = _merge(w.how, F.col(name), carry)
        elif isinstance(w, Whole):
            merged[name] = F.when(F.col("_k_part").isNull(), F.col(name)).otherwise(carry)
        else:
            merged[name] = F.coalesce(F.col(name), carry)
    done = done.withColumns(merged).drop(*names, "_k_part", *across)
    return done if PART in df.columns else done.drop(PART)


def add_row_id(df: DataFrame, order: list[str], name: str = "rn", start: int = 0) -> DataFrame:
    """Gap-free row number over the whole table in `order`, without a one-task sort.

    Rows are range-partitioned on all order columns and a hash of the row, which cuts a heavy entity and many rows of one
    order, too. The laid-out rows are stored once, then each partition's rows get the sizes of the partitions before it
    added.
    """
    along = [*[F.col(c).asc_nulls_first() for c in order], row_hash(df).asc()]
    laid = pin(
        df.repartitionByRange(*along)
        .sortWithinPartitions(*along)
        .withColumns(
            {
                "_pid": F.spark_partition_id(),
                "_pos": F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)),
            }
        )
    )
    # one row per partition, summed up on the driver and sent back as a constant table
    sizes = sorted((r["_pid"], r["_n"]) for r in laid.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n")).collect())
    before = [0, *accumulate(n for _, n in sizes)]
    rows = [(pid, offset + start) for (pid, _), offset in zip(sizes, before)]
    offsets = df.sparkSession.createDataFrame(rows, "_pid int, _offset long")
    return (
        laid.join(F.broadcast(offsets), "_pid")
        .withColumn(name, F.col("_offset") + F.col("_pos"))
        .drop("_pid", "_pos", "_offset")
    )
