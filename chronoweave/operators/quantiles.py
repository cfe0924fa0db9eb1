"""Exact medians per group that stay bounded when a group is over-full.

Spark's exact percentile keeps every distinct value of a group in one task. Of groups above the row limit, a sketch first
tells two bounds that the median lies between; one pass counts what is below, and each different value within. The median is
selected among these by radix: a double's bits, put into an order-preserving long, are told 16 at a time. Each pass counts the
next 16 bits of the values that share the bits known so far, for all over-full groups together, and the wanted rank picks one of
the at most 65,536 counts. Four passes give all 64 bits, whatever the number of rows, groups and ties.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronoweave.functions.doubles import from_ordered_bits, ordered_bits
from chronoweave.operators.splits import same_keys
from chronoweave.session import pin, pin_measured, rows_per_split

DIGIT = 16
PASSES = 64 // DIGIT
ACCURACY = 10_000  # a sketch's ranks are off by one in this many rows at most


def _renamed(df: DataFrame, by: list[str]) -> tuple[DataFrame, list[str]]:
    names = [f"_g_{k}" for k in by]
    return df.withColumnsRenamed(dict(zip(by, names))), names


def _with_groups(df: DataFrame, groups: DataFrame, by: list[str], how: str = "inner", test: Column | None = None) -> DataFrame:
    """Join the rows of `groups`, of which there are at most two per over-full group: 2 * all rows / the row limit."""
    small, names = _renamed(groups, by)
    match = same_keys([df[k] for k in by], [F.col(n) for n in names]) if by else None
    if test is not None:
        match = test if match is None else match & test
    if match is None:
        match = F.lit(True)
    return df.join(F.broadcast(small), match, how).drop(*names)


def _between(stored: DataFrame, by: list[str], sizes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """How often each value between two bounds around the median comes (keys, `_v`, `_c`); `sizes` with the rows `_below`."""
    values = stored.where(F.col("_v").isNotNull())
    value = F.nanvl("_v", F.lit(float("inf")))  # a sketch can't order NaN
    share = [0.5 - 4 / ACCURACY, 0.5 + 4 / ACCURACY]
    bounds = _with_groups(values, sizes.drop("_n"), by).groupBy(*by).agg(F.percentile_approx(value, share, ACCURACY).alias("_bounds"))
    bounds = pin(bounds.select(*by, F.get("_bounds", F.lit(0)).alias("_low"), F.get("_bounds", F.lit(1)).alias("_high")))

    def counted(bounds: DataFrame) -> tuple[DataFrame, DataFrame]:
        # one row for all that is below, whose value is NULL
        kept = _with_groups(values, bounds, by).where(value <= F.col("_high"))
        counts = pin(kept.groupBy(*by, F.when(value >= F.col("_low"), F.col("_v")).alias("_v")).agg(F.count(F.lit(1)).alias("_c")))
        sums = counts.groupBy(*by).agg(F.coalesce(F.sum(F.when(F.col("_v").isNull(), F.col("_c"))), F.lit(0)).alias("_below"), F.sum("_c").alias("_upto"))
        return counts.where(F.col("_v").isNotNull()), pin(_with_groups(sums, sizes, by))

    counts, found = counted(bounds)
    outside = (F.col("_below") > F.floor((F.col("_n") - 1) / 2)) | (F.col("_upto") <= F.floor(F.col("_n") / 2))
    if not found.where(outside).isEmpty():  # the sketch was off by more than it says: no bounds
        counts, found = counted(bounds.withColumns({"_low": F.lit(float("-inf")), "_high": F.lit(float("inf"))}))
    return counts, found.drop("_upto")


def _selected(stored: DataFrame, by: list[str], sizes: DataFrame, name: str) -> DataFrame:
    """The medians of the groups in `sizes` (their keys and `_n`)."""
    between, sizes = _between(stored, by, sizes)
    values = between.withColumn("_bits", ordered_bits(F.col("_v"))).select(*by, "_bits", "_c")
    sides = F.array(F.floor((F.col("_n") - 1) / 2) - F.col("_below"), F.floor(F.col("_n") / 2) - F.col("_below"))
    state = sizes.select(*by, F.posexplode(sides).alias("_side", "_rank")).withColumn("_prefix", F.lit(0).cast("long"))
    for done in range(PASSES):
        shift = 64 - DIGIT * (done + 1)
        known = state.select(*by, F.col("_prefix").alias("_known")).distinct()
        digit = F.shiftright("_bits", shift)
        if done:
            digit = digit.bitwiseAND(F.lit((1 << DIGIT) - 1))
        # the first pass tells the sign, too, and has no bits to compare
        test = F.shiftright("_bits", shift + DIGIT) == F.col("_known") if done else None
        counts = (
            _with_groups(values, known, by, test=test)
            .groupBy(*by, "_known", digit.alias("_digit"))
            .agg(F.sum("_c").alias("_c"))
        )
        along = Window.partitionBy(*by, "_known").orderBy("_digit").rowsBetween(Window.unboundedPreceding, 0)
        ranked = counts.withColumn("_upto", F.sum("_c").over(along))
        here = F.col("_known") == F.col("_prefix")
        here &= (F.col("_rank") < F.col("_upto")) & (F.col("_rank") >= F.col("_upto") - F.col("_c"))
        state = pin(
            _with_groups(ranked, state, by, test=here).select(
                *by, "_side", (F.col("_rank") - F.col("_upto") + F.col("_c")).alias("_rank"),
                (F.shiftleft("_prefix", DIGIT) + F.col("_digit") if done else F.col("_digit")).cast("long").alias("_prefix"),
            )
        )
    value = from_ordered_bits(F.col("_prefix"))
    low, high = (F.max(F.when(F.col("_side") == side, value)) for side in (0, 1))
    return state.groupBy(*by).agg((low * 0.5 + high * 0.5).alias(name))


def stored_median(stored: DataFrame, by: list[str], value: str | Column, n: int, name: str = "median", rows: int | None = None) -> DataFrame:
    """`exact_median` of a stored table of `n` rows."""
    rows = rows or rows_per_split(stored.sparkSession)
    value = F.col(value) if isinstance(value, str) else value
    slim = stored.select(*by, value.cast("double").alias("_v"))
    if n <= rows:
        return slim.groupBy(*by).agg(F.median("_v").alias(name))
    sizes = pin(slim.groupBy(*by).agg(F.count("_v").alias("_n")).filter(F.col("_n") > rows))
    if sizes.isEmpty():
        return slim.groupBy(*by).agg(F.median("_v").alias(name))
    heavy = _selected(slim, by, sizes, name)
    if not by or sizes.agg(F.sum("_n")).first()[0] == n:  # no rows are left
        return heavy
    light = _with_groups(slim, sizes.drop("_n"), by, "left_anti")
    return light.groupBy(*by).agg(F.median("_v").alias(name)).unionByName(heavy)


def exact_median(
    df: DataFrame, by: list[str], value: str | Column, name: str = "median", rows: int | None = None
) -> DataFrame:
    """One row per group: its keys and the exact median of the non-NULL values (as doubles; NaN is the largest).

    The keys and values are stored once, which also counts them.
    """
    value = F.col(value) if isinstance(value, str) else value
    slim, seen = pin_measured(df.select(*by, value.cast("double").alias("_v")), n=F.count(F.lit(1)))
    return stored_median(slim, by, "_v", seen["n"], name, rows)


def column_medians(df: DataFrame, columns, rows: int | None = None) -> dict[str, float | None]:
    """The exact median of each column's non-NULL values, all columns together."""
    columns = list(columns)
    slim, seen = pin_measured(df.select(*[F.col(c).cast("double").alias(c) for c in columns]), n=F.count(F.lit(1)))
    if not columns:
        return {}
    if seen["n"] <= (rows or rows_per_split(df.sparkSession)):
        return slim.agg(*[F.median(c).alias(c) for c in columns]).first().asDict()
    pairs = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.col(c).alias("v")) for i, c in enumerate(columns)]))
    long = slim.select(pairs.alias("_p")).select(F.col("_p.i").alias("_column"), F.col("_p.v").alias("_v"))
    found = {r["_column"]: r["median"] for r in stored_median(long, ["_column"], "_v", seen["n"] * len(columns), rows=rows).collect()}
    return {c: found.get(i) for i, c in enumerate(columns)}
