"""From the wide table to the modelling cohort: trims, masks, interpolation, outliers, summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronoweave.functions import codes
from chronoweave.functions.clock import hours_between
from chronoweave.operators.ordered import LastSeen, NextSeen, Running, Whole, scan, with_neighbours
from chronoweave.operators.quantiles import column_medians, exact_median
from chronoweave.operators.splits import Splits, splits_for
from chronoweave.session import pin_measured

TIME_ORDER = ("timer",)


def _flag(c: Column) -> Column:
    return F.when(c, 1).otherwise(0)


def lower_names(df: DataFrame) -> DataFrame:
    return df.toDF(*[c.lower() for c in df.columns])


def running_count(
    df: DataFrame, id: str = "stay_id", order=TIME_ORDER, name: str = "n", splits: Splits | None = None
) -> DataFrame:
    """1-based position of the row in its entity."""
    return scan(df.drop(name), [id], order, {name: Running(F.lit(1))}, splits)


def group_size(
    df: DataFrame, id: str = "stay_id", order=TIME_ORDER, name: str = "size", splits: Splits | None = None
) -> DataFrame:
    """Number of rows of the row's entity."""
    return scan(df, [id], order, {name: Whole("sum", F.lit(1))}, splits)


def keep_min_readings(
    df: DataFrame, id: str = "stay_id", order=TIME_ORDER, value: str = "glc", n: int = 2, splits: Splits | None = None
) -> DataFrame:
    """Keep entities with at least `n` non-NULL values."""
    counted = scan(df, [id], order, {"_known": Whole("sum", _flag(F.col(value).isNotNull()))}, splits)
    return counted.filter(F.col("_known") >= n).drop("_known")


def trim_trailing(
    df: DataFrame, id: str = "stay_id", order=TIME_ORDER, target: str = "glc_next", splits: Splits | None = None
) -> DataFrame:
    """Drop each entity's rows after its last known target; an entity without any vanishes.

    The closed form of "drop the last row while its target is NULL".
    """
    known = NextSeen(F.when(F.col(target).isNotNull(), F.lit(1)))
    return scan(df, [id], order, {"_known": known}, splits).filter(F.col("_known").isNotNull()).drop("_known")


def keep_usable(
    df: DataFrame, id: str = "stay_id", order=TIME_ORDER, value: str = "glc", target: str = "glc_next", n: int = 2,
    splits: Splits | None = None,
) -> DataFrame:
    """`keep_min_readings` and `trim_trailing` in one pass; neither changes what the other counts."""
    wanted = {
        "_known": Whole("sum", _flag(F.col(value).isNotNull())),
        "_ahead": NextSeen(F.when(F.col(target).isNotNull(), F.lit(1))),
    }
    seen = scan(df, [id], order, wanted, splits)
    return seen.filter((F.col("_known") >= n) & F.col("_ahead").isNotNull()).drop("_known", "_ahead")


def _positions(df: DataFrame, id: str, order, value: str, splits: Splits) -> DataFrame:
    """`n` (1-based position), `msk0` (value missing) and `sum_msk0` (missing so far)."""
    missing = _flag(F.col(value).isNull())
    wanted = {"n": Running(F.lit(1)), "sum_msk0": Running(missing)}
    return scan(df.drop("n", "msk0", "sum_msk0"), [id], order, wanted, splits).withColumn("msk0", missing.cast("double"))


def _lead(value: str) -> Running:
    """Rows before the first known value: what was missing when it came. NULL before it."""
    return Running(F.when(F.col(value).isNotNull(), F.col("sum_msk0")), "min")


def _around(value: str, place: str) -> dict[str, LastSeen | NextSeen]:
    """The known values next to a row, with their positions."""
    point = F.when(F.col(value).isNotNull(), F.struct(F.col(value).alias("v"), F.col(place).alias("i")))
    return {"_a": LastSeen(point), "_b": NextSeen(point)}


def _filled(value: str, place: str, back_limit: int) -> Column:
    i = F.col(place)
    v0, i0, v1, i1 = F.col("_a.v"), F.col("_a.i"), F.col("_b.v"), F.col("_b.i")
    return (
        F.when(F.col(value).isNotNull(), F.col(value))
        .when(v0.isNotNull() & v1.isNotNull(), v0 + (v1 - v0) * (i - i0) / (i1 - i0))
        .when(v0.isNotNull(), v0)
        .when(i1 - i <= back_limit, v1)
    )


def mark_leading(
    df: DataFrame, id: str = "stay_id", order=TIME_ORDER, value: str = "glc", splits: Splits | None = None
) -> DataFrame:
    """Add `msk0` (value missing, 1.0/0.0), `sum_msk0` (missing so far), `n` (1-based position) and `lead` (rows
    before the entity's first known value; NULL on those rows)."""
    splits = splits_for(df, [id], order[0], splits)
    seen = scan(_positions(df, id, order, value, splits), [id], order, {"lead": _lead(value)}, splits)
    return seen.withColumn("sum_msk0", F.col("sum_msk0").cast("double"))


def mark_and_fill(
    df: DataFrame, id: str = "stay_id", order=TIME_ORDER, value: str = "glc", splits: Splits | None = None
) -> DataFrame:
    """`mark_leading` and `interpolate_by_position` in one go, for rows that `drop_leading` then cuts."""
    splits = splits_for(df, [id], order[0], splits)
    wanted = {"lead": _lead(value), **_around(value, "n")}
    seen = scan(_positions(df, id, order, value, splits), [id], order, wanted, splits)
    return seen.withColumns(
        {value: _filled(value, "n", 0), "sum_msk0": F.col("sum_msk0").cast("double")}
    ).drop("_a", "_b")


def drop_leading(marked: DataFrame) -> DataFrame:
    """Drop the marked leading rows and count `n` from the first row kept."""
    return marked.filter(F.col("lead").isNotNull()).withColumn("n", F.col("n") - F.col("lead")).drop("lead")


def trim_leading(
    df: DataFrame, id: str = "stay_id", order=TIME_ORDER, value: str = "glc", splits: Splits | None = None
) -> DataFrame:
    """Drop each entity's rows before its first known value.

    Adds `msk0`, `sum_msk0` (counted before the trim) and `n` (1-based position after the trim).
    """
    return drop_leading(mark_leading(df, id, order, value, splits))


def interpolate_by_position(
    df: DataFrame,
    id: str = "stay_id",
    order=TIME_ORDER,
    value: str = "glc",
    back_limit: int = 2,
    splits: Splits | None = None,
) -> DataFrame:
    """Fill gaps linearly by row position, not by time.

    A trailing gap takes the last value; of a leading gap only the `back_limit` rows next to the first value
    are filled, with that value.
    """
    splits = splits_for(df, [id], order[0], splits)
    placed = running_count(df, id, order, "_i", splits)
    seen = scan(placed, [id], order, _around(value, "_i"), splits)
    return seen.withColumn(value, _filled(value, "_i", back_limit)).drop("_i", "_a", "_b")


def replace_outliers(
    df: DataFrame, columns=codes.DOSE_COLUMNS, limit: float = codes.DOSE_LIMIT, rows: int | None = None
) -> DataFrame:
    """Replace values above `limit` by the exact median of the column's positive values."""
    middle = column_medians(df.select(*[F.when(F.col(c) > 0, F.col(c)).alias(c) for c in columns]), columns, rows)
    return df.withColumns(
        {c: F.when(F.col(c) > limit, F.lit(middle[c])).otherwise(F.col(c)) for c in columns}
    )


def add_gap(df: DataFrame) -> DataFrame:
    """Hours to the stay's next row."""
    return df.withColumn("delta_t", hours_between("timer", "timer_next"))


def add_masks_and_clocks(df: DataFrame) -> DataFrame:
    """Indicator columns and hours since the stay began."""
    return df.withColumns(
        {
            "gender_m": F.when(F.col("gender") == "M", 1.0).otherwise(0.0),
            "msk": F.when(F.col("glc_next").isNull(), 1.0).otherwise(0.0),
            "timer_d": hours_between("icu_intime", "timer"),
            "timer_next_d": hours_between("icu_intime", "timer_next"),
        }
    )


def fill_zero(df: DataFrame, columns=codes.ZERO_FILLED) -> DataFrame:
    return df.na.fill(0.0, [c for c in columns if c in df.columns])


def next_observed(
    df: DataFrame, id: str = "id", time: str = "t", observed: str = "obs", value: str = "glucose_t_obs",
    splits: Splits | None = None,
) -> DataFrame:
    """On observed rows: the next observed value and its time, position and zero masks; NULL elsewhere."""
    splits = splits_for(df, [id, observed], time, splits)
    seen = with_neighbours(
        df,
        [id, observed],
        [time],
        1,
        lambda w: {"_next": F.lead(value).over(w), "_t1": F.lead(time).over(w)},
        splits,
    )
    seen = scan(seen, [id, observed], [time], {"_n": Running(F.lit(1))}, splits)
    here = F.col(observed)
    return seen.withColumns(
        {
            f"{value}_next": F.when(here, F.col("_next")),
            "t1": F.when(here, F.col("_t1")),
            "n": F.when(here, F.col("_n")),
            "msk": F.when(here, F.lit(0)),
            "msk0": F.when(here, F.lit(0)),
        }
    ).drop("_next", "_t1", "_n")


def only_observed(df: DataFrame, observed: str = "obs", target: str = "glucose_t_obs_next") -> DataFrame:
    return df.filter(F.col(observed) & F.col(target).isNotNull())


def persistence_rmse(df: DataFrame, value: str = "glc", target: str = "glc_next", by=()) -> DataFrame:
    """Error of predicting no change; pairs with a NULL are left out."""
    return df.groupBy(*by).agg(F.sqrt(F.avg(F.pow(F.col(value) - F.col(target), 2))).alias("rmse"))


def cohort_summary(df: DataFrame) -> DataFrame:
    """One row: entities, median age, patients with diabetes, and the no-change error."""
    ages = df.groupBy("stay_id").agg(F.min("admission_age").alias("_age"))
    flags = df.groupBy("hadm_id").agg(
        F.max("diabetes_without_cc").alias("_plain"), F.max("diabetes_with_cc").alias("_complicated")
    )
    counts = df.agg(
        F.count_distinct("stay_id").alias("stays"),
        F.count_distinct("hadm_id").alias("admissions"),
        F.count_distinct("subject_id").alias("patients"),
    )
    sums = flags.agg(F.sum("_plain").alias("diabetes"), F.sum("_complicated").alias("diabetes_complicated"))
    return counts.withColumns(
        {
            "median_age": exact_median(ages, [], "_age").scalar(),
            "diabetes": sums.select("diabetes").scalar(),
            "diabetes_complicated": sums.select("diabetes_complicated").scalar(),
            "no_change_rmse": persistence_rmse(df).scalar(),
        }
    )


def histogram(df: DataFrame, value: str | Column, bins: int, where: Column | None = None) -> DataFrame:
    """Counts in `bins` equal-width bins from the smallest to the largest value; the last bin is closed."""
    value = F.col(value) if isinstance(value, str) else value
    data = (df if where is None else df.filter(where)).select(value.cast("double").alias("_x"))
    data, seen = pin_measured(data.filter(F.col("_x").isNotNull()), low=F.min("_x"), high=F.max("_x"))
    low, high = seen["low"], seen["high"]
    if low is not None and low == high:  # a single repeated value gets a range of one around it
        low, high = low - 0.5, high + 0.5
    lo, hi = F.lit(low).cast("double"), F.lit(high).cast("double")
    slot = F.least(F.floor((F.col("_x") - lo) * F.lit(bins) / (hi - lo)), F.lit(bins - 1)).cast("int")
    counts = data.groupBy(slot.alias("bin")).agg(F.count(F.lit(1)).alias("_n"))
    every = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    return every.join(counts, "bin", "left").select(
        "bin",
        (lo + F.col("bin") * (hi - lo) / F.lit(bins)).alias("from_value"),
        (lo + (F.col("bin") + 1) * (hi - lo) / F.lit(bins)).alias("to_value"),
        F.coalesce("_n", F.lit(0)).cast("long").alias("n"),
    )
