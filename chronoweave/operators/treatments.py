"""Insulin treatments: raw orders to clean boluses and infusions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronoweave.functions import codes
from chronoweave.functions.doubles import ordered_bits
from chronoweave.session import pin

SKETCH_BITS = 14
SKETCH_ERROR = 1.04 / 2 ** (SKETCH_BITS / 2)  #: relative standard error of a sketched count, 0.8 %

TREATMENT_COLUMNS = [
    "subject_id", "hadm_id", "stay_id", "starttime", "endtime", "amount", "rate", "originalrate", "itemid",
    "ordercategoryname", "insulintype", "insulinadmin", "infxstop",
]


def code_map(column: str, table: dict[int, str]) -> Column:
    """Category of a code; NULL for an unknown code."""
    out = F
    for name in dict.fromkeys(table.values()):
        out = out.when(F.col(column).isin(*[k for k, v in table.items() if v == name]), F.lit(name))
    return out


def admin_route(column: str = "ordercategoryname") -> Column:
    """Route of a treatment from its order category; the first match wins."""
    return (
        F.when(F.upper(column).like(codes.INJECTION_PATTERN), "BOLUS_INJECTION")
        .when(F.upper(column).like(codes.PUSH_PATTERN), "BOLUS_PUSH")
        .when(F.col(column).isin(*codes.INFUSION_CATEGORIES), "INFUSION")
    )


def raw_treatments(orders: DataFrame) -> DataFrame:
    """Insulin orders inside a stay, not rewritten (a NULL status is dropped too), each distinct row once."""
    return (
        orders.filter(F.col("itemid").isin(*codes.INSULIN_TYPES))
        .filter(F.col("statusdescription") != codes.REWRITTEN)
        .filter(F.col("stay_id").isNotNull())
        .dropDuplicates(
            ["subject_id", "hadm_id", "stay_id", "starttime", "endtime", "itemid", "ordercategoryname",
             "statusdescription", "amount", "rate", "originalrate"]
        )
        .withColumns(
            {
                "insulintype": code_map("itemid", codes.INSULIN_TYPES),
                "insulinadmin": admin_route(),
                "infxstop": F.when(F.col("statusdescription").isin(*codes.STOPPED_STATES), 1).otherwise(0),
            }
        )
        .select(*TREATMENT_COLUMNS)
    )


def _limit(rows: DataFrame, value: str, cap: str, exact: bool) -> Column:
    """The threshold as a one-row scalar subquery."""
    if cap == "p99":
        aggregate = F.percentile_approx(value, 0.99)
    elif exact:
        aggregate = F.count_distinct(value)
    else:
        aggregate = F.approx_count_distinct(value)
    return rows.agg(aggregate.cast("double")).scalar()


def _boluses(raw: DataFrame) -> DataFrame:
    return raw.filter(
        F.upper("insulinadmin").isin("BOLUS_PUSH", "BOLUS_INJECTION") & (F.upper("insulintype") == "SHORT")
    )


def _infusions(raw: DataFrame) -> DataFrame:
    return raw.filter((F.upper("insulinadmin") == "INFUSION") & (F.upper("insulintype") == "SHORT")).withColumn(
        "rate", F.coalesce("rate", "originalrate")
    )


def limit_sketches(raw: DataFrame, part: str | Column) -> DataFrame:
    """part, kind ("bolus" or "infusion"), sketch: what a part of the orders adds to the count of distinct values.

    Sketches unite without loss, so a limit needs the sketches of all parts and no order of theirs. Their standard error
    is SKETCH_ERROR; counts up to some hundreds are exact.
    """
    part = F.lit(part) if isinstance(part, str) else part
    values = _boluses(raw).select(part.alias("part"), F.lit("bolus").alias("kind"), F.col("amount").alias("_v")).unionByName(
        _infusions(raw).select(part.alias("part"), F.lit("infusion").alias("kind"), F.col("rate").alias("_v"))
    )
    bits = ordered_bits(F.col("_v").cast("double"))  # the sketch takes whole numbers
    return values.filter(F.col("_v").isNotNull()).groupBy("part", "kind").agg(F.hll_sketch_agg(bits, SKETCH_BITS).alias("sketch"))


def add_part(raw: DataFrame, part: str | Column, path: str) -> None:
    """Store the sketches of a new part under `path`; a part that is there already is replaced, others aren't touched."""
    sketches = limit_sketches(raw, part)
    sketches.write.option("partitionOverwriteMode", "dynamic").mode("overwrite").partitionBy("part").parquet(path)


def limits_of(sketches: DataFrame) -> DataFrame:
    """kind, limit: the number of distinct values over all parts."""
    return sketches.groupBy("kind").agg(F.hll_sketch_estimate(F.hll_union_agg("sketch")).cast("double").alias("limit"))


def clean_boluses(
    raw: DataFrame, cap: str = "distinct_count", exact: bool = False, sketches: DataFrame | None = None
) -> DataFrame:
    """Short-acting boluses with a positive amount; an amount at or above the limit becomes NULL.

    The limit is the number of distinct amounts, as in the original (its name suggests a 99th percentile was
    meant: `cap='p99'`). `exact` counts distinct amounts exactly instead of by sketch. With `sketches` (of all parts, see
    `add_part`) the limit comes from them, and `raw` may be the new part alone.
    """
    boluses = _boluses(raw)
    limit = _limit(boluses, "amount", cap, exact) if sketches is None else _stored_limit(sketches, "bolus")
    return boluses.filter(F.col("amount") > 0).withColumn("amount", F.when(F.col("amount") < limit, F.col("amount")))


def _stored_limit(sketches: DataFrame, kind: str) -> Column:
    return limits_of(sketches.filter(F.col("kind") == kind)).select("limit").scalar()


def clean_infusions(
    raw: DataFrame, cap: str = "distinct_count", exact: bool = False, sketches: DataFrame | None = None
) -> DataFrame:
    """Short-acting infusions whose rate lies between zero and the limit (see `clean_boluses`)."""
    infusions = _infusions(raw)
    limit = _limit(infusions, "rate", cap, exact) if sketches is None else _stored_limit(sketches, "infusion")
    return infusions.filter((F.col("rate") < limit) & (F.col("rate") > 0))


def clean_treatments(
    orders: DataFrame, cap: str = "distinct_count", exact: bool = False, sketches: DataFrame | None = None
) -> DataFrame:
    raw = pin(raw_treatments(orders))  # read for both limits and both kinds of rows; the orders are read once
    return (
        clean_boluses(raw, cap, exact, sketches).distinct().unionByName(clean_infusions(raw, cap, exact, sketches).distinct())
    ).select(*TREATMENT_COLUMNS)
