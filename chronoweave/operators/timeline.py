"""One timeline of readings and treatments: union, stay assignment, long, wide and with nutrition."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronoweave.functions import codes
from chronoweave.operators.ordered import with_neighbours
from chronoweave.operators.pairing import timeline_order
from chronoweave.operators.ranges import (
    Layer,
    assign_to_interval,
    in_force,
    stab_intervals,
    stab_pairs,
    sum_points_between,
)
from chronoweave.operators.splits import Splits, splits_for
from chronoweave.schemas import STAY_COLUMNS
from chronoweave.session import pin_measured, rows_per_split

TIMELINE = {
    "subject_id": "long", "hadm_id": "long", "stay_id": "long", "timer": "time", "glctimer": "time",
    "glc": "double", "glc_lab": "double", "glcsource": "string", "starttime": "time",
    "endtime": "time", "input": "double", "input_hrs": "double", "insulintype": "string",
    "event": "string", "infxstop": "int",
}


def _shaped(df: DataFrame, given: dict[str, str]) -> DataFrame:
    """Project onto the timeline's columns; a column the source lacks becomes a typed NULL."""
    time = df.schema[given["timer"]].dataType
    return df.select(
        *[
            (F.col(given[c]) if c in given else F.lit(None)).cast(time if t == "time" else t).alias(c)
            for c, t in TIMELINE.items()
        ]
    )


def build_timeline(readings: DataFrame, treatments: DataFrame) -> DataFrame:
    ids = {c: c for c in ("subject_id", "hadm_id", "stay_id")}
    left = _shaped(
        readings,
        {**ids, "timer": "charttime", "glctimer": "charttime", "glc": "glucose", "glc_lab": "glucose_lab",
         "glcsource": "glcsource"},
    )
    right = _shaped(
        treatments,
        {**ids, "timer": "starttime", "starttime": "starttime", "endtime": "endtime", "input": "amount",
         "input_hrs": "rate", "insulintype": "insulintype", "event": "insulinadmin", "infxstop": "infxstop"},
    )
    return left.unionByName(right)


def stay_attributes(stays: DataFrame, comorbidity: DataFrame, weight: DataFrame) -> DataFrame:
    """Stays with comorbidity (by subject and admission) and weight (by stay) where known."""
    return stays.join(comorbidity, ["subject_id", "hadm_id"], "left").join(weight, "stay_id", "left")


def assign_stays(timeline: DataFrame, stays: DataFrame) -> DataFrame:
    """Keep events strictly inside a stay of their subject and admission, with the stay's attributes."""
    side = stays.select("subject_id", "hadm_id", F.col("stay_id").alias("_stay"), *STAY_COLUMNS)
    matched = assign_to_interval(timeline, side, ["subject_id", "hadm_id"], "timer", "icu_intime", "icu_outtime")
    return (
        matched.withColumn("stay_id", F.coalesce("stay_id", "_stay"))
        .select(*TIMELINE, *STAY_COLUMNS)
        .distinct()
    )


def to_long(paired: DataFrame, splits: Splits | None = None) -> DataFrame:
    """Unrepeated fingerstick rows and all treatment rows, each with the next row's time.

    `timer_next` is taken after the filter; the last row of a stay has none and is dropped.
    """
    source = F.coalesce("glcsource", "glcsource_al")
    kept = paired.filter(
        (F.col("repeated").isNull() & (F.lower(source) == "fingerstick")) | F.col("insulintype").isNotNull()
    )
    seen = with_neighbours(
        kept,
        ["stay_id"],
        timeline_order(kept),
        1,
        lambda w: {"timer_next": F.lead("timer").over(w)},
        splits,
    ).filter(F.col("timer_next").isNotNull())
    extra = [c for c in STAY_COLUMNS if c in seen.columns]
    return seen.select(
        "subject_id",
        "hadm_id",
        "stay_id",
        "timer",
        "timer_next",
        F.coalesce("glc", "glc_al").alias("glc"),
        "glc_lab",
        F.coalesce("glctimer", "glctimer_al").alias("glctimer"),
        source.alias("glcsource"),
        "starttime",
        "endtime",
        "input",
        "input_hrs",
        "insulintype",
        "event",
        "infxstop",
        *extra,
    )


def wide_order(df: DataFrame) -> list[str]:
    """Time, then what tells repeated rows of one time apart."""
    last = ["starttime", "endtime", "input_hrs", "tpn_rate", "icu_intime"]
    return ["timer", *[c for c in last if c in df.columns]]


def to_wide(long: DataFrame, splits: Splits | None = None) -> DataFrame:
    """One row per stay and time with the treatments then in force.

    An infusion is in force at its own time and while start <= time < end; overlapping infusions repeat the
    row. `timer_prev` and `glc_next` look at the repeated rows, as in the original.
    """
    splits = splits_for(long, ["stay_id"], "timer", splits)
    attributes = [c for c in STAY_COLUMNS if c in long.columns]
    keys = ["subject_id", "hadm_id", "stay_id", "timer", *attributes]
    kind = F.lower("event")
    base = long.groupBy(*keys).agg(
        *[F.max(c).alias(c) for c in ("timer_next", "glc", "glc_lab", "glctimer", "glcsource")],
    )
    boluses = (
        long.filter(kind.isin("bolus_push", "bolus_injection"))
        .groupBy("subject_id", "hadm_id", "stay_id", "timer")
        .agg(
            F.sum(F.when(kind == "bolus_push", F.col("input"))).alias("input_bolus_push"),
            F.sum(F.when(kind == "bolus_injection", F.col("input"))).alias("input_bolus_injection"),
        )
        .drop("subject_id", "hadm_id")
    )
    infusions = long.filter(kind == "infusion").select(
        "stay_id", F.col("timer").alias("_own"), "starttime", "endtime", "input_hrs"
    )
    probes = base.select("stay_id", "timer").distinct()
    during = stab_pairs(probes, infusions, ["stay_id"], splits=splits).filter(F.col("timer") != F.col("_own")).drop("_own")
    at_start = infusions.withColumnRenamed("_own", "timer")
    in_force = during.unionByName(at_start)
    joined = base.join(in_force, ["stay_id", "timer"], "left").join(boluses, ["stay_id", "timer"], "left")
    # overlapping infusions may fill an entity, or one time of it, that wasn't full: the cuts are made for the joined rows
    joined, seen = pin_measured(joined, n=F.count(F.lit(1)))
    splits = None if seen["n"] > rows_per_split(long.sparkSession) else Splits(("stay_id",), "timer", None)
    out = with_neighbours(
        joined,
        ["stay_id"],
        wide_order(joined),
        1,
        lambda w: {"_prev": F.lag("timer").over(w), "glc_next": F.lead("glc").over(w)},
        splits,
    )
    first = F.col("icu_intime") if "icu_intime" in attributes else F.lit(None).cast(long.schema["timer"].dataType)
    return out.select(
        "subject_id",
        "hadm_id",
        "stay_id",
        "timer",
        "timer_next",
        F.coalesce("_prev", first).alias("timer_prev"),
        "glc",
        "glc_next",
        "glc_lab",
        "glctimer",
        "glcsource",
        "input_bolus_push",
        "input_bolus_injection",
        "input_hrs",
        "starttime",
        "endtime",
        *attributes,
    )


def add_nutrition(
    wide: DataFrame,
    parenteral: DataFrame,
    enteral: DataFrame,
    repeat_rows: bool = True,
    splits: Splits | None = None,
) -> DataFrame:
    """Attach nutrition in force at each time: mean enteral rates, TPN rate, dextrose given since the last row.

    TPN orders that overlap repeat the row. With `repeat_rows=False` they do not: `tpn_rate` is then the mean
    over the orders in force and `n_tpn` their number, for callers that drop such stays anyway.
    """
    splits = splits_for(wide, ["stay_id"], "timer", splits)
    tpn = parenteral.filter(F.col("tpn_rate").isNotNull()).select(
        "stay_id", F.col("starttime").alias("_tpn_start"), F.col("endtime").alias("_tpn_end"), "tpn_rate"
    )
    rates = ["enteral_rate", *[f"{n}_enteral" for n in codes.NUTRIENTS]]
    layers = [
        Layer(enteral, averages={c: c for c in rates}, first_start="ent_starttime", last_end="ent_endtime"),
    ]
    if not repeat_rows:
        layers.append(Layer(tpn, "_tpn_start", "_tpn_end", averages={"tpn_rate": "tpn_rate"}, count="n_tpn"))
    out = in_force(wide, ["stay_id"], "timer", layers, splits)
    if repeat_rows:
        out = stab_intervals(out, tpn, ["stay_id"], "timer", "_tpn_start", "_tpn_end", splits=splits)
        out = out.drop("_tpn_start", "_tpn_end")
    fluid = parenteral.filter(F.col("dextrose_fluid").isNotNull()).select("stay_id", "starttime", "dextrose_fluid")
    given = sum_points_between(wide, fluid, ["stay_id"], "dextrose_fluid", splits=splits)
    return out.join(given, ["stay_id", "timer"], "left")


def drop_fanned_out_entities(
    df: DataFrame, key: str = "stay_id", at: str = "timer", also: Column | None = None
) -> DataFrame:
    """Drop every entity that has two rows at one time, with the NULL rules of NOT IN.

    `also` marks further rows whose entity goes. If any entity is dropped, rows with a NULL key go too; a
    dropped NULL key empties the result.
    """
    marked = F.max(F.coalesce(also, F.lit(False))) if also is not None else F.lit(False)
    removals = (
        df.groupBy(key, at)
        .agg(F.count(F.lit(1)).alias("_n"), marked.alias("_marked"))
        .filter((F.col("_n") > 1) | F.col("_marked"))
        .select(F.col(key).alias("_gone"))
        .distinct()
    )
    removals, seen = pin_measured(removals, n=F.count(F.lit(1)), n_null=F.count_if(F.col("_gone").isNull()))
    if seen["n"] == 0:
        return df
    if seen["n_null"]:
        return df.filter(F.lit(False))
    return df.join(removals, df[key] == F.col("_gone"), "left_anti").filter(F.col(key).isNotNull())
