"""Rows to per-entity sequences, padded batches, and back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronoweave.operators.ordered import Running, Whole, add_row_id, scan
from chronoweave.operators.splits import Splits, splits_for
from chronoweave.roles import Roles

SEGMENT = 10_000


def _vector(columns, kind: str = "double") -> Column:
    return F.array(*[F.col(c).cast(kind) for c in columns]).cast(f"array<{kind}>")


def to_sequences(
    df: DataFrame,
    roles: Roles,
    max_len: int | None = None,
    segment: int = SEGMENT,
    order: list | None = None,
    splits: Splits | None = None,
) -> DataFrame:
    """One row per entity and segment: step arrays `xt`, `xi`, `y`, `msk`, `dt`, `msk0`, `key`, static `x0`.

    `max_len` keeps the first steps only (training). Rows hold `segment` steps each, the last one fewer, are numbered by
    `seg` and follow each other, so no step is lost and no row grows without bound. `seqlen` is the length of the row,
    `steps` that of the whole entity.
    """
    order = order or [roles.time_vars[0], roles.key]
    splits = splits_for(df, [roles.id], order[0], splits)
    steps = scan(df, [roles.id], order, {"_i": Running(F.lit(1))}, splits)
    if max_len is not None:
        steps = steps.filter(F.col("_i") <= max_len)
    first = F.when(F.col("_i") == 1, _vector(roles.static))
    steps = scan(steps, [roles.id], order, {"_x0": Whole("max", first), "_steps": Whole("max", F.col("_i"))}, splits)
    step = F.struct(
        F.col("_i").alias("i"),
        _vector([*roles.timevarying, *roles.counts]).alias("xt"),
        _vector(roles.intervention).alias("xi"),
        F.col(roles.target).cast("double").alias("y"),
        F.col(roles.target_mask).cast("int").alias("msk"),
        _vector(roles.time_vars).alias("dt"),
        F.col("msk0").cast("int").alias("msk0"),
        F.col(roles.key).cast("long").alias("key"),
    )
    grouped = (
        steps.select(
            F.col(roles.id), F.floor((F.col("_i") - 1) / F.lit(segment)).cast("long").alias("seg"), step.alias("_s"), "_x0", "_steps"
        )
        .groupBy(roles.id, "seg")
        .agg(F.array_sort(F.collect_list("_s")).alias("_s"), F.first("_x0").alias("x0"), F.first("_steps").cast("long").alias("steps"))
    )
    return grouped.select(
        roles.id,
        "seg",
        F.size("_s").alias("seqlen"),
        "steps",
        "x0",
        *[F.col(f"_s.{c}").alias(c) for c in ("xt", "xi", "y", "msk", "dt", "msk0", "key")],
    )


def pad_batches(seq: DataFrame, roles: Roles, size: int = 128) -> DataFrame:
    """Number entities in id order, batch them, and pad each segment to the longest of that number in its batch.

    Padding is 0 for values and times, 1 for masks, -1 for keys. Only ids and lengths are sorted; the arrays
    stay where the grouping put them.
    """
    ranked = add_row_id(seq.filter(F.col("seg") == 0).select(roles.id), [roles.id], "_rank")
    ranked = ranked.withColumn("batch", F.floor(F.col("_rank") / F.lit(size)).cast("long")).drop("_rank")
    index = seq.select(roles.id, "seg", "seqlen").join(ranked, roles.id)
    index = index.withColumn("_longest", F.max("seqlen").over(Window.partitionBy("batch", "seg"))).drop("seqlen")
    missing = F.col("_longest") - F.col("seqlen")

    def padded(name: str, value: Column) -> Column:
        return F.concat(F.col(name), F.array_repeat(value, missing)).alias(name)

    def zeros(n: int) -> Column:
        return F.array_repeat(F.lit(0.0), n)

    return seq.join(index, [roles.id, "seg"]).select(
        "batch",
        roles.id,
        "seg",
        "seqlen",
        "steps",
        "x0",
        padded("xt", zeros(len(roles.timevarying) + len(roles.counts))),
        padded("xi", zeros(len(roles.intervention))),
        padded("y", F.lit(0.0)),
        padded("msk", F.lit(1)),
        padded("dt", zeros(2)),
        padded("msk0", F.lit(1)),
        padded("key", F.lit(-1).cast("long")),
    )


def unpad(batches: DataFrame, outputs: list[str]) -> DataFrame:
    """Back to one row per unmasked step: its key and the given output arrays."""
    zipped = F.arrays_zip("key", "msk", *outputs)
    return batches.select(F.inline(zipped)).filter(F.col("msk") == 0).select("key", *outputs)
