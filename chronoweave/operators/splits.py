"""Cutting over-full entities into consecutive parts of their timeline.

Most operators here work along one entity's timeline. One entity may hold a third of all rows, so an
entity with more rows than a task should hold is cut at fixed times into parts. Rows of a part meet in
one task; what a part needs from its neighbours comes either as copies of the rows next to the cut
(`widen`) or as per-part totals (`ordered.scan`). Ordinary entities stay whole and pay for none of it.

The cut times are collected once and enter the plan as constants, so a recomputed task cuts at the same
places. There are at most (rows / rows-per-split) over-full entities, which bounds everything sent out.

Times alone can't cut the rows of one time (or of no time). Where more rows than a part holds share it, it is a cut of its
own, and its rows are numbered along the rest of their order and cut by number.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chronoweave.functions.clock import micros
from chronoweave.session import pin, rows_per_split

PART = "_part"
HALO = "_halo"
SUBPARTS = 1 << 24


def position(df: DataFrame, clock: str) -> Column:
    """The clock as a number: microseconds for timestamps, itself otherwise."""
    kind = df.schema[clock].dataType
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return micros(df, clock).cast("double")
    return F.col(clock).cast("double")


def row_hash(df: DataFrame) -> Column:
    """A hash of the whole row, to order rows that nothing else does; maps, which can't be hashed, are left out."""
    hashed = [f.name.replace("`", "``") for f in df.schema if "map<" not in f.dataType.simpleString()]
    return F.xxhash64(*[F.col(f"`{c}`") for c in hashed])


def same_keys(left: list[Column], right: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, (x.eqNullSafe(y) for x, y in zip(left, right)))


@dataclass(frozen=True)
class Splits:
    keys: tuple[str, ...]
    clock: str
    hot: DataFrame | None  # one row per over-full entity: its keys, and where its parts begin
    thick: DataFrame | None = None  # one row per over-full time of such an entity: its keys and `_x`, which may be NULL
    rows: int = 0

    @property
    def any(self) -> bool:
        return self.hot is not None

    def tag(self, df: DataFrame, order: list[Column] | None = None) -> DataFrame:
        """Add the number of the row's part, which grows along the order; 0 for ordinary entities.

        Rows of an over-full time are numbered along `order` (without it, along nothing but a hash of the row).
        """
        if not self.any:
            return df.withColumn(PART, F.lit(0).cast("long"))
        by_time = self._tag_time(df)
        return by_time if self.thick is None else self._tag_rank(by_time, order or [])

    def _tag_time(self, df: DataFrame) -> DataFrame:
        x = position(df, self.clock)
        names = [f"_hot_{k}" for k in self.keys]
        hot = F.broadcast(self.hot.toDF(*names, "_lo", "_width", "_base", "_cuts"))
        cell = F.least(F.floor((x - F.col("_lo")) / F.col("_width")), F.size("_base") - 1).cast("int")
        cell = F.greatest(cell, F.lit(0))
        # cuts of the cell before x, counted without a lambda, which would take the row out of generated code
        inside = F.array_position(F.sort_array(F.array_append(F.get(F.col("_cuts"), cell), x)), x) - 1
        # rows without a time come before all others
        part = F.when(F.col("_lo").isNotNull(), F.when(x.isNull(), F.lit(-1)).otherwise(F.get(F.col("_base"), cell) + inside))
        return (
            df.join(hot, same_keys([df[k] for k in self.keys], [F.col(n) for n in names]), "left")
            .withColumn(PART, F.coalesce(part, F.lit(0)).cast("long"))
            .drop(*names, "_lo", "_width", "_base", "_cuts")
        )

    def _tag_rank(self, df: DataFrame, order: list[Column]) -> DataFrame:
        """Number the rows of each over-full time over range partitions, stored once, and cut them by number.

        Such a time is the last of its part, so its rows' parts follow the rest of the part.
        """
        names = [f"_thick_{k}" for k in self.keys]
        thick = F.broadcast(self.thick.toDF(*names, "_thick_x"))
        x = position(df, self.clock)
        match = same_keys([df[k] for k in self.keys], [F.col(n) for n in names]) & x.eqNullSafe(F.col("_thick_x"))
        spaced = df.withColumn(PART, F.col(PART) * SUBPARTS)
        thin = spaced.join(thick, match, "left_anti")
        held = [*names, "_thick_x"]
        along = [*[F.col(c).asc_nulls_first() for c in held], *[c.asc_nulls_first() for c in order], row_hash(df).asc()]
        laid = pin(
            spaced.join(thick, match)
            .repartitionByRange(*along)
            .sortWithinPartitions(*along)
            .withColumns({"_pid": F.spark_partition_id(), "_pos": F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))})
        )
        # one row per range partition and over-full time that meet
        runs = laid.groupBy("_pid", *held).agg(F.min("_pos").alias("_from"), F.count(F.lit(1)).alias("_n"))
        before = Window.partitionBy(*held).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
        runs = runs.withColumn("_from", F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_from")).drop("_n")
        here = ["_run_pid", *[f"_run{c}" for c in held]]
        numbered = laid.join(
            F.broadcast(runs.toDF(*here, "_from")), same_keys([laid[c] for c in ("_pid", *held)], [F.col(c) for c in here])
        )
        number = F.floor((F.col("_pos") + F.col("_from")) / F.lit(self.rows)) + 1
        cut = numbered.withColumn(PART, F.col(PART) + number).select(*thin.columns)
        return thin.unionByName(cut)

    def only_hot(self, df: DataFrame) -> DataFrame:
        names = [f"_hot_{k}" for k in self.keys]
        hot = F.broadcast(self.hot.select(*[F.col(k).alias(n) for k, n in zip(self.keys, names)]))
        return df.join(hot, same_keys([df[k] for k in self.keys], [F.col(n) for n in names]), "left_semi")

    def widen(self, df: DataFrame, order: list[Column], reach: int) -> DataFrame:
        """Tag `df` and add, to every part, the `reach` rows just before and just after it (`_halo` = true)."""
        tagged = df if PART in df.columns else self.tag(df, order[1:])
        if not self.any:
            return tagged.withColumn(HALO, F.lit(False))
        forward = [c.asc_nulls_first() for c in order]
        by_part = Window.partitionBy(*self.keys, PART)
        place, size = F.row_number().over(by_part.orderBy(*forward)), F.count(F.lit(1)).over(by_part)
        marked = self.only_hot(tagged).withColumns({"_place": place, "_size": size})
        at_edge = (F.col("_place") <= reach) | (F.col("_size") - F.col("_place") < reach)
        # at most 2 * reach rows per part, stored so that a chain of operators works out its input once per step
        edges = pin(marked.filter(at_edge).drop("_place", "_size"))
        along = Window.partitionBy(*self.keys).orderBy(PART, *forward)
        # a copy goes to every other part that begins or ends within `reach` edge rows
        steps = [F.lead(PART, j).over(along) for j in range(1, reach + 1)]
        steps += [F.lag(PART, j).over(along) for j in range(1, reach + 1)]
        copies = (
            edges.withColumn("_to", F.array_distinct(F.array_compact(F.array(*steps))))
            .withColumn("_to", F.explode("_to"))
            .filter(F.col("_to") != F.col(PART))
            .withColumn(PART, F.col("_to"))
            .drop("_to")
        )
        wide = tagged.withColumn(HALO, F.lit(False)).unionByName(copies.withColumn(HALO, F.lit(True)))
        return self.spread(wide)

    def place(self, df: DataFrame, order: list[Column] | None = None) -> DataFrame:
        """Tag and spread `df` once for a run of operators; they keep the `_part` column they find.

        `order` is what follows the clock in the operators' order.
        """
        return df if not self.any or PART in df.columns else self.spread(self.tag(df, order))

    def spread(self, tagged: DataFrame) -> DataFrame:
        """Shuffle by entity and part, so that an over-full entity's parts land in different tasks.

        Said outright because rows already shuffled by entity alone would count as well placed.
        """
        return tagged.repartition(*self.keys, PART)


def find_splits(df: DataFrame, keys: list[str], clock: str, rows: int | None = None) -> Splits:
    """Count rows per entity and choose cut times for those above `rows` (default: the session's setting)."""
    spark = df.sparkSession
    rows = rows or rows_per_split(spark)
    x = position(df, clock)
    slim = df.select(*keys, x.alias("_x"))
    sizes = (
        slim.groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("_n"), F.min("_x").alias("_lo"), F.max("_x").alias("_hi"))
        .filter(F.col("_n") > rows)
        .collect()
    )
    if not sizes:
        return Splits(tuple(keys), clock, None)
    parts = max(-(-r["_n"] // rows) for r in sizes)
    levels = [i / parts for i in range(1, parts)]
    key_schema = T.StructType([T.StructField(k, df.schema[k].dataType) for k in keys])
    hot_keys = spark.createDataFrame([tuple(r[k] for k in keys) for r in sizes], key_schema)
    names = [f"_hot_{k}" for k in keys]
    rows_of_hot = slim.join(F.broadcast(hot_keys.toDF(*names)), same_keys([slim[k] for k in keys], [F.col(n) for n in names]))
    cuts = rows_of_hot.groupBy(*keys).agg(F.percentile_approx("_x", levels, max(10000, 8 * parts)).alias("_cuts")).collect()
    found = {tuple(r[k] for k in keys): r["_cuts"] or [] for r in cuts}
    # at most all rows / rows-per-split of them, too
    full = rows_of_hot.groupBy(*keys, "_x").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > rows).select(*keys, "_x").collect()
    own: dict[tuple, set[float]] = {}
    for r in full:
        if r["_x"] is not None:
            own.setdefault(tuple(r[k] for k in keys), set()).add(r["_x"])
    table = []
    for r in sizes:
        key = tuple(r[k] for k in keys)
        wanted = -(-r["_n"] // rows)
        step = max(1, parts // wanted)
        low, high = (0.0, 0.0) if r["_lo"] is None else (r["_lo"], r["_hi"])
        times = sorted({c for c in found[key][step - 1 :: step] if c < high} | own.get(key, set()))
        cells = 2 * (len(times) + 1)
        width = (high - low) / cells or 1.0
        inside: list[list[float]] = [[] for _ in range(cells)]
        for c in times:
            inside[min(int((c - low) / width), cells - 1)].append(c)
        base, passed = [], 0
        for group in inside:
            base.append(passed)
            passed += len(group)
        table.append((*key, low, width, base, inside))
    schema = T.StructType(
        list(key_schema.fields)
        + [
            T.StructField("_lo", T.DoubleType()),
            T.StructField("_width", T.DoubleType()),
            T.StructField("_base", T.ArrayType(T.IntegerType())),
            T.StructField("_cuts", T.ArrayType(T.ArrayType(T.DoubleType()))),
        ]
    )
    thick_schema = T.StructType([*key_schema.fields, T.StructField("_x", T.DoubleType())])
    thick = spark.createDataFrame([tuple(r) for r in full], thick_schema) if full else None
    return Splits(tuple(keys), clock, spark.createDataFrame(table, schema), thick, rows)


def splits_for(df: DataFrame, keys: list[str], clock: str, given: Splits | None) -> Splits:
    return given if given is not None else find_splits(df, keys, clock)
