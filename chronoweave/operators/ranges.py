"""Time points against time intervals of the same entity.

A plain equi join on the entity with the time test as residual compares every point with every interval of
that entity. Two ways around it:

* `in_force` for counts, averages, earliest start and latest end of the intervals around a point: starts,
  ends and points form one timeline and running aggregates give the answer, so no pair is ever built.
* `stab_pairs` where the pairs themselves are wanted. Intervals get a size class and points meet only
  intervals of the same stretch of time: class c cuts time into stretches of 16^(c+1) milliseconds and holds
  the intervals that fit into one, so an interval touches at most two stretches, and the pairs compared stay
  within a constant factor of those that match (for evenly spread points). A bitmap per entity tells the classes
  its intervals really have; a point is copied for those alone, and a point of an entity without intervals goes.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronoweave.functions.clock import micros
from chronoweave.functions.doubles import bins_between, part_in_bin, with_totals
from chronoweave.functions.links import nan_to_null
from chronoweave.operators.ordered import Remaining, Running, scan
from chronoweave.operators.splits import Splits, find_splits
from chronoweave.session import pin_measured, rows_per_split

BASE = 16
MILLISECOND = 1_000
CLASSES = 12


def stab_pairs(
    points: DataFrame,
    intervals: DataFrame,
    keys: list[str],
    point: str = "timer",
    start: str = "starttime",
    end: str = "endtime",
    closed: str = "left",
    splits: Splits | None = None,
) -> DataFrame:
    """All (point, interval) pairs of one entity with the point inside the interval.

    `closed`: 'left' is start <= t < end, 'neither' is start < t < end. Columns of `points` come first, then
    the interval's own columns (its keys are dropped, its names must not clash). Nothing runs while the plan is built.
    Stretches with more points than a part holds are salted: their points are dealt over shares, and their intervals
    go to every share. `splits` that hold no over-full entity say that there is no such stretch.
    """
    length = micros(intervals, end) - micros(intervals, start)
    level = F
    for n in range(CLASSES):
        level = level.when(length <= MILLISECOND * BASE ** (n + 1), n)
    sized = intervals.filter(length > 0).withColumn("_level", level.otherwise(CLASSES))
    stretch = F
    for n in range(CLASSES + 1):
        stretch = stretch.when(F.col("_level") == n, F.lit(MILLISECOND * BASE ** (n + 1)))
    slots = F.sequence(F.floor(micros(intervals, start) / stretch), F.floor(micros(intervals, end) / stretch))
    spread = sized.withColumn("_slot", F.explode(slots))

    own = {k: f"_i_{k}" for k in keys}
    bit = F.call_function("shiftleft", F.lit(1), F.col("_level"))
    classes = sized.groupBy(*keys).agg(F.bit_or(bit).alias("_classes")).withColumnsRenamed({k: f"_c_{k}" for k in keys})
    known = points.join(classes, reduce(lambda a, b: a & b, (points[k] == F.col(f"_c_{k}") for k in keys)))
    used = [F.when(F.col("_classes").bitwiseAND(F.lit(1 << n)) != 0, F.lit(n)) for n in range(CLASSES + 1)]
    placed = known.withColumn("_level", F.explode(F.array_compact(F.array(*used)))).drop("_classes", *[f"_c_{k}" for k in keys])
    placed = placed.withColumn("_slot", F.floor(micros(points, point) / stretch))

    where = [*keys, "_level", "_slot"]
    own |= {"_level": "_i_level", "_slot": "_i_slot"}
    if splits is None or splits.any:
        # at most all copies / rows-per-split stretches
        rows = rows_per_split(points.sparkSession)
        full = placed.groupBy(*where).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > rows)
        names = [f"_f_{c}" for c in where]
        full = F.broadcast(full.select(*[F.col(c).alias(n) for c, n in zip(where, names)], F.ceil(F.col("_n") / rows).alias("_shares")))

        def shared(df: DataFrame) -> DataFrame:
            return df.join(full, reduce(lambda a, b: a & b, (df[c] == F.col(n) for c, n in zip(where, names))), "left").drop(*names)

        deal = F.pmod(F.xxhash64(*points.columns), F.coalesce("_shares", F.lit(1)))
        placed = shared(placed).withColumn("_share", deal).drop("_shares")
        every = F.sequence(F.lit(0).cast("long"), F.coalesce("_shares", F.lit(1)) - 1)
        spread = shared(spread).withColumn("_share", F.explode(every)).drop("_shares")
        own["_share"] = "_i_share"
    spread = spread.withColumnsRenamed(own)
    inside = (F.col(point) >= F.col(start)) if closed == "left" else (F.col(point) > F.col(start))
    condition = inside & (F.col(point) < F.col(end))
    for here, there in own.items():
        condition &= F.col(here) == F.col(there)
    return placed.join(spread, condition).drop("_level", "_slot", "_share", *own.values())


def stab_intervals(
    df: DataFrame,
    intervals: DataFrame,
    keys: list[str],
    point: str = "timer",
    start: str = "starttime",
    end: str = "endtime",
    aggs: dict[str, Column] | None = None,
    splits: Splits | None = None,
) -> DataFrame:
    """Left join each row with the intervals that hold its time (start <= t < end).

    With `aggs` (name -> aggregate over interval columns) there is one output row per input row; without,
    a row is repeated once per interval. Interval columns must not share a name with `df`, keys aside.
    """
    probes = df.select(*keys, point).distinct()
    pairs = stab_pairs(probes, intervals, keys, point, start, end, splits=splits)
    if aggs is not None:
        pairs = pairs.groupBy(*keys, point).agg(*[c.alias(n) for n, c in aggs.items()])
    return df.join(pairs, [*keys, point], "left")


@dataclass(frozen=True)
class Layer:
    """One table of intervals for `in_force`, and the names of the outputs wanted from it."""

    rows: DataFrame
    start: str = "starttime"
    end: str = "endtime"
    averages: dict[str, str] = field(default_factory=dict)  # output name -> column
    count: str | None = None
    first_start: str | None = None
    last_end: str | None = None


def _stored(layer: Layer, keys: list[str]) -> tuple[DataFrame, dict]:
    """The layer's intervals that have a length, and how large and small their values are, noted as they are stored."""
    alive = layer.rows.filter(F.col(layer.end) > F.col(layer.start))
    values = {out: nan_to_null(F.col(c).cast("double")) for out, c in layer.averages.items()}
    renamed = [F.col(layer.start).alias("_start"), F.col(layer.end).alias("_end")]
    slim = alive.select(*keys, *renamed, *[v.alias(f"_v_{out}") for out, v in values.items()])
    measures = {"n": F.count(F.lit(1))}
    for out in values:
        size = F.abs(f"_v_{out}")
        finite = size < float("inf")
        measures[f"least_{out}"] = F.min(F.when(finite & (size > 0), size))
        measures[f"most_{out}"] = F.max(F.when(finite, size))
        measures[f"endless_{out}"] = F.count_if(~finite)
    return pin_measured(slim, **measures)


def in_force(
    df: DataFrame, keys: list[str], point: str, layers: list[Layer], splits: Splits | None = None
) -> DataFrame:
    """Add, per row, aggregates of the intervals that hold its time (start <= t < end); NULL where there is none.

    Rows, interval starts and interval ends are sorted into one timeline. What started less what ended gives
    counts and sums. The latest end of all that started is the latest end in force whenever any is, and the
    earliest start of all that has yet to end likewise. Sums are kept in bins of 32 bits, as many as the values at
    hand can touch, so what is added is taken away to the last bit, whatever the values' sizes and the order of rows;
    a sum is rounded once, when it is divided. NaN counts as missing, an infinite value makes its average infinite.
    """
    time = df.schema[point].dataType
    moves, wanted, sums, endless, moved = [], {}, {}, set(), 0
    for n, layer in enumerate(layers):
        stored, seen = _stored(layer, keys)
        moved += 2 * seen["n"]
        wanted[f"_n{n}"] = Running(F.col(f"_n{n}"))
        parts: dict[str, Column] = {f"_n{n}": F.lit(1)}
        for out in layer.averages:
            value = F.col(f"_v_{out}")
            parts[f"_k{n}_{out}"] = F.when(value.isNotNull(), F.lit(1))
            bins = bins_between(seen[f"least_{out}"], seen[f"most_{out}"])
            finite = F.when(F.abs(value) < float("inf"), value)
            parts |= {f"_s{n}_{out}_{b}": part_in_bin(finite, b) for b in bins}
            sums[f"_s{n}_{out}"] = [f"_s{n}_{out}_{b}" for b in bins], bins.start
            if seen[f"endless_{out}"]:
                endless.add(f"{n}_{out}")
                parts[f"_p{n}_{out}"] = F.when(value == float("inf"), F.lit(1))
                parts[f"_m{n}_{out}"] = F.when(value == float("-inf"), F.lit(1))
        wanted |= {c: Running(F.col(c)) for c in parts}
        if layer.last_end:
            wanted[f"_e{n}"] = Running(F.col(f"_e{n}"), "max")
        if layer.first_start:
            wanted[f"_b{n}"] = Remaining(F.col(f"_b{n}"), "min")
        for at, sign in (("_start", 1), ("_end", -1)):
            columns = [(c * F.lit(sign)).alias(name) for name, c in parts.items()]
            columns.append((F.col("_end") if sign == 1 else F.lit(None)).cast(time).alias(f"_e{n}"))
            columns.append((F.col("_start") if sign == -1 else F.lit(None)).cast(time).alias(f"_b{n}"))
            moves.append(stored.select(*keys, F.col(at).alias(point), *columns, F.lit(0).alias("_kind")))
    timeline = df.withColumn("_kind", F.lit(1))
    for move in moves:
        timeline = timeline.unionByName(move, allowMissingColumns=True)
    if splits is not None and moved > rows_per_split(df.sparkSession):
        splits = find_splits(timeline, keys, point)  # starts and ends may fill an entity that its rows don't
    # at one time, starts and ends come before rows: a start at t counts at t, an end at t no longer does
    rows = scan(timeline, keys, [point, "_kind"], wanted, splits).filter(F.col("_kind") == 1)
    rows = with_totals(rows, {name: found for name, found in sums.items() if found[0]})
    outputs: list[Column] = []
    for n, layer in enumerate(layers):
        active = F.col(f"_n{n}") > 0
        for out in layer.averages:
            held = F.col(f"_k{n}_{out}")
            mean = (F.col(f"_s{n}_{out}") if sums[f"_s{n}_{out}"][0] else F.lit(0.0)) / held
            if f"{n}_{out}" in endless:
                up, down = F.col(f"_p{n}_{out}") > 0, F.col(f"_m{n}_{out}") > 0
                mean = F.when(up & down, float("nan")).when(up, float("inf")).when(down, float("-inf")).otherwise(mean)
            outputs.append(F.when(held > 0, mean).alias(out))
        if layer.count:
            outputs.append(F.when(active, F.col(f"_n{n}")).alias(layer.count))
        if layer.first_start:
            outputs.append(F.when(active, F.col(f"_b{n}")).alias(layer.first_start))
        if layer.last_end:
            outputs.append(F.when(active, F.col(f"_e{n}")).alias(layer.last_end))
    return rows.select(*df.columns, *outputs)


def sum_points_between(
    df: DataFrame,
    points: DataFrame,
    keys: list[str],
    value: str,
    at: str = "starttime",
    previous: str = "timer_prev",
    current: str = "timer",
    name: str | None = None,
    splits: Splits | None = None,
) -> DataFrame:
    """Per (keys, current): sum of `value` over points with previous <= at < current; NULL if there is none."""
    name = name or value
    windows = df.select(*keys, previous, current)
    wanted = points.select(*keys, F.col(at).alias("_at"), F.col(value).alias("_value"))
    pairs = stab_pairs(wanted, windows, keys, "_at", previous, current, splits=splits)
    sums = pairs.groupBy(*keys, current).agg(F.sum("_value").alias(name))
    return windows.select(*keys, current).distinct().join(sums, [*keys, current], "left")


def assign_to_interval(
    events: DataFrame,
    intervals: DataFrame,
    keys: list[str],
    point: str,
    start: str,
    end: str,
    splits: Splits | None = None,
) -> DataFrame:
    """Inner join of each event with the intervals of its entity that strictly hold its time."""
    return stab_pairs(events, intervals, keys, point, start, end, "neither", splits)
