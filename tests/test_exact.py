"""Doubles taken apart, sums without loss, medians by radix, and the joins and histograms built on measured stores."""

import math
import random
import statistics
import struct
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from chronoweave.functions.doubles import bins_between, from_ordered_bits, ordered_bits, part_in_bin, with_totals
from chronoweave.operators import quantiles
from chronoweave.operators.quantiles import PASSES, column_medians, exact_median
from chronoweave.operators.ranges import Layer, in_force, stab_pairs
from chronoweave.session import pin_measured

T0 = datetime(2024, 3, 1)


def anything(rng):
    kind = rng.random()
    if kind < 0.4:
        return struct.unpack("<d", struct.pack("<Q", rng.getrandbits(64)))[0]
    if kind < 0.6:
        return rng.choice([0.0, -0.0, 5e-324, 2.0**-1022, 2.0**-1022 - 5e-324, 1.7976931348623157e308, float("inf")]) * rng.choice([1, -1])
    return rng.gauss(0, 1) * 10.0 ** rng.randint(-30, 30)


def powers():
    return [s * 2.0**e * f for e in range(-1074, 1024) for s in (1, -1) for f in (1.0, 1 - 2**-53, 1 + 2**-52)]


def test_bits_order_as_doubles_and_come_back(spark):
    rng = random.Random(1)
    data = [v for v in [anything(rng) for _ in range(5000)] + powers() if not math.isnan(v)]
    df = spark.createDataFrame([(v,) for v in data], "v double")
    got = df.select("v", ordered_bits(F.col("v")).alias("b"), from_ordered_bits(ordered_bits(F.col("v"))).alias("w")).collect()
    for r in got:
        (bits,) = struct.unpack("<Q", struct.pack("<d", abs(r.v)))
        assert r.b == (-bits - 1 if r.v < 0 else bits) and r.w == r.v
    ranked = sorted(got, key=lambda r: r.b)
    assert all(x.v <= y.v for x, y in zip(ranked, ranked[1:]))
    odd = spark.sql("select double('nan') as v union all select cast(null as double)").select("v", ordered_bits(F.col("v")).alias("b")).collect()
    assert {r.b is None for r in odd} == {True, False} and max(r.b or 0 for r in odd) > max(r.b for r in got)


def totals(spark, groups):
    rows = [(g, v) for g, vs in enumerate(groups) for v in vs]
    sizes = [abs(v) for _, v in rows if v]
    bins = bins_between(min(sizes), max(sizes))
    df = spark.createDataFrame(rows, "g long, v double")
    names = [f"b{b}" for b in bins]
    summed = df.groupBy("g").agg(*[F.sum(part_in_bin(F.col("v"), b)).alias(n) for b, n in zip(bins, names)])
    return {r.g: r.total for r in with_totals(summed, {"total": (names, bins.start)}).collect()}


@pytest.mark.parametrize("kind", ["plain", "wide", "halves", "small", "large"])
def test_sums_are_the_nearest_double(spark, kind):
    rng = random.Random(2)
    groups = []
    for _ in range(120):
        n = rng.randint(1, 12)
        if kind == "plain":
            vs = [round(rng.uniform(-50, 500), 3) for _ in range(n)]
        elif kind == "wide":
            vs = [rng.choice([1, -1]) * rng.random() * 10.0 ** rng.randint(-60, 60) for _ in range(n)]
        elif kind == "halves":  # ties of rounding, and ties broken far below
            big = float(2 ** rng.randint(53, 60) + 2 * rng.randint(0, 1000))
            vs = [big, big * 2.0**-53, rng.choice([0.0, 2.0**-200, -(2.0**-200)])] * rng.choice([1, -1])
            vs = [rng.choice([1, -1]) * x for x in vs] if vs else [big]
        elif kind == "small":
            vs = [rng.choice([1, -1]) * 5e-324 * rng.randint(1, 1 << 54) for _ in range(n)]
        else:
            vs = [rng.uniform(-1, 1) * 2.0**1000 for _ in range(n)]
        groups.append(vs)
    groups.append([1e20, 1e-19, -1e20])
    groups[-1] = groups[-1] if kind == "wide" else [1.0, -1.0]
    if kind in ("small", "large"):
        groups[-1] = [groups[0][0], -groups[0][0]]
    got = totals(spark, groups)
    assert [got[g] for g in range(len(groups))] == [math.fsum(vs) for vs in groups]


def line(spark, intervals, n=60):
    points = spark.createDataFrame([(1, T0 + timedelta(seconds=s)) for s in range(n)], "k long, timer timestamp_ntz")
    rows = [(1, T0 + timedelta(seconds=a), T0 + timedelta(seconds=b), v) for a, b, v in intervals]
    return points, spark.createDataFrame(rows, "k long, starttime timestamp_ntz, endtime timestamp_ntz, v double")


@pytest.mark.parametrize("kind", ["small", "large", "mixed", "plain"])
def test_averages_in_force_lose_nothing(spark, split_rows, kind):
    rng = random.Random(3)
    value = {
        "small": lambda: 1e-19 * rng.randint(1, 9), "large": lambda: 1e20 * rng.random(), "plain": lambda: round(rng.random() * 90, 2),
        "mixed": lambda: rng.choice([1e-19, 1e20, 3.7, -1e20, -2.5e-300]),
    }[kind]
    intervals = [(a, a + rng.randint(1, 30), value()) for a in (rng.randint(0, 55) for _ in range(80))]
    points, rows = line(spark, intervals)
    found = []
    for limit in (10**6, 9):
        split_rows(limit)
        out = in_force(points, ["k"], "timer", [Layer(rows, averages={"rate": "v"}, count="n")])
        assert "decimal" not in out._jdf.queryExecution().toString().lower()
        found.append({r.timer: (r.rate, r.n) for r in out.collect()})
    assert found[0] == found[1] and len(found[0]) == 60
    for s in range(60):
        held = [v for a, b, v in intervals if a <= s < b]
        assert found[0][T0 + timedelta(seconds=s)] == ((math.fsum(held) / len(held), len(held)) if held else (None, None))


def test_infinite_missing_and_no_values(spark):
    inf, nan = float("inf"), float("nan")
    points, rows = line(spark, [(0, 5, inf), (3, 6, -inf), (5, 8, 2.0), (8, 10, nan), (10, 12, None), (11, 12, 0.0)], 13)
    out = {r.timer: r.rate for r in in_force(points, ["k"], "timer", [Layer(rows, averages={"rate": "v"})]).collect()}
    got = [out[T0 + timedelta(seconds=s)] for s in range(13)]
    assert got[:3] == [inf] * 3 and all(math.isnan(x) for x in got[3:5]) and got[5] == -inf
    assert got[6:] == [2.0, 2.0, None, None, None, 0.0, None]
    none = in_force(points, ["k"], "timer", [Layer(rows.where("false"), averages={"rate": "v"}, count="n")])
    assert {(r.rate, r.n) for r in none.collect()} == {(None, None)}


@pytest.mark.parametrize("rows", [5, 1000])
def test_medians_of_any_doubles(spark, rows):
    rng = random.Random(5)
    data = [(g, v) for g in range(6) for v in [anything(rng) for _ in range(41 + g)] if not math.isnan(v)]
    data += [(7, 0.25)] * 500 + [(8, -1.0 * i) for i in range(301)] + [(9, 1e-310)] * 3 + [(10, None)] * 40
    df = spark.createDataFrame(data, "g long, v double").repartition(6)
    got = {r.g: r["median"] for r in exact_median(df, ["g"], "v", rows=rows).collect()}
    for g in {g for g, _ in data}:
        values = sorted(v for k, v in data if k == g and v is not None)
        if not values:
            assert got[g] is None
            continue
        low, high = values[(len(values) - 1) // 2], values[len(values) // 2]
        wanted = {low, low * 0.5 + high * 0.5} if low == high else {low * 0.5 + high * 0.5}
        assert got[g] in wanted or math.isnan(got[g])
    whole = [v for _, v in data if v is not None and abs(v) < 1e300]
    one = exact_median(df.where("abs(v) < 1e300"), [], "v", rows=rows).collect()
    assert len(one) == 1 and one[0][0] == pytest.approx(statistics.median(whole))


def jobs(spark, name):
    return len(spark.sparkContext.statusTracker().getJobIdsForGroup(name))


def test_passes_do_not_depend_on_the_data(spark):
    counts = []
    for spread in (3, 10**9):
        df = spark.range(3000).selectExpr("id % 2 as g", f"cast(id * 7919 % {spread} as double) / 7 as v")
        spark.sparkContext.setJobGroup(f"median{spread}", "")
        exact_median(df, ["g"], "v", rows=20)
        counts.append(jobs(spark, f"median{spread}"))
    spark.sparkContext.setJobGroup("", "")
    assert PASSES == 4 and counts[0] == counts[1]


def test_few_values_are_taken_apart(spark, monkeypatch):
    """Bits are worked out for what lies around the median, not for all rows in each pass."""
    apart, real = spark.sparkContext.accumulator(0), quantiles.ordered_bits
    monkeypatch.setattr(quantiles, "ordered_bits", lambda v: real(F.udf(lambda x: (apart.add(1), x)[1], "double")(v)))
    df = spark.range(40_000).selectExpr("id % 2 as g", "cast(id * 7919 % 40000 as double) / 8 as v")
    got = {r.g: r["median"] for r in exact_median(df, ["g"], "v", rows=500).collect()}
    assert got == {0: 19999 / 8, 1: 20000 / 8 + 0.0} and 0 < apart.value < 4000


@pytest.mark.parametrize("wrong", [F.min, F.max])
def test_medians_do_not_rest_on_the_sketch(spark, monkeypatch, wrong):
    nan, inf = float("nan"), float("inf")
    data = [(0, v) for v in [*range(40), None, -inf, inf]] + [(1, v) for v in [nan] * 30 + [1.0] * 20] + [(2, v) for v in [-0.0, 0.0] * 20 + [inf] * 41]
    df = spark.createDataFrame([(g, v if v is None else float(v)) for g, v in data], "g long, v double")
    expected = {0: 19.5, 1: "nan", 2: inf}
    for _ in range(2):
        got = {r.g: "nan" if math.isnan(r["median"]) else r["median"] for r in exact_median(df, ["g"], "v", rows=20).collect()}
        assert got == expected
        monkeypatch.setattr(quantiles.F, "percentile_approx", lambda v, *a: F.array(wrong(v), wrong(v)))


def test_column_medians_with_nothing(spark):
    df = spark.createDataFrame([(None, 1.0), (None, 2.0)], "a double, b double")
    for rows in (1, 100):
        assert column_medians(df, ["a", "b"], rows) == {"a": None, "b": 1.5}
    assert column_medians(df.where("false"), ["a"]) == {"a": None}


def test_pairs_start_no_job_and_copy_points_for_their_own_classes(spark):
    points = spark.range(2000).selectExpr("id % 100 as k", "timestamp_ntz'2024-01-01' + make_dt_interval(0, 0, 0, id * 37) as timer")
    # every entity has intervals of one size; together they have six sizes
    size = "pow(16, 3 + k % 6) / 1000"
    spans = spark.range(100).selectExpr("id as k").selectExpr("k", "timestamp_ntz'2024-01-01' as starttime", f"timestamp_ntz'2024-01-01' + make_dt_interval(0, 0, 0, {size}) as endtime")
    spark.sparkContext.setJobGroup("pairs", "")
    out = stab_pairs(points, spans, ["k"])
    assert jobs(spark, "pairs") == 0
    spark.sparkContext.setJobGroup("", "")
    expected = points.join(spans, "k").where("timer >= starttime and timer < endtime").count()
    assert out.count() == expected
    assert copies(out) <= 2 * 2000


def copies(df):
    """The rows that came out of the points' explode, as the executed plan counted them."""
    df.collect()
    plan, most = df._jdf.queryExecution().executedPlan(), []

    def walk(node):
        name = node.nodeName()
        if name == "AdaptiveSparkPlan":
            return walk(node.executedPlan())
        if name.startswith(("ShuffleQueryStage", "BroadcastQueryStage")):
            return walk(node.plan())
        if name == "Generate" and "array_compact" in node.toString().split("\n")[0] + node.verboseStringWithOperatorId():
            most.append(node.metrics().apply("numOutputRows").value())
        children = node.children()
        for i in range(children.size()):
            walk(children.apply(i))

    walk(plan)
    return max(most, default=0)


@pytest.mark.parametrize("rows", [7, 10**6])
def test_full_stretches_are_shared_out(spark, split_rows, rows):
    split_rows(rows)
    points = spark.range(300).selectExpr("1 as k", "timestamp_ntz'2024-01-01' + make_dt_interval(0, 0, 0, if(id < 200, 30, id)) as timer", "id as p")
    spans = spark.range(20).selectExpr("1 as k", "timestamp_ntz'2024-01-01' + make_dt_interval(0, 0, 0, id * 13) as starttime", "timestamp_ntz'2024-01-01' + make_dt_interval(0, 0, 0, id * 13 + 40) as endtime", "id as i")
    got = sorted((r.p, r.i) for r in stab_pairs(points, spans, ["k"]).collect())
    want = points.join(spans, "k").where("timer >= starttime and timer < endtime").collect()
    assert got == sorted((r.p, r.i) for r in want)


def test_measures_come_with_the_write(spark):
    spark.sparkContext.setJobGroup("measured", "")
    stored, seen = pin_measured(spark.range(100).selectExpr("id", "id / 2 as v"), n=F.count(F.lit(1)), low=F.min("v"), high=F.max("v"))
    assert jobs(spark, "measured") == 1 and seen == {"n": 100, "low": 0.0, "high": 49.5} and stored.count() == 100
    spark.sparkContext.setJobGroup("", "")
    _, seen = pin_measured(spark.range(0).selectExpr("id"), n=F.count(F.lit(1)), low=F.min("id"))
    assert seen == {"n": 0, "low": None}
    _, seen = pin_measured(spark.createDataFrame([], "id long").groupBy("id").count(), n=F.count(F.lit(1)))
    assert seen == {"n": 0}
