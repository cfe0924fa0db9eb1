import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from chronoweave.operators.ranges import (
    Layer,
    assign_to_interval,
    in_force,
    stab_intervals,
    stab_pairs,
    sum_points_between,
)

T0 = datetime(2024, 3, 1)


def at(seconds):
    return None if seconds is None else T0 + timedelta(seconds=seconds)


def data(seed):
    rng = random.Random(seed)
    points = list({(rng.choice([1, 1, 1, 2, 3]), rng.randint(0, 4000)) for _ in range(150)})
    intervals = []
    for i in range(80):
        start = rng.randint(0, 4000)
        length = rng.choice([0, -5, 1, 30, 600, 3600, 90000])
        end = None if rng.random() < 0.05 else start + length
        intervals.append((rng.choice([1, 1, 2, 4]), start, end, rng.choice([None, rng.random() * 10]), i))
    # touching intervals, and points exactly on their ends
    intervals += [(3, 100, 200, 1.5, 900), (3, 200, 300, 2.5, 901)]
    points = list({*points, (3, 100), (3, 200), (3, 300)})
    return points, intervals


def frames(spark, points, intervals):
    p = spark.createDataFrame([(k, at(t)) for k, t in points], "k long, timer timestamp_ntz")
    i = spark.createDataFrame(
        [(k, at(a), at(b), v, n) for k, a, b, v, n in intervals],
        "k long, starttime timestamp_ntz, endtime timestamp_ntz, v double, n long",
    )
    return p, i


@pytest.mark.parametrize("limit", [10**6, 20])
@pytest.mark.parametrize("seed", [1, 2])
def test_pairs_match_nested_loops(spark, split_rows, seed, limit):
    split_rows(limit)
    points, intervals = data(seed)
    p, i = frames(spark, points, intervals)
    got = sorted((r.k, r.timer, r.n) for r in stab_pairs(p, i, ["k"]).collect())
    loops = [(k, at(t), n) for k, t in points for k2, a, b, _, n in intervals if k == k2 and b is not None and a <= t < b]
    assert got == sorted(loops)
    strict = sorted((r.k, r.timer, r.n) for r in assign_to_interval(p, i, ["k"], "timer", "starttime", "endtime").collect())
    loops = [(k, at(t), n) for k, t in points for k2, a, b, _, n in intervals if k == k2 and b is not None and a < t < b]
    assert strict == sorted(loops)


@pytest.mark.parametrize("limit", [10**6, 20])
def test_sweep_equals_pairs(spark, split_rows, limit):
    split_rows(limit)
    points, intervals = data(5)
    p, i = frames(spark, points, intervals)
    layer = Layer(i, averages={"rate": "v"}, count="n_in", first_start="a", last_end="b")
    swept = in_force(p, ["k"], "timer", [layer])
    aggs = {"rate": F.avg("v"), "n_in": F.count(F.lit(1)), "a": F.min("starttime"), "b": F.max("endtime")}
    joined = stab_intervals(p, i, ["k"], aggs=aggs)

    def rows(df):
        return sorted((r.k, r.timer, r.n_in, r.a, r.b, None if r.rate is None else round(r.rate, 9)) for r in df.collect())

    assert str(rows(swept)) == str(rows(joined)) and len(rows(swept)) == len(points)


def test_two_layers_do_not_mix(spark):
    p, i = frames(spark, [(1, 50)], [(1, 0, 100, 2.0, 1), (1, 40, 60, 4.0, 2)])
    j = i.filter("n = 2")
    out = in_force(p, ["k"], "timer", [Layer(i, averages={"x": "v"}), Layer(j, averages={"y": "v"}, count="c")]).first()
    assert (out.x, out.y, out.c) == (3.0, 4.0, 1)


def test_rows_repeat_per_interval_and_stay_without(spark):
    p, i = frames(spark, [(1, 50), (1, 500)], [(1, 0, 100, 2.0, 1), (1, 40, 60, 4.0, 2)])
    out = stab_intervals(p, i, ["k"]).orderBy("timer", "n").collect()
    assert [(r.timer, r.n) for r in out] == [(at(50), 1), (at(50), 2), (at(500), None)]


def test_points_between(spark, split_rows):
    for limit in (10**6, 2):
        split_rows(limit)
        rows = [(1, at(0), at(10)), (1, at(10), at(20)), (1, None, at(0)), (2, at(0), at(10)), (1, at(20), at(20))]
        df = spark.createDataFrame(rows, "k long, timer_prev timestamp_ntz, timer timestamp_ntz")
        doses = [(1, at(0), 1.0), (1, at(9), 2.0), (1, at(10), 4.0), (1, at(20), 8.0), (3, at(5), 16.0)]
        points = spark.createDataFrame(doses, "k long, starttime timestamp_ntz, dose double")
        out = sum_points_between(df, points, ["k"], "dose").orderBy("k", "timer").collect()
        assert [(r.k, r.timer, r.dose) for r in out] == [
            (1, at(0), None), (1, at(10), 3.0), (1, at(20), 4.0), (2, at(10), None)
        ]


def test_sums_cancel_exactly(spark):
    many = [(1, i, i + 1, 0.1 + i * 1e-7, i) for i in range(300)]
    p, i = frames(spark, [(1, 299)], many)
    out = in_force(p, ["k"], "timer", [Layer(i, averages={"rate": "v"})]).first()
    assert out.rate == 0.1 + 299 * 1e-7


def test_pairs_do_not_depend_on_the_zone_of_the_session(spark):
    points = spark.sql("select 1 as k, timestamp_ntz'2024-03-10 02:45:00' as timer")
    rows = spark.sql("select 1 as k, timestamp_ntz'2024-03-10 02:30:00' as starttime, timestamp_ntz'2024-03-10 03:00:00' as endtime, 7 as v")
    zone = spark.conf.get("spark.sql.session.timeZone")
    try:
        for name in ("UTC", "America/New_York", "Europe/Berlin"):
            spark.conf.set("spark.sql.session.timeZone", name)
            assert stab_pairs(points, rows, ["k"]).count() == 1
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
