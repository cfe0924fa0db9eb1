"""Parts and seams, scans, row numbers and medians against plain Python."""

import random
import statistics

import pytest
from pyspark.sql import functions as F

from chronoweave.operators.ordered import (
    LastSeen,
    NextSeen,
    Remaining,
    Running,
    Whole,
    add_row_id,
    scan,
    with_neighbours,
)
from chronoweave.operators.quantiles import column_medians, exact_median
from chronoweave.operators.splits import PART, find_splits
from chronoweave.session import pin


def skewed(seed=0, n=400):
    """One entity holds most rows; times repeat; values are missing at random."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        key = 1 if rng.random() < 0.7 else rng.randint(2, 9)
        rows.append((key, rng.randint(0, 60) if rng.random() < 0.8 else 30, i, rng.choice([None, rng.randint(0, 99)])))
    return rows


@pytest.mark.parametrize("limit", [10**6, 60, 13, 3])
def test_neighbours_match_plain_windows(spark, split_rows, limit):
    rows = skewed(limit)
    split_rows(limit)
    df = spark.createDataFrame(rows, "k long, t long, i long, v long")
    out = with_neighbours(
        df, ["k"], ["t", "i"], 3,
        lambda w: {"a": F.lag("i", 3).over(w), "b": F.lag("v", 1).over(w), "c": F.lead("i", 2).over(w)},
    )
    got = {(r.k, r.t, r.i): (r.a, r.b, r.c) for r in out.collect()}
    assert len(got) == len(rows) and set(out.columns) == {"k", "t", "i", "v", "a", "b", "c"}
    for key in {r[0] for r in rows}:
        own = sorted([r for r in rows if r[0] == key], key=lambda r: (r[1], r[2]))
        for n, r in enumerate(own):
            expected = (
                own[n - 3][2] if n >= 3 else None,
                own[n - 1][3] if n >= 1 else None,
                own[n + 2][2] if n + 2 < len(own) else None,
            )
            assert got[(r[0], r[1], r[2])] == expected


@pytest.mark.parametrize("limit", [10**6, 60, 13, 3])
def test_scan_matches_plain_loops(spark, split_rows, limit):
    rows = skewed(limit + 1)
    split_rows(limit)
    df = spark.createDataFrame(rows, "k long, t long, i long, v long")
    out = scan(
        df, ["k"], ["t", "i"],
        {
            "n": Running(F.lit(1)), "total": Running(F.col("v")), "high": Running(F.col("v"), "max"),
            "low_ahead": Remaining(F.col("v"), "min"), "last": LastSeen(F.col("v")), "next": NextSeen(F.col("v")),
            "all": Whole("sum", F.lit(1)), "top": Whole("max", F.col("v")),
        },
    )
    got = {r.i: r for r in out.collect()}
    for key in {r[0] for r in rows}:
        own = sorted([r for r in rows if r[0] == key], key=lambda r: (r[1], r[2]))
        for n, r in enumerate(own):
            seen = [x[3] for x in own[: n + 1] if x[3] is not None]
            ahead = [x[3] for x in own[n:] if x[3] is not None]
            everything = [x[3] for x in own if x[3] is not None]
            g = got[r[2]]
            assert (g.n, g["all"]) == (n + 1, len(own))
            assert g.total == (sum(seen) if seen else None) and g.high == max(seen, default=None)
            assert g.last == (seen[-1] if seen else None) and g.next == (ahead[0] if ahead else None)
            assert g.low_ahead == min(ahead, default=None) and g.top == max(everything, default=None)


def test_parts_are_consecutive_and_even(spark):
    df = spark.range(1000).selectExpr("id % 2 * 0 as k", "cast(id as double) as t")
    splits = find_splits(df, ["k"], "t", rows=100)
    parts = splits.tag(df).groupBy(PART).agg(F.count(F.lit(1)).alias("n"), F.min("t").alias("a"), F.max("t").alias("b"))
    rows = sorted(parts.collect())
    assert len(rows) == 10 and max(r.n for r in rows) <= 130
    assert all(x.b < y.a for x, y in zip(rows, rows[1:]))


@pytest.mark.parametrize("time", ["5.0d", "cast(null as double)", "if(id % 5 = 0, cast(null as double), if(id < 300, 5.0d, id))"])
def test_one_time_of_many_rows_is_cut_by_rank(spark, split_rows, time):
    split_rows(40)
    df = spark.range(400).selectExpr("1 as k", f"{time} as t", "id * 7919 % 400 as i").repartition(5)
    splits = find_splits(df, ["k"], "t", rows=40)
    parts = splits.tag(df, [F.col("i")]).groupBy(PART)
    first = F.min(F.struct(F.col("t").isNotNull(), "t", "i"))
    last = F.max(F.struct(F.col("t").isNotNull(), "t", "i"))
    found = parts.agg(F.count(F.lit(1)).alias("n"), first.alias("a"), last.alias("b")).orderBy(PART).collect()

    def place(s):
        return tuple(-1 if x is None else x for x in s)

    assert max(r.n for r in found) <= 80 and len(found) >= 8
    assert all(place(x.b) < place(y.a) for x, y in zip(found, found[1:]))
    out = scan(df, ["k"], ["t", "i"], {"n": Running(F.lit(1)), "last": LastSeen(F.col("i"))}).orderBy("n").collect()
    order = sorted(((r.t is not None, r.t or 0, r.i) for r in out))
    assert [(r.t is not None, r.t or 0, r.i) for r in out] == order and [r.n for r in out] == list(range(1, 401))
    near = with_neighbours(df, ["k"], ["t", "i"], 2, lambda w: {"up": F.lead("i", 2).over(w), "down": F.lag("i").over(w)}).collect()
    rows = [i for _, _, i in order]
    at = {i: n for n, i in enumerate(rows)}
    for r in near:
        n = at[r.i]
        assert r.up == (rows[n + 2] if n + 2 < 400 else None) and r.down == (rows[n - 1] if n else None)


def test_null_keys_are_cut_too(spark, split_rows):
    split_rows(5)
    df = spark.range(40).selectExpr("cast(null as long) as k", "id as t")
    out = scan(df, ["k"], ["t"], {"n": Running(F.lit(1))})
    assert sorted((r.t, r.n) for r in out.collect()) == [(i, i + 1) for i in range(40)]


def test_parts_of_one_entity_spread_over_tasks(spark, split_rows):
    split_rows(100)
    df = spark.range(4000).selectExpr("1L as k", "id as t").repartition(1)
    whole = scan(df, ["k"], ["t"], {"n": Running(F.lit(1))}, find_splits(df, ["k"], "t", 10**9))
    cut = scan(whole, ["k"], ["t"], {"m": Running(F.lit(1))})
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        used = cut.select(F.spark_partition_id().alias("p")).distinct().count()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert used > 1 and cut.filter("n <> m").count() == 0


def test_row_id_is_gap_free_and_ordered(spark):
    rows = [(i * 7919 % 1000, i) for i in range(1000)]
    df = spark.createDataFrame(rows, "a long, b long").repartition(7)
    out = add_row_id(df, ["a", "b"])
    assert [r.rn for r in out.orderBy("a", "b").collect()] == list(range(1000))


@pytest.mark.parametrize("rows", [10**6, 50, 5])
def test_exact_median_per_group(spark, rows):
    rng = random.Random(rows)
    data = [("a", rng.gauss(0, 1)) for _ in range(301)] + [("b", float(rng.randint(0, 3))) for _ in range(400)]
    data += [("c", 1.0), ("c", 2.0), ("d", None), ("e", 5.0)] + [(None, float(i)) for i in range(120)]
    out = exact_median(spark.createDataFrame(data, "g string, v double"), ["g"], "v", rows=rows)
    got = {r.g: r["median"] for r in out.collect()}
    groups = {g for g, _ in data}
    expected = {}
    for g in groups:
        values = [v for k, v in data if k == g and v is not None]
        expected[g] = statistics.median(values) if values else None
    assert got.keys() == expected.keys()
    assert all(got[g] == pytest.approx(expected[g]) if expected[g] is not None else got[g] is None for g in groups)


@pytest.mark.parametrize("rows", [10**6, 20])
def test_column_medians(spark, rows):
    rng = random.Random(3)
    data = [(rng.random(), float(i % 5) if i % 3 else None) for i in range(200)]
    got = column_medians(spark.createDataFrame(data, "a double, b double"), ["a", "b"], rows)
    assert got["a"] == pytest.approx(statistics.median(x for x, _ in data))
    assert got["b"] == pytest.approx(statistics.median(x for _, x in data if x is not None))


def test_pin_reads_back_the_same(spark):
    df = spark.range(10).selectExpr("id", "array(cast(id as double)) as v", "timestamp_ntz'2024-01-01 00:00:00' as t")
    back = pin(df)
    assert back.dtypes == df.dtypes
    assert sorted(back.collect()) == sorted(df.collect())


def test_row_id_splits_rows_of_one_order(spark):
    df = spark.range(2000).selectExpr("1 as a", "id as b", "map('k', id) as m", "id as `c.d`").repartition(4)
    out = add_row_id(df, ["a"])
    assert sorted(r.rn for r in out.select("rn").collect()) == list(range(2000))
    assert out.columns == ["a", "b", "m", "c.d", "rn"]
