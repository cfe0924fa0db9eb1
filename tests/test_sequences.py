import pytest

from chronoweave.operators import sequences, trajectories
from chronoweave.roles import Roles

ROLES = Roles(
    key="rn", id="id", target="y", time_vars=("t0", "t1"), target_mask="msk", timevarying=("g", "a"), intervention=("a",),
    static=("s",), counts=("n",),
)
LENGTHS = {1: 1, 2: 100, 3: 101, 4: 7}


@pytest.fixture(scope="module")
def rows(spark):
    data, rn = [], 0
    for k, length in LENGTHS.items():
        for t in range(length):
            data.append((rn, k, float(t), t + 1.0, t + 0.1, float(t % 3), 10.0 * k if t == 0 else -1.0, t + 1, float(t + 5),
                         float(t % 4 == 3), 0.0))
            rn += 1
    return spark.createDataFrame(
        data, "rn long, id long, t0 double, t1 double, g double, a double, s double, n int, y double, msk double, msk0 double"
    ).repartition(5)


def test_sequences(rows):
    out = {r.id: r for r in sequences.to_sequences(rows, ROLES).collect()}
    assert {k: r.seqlen for k, r in out.items()} == LENGTHS
    r = out[4]
    assert r.xt[2] == [2.1, 2.0, 3.0] and r.xi[2] == [2.0] and r.dt[2] == [2.0, 3.0] and r.y[2] == 7.0
    assert r.x0 == [40.0] and r.msk == [0, 0, 0, 1, 0, 0, 0] and r.key == list(range(202, 209))


def test_truncation_and_segments(rows, split_rows):
    assert {r.id: r.seqlen for r in sequences.to_sequences(rows, ROLES, max_len=100).collect()} == {**LENGTHS, 3: 100}
    split_rows(30)
    parts = sequences.to_sequences(rows, ROLES, segment=40).collect()
    for k, length in LENGTHS.items():
        own = sorted([r for r in parts if r.id == k], key=lambda r: r.seg)
        assert [r.seqlen for r in own] == [min(40, length - 40 * i) for i in range(-(-length // 40))]
        assert [t[0] for r in own for t in r.dt] == [float(t) for t in range(length)]
        assert {tuple(r.x0) for r in own} == {(10.0 * k,)}


@pytest.mark.parametrize("size", [2, 3, 128])
def test_pad_then_unpad_is_the_identity(rows, size):
    padded = sequences.pad_batches(sequences.to_sequences(rows, ROLES), ROLES, size)
    for batch in {r.batch for r in padded.collect()}:
        members = [r for r in padded.collect() if r.batch == batch]
        longest = max(r.seqlen for r in members)
        for r in members:
            assert len(r.xt) == len(r.y) == len(r.key) == len(r.msk) == len(r.dt) == longest
            assert r.key[r.seqlen:] == [-1] * (longest - r.seqlen) and r.msk[r.seqlen:] == [1] * (longest - r.seqlen)
            assert all(x == [0.0, 0.0, 0.0] for x in r.xt[r.seqlen:])
    back = sequences.unpad(padded, ["y"]).orderBy("key").collect()
    expected = rows.filter("msk = 0").orderBy("rn").collect()
    assert [(r.key, r.y) for r in back] == [(r.rn, r.y) for r in expected]


def test_no_static_columns(rows):
    roles = Roles(**{**ROLES.__dict__, "static": ()})
    assert all(r.x0 == [] for r in sequences.to_sequences(rows, roles).collect())


def test_time_grid_and_flatten(spark):
    df = spark.createDataFrame([(1, 0.0, 1.0), (1, 1.0, 3.0)], "id long, t0 double, t1 double")
    out = trajectories.time_grid(df, 2).orderBy("t0", "k").collect()
    assert [r.ts for r in out] == [0.0, 0.5, 1.0, 1.0, 2.0, 3.0]
    steps = spark.createDataFrame([(1, [[(1.0, 0.1), (2.0, 0.2)], [(3.0, 0.3)]])], "id long, steps array<array<struct<mu:double,sigma:double>>>")
    flat = trajectories.flatten_steps(steps).collect()
    assert [(r.step, r.k, r.mu, r.sigma) for r in flat] == [(0, 0, 1.0, 0.1), (0, 1, 2.0, 0.2), (1, 0, 3.0, 0.3)]


def test_observed_series_and_bands(spark):
    df = spark.createDataFrame([(1, 0.0, 1.0, 5.0, 6.0), (1, 1.0, 4.0, 6.0, 7.0)], "id long, t0 double, t1 double, x double, y double")
    out = trajectories.observed_series(df, "id", "x", "y", "t0", "t1").orderBy("k").collect()
    assert [(r.t, r.y) for r in out] == [(0.0, 5.0), (1.0, 6.0), (4.0, 7.0)]
    grid = spark.createDataFrame([(0.0, 0.0, 1.0), (24.0, 0.0, 1.0)], "ts double, mu double, sigma double")
    bands = trajectories.fan_bands(grid, ginv=lambda c: c).orderBy("band").collect()
    assert [r.level for r in bands] == pytest.approx([0.1, 0.565, 1.03, 1.495, 1.96])
    assert all(r.lower == -r.level and r.upper == r.level for r in bands)
