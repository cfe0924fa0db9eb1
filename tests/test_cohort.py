import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from chronoweave.operators import cohort, entities, features
from chronoweave.roles import Roles, load_roles, roles_from

SCHEMA = "stay_id long, timer long, glc double, glc_next double"


def table(spark, stays):
    """stays: id -> list of values; the target is the next value."""
    rows = []
    for k, values in stays.items():
        nexts = values[1:] + [None]
        rows += [(k, t, v, w) for t, (v, w) in enumerate(zip(values, nexts))]
    return spark.createDataFrame(rows, SCHEMA)


def result(df, *columns):
    return [tuple(r[c] for c in columns) for r in df.orderBy("stay_id", "timer").collect()]


@pytest.mark.parametrize("limit", [10**6, 2])
def test_trims(spark, split_rows, limit):
    split_rows(limit)
    df = table(spark, {1: [None, None], 2: [5.0], 3: [None, None, 7.0], 4: [None, 1.0, None, 2.0, None, None]})
    tail = cohort.trim_trailing(df)
    assert result(tail, "stay_id", "timer") == [(3, 0), (3, 1), (4, 0), (4, 1), (4, 2)]
    head = cohort.trim_leading(df)
    assert result(head, "stay_id", "timer", "n", "msk0", "sum_msk0") == [
        (2, 0, 1, 0.0, 0.0), (3, 2, 1, 0.0, 2.0), (4, 1, 1, 0.0, 1.0), (4, 2, 2, 1.0, 2.0), (4, 3, 3, 0.0, 2.0),
        (4, 4, 4, 1.0, 3.0), (4, 5, 5, 1.0, 4.0)]
    assert result(cohort.keep_min_readings(df), "stay_id")[0] == (4,)


@pytest.mark.parametrize("limit", [10**6, 2])
def test_interpolation_by_row(spark, split_rows, limit):
    split_rows(limit)
    df = table(spark, {1: [None, 1.0, None, None, 4.0, None], 2: [None, None, None, 5.0], 3: [None], 4: [2.0, None, 3.0]})
    out = cohort.interpolate_by_position(df)
    assert result(out, "glc") == [(x,) for x in [1.0, 1.0, 2.0, 3.0, 4.0, 4.0, None, 5.0, 5.0, 5.0, None, 2.0, 2.5, 3.0]]


def loop_trim(values):
    """Drop the last row while its target is missing; then rows before the first value."""
    rows = list(zip(values, values[1:] + [None]))
    while rows and rows[-1][1] is None:
        rows.pop()
    while rows and rows[0][0] is None:
        rows.pop(0)
    return [r[0] for r in rows]


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.lists(st.one_of(st.none(), st.integers(1, 9)), min_size=1, max_size=8), min_size=3, max_size=12))
def test_trims_match_the_loop_and_settle(spark, split_rows, stays):
    split_rows(3)
    stays = {k: [None if v is None else float(v) for v in values] for k, values in enumerate(stays)}
    once = cohort.trim_leading(cohort.trim_trailing(table(spark, stays)))
    expected = [(k, v) for k, values in stays.items() for v in loop_trim(values)]
    assert result(once, "stay_id", "glc") == expected
    again = cohort.trim_leading(cohort.trim_trailing(once.select(*once.columns)))
    assert result(again, "stay_id", "timer", "n") == result(once, "stay_id", "timer", "n")


def test_outliers_use_median_of_positives_before_replacement(spark):
    rows = [(v, None) for v in (0.0, -3.0, 1.0, 2.0, 60.0, 80.0)] + [(None, 51.0), (50.0, 50.0)]
    df = spark.createDataFrame(rows, "input_hrs double, other double")
    out = cohort.replace_outliers(df, ["input_hrs", "other"])
    assert sorted(r.input_hrs for r in out.collect() if r.input_hrs is not None) == [-3.0, 0.0, 1.0, 2.0, 50.0, 50.0, 50.0]
    assert sorted(r.other for r in out.collect() if r.other is not None) == [50.0, 50.5]


def test_histogram_closed_last_bin_and_single_value(spark):
    out = cohort.histogram(spark.createDataFrame([(float(x),) for x in range(11)], "v double"), "v", 5).orderBy("bin")
    assert [r.n for r in out.collect()] == [2, 2, 2, 2, 3]
    one = cohort.histogram(spark.createDataFrame([(3.0,), (None,)], "v double"), "v", 4).orderBy("bin").collect()
    assert [r.n for r in one] == [0, 0, 1, 0] and one[0].from_value == 2.5


def test_next_observed(spark):
    rows = [(1, 0.0, True, 1.0), (1, 1.0, False, 9.0), (1, 2.0, True, 2.0), (2, 0.0, False, 5.0)]
    out = cohort.next_observed(spark.createDataFrame(rows, "id long, t double, obs boolean, glucose_t_obs double"))
    got = [(r.glucose_t_obs_next, r.t1, r.n, r.msk) for r in out.orderBy("id", "t").collect()]
    assert got == [(2.0, 2.0, 1, 0), (None, None, None, None), (None, None, 2, 0), (None, None, None, None)]
    assert cohort.only_observed(out).count() == 1


def test_folds_are_contiguous_with_larger_first(spark):
    df = spark.createDataFrame([(i, j) for i in range(11) for j in range(2)], "stay_id long, x long")
    out = entities.fold_by_entity(df, 3)
    got = {r.stay_id: r.fold for r in out.collect()}
    assert [got[i] for i in range(11)] == [0, 0, 0, 0, 1, 1, 1, 1, 2, 2, 2] and out.count() == 22
    few = entities.fold_by_entity(df.filter("stay_id < 2"), 3).select("fold").distinct().collect()
    assert sorted(r.fold for r in few) == [0, 1]


def test_split_share_is_exact_and_repeatable(spark):
    df = spark.createDataFrame([(i, j) for i in range(23) for j in range(3)], "stay_id long, x long")
    a = entities.split_by_entity(df, 0.1, 5)
    b = entities.split_by_entity(df.repartition(3), 0.1, 5)
    held = {r.stay_id for r in a.filter("held_out").collect()}
    assert len(held) == 3 and held == {r.stay_id for r in b.filter("held_out").collect()} and a.count() == 69
    assert held.isdisjoint({r.stay_id for r in a.filter("not held_out").collect()})
    assert held != {r.stay_id for r in entities.split_by_entity(df, 0.1, 6).filter("held_out").collect()}


def test_sample_and_lists(spark):
    df = spark.createDataFrame([(i, j) for i in range(9) for j in range(4)], "stay_id long, x long")
    out = entities.sample_entities(df, 2)
    assert out.count() == 8 and out.select("stay_id").distinct().count() == 2
    ids = out.select("stay_id")
    assert entities.keep_entities(df, ids).count() == 8 and entities.drop_entities(df, ids).count() == 28
    assert [r.stay_id for r in entities.distinct_entities(df, "stay_id").collect()] == list(range(9))


ROLES = Roles(
    key="rn", id="stay_id", target="y", time_vars=("t0", "t1"), target_mask="msk", timevarying=("g", "a"),
    intervention=("a",), static=("s", "c", "m"), counts=("n",), features_divider={"a": 20.0},
)


def test_scaler(spark):
    rows = [(1.0, 140.0, 40.0, 1.0, 7.0, None), (0.0, 0.0, 20.0, 3.0, 7.0, None), (None, -1.0, None, None, 7.0, None)]
    df = spark.createDataFrame(rows, "y double, g double, a double, s double, c double, m double")
    stats = features.fit_scaler(df, ROLES)
    assert set(stats) == {"s", "c", "m"} and stats["s"] == (2.0, 1.0) and stats["c"] == (7.0, 1.0)
    out = features.apply_scaler(df, stats, ROLES).collect()
    assert [r.g for r in out] == [pytest.approx(0.0), 0.0, -1.0]  # only positive values are transformed
    assert [r.a for r in out] == [2.0, 1.0, None] and [r.s for r in out] == [-1.0, 1.0, 0.0]
    assert [r.c for r in out] == [0.0, 0.0, 0.0] and [r.m for r in out] == [0.0, 0.0, 0.0] and out[2].y is None


def test_lag_features(spark):
    df = spark.createDataFrame([(1, float(t), t + 0.5, float(t * t)) for t in range(4)], "id long, t0 double, t1 double, v double")
    out = features.lag_features(df, ["v"], "id", ("t0", "t1"), 2).orderBy("t0").collect()
    assert [(r.v_s1, r.v_s2, r.delta_t) for r in out] == [
        (None, None, 0.5), (0.0, None, 0.5), (1.0, 0.0, 0.5), (4.0, 1.0, 0.5)]


def test_roles_lookup(tmp_path):
    import json

    entry = {"key": "rn", "id": "id", "target": "y", "time_vars": ["t", "t1"], "target_mask": "msk",
             "timevarying": ["g", "a"], "intervention": ["a"], "static": [], "counts": ["n"], "features_divider": {"a": 2.0}}
    path = tmp_path / "roles.json"
    path.write_text(json.dumps({"simulation": {"features": entry}}))
    roles = load_roles(str(path), "simulation_5000_v0", "features")
    assert roles == roles_from(entry) and roles.model_inputs == ["g", "a", "n", "t", "t1"]
    assert roles.without_interventions().timevarying == ("g",) and roles.scaled == []
