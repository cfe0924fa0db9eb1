from datetime import datetime, timedelta

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from chronoweave.operators.pairing import flag_repeated, pair_events

T0 = datetime(2024, 1, 1)
SCHEMA = (
    "hadm_id long, stay_id long, timer timestamp_ntz, glctimer timestamp_ntz, glc double, glcsource string, "
    "starttime timestamp_ntz, endtime timestamp_ntz, input double, input_hrs double, insulintype string, event string"
)


def at(minutes):
    return T0 + timedelta(seconds=round(minutes * 60))


def reading(minutes, glc, source="fingerstick", adm=1, stay=1):
    return (adm, stay, at(minutes), at(minutes), float(glc), source, None, None, None, None, None, None)


def dose(minutes, event="BOLUS_PUSH", kind="Short", adm=1, stay=1, end=None):
    last = None if end is None else at(end)
    return (adm, stay, at(minutes), None, None, None, at(minutes), last, 1.0, None, kind, event)


def pairs(spark, rows, **options):
    out = pair_events(spark.createDataFrame(rows, SCHEMA), **options).filter("event is not null").orderBy("timer")
    return [
        (r.glc_al, None if r.glctimer_al is None else (r.glctimer_al - T0).total_seconds() / 60, r.glcsource_al, r.rule)
        for r in out.collect()
    ]


CASES = {
    "clause 1: nearer and higher reading before": (
        [reading(0, 150), dose(10), reading(40, 120)], [(150.0, 0.0, "FINGERSTICK", 1)]),
    "clause 1: equal gaps and equal values": (
        [reading(0, 120), dose(30), reading(60, 120)], [(120.0, 0.0, "FINGERSTICK", 1)]),
    "clause 2: nearer and higher reading after": (
        [reading(0, 100), dose(40), reading(50, 180, "blood")], [(180.0, 50.0, "BLOOD", 3)]),
    "clause 2 without the fast type: no rule, then clause 7's": (
        [reading(0, 100), dose(40, kind="Long"), reading(50, 180)], [(180.0, 50.0, "FINGERSTICK", 1)]),
    "clause 3 cannot hold: a reading carries no type; falls through": (
        [reading(0, 200), dose(10), dose(20), reading(60, 100)],
        [(200.0, 0.0, "FINGERSTICK", 4), (None, None, None, None)]),
    "clause 4 for the second dose (clause 6 gives the first its value)": (
        [reading(0, 100), dose(60), dose(70), reading(80, 180)],
        [(180.0, 80.0, "FINGERSTICK", 1), (180.0, 80.0, "FINGERSTICK", 4)]),
    "clause 5: reading before, dose after, reading after that": (
        [reading(0, 200), dose(10), dose(30), reading(95, 150)],
        [(200.0, 0.0, "FINGERSTICK", 4), (None, None, None, None)]),
    "clause 6: value and time from the later reading, source and rule from clause 7": (
        [reading(0, 100), dose(60), dose(65), reading(90, 180)],
        [(180.0, 90.0, "FINGERSTICK", 1), (180.0, 90.0, "FINGERSTICK", 4)]),
    "clause 7: only a reading before": ([reading(0, 100), dose(10)], [(100.0, 0.0, "FINGERSTICK", 1)]),
    "clause 8: nothing near before, a reading near after": (
        [reading(0, 100), dose(200), reading(210, 130)], [(130.0, 210.0, "FINGERSTICK", 2)]),
    "value exactly at the floor": ([reading(0, 90), dose(10)], [(90.0, 0.0, "FINGERSTICK", 1)]),
    "value under the floor": ([reading(0, 89.9), dose(10)], [(None, None, None, None)]),
    "90 min 59 s counts as 90": ([reading(0, 100), dose(90 + 59 / 60)], [(100.0, 0.0, "FINGERSTICK", 1)]),
    "91 min is too far": ([reading(0, 100), dose(91)], [(None, None, None, None)]),
    "equal times: the reading comes first": ([dose(10), reading(10, 100)], [(100.0, 10.0, "FINGERSTICK", 1)]),
    "no neighbour": ([dose(0)], [(None, None, None, None)]),
    "lower-case event and unknown source": (
        [reading(0, 100, "other"), dose(10, event="bolus_push")], [(None, None, None, None)]),
}


@pytest.mark.parametrize("name", CASES)
def test_clause(spark, name):
    rows, expected = CASES[name]
    assert pairs(spark, rows) == expected


def test_consistent_sixth_clause(spark):
    rows = [reading(0, 100), dose(60), dose(65), reading(90, 180)]
    assert pairs(spark, rows, strict_reference=False)[0] == (180.0, 90.0, "FINGERSTICK", 4)


def test_neighbours_cross_stays_but_not_admissions(spark):
    rows = [reading(0, 100, stay=1), dose(10, stay=2), reading(5, 300, adm=2, stay=9)]
    assert pairs(spark, rows) == [(100.0, 0.0, "FINGERSTICK", 1)]


def test_repeated_flag(spark):
    rows = [reading(0, 150), dose(10, event="INFUSION", end=30), reading(20, 160), reading(60, 100)]
    rows += [reading(500, 100), dose(600, event="INFUSION", end=700), reading(610, 180)]
    out = flag_repeated(pair_events(spark.createDataFrame(rows, SCHEMA))).orderBy("timer").collect()
    # the first dose took the reading before it, the second (which has an end) the reading after it
    assert [r.repeated for r in out] == [1, None, None, None, None, None, 1]


def by_hand(rows, tolerance=90):
    """Row-at-a-time form of the rules, for one admission with distinct times."""
    rows = sorted(rows, key=lambda r: r[2])

    def get(n):
        return rows[n] if 0 <= n < len(rows) else None

    def is_reading(r):
        return r is not None and r[5] is not None

    def is_dose(r):
        return r is not None and r[11] is not None

    out = []
    for n, cur in enumerate(rows):
        if not is_dose(cur):
            continue
        p2, p1, n1, n2 = get(n - 2), get(n - 1), get(n + 1), get(n + 2)

        def gap(r):
            return int(abs((r[2] - cur[2]).total_seconds()) // 60)

        def first(a, b):
            return gap(a) <= gap(b) and gap(a) <= tolerance and a[4] >= 90 and a[4] >= b[4]

        def second(a, b):
            return gap(a) > gap(b) and gap(a) <= tolerance and gap(b) <= tolerance and b[4] >= 90 and a[4] < b[4]

        value = rule = None
        if is_reading(p1) and is_reading(n1) and first(p1, n1):
            value, rule = p1, 1
        elif is_reading(p1) and is_reading(n1) and second(p1, n1):
            value, rule = n1, 3
        elif is_reading(p2) and is_dose(p1) and is_reading(n1) and second(p2, n1):
            value, rule = n1, 4
        elif is_reading(p1) and is_dose(n1) and is_reading(n2) and first(p1, n2):
            value, rule = p1, 4
        elif is_reading(p1) and is_dose(n1) and is_reading(n2) and second(p1, n2):
            value, rule = n2, 4
        elif is_reading(p1) and gap(p1) <= tolerance and p1[4] >= 90:
            value, rule = p1, 1
        elif (
            is_reading(p1) and is_reading(n1) and gap(p1) > tolerance and gap(n1) <= tolerance and n1[4] >= 90
        ):
            value, rule = n1, 2
        out.append((cur[2], value and value[4], value and value[2], rule))
    return out


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(1, 70), st.booleans(), st.integers(70, 180)), min_size=40, max_size=80))
def test_random_timelines_whole_and_cut(spark, split_rows, steps):
    rows, clock = [], 0.0
    for gap, is_reading, glc in steps:
        clock += gap + 0.25
        rows.append(reading(clock, glc) if is_reading else dose(clock))
    expected = by_hand(rows)
    for limit in (10**6, 7, 1):
        split_rows(limit)
        out = pair_events(spark.createDataFrame(rows, SCHEMA), strict_reference=False)
        got = out.filter("event is not null").select("timer", "glc_al", "glctimer_al", "rule").orderBy("timer").collect()
        assert [tuple(r) for r in got] == expected
