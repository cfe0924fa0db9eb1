from datetime import datetime, timedelta

import pytest

from chronoweave.functions import codes
from chronoweave.operators import nutrition, quality, readings, timeline, treatments
from chronoweave.schemas import CHARLSON, CHARTEVENTS, FIRST_DAY_WEIGHT, ICUSTAYS, INPUTEVENTS, LABEVENTS

T0 = datetime(2024, 1, 1)


def at(minutes):
    return T0 + timedelta(minutes=minutes)


def charted(minutes, item, value, stay=1, store=0):
    return (1, 1, stay, at(minutes), at(minutes + store), item, value)


def order(minutes, item=223258, amount=2.0, end=60, status="FinishedRunning", category="05-Med Bolus", stay=1, rate=None,
          original=None):
    return (1, 1, stay, at(minutes), at(end), amount, rate, original, "mL", category, None, status, item)


def test_raw_readings_drop_unlisted_zero_and_repeated(spark):
    chart = spark.createDataFrame(
        [charted(0, 807, 100.0), charted(0, 807, 100.0), charted(1, 807, 0.0), charted(2, 807, -5.0),
         charted(3, 220045, 80.0), charted(4, 807, None)], CHARTEVENTS)
    labs = spark.createDataFrame([(1, 1, at(0), 50931, 100.0), (1, 1, at(9), 50820, 7.4)], LABEVENTS)
    out = readings.raw_readings(chart, labs).collect()
    assert sorted((r.item_glc, r.glucose, r.stay_id) for r in out) == [(807, 100.0, 1), (50931, 100.0, None)]


def test_same_time_readings_collapse(spark):
    chart = spark.createDataFrame(
        [charted(0, 807, 110.0), charted(1, 225664, 500.0), charted(2, 220621, 999.0), charted(3, 3744, 120.0),
         charted(4, 220621, 1000.0)], CHARTEVENTS)
    labs = spark.createDataFrame([(1, 1, at(0), 50931, 105.0), (1, 1, at(5), 50809, 90.0)], LABEVENTS)
    out = {r.charttime: r for r in readings.clean_readings(chart, labs).collect()}
    assert set(out) == {at(0), at(2), at(5)}  # at the limits and item 3744 drop out
    both = out[at(0)]
    assert (both.glucose, both.glucose_lab, both.glcsource, both.stay_id) == (110.0, 105.0, "fingerstick", 1)
    assert (out[at(5)].glcsource, out[at(5)].stay_id) == ("blood", None)


def test_route_first_match_wins(spark):
    rows = [("06-Insulin (Non IV)",), ("non iv med bolus",), ("05-Med Bolus",), ("01-Drips",), ("01-drips",), (None,)]
    df = spark.createDataFrame(rows, "ordercategoryname string")
    got = [r[0] for r in df.select(treatments.admin_route()).collect()]
    assert got == ["BOLUS_INJECTION", "BOLUS_INJECTION", "BOLUS_PUSH", "INFUSION", None, None]


def test_raw_treatments(spark):
    rows = [order(0), order(0), order(1, status="Rewritten"), order(2, status=None), order(3, stay=None),
            order(4, item=999), order(5, item=223260, status="Paused"), order(0, status="Other")]
    out = treatments.raw_treatments(spark.createDataFrame(rows, INPUTEVENTS)).collect()
    assert sorted((r.starttime, r.insulintype, r.infxstop) for r in out) == [
        (at(0), "Short", 0), (at(0), "Short", 0), (at(5), "Long", 1)]


def test_bolus_cap_is_the_distinct_count(spark):
    rows = [order(i, amount=float(a)) for i, a in enumerate([1, 2, 2, 3, 4, 50, 0, -1])]
    raw = treatments.raw_treatments(spark.createDataFrame(rows, INPUTEVENTS))
    for exact in (True, False):  # seven distinct amounts, zero and negative ones among them
        out = sorted((r.starttime, r.amount) for r in treatments.clean_boluses(raw, exact=exact).collect())
        assert out == [(at(i), a) for i, a in enumerate([1.0, 2.0, 2.0, 3.0, 4.0, None])]
    by_share = treatments.clean_boluses(raw, cap="p99").collect()
    assert sorted(r.amount for r in by_share if r.amount is not None) == [1.0, 2.0, 2.0, 3.0, 4.0]


def test_infusion_rate_falls_back_and_is_capped(spark):
    drips = dict(category="01-Drips")
    rows = [order(0, rate=1.0, **drips), order(1, rate=None, original=2.0, **drips), order(2, rate=9.0, **drips),
            order(3, rate=0.0, **drips), order(4, **drips)]
    raw = treatments.raw_treatments(spark.createDataFrame(rows, INPUTEVENTS))
    assert sorted(r.rate for r in treatments.clean_infusions(raw, exact=True).collect()) == [1.0, 2.0]


def test_parenteral_components(spark):
    rows = [order(0, item=220949, amount=100.0), order(0, item=225916, amount=10.0), order(0, item=225917, amount=5.0),
            order(0, item=227090, amount=20.0), order(0, item=225823, amount=77.0),
            order(70, item=220952, amount=-1.0, end=70), order(80, item=225917, amount=6.0, end=80, status=None),
            order(90, item=225948, amount=3.0, status="Rewritten", end=100)]
    parts = nutrition.parenteral_components(spark.createDataFrame(rows, INPUTEVENTS))
    out = {r.starttime: r for r in parts.collect()}
    assert set(out) == {at(0), at(70), at(80)}
    r = out[at(0)]
    assert (r.dextrose_fluid, r.tpn, r.tpn_lipids, r.lipids_10_20) == (5.0, 15.0, 1, 2.0)
    assert out[at(70)].dextrose_fluid is None and out[at(80)].tpn_lipids == 0
    rates = {r.timer: r for r in nutrition.parenteral_rates(parts).collect()}
    assert rates[at(0)].tpn_rate == 15.0 and rates[at(80)].tpn_rate is None  # a zero-length order has no rate
    assert rates[at(70)].tpn_length is None


def test_enteral_products(spark):
    items = [(i, p) for p, ids in codes.ENTERAL_ITEMS.items() for i in ids]
    assert len(items) == len({i for i, _ in items}) == 101
    assert set(codes.ENTERAL_FACTORS) == set(codes.ENTERAL_ITEMS) and len(codes.ENTERAL_ITEMS) == 23
    rows = [order(0, item=225934, amount=100.0, end=120), order(1, item=225929, amount=10.0, end=31),
            order(2, item=228383, amount=-1.0), order(3, item=1, amount=1.0), order(4, item=225937, amount=0.0, end=4)]
    out = {r.timer: r for r in nutrition.enteral_rates(
        nutrition.enteral_amounts(spark.createDataFrame(rows, INPUTEVENTS))).collect()}
    assert set(out) == {at(0), at(1), at(2), at(4)}
    vivonex = out[at(0)]
    assert (vivonex.enteral_rate, vivonex.fibre_enteral) == (50.0, 0.0)
    assert vivonex.calorie_enteral == pytest.approx(60.6)
    assert out[at(1)].enteral_rate == 20.0 and out[at(1)].cho_enteral is None
    assert out[at(2)].enteral_rate is None and out[at(4)].enteral_rate is None


def test_unit_of_solutions(spark):
    rows = [order(0, item=220949), order(1, item=225947)]
    out = spark.createDataFrame(rows, INPUTEVENTS).select("itemid", nutrition.solution_unit().alias("u")).collect()
    assert {r.itemid: r.u for r in out} == {220949: "grams", 225947: "mL"}


def stay(sid, start, end, hadm=1):
    return (1, hadm, sid, "F", None, at(start), at(end), 1.0, 50.0, "x", 0, 1, True, at(start), at(end), 1.0, 1, True)


def test_stay_assignment_is_strict_and_fills_stay(spark):
    chart = spark.createDataFrame([charted(m, 807, 100.0 + m, stay=None) for m in (0, 1, 59, 60, 61)], CHARTEVENTS)
    labs = spark.createDataFrame([], LABEVENTS)
    orders = spark.createDataFrame([order(30, stay=1)], INPUTEVENTS)
    treated = treatments.clean_treatments(orders, cap="p99")
    line = timeline.build_timeline(readings.clean_readings(chart, labs), treated)
    side = timeline.stay_attributes(
        spark.createDataFrame([stay(1, 0, 60)], ICUSTAYS),
        spark.createDataFrame([(1, 1, 1, 0)], CHARLSON),
        spark.createDataFrame([], FIRST_DAY_WEIGHT),
    )
    out = timeline.assign_stays(line, side).orderBy("timer").collect()
    assert [r.timer for r in out] == [at(1), at(30), at(59)]
    assert {r.stay_id for r in out} == {1} and {r.diabetes_without_cc for r in out} == {1}
    assert {r.weight for r in out} == {None}
    assert quality.check_stay_known(timeline.assign_stays(line, side)).count() == 0
    assert quality.check_timer_known(line).count() == 0


def test_not_in_rules(spark):
    def left(rows):
        df = spark.createDataFrame(rows, "stay_id long, timer long")
        return sorted((r.stay_id is None, r.stay_id, r.timer) for r in timeline.drop_fanned_out_entities(df).collect())

    assert left([(1, 1), (1, 2), (None, 1)]) == [(False, 1, 1), (False, 1, 2), (True, None, 1)]
    assert left([(1, 1), (1, 1), (2, 1), (None, 1)]) == [(False, 2, 1)]
    assert left([(1, 1), (None, 1), (None, 1)]) == []


def test_duplicate_readings_check(spark):
    rows = [(1, at(0), 1.0, "blood"), (1, at(0), 1.0, "blood"), (1, at(0), 2.0, "blood"), (1, None, 1.0, "blood")] * 1
    df = spark.createDataFrame(rows + [(1, None, 1.0, "blood")], "stay_id long, glctimer timestamp_ntz, glc double, glcsource string")
    assert [r.n for r in quality.check_duplicate_readings(df).collect()] == [2]


LONG = (
    "subject_id long, hadm_id long, stay_id long, timer timestamp_ntz, timer_next timestamp_ntz, glc double, "
    "glc_lab double, glctimer timestamp_ntz, glcsource string, starttime timestamp_ntz, endtime timestamp_ntz, "
    "input double, input_hrs double, insulintype string, event string, infxstop int"
)


def test_wide_keeps_infusion_in_force(spark):
    def row(m, glc=None, event=None, end=None, amount=None, rate=None, src=None):
        started = at(m) if event else None
        return (1, 1, 1, at(m), at(m + 1), glc, None, None, src, started, None if end is None else at(end), amount, rate,
                "Short" if event else None, event, None)

    rows = [row(0, 100.0), row(10, event="INFUSION", end=30, rate=5.0), row(20, 120.0, src="BLOOD"),
            row(20, event="BOLUS_PUSH", amount=2.0, src="fingerstick"), row(20, event="BOLUS_PUSH", amount=3.0),
            row(30, 130.0), row(40, event="INFUSION", end=40, rate=7.0), row(50, event="BOLUS_INJECTION", amount=1.0)]
    out = timeline.to_wide(spark.createDataFrame(rows, LONG)).orderBy("timer").collect()
    assert [r.input_hrs for r in out] == [None, 5.0, 5.0, None, 7.0, None]
    assert [r.input_bolus_push for r in out] == [None, None, 5.0, None, None, None]
    assert out[5].input_bolus_injection == 1.0
    assert [r.glc_next for r in out] == [None, 120.0, 130.0, None, None, None]
    assert out[2].glcsource == "fingerstick"  # lower case sorts after upper case
    assert [r.timer_prev for r in out] == [None, at(0), at(10), at(20), at(30), at(40)]


def test_sketches_of_parts_unite_to_the_whole(spark, tmp_path):
    """A new part adds its own sketches alone, repeating it changes nothing, and old orders are not needed for the limit."""
    rows = spark.range(60_000).selectExpr(
        "id as subject_id", "id as hadm_id", "id as stay_id", "timestamp_ntz'2024-01-01' + make_dt_interval(cast(id % 3 as int)) as starttime",
        "timestamp_ntz'2024-01-02' as endtime", "cast(id * 7919 % 20000 as double) / 7 as amount", "if(id % 2 = 0, null, cast(id % 50 as double)) as rate",
        "cast(id % 9 as double) as originalrate", "1 as itemid", "'x' as ordercategoryname", "'Short' as insulintype",
        "if(id % 5 = 0, 'INFUSION', 'BOLUS_PUSH') as insulinadmin", "0 as infxstop",
    )
    path = str(tmp_path / "sketches")
    for day in (0, 1, 2, 2):
        treatments.add_part(rows.filter(f"day(starttime) = {day + 1}"), f"day {day}", path)
    stored = spark.read.parquet(path)
    assert stored.count() == 6 and {r.part for r in stored.select("part").collect()} == {"day 0", "day 1", "day 2"}
    limits = {r.kind: r.limit for r in treatments.limits_of(stored).collect()}
    infusions = rows.filter("insulinadmin = 'INFUSION'").selectExpr("count(distinct coalesce(rate, originalrate)) as n").first().n
    boluses = rows.filter("insulinadmin <> 'INFUSION'").selectExpr("count(distinct amount) as n").first().n
    assert limits["infusion"] == infusions and abs(limits["bolus"] / boluses - 1) < 4 * treatments.SKETCH_ERROR
    new = treatments.clean_infusions(rows.filter("day(starttime) = 1 and id < 100"), sketches=stored)
    assert new.count() == new.filter(f"rate > 0 and rate < {limits['infusion']}").count() > 0
    assert treatments.limits_of(treatments.limit_sketches(rows.filter("false"), "none")).count() == 0
