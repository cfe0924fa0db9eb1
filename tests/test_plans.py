"""What the plans must look like: shuffles, pushed filters, pruned columns."""

import re

from pyspark.sql import functions as F

from chronoweave.operators import cohort
from chronoweave.operators.nutrition import enteral_amounts
from chronoweave.operators.ordered import add_row_id
from chronoweave.operators.pairing import pair_events
from chronoweave.operators.splits import PART, Splits, find_splits
from chronoweave.operators.treatments import raw_treatments
from chronoweave.schemas import INPUTEVENTS
from chronoweave.session import pin
from registry import mapping as m

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def shuffles(df):
    return len(re.findall(r"Exchange (?:hash|range)partitioning", plan(df)))


def test_pairing_is_one_window_and_one_shuffle(spark):
    line = pin(m.timeline(spark, SF))
    paired = pair_events(line, splits=find_splits(line, ["hadm_id"], "timer"))
    assert shuffles(paired) == 1 and plan(paired).count("Window [") == 1


def test_cohort_windows_share_one_shuffle(spark):
    rows = pin(m.modelling_rows(spark, SF))
    splits = find_splits(rows, ["stay_id"], "timer")
    df = cohort.keep_min_readings(rows, splits=splits)
    df = cohort.trim_trailing(df, splits=splits)
    df = cohort.mark_leading(df, splits=splits)
    df = cohort.interpolate_by_position(df, splits=splits)
    assert shuffles(df) == 1
    assert shuffles(cohort.mark_and_fill(cohort.keep_usable(rows, splits=splits), splits=splits)) == 1


def test_placed_rows_are_shuffled_once(spark):
    rows = pin(m.modelling_rows(spark, SF))
    splits = find_splits(rows, ["stay_id"], "timer", rows=20)
    placed = splits.place(rows)
    df = cohort.mark_and_fill(cohort.keep_usable(placed, splits=splits), splits=splits)
    main = plan(df).split("BroadcastExchange")[0]
    assert PART in df.columns and main.count("REPARTITION_BY_COL") == 1


def test_item_filter_reaches_the_scan(spark, tmp_path):
    m.inputevents(m.load(spark, SF, "events")).withColumn("ordercategorydescription", F.lit("x")).write.parquet(str(tmp_path / "o"))
    orders = spark.read.parquet(str(tmp_path / "o"))
    text = plan(raw_treatments(orders))
    assert "PushedFilters" in text and "In(itemid" in text and "ordercategorydescription" not in text
    assert "BroadcastHashJoin" in plan(enteral_amounts(orders))
    assert set(INPUTEVENTS.names) >= set(orders.columns)


def test_row_id_reads_only_what_is_asked(spark):
    numbered = add_row_id(spark.range(100).selectExpr("id", "id * 2 as a", "id * 3 as b"), ["id"])
    assert "ReadSchema: struct<a:bigint,_pid:int,_pos:bigint>" in plan(numbered.select("a", "rn"))


def test_no_python_workers_or_cartesian_products(spark):
    from registry.queries import QUERIES

    for name in ("wide_timeline", "modelling_cohort", "scores_by_model", "rows_in_force", "trailing_trim"):
        text = plan(QUERIES[name](spark, SF))
        assert "Python" not in text and "CartesianProduct" not in text and "NestedLoop" not in text, name


def test_whole_entities_carry_no_parts(spark):
    rows = m.modelling_rows(spark, SF)
    assert find_splits(rows, ["stay_id"], "timer") == Splits(("stay_id",), "timer", None)
    assert "_part" not in plan(cohort.trim_trailing(rows))
