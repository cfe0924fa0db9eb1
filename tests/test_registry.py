"""Every registered query against its SQL on the smallest tables, then again with entities cut into parts."""

import pytest

import __spark_entry__ as entry
from registry.check import check, connect
from registry.queries import QUERIES

SF = "/root/testdata/sf0.001"
SLOW = {"tree_folds", "grid_of_seeds", "linear_folds"}
ALONG_TIME = [
    "paired_within_90_minutes", "paired_one_reading_per_rule", "repeated_readings", "long_timeline", "wide_timeline",
    "sweep_in_force", "rows_in_force", "points_between_rows", "stay_timeline", "wide_with_nutrition", "trailing_trim",
    "leading_trim", "interpolated", "modelling_cohort", "next_observed_value", "lagged_doses", "padded_batches",
    "doses_without_outliers", "scores_by_model_and_fold", "observed_series", "extreme_rates_in_force", "price_medians",
    "neighbours_within_one_time",
]


@pytest.fixture(scope="module")
def duck():
    return connect(SF)


@pytest.mark.parametrize("name", [q for q in QUERIES if q not in SLOW])
def test_query_agrees_with_sql(spark, duck, name):
    assert check(spark, duck, SF, name, entry.queries()[name], entry.oracle_sql().get(name)) == ""


@pytest.mark.parametrize("name", ALONG_TIME)
def test_query_agrees_with_sql_when_entities_are_cut(spark, duck, split_rows, name):
    split_rows(9)
    assert check(spark, duck, SF, name, entry.queries()[name], entry.oracle_sql()[name]) == ""


def test_entry_runs(spark):
    assert entry.entry(spark).count() > 0


def test_every_sql_has_its_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
