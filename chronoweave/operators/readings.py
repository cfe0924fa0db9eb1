"""Glucose readings: raw charted and laboratory values to one row per admission and time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronoweave.functions import codes


def positive_value(items: tuple[int, ...], item: str = "itemid", value: str = "valuenum") -> Column:
    """The value if the item is listed and the value is above zero, else NULL."""
    return F.when(F.col(item).isin(*items) & (F.col(value) > 0), F.col(value))


def raw_readings(chart: DataFrame, labs: DataFrame) -> DataFrame:
    """Listed items with a positive value from both sources, each distinct row once."""
    charted = chart.filter(F.col("itemid").isin(*codes.CHART_ITEMS)).select(
        "subject_id",
        "hadm_id",
        "stay_id",
        "charttime",
        "storetime",
        positive_value(codes.CHART_ITEMS).alias("glucose"),
        F.col("itemid").alias("item_glc"),
    )
    tested = labs.filter(F.col("itemid").isin(*codes.LAB_ITEMS)).select(
        "subject_id",
        "hadm_id",
        F.lit(None).cast(chart.schema["stay_id"].dataType).alias("stay_id"),
        "charttime",
        F.lit(None).cast(chart.schema["storetime"].dataType).alias("storetime"),
        positive_value(codes.LAB_ITEMS).alias("glucose"),
        F.col("itemid").alias("item_glc"),
    )
    # the two item lists share no code, so one distinct over the union keeps the sources apart
    return tested.unionByName(charted).filter(F.col("glucose").isNotNull()).distinct()


def collapse_readings(raw: DataFrame) -> DataFrame:
    """One row per (subject, admission, time); a fingerstick value goes before a laboratory one.

    The distinct steps before the union change no maximum, so one aggregate with partial combine does it all.
    """
    finger = F.col("item_glc").isin(*codes.FINGERSTICK_ITEMS) & (F.col("glucose") < codes.FINGERSTICK_BELOW)
    blood = F.col("item_glc").isin(*codes.BLOOD_ITEMS) & (F.col("glucose") < codes.BLOOD_BELOW)
    both = (
        raw.filter(finger | blood)
        .groupBy("subject_id", "hadm_id", "charttime")
        .agg(
            F.max("stay_id").alias("stay_id"),
            F.max(F.when(finger, F.col("glucose"))).alias("_finger"),
            F.max(F.when(blood, F.col("glucose"))).alias("glucose_lab"),
        )
    )
    return both.select(
        "subject_id",
        "hadm_id",
        "stay_id",
        "charttime",
        F.coalesce("_finger", "glucose_lab").alias("glucose"),
        "glucose_lab",
        F.when(F.col("_finger").isNotNull(), "fingerstick").otherwise("blood").alias("glcsource"),
    )


def clean_readings(chart: DataFrame, labs: DataFrame) -> DataFrame:
    return collapse_readings(raw_readings(chart, labs))
