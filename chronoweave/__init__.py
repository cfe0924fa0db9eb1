"""Irregular event timelines on Spark: DataFrame-in, DataFrame-out operators."""
