"""Splits, folds and samples by entity: every row follows its entity, so nothing leaks between sides."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoweave.operators.ordered import add_row_id


def distinct_entities(df: DataFrame, id: str) -> DataFrame:
    """Distinct ids in order."""
    return df.select(id).distinct().orderBy(id)


def split_by_entity(df: DataFrame, share: float, seed: int = 0, id: str = "stay_id", name: str = "held_out") -> DataFrame:
    """Mark the rows of a `share` of the entities (rounded up); the choice depends on ids and seed only."""
    ids = df.select(id).distinct().filter(F.col(id).isNotNull())
    ranked = add_row_id(ids.withColumn("_hash", F.xxhash64(F.col(id), F.lit(seed))), ["_hash", id], "_rank")
    total = ranked.agg(F.count(F.lit(1))).scalar()
    marked = ranked.select(id, (F.col("_rank") < F.ceil(F.lit(share) * total)).alias(name))
    return df.join(marked, id)


def fold_by_entity(df: DataFrame, k: int, id: str = "stay_id", name: str = "fold") -> DataFrame:
    """Contiguous folds over the sorted ids, 0-based; the first (ids mod k) folds hold one id more."""
    ranked = add_row_id(df.select(id).distinct().filter(F.col(id).isNotNull()), [id], "_rank")
    total = ranked.agg(F.count(F.lit(1))).scalar()
    small, more = F.floor(total / F.lit(k)), total % F.lit(k)
    rank = F.col("_rank")
    in_larger = rank < more * (small + 1)
    fold = F.when(in_larger, F.floor(rank / (small + 1))).otherwise(
        more + F.floor((rank - more * (small + 1)) / F.greatest(small, F.lit(1)))
    )
    return df.join(ranked.select(id, fold.cast("int").alias(name)), id)


def sample_entities(df: DataFrame, n: int, seed: int = 0, id: str = "stay_id") -> DataFrame:
    """All rows of `n` entities chosen by hash."""
    ids = df.select(id).distinct().filter(F.col(id).isNotNull())
    return df.join(ids.orderBy(F.xxhash64(F.col(id), F.lit(seed)), id).limit(n), id, "left_semi")


def keep_entities(df: DataFrame, ids: DataFrame, id: str = "stay_id") -> DataFrame:
    return df.join(ids.select(id).distinct(), id, "left_semi")


def drop_entities(df: DataFrame, ids: DataFrame, id: str = "stay_id") -> DataFrame:
    return df.join(ids.select(id).distinct(), id, "left_anti")


def first_rows(df: DataFrame, order: list[str], n: int = 8000) -> DataFrame:
    """The first `n` rows in order, for a small trial run."""
    return df.orderBy(*order).limit(n)
