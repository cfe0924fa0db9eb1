"""Connected components of links, by alternating large and small stars; a round is two aggregates and two joins.

Before that each task replaces every `PIECE` of its links by stars, which hold its nodes together as well as the links did. Links that
all fit one piece are done then, without any rounds.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoweave.session import pin, pin_measured

PIECE = 500_000


def stars(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, root): of these links alone, the least node of its component for every other node."""
    nodes, ends = np.unique(np.concatenate([u, v]), return_inverse=True)
    root, a, b = np.arange(len(nodes)), ends[: len(u)], ends[len(u) :]
    while len(a):
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while (root[root] != root).any():
            root = root[root]
        a, b = root[a], root[b]
        a, b = a[a != b], b[a != b]
    rest = root != np.arange(len(nodes))
    return nodes[rest], nodes[root[rest]]


def _pieces(most: int):
    """Links of a task as stars, `most` links at a time, so that a task's memory doesn't follow its input."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0

        def stars_of_held() -> pa.RecordBatch:
            u, v = (np.concatenate([b.column(k).to_numpy() for b in held]) for k in (0, 1))
            return pa.RecordBatch.from_arrays([pa.array(x) for x in stars(u, v)], names=["u", "v"])

        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            if n >= most:
                yield stars_of_held()
                held, n = [], 0
        if n:
            yield stars_of_held()

    return run


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Hang every neighbour that is larger (or, for small stars, the smaller ones and the node itself) on the least one."""
    if large:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        both = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    both = pin(both.where("u != v").distinct())
    least = pin(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")))
    hung = both.join(least, "u")
    if large:
        return hung.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return hung.where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(edges: DataFrame, piece: int = PIECE) -> DataFrame:
    """(node, root): the least node of its component, for every node that has a link. `edges` has columns u and v."""
    now, seen = pin_measured(edges.select("u", "v").where("u != v").distinct(), n=F.count(F.lit(1)))
    tasks = (seen.get("n") or 0) // piece + 1
    now = pin(now.coalesce(tasks).mapInArrow(_pieces(piece), "u long, v long"))
    before, state = None, _state(now) if tasks > 1 else None
    while state != before and state[0]:
        now = pin(_star(_star(now, True), False).where("u != v").distinct())
        before, state = state, _state(now)
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
