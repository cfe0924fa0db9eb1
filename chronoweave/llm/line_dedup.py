r"""Operator 1, line dedup: sharded cuckoo filters over exact reference-count tables.

The index is a folder of plain tables. `refs` holds one row per distinct (line key, document), `counts` how many documents hold
each key, and `filters` one cuckoo filter per shard of keys. An insertion asks the filters which keys are surely new; only the
others are joined with the stored counts. A deletion lowers counts, and a key whose count reaches 0 leaves its filter, which
is safe because the exact table says that it is there. So inserting and deleting the same documents leaves what was before.

A key is a 128-bit hash of the line without the bytes [\x20\x09-\x0D] at its ends and with A-Z lower-cased.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoweave.session import pin

from .common import LOWER, SPACE, doc_key

SLOTS = 4


class CuckooFilter:
    """16-bit fingerprints in buckets of four; a whole array of keys at a time."""

    def __init__(self, buckets: int = 64, table: np.ndarray | None = None):
        self.table = np.zeros((buckets, SLOTS), np.uint16) if table is None else table
        self.mask = np.uint64(len(self.table) - 1)

    @classmethod
    def loads(cls, data: bytes | None) -> CuckooFilter:
        return cls() if not data else cls(table=np.frombuffer(data, np.uint16).reshape(-1, SLOTS).copy())

    def dumps(self) -> bytes:
        return self.table.tobytes()

    def _places(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        prints = (keys >> np.uint64(48)).astype(np.uint16) | np.uint16(1)
        return prints, (keys & self.mask).astype(np.int64)

    def _other(self, prints: np.ndarray, at: np.ndarray) -> np.ndarray:
        return ((at.astype(np.uint64) ^ (prints.astype(np.uint64) * np.uint64(0x5BD1E995))) & self.mask).astype(np.int64)

    def has(self, keys: np.ndarray) -> np.ndarray:
        """True for every key that was added; for others mostly False."""
        prints, at = self._places(keys)
        here = (self.table[at] == prints[:, None]).any(1)
        return here | (self.table[self._other(prints, at)] == prints[:, None]).any(1)

    def add(self, keys: np.ndarray, all_keys=None) -> CuckooFilter:
        """Add keys; when they don't fit, a filter twice as large is made from `all_keys()` (the exact table) and `keys`."""
        held = int(np.count_nonzero(self.table))
        if held + len(keys) > 0.85 * self.table.size:
            return self._grown(keys, all_keys, held + len(keys))
        prints, at = self._places(keys)
        pick = np.random.default_rng(len(keys))
        for attempt in range(200):
            if not len(prints):
                return self
            order = np.argsort(at, kind="stable")
            prints, at = prints[order], at[order]
            rank = np.arange(len(at)) - np.searchsorted(at, at)
            free = self.table[at] == 0
            fits = rank < free.sum(1)
            slot = np.argmax(np.cumsum(free, 1) == (rank + 1)[:, None], 1)
            self.table[at[fits], slot[fits]] = prints[fits]
            prints, at = prints[~fits], at[~fits]
            if attempt % 2:  # both buckets are full: one key per bucket takes a slot, and what it held moves on
                first = np.unique(at, return_index=True)[1]
                slots = pick.integers(0, SLOTS, len(first))
                out = self.table[at[first], slots].copy()
                self.table[at[first], slots] = prints[first]
                prints[first] = out
            at = self._other(prints, at)
        return self._grown(keys, all_keys, int(self.table.size))

    def _grown(self, keys: np.ndarray, all_keys, least: int) -> CuckooFilter:
        buckets = len(self.table) * 2
        while buckets * SLOTS * 0.8 < least:
            buckets *= 2
        old = all_keys() if all_keys is not None else np.empty(0, np.uint64)
        return CuckooFilter(buckets).add(np.concatenate([old, keys]))

    def remove(self, keys: np.ndarray) -> None:
        """Take out keys that were added."""
        prints, at = self._places(keys)
        for p, a, b in zip(prints.tolist(), at.tolist(), self._other(prints, at).tolist(), strict=True):
            for bucket in (a, b):
                slots = np.flatnonzero(self.table[bucket] == p)
                if len(slots):
                    self.table[bucket, slots[0]] = 0
                    break


def line_key(line: bytes) -> bytes:
    return line.strip(SPACE).translate(LOWER)


def code_points(line: bytes) -> int:
    return len(line) if line.isascii() else len(line.decode("utf-8", "replace"))


def line_refs(docs: DataFrame, least: int) -> DataFrame:
    """(high, low, doc_id), once per key and row of documents; keys shorter than `least` code points are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, owners = [], []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                text = text.as_py() or b""
                if doc is None or len(text) < least:
                    continue
                lines = {k for line in text.split(b"\n") if len(line) >= least and len(k := line_key(line)) >= least}
                held = [xxhash.xxh3_128_digest(k) for k in lines if code_points(k) >= least]
                keys += held
                owners += [doc] * len(held)
            pairs = np.frombuffer(b"".join(keys), ">i8").reshape(-1, 2).astype(np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.ascontiguousarray(pairs[:, 0])), pa.array(np.ascontiguousarray(pairs[:, 1])), pa.array(owners, pa.int64())],
                names=["high", "low", "doc_id"],
            )

    return doc_key(docs).mapInArrow(run, "high long, low long, doc_id long")


def _count(refs: DataFrame) -> DataFrame:
    return refs.groupBy("high", "low").agg(F.count(F.lit(1)).alias("n"), F.max("doc_id").alias("keeper"))


@dataclass(frozen=True)
class LineIndex:
    """The stored state; every change gives a new index and leaves the old tables as they are."""

    spark: SparkSession
    least: int
    shards: int
    refs: DataFrame | None = None
    counts: DataFrame | None = None
    filters: DataFrame | None = None

    def insert(self, docs: DataFrame) -> LineIndex:
        """Add documents. A doc_id is one document, so a repeated one counts once; NULL ids, empty texts and NULLs add nothing."""
        fresh = line_refs(docs, self.least).distinct()
        if self.refs is not None:  # a document that is there already adds only lines that it didn't have
            fresh = fresh.join(self.refs, ["high", "low", "doc_id"], "left_anti")
        fresh = pin(fresh)
        probed = self._probe(_count(fresh))
        filters = probed.where("data is not null").select("shard", "data")
        new = probed.where("data is null and not known").select("high", "low", "n", "keeper")
        if self.refs is None:
            return LineIndex(self.spark, self.least, self.shards, fresh, pin(new), pin(filters))
        maybe = probed.where("data is null and known").select("high", "low", "n", "keeper")
        old = self.counts.select("high", "low", F.col("n").alias("old_n"), F.col("keeper").alias("old_keeper"))
        merged = maybe.join(old, ["high", "low"], "full").select(
            "high", "low",
            (F.coalesce("n", F.lit(0)) + F.coalesce("old_n", F.lit(0))).alias("n"), F.greatest("keeper", "old_keeper").alias("keeper"),
        )
        return LineIndex(self.spark, self.least, self.shards, pin(self.refs.unionByName(fresh)), pin(merged.unionByName(new)), pin(filters))

    def delete(self, ids: DataFrame) -> LineIndex:
        """Take out the documents whose doc_id is in `ids`; unknown ids change nothing."""
        if self.refs is None:
            return self
        gone = ids.select(F.col("doc_id").cast("long").alias("doc_id")).distinct()
        refs = pin(self.refs.join(gone, "doc_id", "left_anti"))
        left = self.refs.join(gone, "doc_id", "left_semi").groupBy("high", "low").agg(F.count(F.lit(1)).alias("less"))
        # Only keys that lost a reference are counted down; their keeper is looked up among what is left.
        touched = self.counts.join(left, ["high", "low"])
        keepers = refs.join(left, ["high", "low"], "left_semi").groupBy("high", "low").agg(F.max("doc_id").alias("keeper"))
        lowered = pin(touched.drop("keeper").join(keepers, ["high", "low"], "left").select("high", "low", (F.col("n") - F.col("less")).alias("n"), "keeper"))
        counts = pin(self.counts.join(left, ["high", "low"], "left_anti").unionByName(lowered.where("n > 0")))
        dead = lowered.where("n = 0").select(self._shard().alias("shard"), "low")
        filters = self.filters.select("shard", "data").groupBy("shard").cogroup(dead.groupBy("shard")).applyInPandas(_remove, "shard int, data binary")
        return LineIndex(self.spark, self.least, self.shards, refs, counts, pin(filters))

    def dropped(self, most: int) -> DataFrame:
        """(doc_id, gone: array of line keys): what loses its lines, because at least `most` documents hold the key."""
        often = self.counts.where(F.col("n") >= most).select("high", "low", "keeper")
        hits = self.refs.join(often, ["high", "low"]).where(F.col("doc_id") != F.col("keeper"))
        # The list of one document is as long as its own lines.
        return hits.groupBy("doc_id").agg(F.collect_list(F.struct("high", "low")).alias("gone"))

    def clean(self, docs: DataFrame, most: int = 5, carry: list[str] | None = None) -> DataFrame:
        """Every row of `docs` with text (bytes) after the drop, n_lines before it, n_dropped, and the columns of `carry`.

        A NULL or empty text is one empty line; NULL stays NULL.
        """
        carried = F.struct(*(carry or [])).alias("carried") if carry else F.lit(None).cast("struct<none:int>").alias("carried")
        base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"), carried)
        least = self.least

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                ids, texts, lists = batch.column(0), batch.column(1), batch.column(2)
                kept, n_lines, n_gone = [], [], []
                for text, gone in zip(texts, lists, strict=True):
                    lines = (text.as_py() or b"").split(b"\n")
                    n_lines.append(len(lines))
                    drop = {(g["high"], g["low"]) for g in gone.as_py()} if gone.is_valid else None
                    if drop:
                        lines = [x for x in lines if len(x) < least or _pair(line_key(x)) not in drop]
                    n_gone.append(n_lines[-1] - len(lines))
                    kept.append(b"\n".join(lines) if text.is_valid else None)
                yield pa.RecordBatch.from_arrays(
                    [ids, pa.array(kept, pa.binary()), pa.array(n_lines, pa.int64()), pa.array(n_gone, pa.int64()), batch.column(3)],
                    names=["doc_id", "text", "n_lines", "n_dropped", "carried"],
                )

        joined = base.join(self.dropped(most), "doc_id", "left").select("doc_id", "text", "gone", "carried")
        kind = joined.schema["carried"].dataType.simpleString()
        done = joined.mapInArrow(run, f"doc_id long, text binary, n_lines long, n_dropped long, carried {kind}")
        return done.select("doc_id", "text", "n_lines", "n_dropped", *([f"carried.{c}" for c in carry] if carry else []))

    def _shard(self):
        return F.pmod(F.col("high"), F.lit(self.shards)).cast("int")

    def _probe(self, batch: DataFrame) -> DataFrame:
        """The batch's keys with `known` (the filter may hold it), and one row per shard with its filter after them."""
        schema = "shard int, high long, low long, n long, keeper long, known boolean, data binary"
        keys = batch.withColumn("shard", self._shard())
        if self.filters is None:
            return keys.groupBy("shard").applyInPandas(lambda key, new: _insert(key, new, None, None), schema)
        known = self.counts.select(self._shard().alias("shard"), "low", F.lit(None).cast("binary").alias("data"))
        state = known.unionByName(self.filters.select("shard", F.lit(None).cast("long").alias("low"), "data"))
        return keys.groupBy("shard").cogroup(state.groupBy("shard")).applyInPandas(
            lambda key, new, old: _insert(key, new, next((d for d in old["data"] if d is not None), None), lambda: _unsigned(old["low"].dropna())), schema
        )


def _pair(key: bytes) -> tuple[int, int]:
    return tuple(np.frombuffer(xxhash.xxh3_128_digest(key), ">i8").tolist())


def _unsigned(low: pd.Series) -> np.ndarray:
    return low.to_numpy(np.int64).view(np.uint64)


def _insert(key, new: pd.DataFrame, data: bytes | None, all_keys) -> pd.DataFrame:
    low = _unsigned(new["low"])
    held = CuckooFilter.loads(data)
    known = held.has(low) if data else np.zeros(len(low), bool)
    there = known.copy()
    if known.any():  # what the filter holds by chance only must still be added, or its deletion would take out another key
        there[known] = np.isin(low[known], all_keys())
    held = held.add(low[~there], all_keys)
    out = new.assign(known=known, data=None)[["shard", "high", "low", "n", "keeper", "known", "data"]]
    row = pd.DataFrame([{"shard": key[0], "high": 0, "low": 0, "n": 0, "keeper": 0, "known": True, "data": held.dumps()}])
    return pd.concat([out, row], ignore_index=True) if len(out) else row


def _remove(key, state: pd.DataFrame, dead: pd.DataFrame) -> pd.DataFrame:
    held = CuckooFilter.loads(state["data"].iloc[0] if len(state) else None)
    held.remove(_unsigned(dead["low"]))
    return pd.DataFrame([{"shard": key[0], "data": held.dumps()}])


def build(docs: DataFrame, least: int = 40, bytes_per_shard: int = 4 << 20) -> LineIndex:
    """An index of `docs`; the number of shards follows the bytes of text, so that a shard's keys fit in one task."""
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return LineIndex(docs.sparkSession, least, max(8, size // bytes_per_shard + 1)).insert(docs)


