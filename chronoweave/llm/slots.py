"""Operator 8, token-ID output: training-order materialisation.

Token ids of texts become streams of uint16, or uint32 where an id needs it, each text closed by the greatest number, which is no id.
Without a tokenizer a text's bytes are its ids (uint8), closed by 255, which no UTF-8 text contains. A stream is cut into sequences
of equal length, the sequences are numbered over the whole table, and a keyed Feistel permutation with cycle-walking gives each
number its global slot without any sort or shuffle of numbers. Slots are range-partitioned into shard files in which sequence i
lies at byte i * stride, so a reader seeks to any slot and goes on from there.
"""

from __future__ import annotations

import hashlib
import io
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoweave.session import pin, shared_folder

from .common import doc_key, groups_of_bytes, mix
from .packing import encoder, vocabulary

END = 255
PIECE = 8 << 20


class Permutation:
    """A bijection of 0..n-1 that depends on `key` alone."""

    def __init__(self, n: int, key: int, rounds: int = 6):
        self.n = n
        self.half = np.uint64(max(1, (max(n - 1, 1).bit_length() + 1) // 2))
        self.low = np.uint64((1 << int(self.half)) - 1)
        self.keys = mix(np.arange(1, rounds + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(key & (2**64 - 1)))

    def _walk(self, x: np.ndarray, keys: np.ndarray, back: bool) -> np.ndarray:
        x = x.astype(np.uint64)
        todo = np.ones(len(x), bool)
        while todo.any():  # the network permutes a power of four, under 4n: who lands outside walks on along its cycle
            left, right = x[todo] >> self.half, x[todo] & self.low
            for k in keys:
                if back:
                    left, right = right ^ (mix(left + k) & self.low), left
                else:
                    left, right = right, left ^ (mix(right + k) & self.low)
            x[todo] = (left << self.half) | right
            todo[todo] = x[todo] >= self.n
        return x.astype(np.int64)

    def slot(self, index: np.ndarray) -> np.ndarray:
        return self._walk(index, self.keys, False)

    def index(self, slot: np.ndarray) -> np.ndarray:
        return self._walk(slot, self.keys[::-1], True)


@dataclass(frozen=True)
class Layout:
    """Where the shards are and how they are cut."""

    folder: str
    sequences: int
    length: int
    per_shard: int
    key: int
    dtype: str = "<u1"

    @property
    def stride(self) -> int:
        return self.length * np.dtype(self.dtype).itemsize


def _sequences(held: int, length: int) -> int:
    return -(-held // length)


def groups_of_ids(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[tuple[None, list[np.ndarray]]]:
    """The id lists of a column in pieces of about `most` bytes."""
    lists, held = [], 0
    for batch in batches:
        column = batch.column(0)
        values = column.flatten()
        if values.null_count:
            raise ValueError("a NULL among the ids of a text")
        ends = np.cumsum(column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
        for own in np.split(values.to_numpy(), ends[:-1]) if len(ends) else []:
            lists.append(own)
            held += own.nbytes + 64
            if held >= most:
                yield None, lists
                lists, held = [], 0
    if lists:
        yield None, lists


def groups_of_encoded(batches: Iterator[pa.RecordBatch], most: int, name: str, table: tuple) -> Iterator[tuple[None, list[np.ndarray]]]:
    """The ids of texts, in pieces of about `most` bytes of text; one encoder per worker process, for its next tasks too."""
    if name not in _encoders:
        _encoders.clear()
        _encoders[name] = encoder(table)
    encode = _encoders[name]
    for _, texts in groups_of_bytes(batches, most):
        yield None, [encode(t.decode("utf-8", "replace")) for t in texts]


_encoders: dict[str, object] = {}


def _stream(texts: list, dtype: str) -> np.ndarray:
    if dtype == "<u1":
        return np.frombuffer(b"\xff".join(texts) + b"\xff", np.uint8)
    end = np.array([np.iinfo(dtype).max], dtype)
    return np.concatenate([x for t in texts for x in (t.astype(dtype), end)])


def _dtype(greatest: int) -> str:
    return "<u2" if greatest < 2**16 - 1 else "<u4"


def streams(docs: DataFrame, length: int, ids: str | None = None, vocabulary_file: str | None = None) -> DataFrame:
    """part, first, n, most, data: the packed stream of about 8 MB of input each, as a stored table.

    A piece holds `n` sequences of `length`; `first` is the number of sequences that its task `part` packed before it, `most` its
    greatest id. A piece has the narrowest numbers that hold its ids, whatever other pieces need.
    """
    if vocabulary_file:
        with open(vocabulary_file, encoding="utf-8") as f:
            content = f.read()
        name = hashlib.sha256(content.encode()).hexdigest()
        shared = docs.sparkSession.sparkContext.broadcast(vocabulary(content))  # a vocabulary has a fixed size

    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, done, compress = TaskContext.get().partitionId(), 0, zstandard.ZstdCompressor(level=6).compress
        if vocabulary_file:
            groups = groups_of_encoded(batches, PIECE, name, shared.value)
        else:
            groups = (groups_of_ids if ids else groups_of_bytes)(batches, PIECE)
        for _, texts in groups:
            most, dtype = 0, "<u1"
            if ids or vocabulary_file:
                held = [t for t in texts if len(t)]
                least, most = min((int(t.min()) for t in held), default=0), max((int(t.max()) for t in held), default=0)
                if least < 0:
                    raise ValueError(f"{least} is no id")
                dtype = _dtype(most)
            stream = _stream(texts, dtype)
            n = _sequences(len(stream), length)
            row = [pa.array([x], pa.int64()) for x in (part, done, n, most)]
            yield pa.RecordBatch.from_arrays([*row, pa.array([compress(stream.tobytes())], pa.binary())], names=["part", "first", "n", "most", "data"])
            done += n

    source = docs.select(F.col(ids).cast("array<int>").alias("ids")) if ids else doc_key(docs)
    return pin(source.mapInArrow(store, "part long, first long, n long, most long, data binary"))


def materialise(
    docs: DataFrame, length: int = 1024, per_shard: int = 8192, key: int = 42, folder: str | None = None, ids: str | None = None, vocabulary_file: str | None = None
) -> Layout:
    """Write every text of `docs` into shards under `folder`; a task takes one shard at a time.

    `ids` names a column of token ids (array<int>), as bpe.encode makes; `vocabulary_file` encodes `text` on the way instead; without
    either the bytes of `text` are written. Negative ids and NULLs among the ids of a text are refused.

    The input is read once. Its packed streams are stored, and sequences are numbered by the stored table: a piece's number
    within its task lies beside it, and the tasks' own first numbers are running sums of their counts, one number for each
    partition of the input, which is all that is sent around. So a task that runs again numbers its sequences alike.
    NULL and empty texts are a closing id; repeated rows and ids are written as often as they come; no rows make no shards.
    """
    spark = docs.sparkSession
    folder = folder or f"{shared_folder(spark)}/shards-{uuid.uuid4().hex}"
    stored = streams(docs, length, ids, vocabulary_file)
    parts = stored.groupBy("part").agg(F.sum("n").alias("n"), F.max("most").alias("most")).orderBy("part").collect()
    total = sum(r.n for r in parts)
    dtype = _dtype(max((r.most for r in parts), default=0)) if ids or vocabulary_file else "<u1"
    layout = Layout(folder, total, length, per_shard, key, dtype)
    stride = layout.stride
    names = np.array([r.part for r in parts], np.int64)
    begin = np.cumsum([0, *(r.n for r in parts)], dtype=np.int64)
    offsets, order = spark.sparkContext.broadcast((names, begin)), Permutation(total, key)

    def scatter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, begin = offsets.value
        for batch in batches:
            for part, first, n, most, data in zip(*(batch.column(i) for i in range(5)), strict=True):
                held = np.frombuffer(zstandard.ZstdDecompressor().decompress(data.as_buffer()), "<u1" if dtype == "<u1" else _dtype(most.as_py()))
                n, first = n.as_py(), first.as_py() + int(begin[np.searchsorted(names, part.as_py())])
                cut = np.full(n * length, np.iinfo(dtype).max, dtype)
                cut[: len(held)] = held
                if held.dtype != dtype:  # the closing number of narrow pieces is no id there
                    cut[: len(held)][held == np.iinfo(held.dtype).max] = np.iinfo(dtype).max
                cut = cut.view(np.uint8).reshape(n, stride)
                slots = order.slot(np.arange(first, first + n))
                by = np.argsort(slots, kind="stable")
                shards = slots[by] // per_shard
                edges = [0, *(np.flatnonzero(np.diff(shards)) + 1).tolist(), n]
                blobs = [_pack(slots[by[a:b]] % per_shard, cut[by[a:b]]) for a, b in zip(edges, edges[1:])]
                yield pa.RecordBatch.from_arrays([pa.array(shards[edges[:-1]], pa.int64()), pa.array(blobs, pa.binary())], names=["shard", "data"])

    def gather(group: tuple, blobs: pd.DataFrame) -> pd.DataFrame:
        held = min(per_shard, order.n - group[0] * per_shard)
        out = np.empty((held, stride), np.uint8)
        for blob in blobs["data"]:
            places, held_ids = _unpack(blob, stride)
            out[places] = held_ids
        return pd.DataFrame({"shard": [group[0]], "content": [out.tobytes()]})

    blobs = stored.mapInArrow(scatter, "shard long, data binary")
    files = blobs.groupBy("shard").applyInPandas(gather, "shard long, content binary")
    # The text writer puts the bytes into the file as they are and one newline after the last sequence.
    files.select("shard", F.col("content").cast("string").alias("value")).write.partitionBy("shard").option("compression", "none").mode("overwrite").text(folder)
    return layout


def _pack(places: np.ndarray, ids: np.ndarray) -> bytes:
    out = io.BytesIO()
    batch = pa.RecordBatch.from_arrays([pa.array(places.astype(np.int32)), pa.FixedSizeBinaryArray.from_buffers(pa.binary(ids.shape[1]), len(ids), [None, pa.py_buffer(np.ascontiguousarray(ids))])], names=["place", "ids"])
    with pa.ipc.new_stream(out, batch.schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", compression_level=3))) as w:
        w.write_batch(batch)
    return out.getvalue()


def _unpack(blob: bytes, stride: int) -> tuple[np.ndarray, np.ndarray]:
    batch = pa.ipc.open_stream(blob).read_next_batch()
    ids = np.frombuffer(batch.column(1).buffers()[1], np.uint8)[: batch.num_rows * stride].reshape(-1, stride)
    return batch.column(0).to_numpy(), ids


def read(spark, layout: Layout, start: int = 0) -> DataFrame:
    """slot, ids (binary, ids of the layout's dtype one after another) from slot `start` on; only the shards that hold them are opened."""
    if layout.sequences <= start:
        return spark.createDataFrame([], "slot long, shard long, ids binary")
    stride, per_shard = layout.stride, layout.per_shard

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                view = content.as_buffer()
                n = view.size // stride
                skip = max(0, start - shard * per_shard)
                if n > skip:
                    ids = pa.FixedSizeBinaryArray.from_buffers(pa.binary(stride), n, [None, view]).slice(skip).cast(pa.binary())
                    slots = np.arange(shard * per_shard + skip, shard * per_shard + n)
                    yield pa.RecordBatch.from_arrays([pa.array(slots), pa.array(np.full(n - skip, shard)), ids], names=["slot", "shard", "ids"])

    files = spark.read.format("binaryFile").load(layout.folder).where(F.col("shard") >= start // per_shard)
    return files.select(F.col("shard").cast("long"), "content").mapInArrow(cut, "slot long, shard long, ids binary")
