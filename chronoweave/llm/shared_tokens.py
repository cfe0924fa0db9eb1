"""Which tokens of a text other texts have too, and how many have them.

Equal texts (or equal token sets) are one class from the start, so a group of copies counts once. Tokens travel in packed
pieces, a range of tokens to each task, which counts classes per token and sends back only what at least two classes hold.
A token that a great share of all classes holds would fill one task; those are found beforehand by counts that are summed within
each piece, and stay out of the exchange. There are at most 2 * tokens / (their least count) of them, whatever the input.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoweave.session import pin

from .common import doc_key, groups_of_bytes

PIECE = 8 << 20
TOKENS_PER_RANGE = 2_000_000
LEAST_HOT = 1000
HOT_SHARE = 0.001
MOST_HOT = 2_000_000
HOT = 1 << 40  # stands for the count of a token that was kept out: it comes after all others

Tokens = Callable[[bytes], np.ndarray]


@dataclass(frozen=True)
class Shared:
    """rows: (doc_id, class, n), one for each row of the input. sets: (class, n, n_single, tokens, counts) of every class with shared
    tokens, ordered by count and then token; tokens with HOT counts come last."""

    rows: DataFrame
    sets: DataFrame
    shift: int  # an identity in `sets` is a token without this many low bits


def class_of(data: bytes) -> int:
    return xxhash.xxh3_64_intdigest(data)


def with_class(docs: DataFrame, packed: bool = False) -> DataFrame:
    """class, doc_id and text (bytes) of every row, where equal texts are a class; `packed` texts are for `unpacked`."""

    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        smaller = zstandard.ZstdCompressor(level=1).compress
        for batch in batches:
            texts = [t.as_py() or b"" for t in batch.column(1)]
            classes = np.array(list(map(class_of, texts)), np.uint64).view(np.int64)
            held = pa.array(map(smaller, texts), pa.binary()) if packed else batch.column(1)
            yield pa.RecordBatch.from_arrays([pa.array(classes), batch.column(0), held], names=["class", "doc_id", "text"])

    return doc_key(docs).mapInArrow(named, "class long, doc_id long, text binary")


def unpacked(text: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(text)


def _signed(x: np.ndarray) -> np.ndarray:
    return np.asarray(x, np.uint64).view(np.int64)


def shared_tokens(docs: DataFrame, tokens_of: Tokens, by_text: bool) -> Shared:
    """Classes are equal texts if `by_text`, else equal token sets. tokens_of(text) gives distinct sorted 64-bit tokens, which must be
    spread evenly: each task counts a range of one width."""
    spark = docs.sparkSession
    source = doc_key(docs)
    n_docs = source.count()
    least = max(LEAST_HOT, HOT_SHARE * n_docs)
    rate = least / max(n_docs, 1)

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in groups_of_bytes(batches, PIECE):
            seen, classes, sizes = {}, [], []
            for text in texts:
                if text in seen:
                    c, n, _ = seen[text]
                else:
                    t = tokens_of(text)
                    c, n = class_of(text if by_text else t.tobytes()), len(t)
                    seen[text] = (c, n, t)
                classes.append(c)
                sizes.append(n)
            yield _rows(np.zeros(len(ids), np.int8), ids, _signed(np.array(classes, np.uint64)), np.array(sizes, np.int64))
            own = [t for _, _, t in {c: x for x in seen.values() for c in [x[0]]}.values()]
            tokens, counts = np.unique(np.concatenate(own) if own else np.empty(0, np.uint64), return_counts=True)
            often = counts >= max(2, rate * len(own) / 2)
            if often.any():
                yield _rows(np.ones(often.sum(), np.int8), _signed(tokens[often]), counts[often], np.zeros(often.sum(), np.int64))

    passed = pin(source.mapInArrow(first, "kind byte, doc_id long, class long, n long"))
    rows = passed.where("kind = 0").select("doc_id", "class", "n")
    hot = passed.where("kind = 1").groupBy(F.col("doc_id").alias("token")).agg(F.sum("class").alias("count")).where(F.col("count") >= least / 2)
    hot = np.sort(np.array([r.token for r in hot.orderBy(F.desc("count"), "token").limit(MOST_HOT).collect()], np.int64).view(np.uint64))
    total = rows.agg(F.sum("n")).first()[0] or 0
    ranges, buckets = max(12, total // TOKENS_PER_RANGE + 1), max(12, total // TOKENS_PER_RANGE + 1)
    shared_hot = spark.sparkContext.broadcast(hot)

    # 40 bits tell the tokens of one range apart, so an identity has 40 bits and the range's own, 63 at a million ranges.
    shift = np.uint64(max(0, 24 - (ranges - 1).bit_length()))
    width = np.uint64((2**64 >> int(shift)) // ranges + 1)

    def identities(text: bytes) -> tuple[int, np.ndarray]:
        t = tokens_of(text)
        return class_of(text if by_text else t.tobytes()), t

    def scatter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot = shared_hot.value
        for _, texts in groups_of_bytes(batches, PIECE):
            sets = {c: t for c, t in map(identities, set(texts)) if len(t)}
            if not sets:
                continue
            classes, sizes = np.array(list(sets), np.uint64), np.array([len(t) for t in sets.values()], np.int64)
            tokens, owner = np.concatenate(list(sets.values())), np.repeat(np.arange(len(sets)), sizes)
            kept_out = np.isin(tokens, hot) if len(hot) else np.zeros(len(tokens), bool)
            keys, data = [], []
            to = (classes % np.uint64(buckets)).astype(np.int64)
            for b in np.unique(to):
                mine = kept_out & (to[owner] == b) if kept_out.any() else kept_out
                keys.append(ranges + int(b))
                data.append(pack(classes[to == b], sizes[to == b], classes[owner[mine]], tokens[mine] >> shift))
            tokens, owner = tokens[~kept_out] >> shift, owner[~kept_out]
            by = np.argsort(tokens, kind="stable")
            tokens, owner = tokens[by], owner[by]
            edges = np.searchsorted(tokens, np.arange(ranges + 1, dtype=np.uint64) * width)
            for r in range(ranges):
                a, b = edges[r], edges[r + 1]
                if b > a:
                    here, local = np.unique(owner[a:b], return_inverse=True)
                    keys.append(r)
                    data.append(pack(classes[here], local.astype(np.uint32), np.diff(tokens[a:b], prepend=np.uint64(0))))
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int32()), pa.array(data, pa.binary())], names=["part", "data"])

    def count(key: tuple, blobs: pa.Table) -> pa.Table:
        part, data = key[0].as_py(), blobs.column("data")
        if part >= ranges:  # sizes and kept-out tokens pass through to their classes
            return pa.table({"bucket": pa.array([part - ranges] * len(data), pa.int32()), "data": data})
        pieces = [unpack(b.as_py()) for b in data]
        owner = np.concatenate([classes[local] for classes, local, _ in pieces])
        token = np.concatenate([np.cumsum(steps) for _, _, steps in pieces])
        by = np.lexsort((owner, token))
        owner, token = _distinct(owner[by], token[by])
        edges = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1], [True]]))
        n = np.repeat(np.diff(edges), np.diff(edges))
        owner, token, n = owner[n > 1], token[n > 1], n[n > 1]
        to = (owner % np.uint64(buckets)).astype(np.int64)
        found = np.unique(to)
        data = [pack(owner[to == b], token[to == b], n[to == b]) for b in found]
        return pa.table({"bucket": pa.array(found.astype(np.int32)), "data": pa.array(data, pa.binary())})

    def collect(key: tuple, blobs: pa.Table) -> pa.Table:
        parts = [unpack(b.as_py()) for b in blobs.column("data")]
        heads, replies = [p for p in parts if len(p) == 4], [p for p in parts if len(p) == 3]
        classes, at = np.unique(np.concatenate([h[0] for h in heads]), return_index=True)
        size = np.concatenate([h[1] for h in heads])[at]
        owner = np.concatenate([h[2] for h in heads] + [r[0] for r in replies])
        token = np.concatenate([h[3] for h in heads] + [r[1] for r in replies])
        n = np.concatenate([np.full(len(h[2]), HOT, np.int64) for h in heads] + [r[2] for r in replies])
        by = np.lexsort((token, n, owner))
        owner, token, n = _distinct(owner[by], token[by], n[by])
        left, right = np.searchsorted(owner, classes), np.searchsorted(owner, classes, "right")
        some = np.flatnonzero(right > left)
        ends = pa.array(np.concatenate([[0], np.cumsum((right - left)[some])]).astype(np.int32))
        lists = [pa.ListArray.from_arrays(ends, pa.array(x)) for x in (_signed(token), n)]  # classes without shared tokens have none
        return pa.table(
            {"class": pa.array(_signed(classes[some])), "n": pa.array(size[some]), "n_single": pa.array(size[some] - (right - left)[some]), "tokens": lists[0], "counts": lists[1]}
        )

    replies = source.mapInArrow(scatter, "part int, data binary").groupBy("part").applyInArrow(count, "bucket int, data binary")
    sets = replies.groupBy("bucket").applyInArrow(collect, "class long, n long, n_single long, tokens array<long>, counts array<long>")
    return Shared(rows, sets, int(shift))


def _distinct(owner: np.ndarray, token: np.ndarray, *more: np.ndarray) -> list[np.ndarray]:
    """Sorted neighbours that are equal in class and token come once."""
    fresh = np.ones(len(token), bool)
    fresh[1:] = (token[1:] != token[:-1]) | (owner[1:] != owner[:-1])
    return [x[fresh] for x in (owner, token, *more)]


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays of whole numbers, byte plane by byte plane, compressed: small steps between sorted tokens take few bytes."""
    planes = [(str(x.dtype), np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.itemsize).T).tobytes()) for x in map(np.ascontiguousarray, arrays)]
    return zstandard.ZstdCompressor(level=1).compress(pickle.dumps(planes))


def unpack(data: bytes) -> list[np.ndarray]:
    out = []
    for kind, plane in pickle.loads(zstandard.ZstdDecompressor().decompress(data)):
        width = np.dtype(kind).itemsize
        out.append(np.ascontiguousarray(np.frombuffer(plane, np.uint8).reshape(width, -1).T).reshape(-1).view(kind))
    return out


def _rows(*columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [pa.int8(), pa.int64(), pa.int64(), pa.int64()], strict=True)], names=["kind", "doc_id", "class", "n"])
