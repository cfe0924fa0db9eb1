"""Operator 11, packing: best-fit decreasing per partition, certified by lower bounds, with repacking where a gap is left.

Pieces of at most `capacity` tokens are dealt over partitions and packed there by best-fit decreasing. Dual feasible functions
give a lower bound on the bins any packing of the same pieces needs; where the count equals the bound, the partition is done.
Partitions with a gap hand in the pieces of their bins that aren't full, and done ones those of their emptiest bin, since
bounds round up once per partition. What was handed in is dealt anew, so that pieces of different partitions meet, and is
packed again, until the whole table's count equals the whole table's bound. Where a round saves nothing, the next one takes
all bins that aren't full; where that saves nothing either, packing ends.
"""

from __future__ import annotations

import hashlib
import json
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoweave.session import pin

from .bpe import byte_names
from .common import doc_key

# Fixed value: the pattern that cuts a text into words before the public byte-level vocabulary is applied.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
FUNCTIONS = 64


def lower_bound(counts: np.ndarray, capacity: int, functions: int = FUNCTIONS) -> int:
    """No packing of `counts[s]` pieces of size s takes fewer bins than this.

    A dual feasible function maps sizes so that what fits into a bin still sums to at most 1. U(e) counts sizes above
    capacity - e as whole bins and leaves out those below e; u(k) rounds the sizes between to k-ths. All pairs of e up to half
    a bin and k up to `functions` are tried, the plain sum (no rounding) too, in whole numbers.
    """
    counts = np.asarray(counts, np.int64)[: capacity + 1]
    size = np.arange(capacity + 1, dtype=np.int64)
    e = np.arange(capacity // 2 + 1)
    upto = np.concatenate([[0], np.cumsum(counts)])
    big = upto[-1] - upto[capacity - e + 1]
    best = 0
    for k in range(functions + 1):
        if k == 0:
            value, whole = size, capacity
        else:
            value, whole = np.where((k + 1) * size % capacity == 0, k * size, (k + 1) * size // capacity * capacity), k * capacity
        sums = np.concatenate([[0], np.cumsum(counts * value)])
        between = sums[capacity - e + 1] - sums[e]
        best = max(best, int((big - (-between // whole)).max()))
    return best


def best_fit_decreasing(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Each piece's bin and its offset there. Pieces go in falling size (equal ones in their order) into the fullest bin that
    has room. Bins are kept by their room, and as many equal pieces as fit go into a bin at once, which is what one by one
    does too."""
    n = len(sizes)
    order = np.argsort(-sizes, kind="stable")
    bins = np.empty(n, np.int64)
    rooms: list[list[int]] = [[] for _ in range(capacity + 1)]
    held = np.zeros(capacity + 1, np.int64)
    at = made = 0
    values, counts = np.unique(sizes, return_counts=True)
    for size, left in zip(values[::-1].tolist(), counts[::-1].tolist()):
        for room in (np.flatnonzero(held[size:]) + size).tolist():
            row = rooms[room]
            while row and left:
                fit = min(room // size, left)
                bins[at : at + fit] = row[-1]
                rooms[room - fit * size].append(row.pop())
                held[room] -= 1
                held[room - fit * size] += 1
                at, left = at + fit, left - fit
            if not left:
                break
        while left:
            fit = min(capacity // size, left)
            bins[at : at + fit] = made
            rooms[capacity - fit * size].append(made)
            held[capacity - fit * size] += 1
            at, left, made = at + fit, left - fit, made + 1
    where = np.empty(n, np.int64)
    where[order] = bins
    inside = np.argsort(bins, kind="stable")
    ends = np.cumsum(sizes[order][inside])
    starts = ends - sizes[order][inside]
    first = np.searchsorted(bins[inside], bins[inside], "left")
    offsets = np.empty(n, np.int64)
    offsets[order[inside]] = starts - starts[first]
    return where, offsets


def vocabulary(content: str) -> tuple:
    """A byte-level BPE vocabulary in the JSON form of the tokenizers library, as little as a worker needs to hold of it.

    The special tokens, the ids, the tokens' bytes end to end, and their lengths; the file's content instead where ids don't
    follow the order of merging, which only that library reads.
    """
    spec = json.loads(content)
    special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
    vocab, names = spec["model"]["vocab"], byte_names()
    pairs = [p.split(" ") if isinstance(p, str) else p for p in spec["model"]["merges"]]
    made = [vocab[a + b] for a, b in pairs]
    top = max([*vocab.values(), *special.values()])
    if made != sorted(made):
        return top, content
    tokens = [(i, bytes(names[c] for c in name)) for name, i in vocab.items() if name not in special]
    ids, sizes = np.array([i for i, _ in tokens], np.uint32), np.array([len(t) for _, t in tokens], np.uint16)
    return top, special, ids, b"".join(t for _, t in tokens), sizes


def encoder(table: tuple):
    """text -> ids, as the tokenizers library gives them."""
    if len(table) == 2:
        from tokenizers import Tokenizer

        library = Tokenizer.from_str(table[1])
        library.no_truncation()
        library.no_padding()
        return lambda text: np.array(library.encode(text, add_special_tokens=False).ids, np.uint32)
    import tiktoken

    _, special, ids, data, sizes = table
    ends = np.cumsum(sizes, dtype=np.int64).tolist()
    ranks = {data[a:b]: i for a, b, i in zip([0, *ends], ends, ids.tolist())}
    fast = tiktoken.Encoding("pieces", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=special)
    return lambda text: fast.encode_to_numpy(text, allowed_special="all")


_loaded: dict[str, object] = {}


def pieces(docs: DataFrame, path: str, capacity: int = 2048, end_id: int = 0) -> DataFrame:
    """_uid, doc_id, piece, start, length, ids_crc32, ids: every text's ids and `end_id`, cut only if longer than `capacity`.

    All pieces of a cut text but the first have `capacity` ids. `ids` holds little-endian 16-bit numbers, or 32-bit ones for a
    vocabulary beyond 65,536. The table is stored, and `_uid` names its rows. NULL and empty texts are the end alone; repeated
    rows and NULL doc_ids are rows like others; no rows give no pieces; other columns aren't read.
    """
    with open(path, encoding="utf-8") as f:
        content = f.read()
    name, table = hashlib.sha256(content.encode()).hexdigest(), vocabulary(content)
    width = "<u2" if max(table[0], end_id) < 1 << 16 else "<u4"
    shared = docs.sparkSession.sparkContext.broadcast(table)  # a vocabulary has a fixed size, under 1 MB here

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if name not in _loaded:  # one per worker process, for its next tasks too
            _loaded.clear()
            _loaded[name] = encoder(shared.value)
        encode = _loaded[name]
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part, rows = batch.slice(at, 512), []
                for doc, text in zip(part.column(0).to_pylist(), part.column(1)):
                    ids = np.append(encode((text.as_py() or b"").decode("utf-8", "replace")), np.uint32(end_id))
                    begin, piece = 0, 0
                    while begin < len(ids):
                        rest = len(ids) - begin
                        cut = ids[begin : begin + (rest if rest <= capacity else rest % capacity or capacity)].astype("<u4")
                        rows.append((doc, piece, begin, len(cut), zlib.crc32(cut.tobytes()), cut.astype(width).tobytes()))
                        begin, piece = begin + len(cut), piece + 1
                kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=["doc_id", "piece", "start", "length", "ids_crc32", "ids"]
                )

    cut = doc_key(docs).mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long, ids binary")
    return pin(cut.select(F.monotonically_increasing_id().alias("_uid"), "*"))


@dataclass(frozen=True)
class Packing:
    placed: DataFrame  #: the pieces' columns without `ids`, then sequence_id and offset
    sequences: int
    bound: int  #: no packing of these pieces has fewer sequences


def _pack_partition(capacity: int, stage: int, columns: list[str]):
    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("_uid")
        sizes = table.column("length").to_numpy().astype(np.int64)
        where, offset = best_fit_decreasing(sizes, capacity)
        used = np.bincount(where, sizes.astype(np.float64)).astype(np.int64)
        gap = len(used) - lower_bound(np.bincount(sizes, minlength=capacity + 1), capacity)
        hand_in = np.where(used < capacity, 2 if gap else 1, 0).astype(np.int32)
        if used.min() < capacity:
            hand_in[np.argmin(used)] = 2
        name = (np.int64(stage) << 56) + (table.column("_part").to_numpy().astype(np.int64) << 24) + where
        return pa.table(
            [*[table.column(c) for c in columns], pa.array(name), pa.array(offset), pa.array(hand_in[where])],
            names=[*columns, "sequence_id", "offset", "_hand_in"],
        )

    return run


def pack(items: DataFrame, capacity: int = 2048, rows: int = 20_000, rounds: int = 8) -> Packing:
    """Sequences of at most `capacity` tokens for a stored table of `_uid`, `length` (1 to `capacity`) and other columns.

    A task holds about `rows` pieces, whatever their number or their lengths. Pieces that fill a sequence need no packing.
    Sequence numbers have gaps. No pieces give no rows and a bound of 0.
    """
    items = items.drop("ids")
    counts = np.zeros(capacity + 1, np.int64)
    for length, n in items.groupBy("length").count().collect():  # at most `capacity` rows
        counts[length] = n
    bound, whole = lower_bound(counts, capacity), int(counts[capacity])
    full = items.where(F.col("length") == capacity)
    done = [full.withColumns({"sequence_id": -1 - F.col("_uid"), "offset": F.lit(0).cast("long")})]
    columns = items.columns
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in items.schema)

    def packed(frame: DataFrame, n: int, stage: int) -> tuple[DataFrame, int]:
        parts = -(-n // rows)
        dealt = frame.withColumn("_part", F.pmod(F.xxhash64("_uid", F.lit(stage)), F.lit(parts)).cast("int"))
        run = _pack_partition(capacity, stage, columns)
        out = dealt.groupBy("_part").applyInArrow(run, f"{schema}, sequence_id long, offset long, _hand_in int")
        out = pin(out)
        return out, out.where(F.col("offset") == 0).count()

    n, bins, asked = int(counts.sum()) - whole, 0, 2
    if n:
        current, bins = packed(items.where(F.col("length") < capacity), n, 1)
        for stage in range(2, rounds + 2):
            if whole + bins <= bound or asked == 0:
                break
            handed = current.where(F.col("_hand_in") >= asked)
            n, before = handed.agg(F.count(F.lit(1)), F.count_if(F.col("offset") == 0)).first()
            again, after = packed(handed.select(*columns), n, stage) if before > 1 else (None, before)
            if after >= before:
                asked -= 1
                continue
            done.append(current.where(F.col("_hand_in") < asked).drop("_hand_in"))
            current, bins, asked = again, bins - before + after, 2
        done.append(current.drop("_hand_in"))
    placed = done[0]
    for more in done[1:]:
        placed = placed.unionByName(more)
    return Packing(placed, whole + bins, bound)


def sequences(packing: Packing, cut: DataFrame) -> DataFrame:
    """sequence_id, doc_ids, length, ids: the packed sequences themselves, pieces in their places (at most `capacity` ids each)."""
    parts = packing.placed.select("_uid", "doc_id", "sequence_id", "offset", "length").join(cut.select("_uid", "ids"), "_uid")
    rows = F.array_sort(F.collect_list(F.struct("offset", "doc_id", "ids")))
    joined = parts.groupBy("sequence_id").agg(rows.alias("_rows"), F.sum("length").alias("length"))
    ids = F.aggregate("_rows", F.lit(b""), lambda seen, row: F.concat(seen, row.ids))
    return joined.select("sequence_id", F.col("_rows.doc_id").alias("doc_ids"), "length", ids.alias("ids"))
