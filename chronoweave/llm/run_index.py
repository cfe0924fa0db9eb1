"""Operator 3, suffix-array dedup: a run-length index.

Only text that another document may have too is indexed. A 50-byte string has one minimizer, the least hash among its 24-byte
strings, so neighbouring strings with the same minimizer form a segment, and equal strings lie in segments of equal minimizers.
Minimizers of one text alone are dropped; equal segments are one, with the least document that has it. The segments of
some minimizers at a time make a run-length Burrows-Wheeler transform with suffix samples at both ends of each run; every segment
is streamed through it for its matching statistics, and where a match is long enough, the least document of the suffixes that
share it is known. A document loses the bytes of strings whose least document comes before it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoweave.session import pin, pin_measured

from .common import mix
from .shared_tokens import shared_tokens, unpacked, with_class

LENGTH, GRAM = 50, 24
WIDTH = LENGTH - GRAM + 1
BUCKET = 1 << 20
MOST_SEGMENTS = 8000


def gram_hashes(text: bytes) -> np.ndarray:
    """A 64-bit hash of the GRAM bytes from every place on."""
    n = len(text) - GRAM + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    eight = _words_at(np.frombuffer(text, np.uint8))
    h = np.zeros(n, np.uint64)
    for at, odd in ((0, 0x9E3779B97F4A7C15), (8, 0xD6E8FEB86659FD93), (16, 0xFF51AFD7ED558CCD)):
        h += eight[at : at + n]
        h *= np.uint64(odd)
        h ^= h >> np.uint64(32)
    return h * np.uint64(0xC4CEB9FE1A85EC53)


def _words_at(data: np.ndarray) -> np.ndarray:
    """The eight bytes from every place on, as a number."""
    return np.lib.stride_tricks.as_strided(data[:8].view("<u8"), (len(data) - 7,), (1,))


def minimizers(h: np.ndarray) -> np.ndarray:
    """For each 50-byte string, the least hash among its grams."""
    if len(h) < WIDTH:
        return h[:0]
    step = 1
    while step < WIDTH:
        shift = min(step, WIDTH - step)
        h = np.minimum(h[:-shift], h[shift:])
        step += shift
    return h


def _runs(least: np.ndarray) -> np.ndarray:
    """Where runs of strings with one minimizer begin, and the end of the last; longer runs are cut after each `WIDTH` strings."""
    edges = np.flatnonzero(np.concatenate([[True], least[1:] != least[:-1], [True]]))
    parts = -(-np.diff(edges) // WIDTH)
    if parts.max() > 1:
        part = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
        edges = np.append(np.repeat(edges[:-1], parts) + WIDTH * part, len(least))
    return edges


def anchors(text: bytes) -> np.ndarray:
    """The minimizers, as tokens: least hashes are small numbers, so they are spread over all again."""
    least = minimizers(gram_hashes(text))
    return np.unique(mix(least[_runs(least)[:-1]])) if len(least) else least


def segments(text: bytes, tokens: np.ndarray, shift: int) -> Iterator[tuple[int, int, bytes]]:
    """(minimizer, first byte, bytes) of the runs of strings whose minimizer is among the shared `tokens`."""
    least = minimizers(gram_hashes(text))
    if not len(least):
        return
    edges = _runs(least)
    names = mix(least[edges[:-1]]) >> np.uint64(shift)
    some = np.flatnonzero(np.isin(names, tokens))
    for name, a, b in zip(names[some].tolist(), edges[some].tolist(), edges[some + 1].tolist(), strict=True):
        yield name, a, text[a : b - 1 + LENGTH]


def _sorted(key: np.ndarray) -> np.ndarray:
    """The places of the keys (none negative) in order, equal ones as they come: by one sort of plain numbers that hold both, if they fit."""
    bits = (len(key) - 1).bit_length()
    if int(key.max()).bit_length() + bits > 63:
        return np.argsort(key, kind="stable")
    return np.sort(key << bits | np.arange(len(key))) & ((1 << bits) - 1)


class RunIndex:
    """A run-length BWT of short texts, each with an end of its own, and the least owner of every `LENGTH`-byte string."""

    def __init__(self, texts: list[bytes], owners: np.ndarray):
        self.size = np.array([len(t) for t in texts])
        self.row = int(self.size.max()) + 8 * 11
        flat = np.frombuffer(b"".join(t.ljust(self.row, b"\0") for t in texts) + bytes(8 * 11), np.uint8)
        self.flat, self.eight = flat, np.ascontiguousarray(_words_at(flat))
        text = np.repeat(np.arange(len(texts)), self.size + 1)
        offset = np.arange(len(text)) - np.repeat(np.cumsum(self.size + 1) - self.size - 1, self.size + 1)
        place, left = text * self.row + offset, self.size[text] - offset
        order, ranks = self._ordered(place, left)
        self._least(ranks, place, left, text, order, owners)
        # The transform: the byte before each suffix, 256 before a text's first byte.
        before = np.where(offset > 0, flat[np.maximum(place - 1, 0)].astype(np.int64), 256)[order]
        heads = np.flatnonzero(np.concatenate([[True], before[1:] != before[:-1]]))
        self.heads, self.symbol = heads, before[heads]
        lengths = np.diff(np.append(heads, len(before)))
        self.first_at, self.last_at = place[order[heads]], place[order[heads + lengths - 1]]  # the samples
        self.tails = heads + lengths - 1
        self.run_of = np.repeat(np.arange(len(heads)), lengths)
        by = np.argsort(self.symbol, kind="stable")
        run_sum = np.cumsum(lengths[by]) - lengths[by]
        group = np.searchsorted(self.symbol[by], self.symbol[by])
        self.earlier = np.empty(len(heads), np.int64)
        self.earlier[by] = run_sum - run_sum[group]
        counts = np.bincount(before, minlength=257)[:256]
        self.less = len(texts) + np.concatenate([[0], np.cumsum(counts)])[:256].astype(np.int64)
        self.keys = self.symbol[by] * len(heads) + by  # runs by symbol, then place

    def _ordered(self, place: np.ndarray, left: np.ndarray) -> tuple[np.ndarray, dict[int, np.ndarray]]:
        """The suffixes in order, by doubling, and by width the rank of the bytes from every place on; of equal ones the first text's."""
        # Five bytes first: after three doublings two widths make a string, and a key and a place fit one number.
        ranks, width, key = {}, 5, (self.eight[place].byteswap() >> np.uint64(24)).astype(np.int64)
        while True:
            by = _sorted(key)
            held = key[by]
            rank = np.empty(len(by), np.int64)
            rank[by] = np.cumsum(np.concatenate([[0], held[1:] != held[:-1]]))
            if width >= self.size.max():
                return _sorted(rank * (int(left.max()) + 1) + left), ranks
            ranks[width] = np.zeros(len(self.flat), np.int64)  # after a text's end as at its end, where no bytes are left
            ranks[width][place] = rank
            key = rank * (len(place) + 1) + np.where(left > width, ranks[width][np.minimum(place + width, len(self.flat) - 1)], 0)
            width *= 2

    def _least(self, ranks, place, left, text, order, owners) -> None:
        whole = left[order] >= LENGTH
        same, at, done = whole[1:] & whole[:-1], place[order], 0
        for width in sorted(ranks, reverse=True):
            while LENGTH - done >= width:
                rank = ranks[width][np.where(whole, at + done, at)]
                same &= rank[1:] == rank[:-1]
                done += width
        if done < LENGTH:
            last = self.eight[np.where(whole, at + done, at)] << np.uint64(8 * (8 - LENGTH + done))
            same &= last[1:] == last[:-1]
        starts = np.flatnonzero(np.concatenate([[True], ~same]))
        least = np.minimum.reduceat(owners[text[order]], starts)
        self.least = np.repeat(least, np.diff(np.append(starts, len(order))))

    def _step(self, rows: np.ndarray, runs: np.ndarray) -> np.ndarray:
        return self.less[self.symbol[runs]] + self.earlier[runs] + rows - self.heads[runs]

    def _common(self, pattern: np.ndarray, place: np.ndarray, most: np.ndarray) -> np.ndarray:
        """How many bytes from `place` to its text's end equal the bytes of the pattern, up to `most`."""
        most = np.minimum(most, self.size[place // self.row] - place % self.row)
        length = np.zeros(len(most), np.int64)
        on = np.flatnonzero(most > 0)
        while len(on):
            other = self.eight[pattern[on] + length[on]] ^ self.eight[place[on] + length[on]]
            same = other == 0
            lowest = np.where(same, np.uint64(1), other & (~other + np.uint64(1)))
            length[on] += np.where(same, 8, np.log2(lowest.astype(np.float64)).astype(np.int64) // 8)
            on = on[same & (length[on] < most[on])]
        return np.minimum(length, most)

    def statistics(self) -> list[np.ndarray]:
        """For each text and each of its places, the least owner of the LENGTH bytes from there on (those of the longest match)."""
        n, runs = len(self.size), len(self.heads)
        rows, length = np.zeros(n, np.int64), np.zeros(n, np.int64)
        strings = np.maximum(self.size - LENGTH + 1, 0)
        ends = np.cumsum(strings)
        out, last = np.full(ends[-1], -1, np.int64), ends - strings + self.size
        for back in range(1, int(self.size.max()) + 1):
            on = np.flatnonzero(self.size >= back)
            place = on * self.row + self.size[on] - back
            c = self.flat[place].astype(np.int64)
            run = self.run_of[rows[on]]
            jump = np.flatnonzero(self.symbol[run] != c)
            if len(jump):
                who, r = on[jump], run[jump]
                at = np.searchsorted(self.keys, c[jump] * runs + r)
                up, down = np.maximum(at - 1, 0), np.minimum(at, runs - 1)
                has_up, has_down = (at > 0) & (self.keys[up] // runs == c[jump]), (at < runs) & (self.keys[down] // runs == c[jump])
                up, down = self.keys[up] % runs, self.keys[down] % runs
                rest, most = place[jump] + 1, length[who]
                above = np.where(has_up, self._common(rest, self.last_at[up], most), -1)
                below = np.where(has_down, self._common(rest, self.first_at[down], most), -1)
                higher = above >= below
                rows[who] = np.where(higher, self.tails[up], self.heads[down])
                length[who] = np.where(higher, above, below)  # every byte of a text stands somewhere in the index
                run[jump] = np.where(higher, up, down)
            rows[on] = self._step(rows[on], run)
            length[on] += 1
            long = on[length[on] >= LENGTH]
            out[last[long] - back] = self.least[rows[long]]
        return np.split(out, ends[:-1])


def _owners(key: tuple, held: pa.Table) -> pa.Table:
    """The least document of every string of the segments in a bucket, but of those that only their own document has."""
    token, least, n = (held.column(c).to_numpy() for c in ("token", "least", "n"))
    _, of, per = np.unique(token, return_inverse=True, return_counts=True)
    # A segment alone with its minimizer needs no index: its least document has all its strings first.
    alone = np.flatnonzero((per[of] == 1) & (n > 1))
    many = np.flatnonzero(per[of] > 1)
    content = held.column("content")
    size = pc.binary_length(content).to_numpy()
    found = [np.full(x - LENGTH + 1, y) for x, y in zip(size[alone].tolist(), least[alone].tolist(), strict=True)]
    if len(many):
        indexed = RunIndex(content.take(pa.array(many)).to_pylist(), least[many]).statistics()
        some = [k for k, (own, x) in enumerate(zip(indexed, many.tolist(), strict=True)) if n[x] > 1 or own.min() < least[x]]
        found += [indexed[k] for k in some]
        many = many[some]
    ends = pa.array(np.concatenate([[0], np.cumsum([len(x) for x in found])]).astype(np.int32))
    rows = held.select(["token", "name"]).take(pa.array(np.concatenate([alone, many])))
    values = pa.array(np.concatenate(found) if found else np.empty(0, np.int64), pa.int64())
    return rows.append_column("owners", pa.ListArray.from_arrays(ends, values))


def owners(parts: DataFrame) -> DataFrame:
    """(token, name, owners) of the segments that have a string which an earlier document may have too."""
    held = parts.groupBy("token", "content").agg(F.min("doc").alias("least"), F.count(F.lit(1)).alias("n")).withColumn("name", F.xxhash64("content"))
    held, seen = pin_measured(held, "zstd", size=F.sum(F.octet_length("content")))
    # A minimizer with very many segments would fill one task. There are few such: at most one for each MOST_SEGMENTS segments.
    often = pin(held.groupBy("token").agg(F.count(F.lit(1)).alias("held")).where(f"held > {MOST_SEGMENTS}").select("token"))
    bucketed = held.join(F.broadcast(often), "token", "left_anti").withColumn("bucket", F.pmod(F.xxhash64("token"), F.lit((seen.get("size") or 0) // BUCKET + 12)))
    indexed = bucketed.select("bucket", "token", "name", "content", "least", "n").groupBy("bucket").applyInArrow(_owners, "token long, name long, owners array<long>")
    # The strings of those are dealt out one by one, equal ones summed up first.
    hot = held.join(F.broadcast(often), "token", "left_semi")
    strings = hot.select("token", "name", "least", F.posexplode(F.transform(F.sequence(F.lit(1), F.octet_length("content") - LENGTH + 1), lambda i: F.substring("content", i, F.lit(LENGTH)))).alias("at", "string"))
    first = strings.groupBy("string").agg(F.min("least").alias("owner"))
    back = strings.join(first, "string").groupBy("token", "name").agg(F.array_sort(F.collect_list(F.struct("at", "owner"))).alias("all"))
    return indexed.unionByName(back.select("token", "name", F.col("all")["owner"].alias("owners")))


def _cut(text: bytes, spans: list[tuple[int, int]]) -> tuple[bytes, int, int]:
    """What is left, bytes removed and maximal runs."""
    kept, at, removed, runs = [], 0, 0, 0
    for a, b in sorted(spans):
        if b <= at:
            continue
        runs += a > at or runs == 0
        a = max(a, at)
        kept.append(text[at:a])
        removed += b - a
        at = b
    kept.append(text[at:])
    return b"".join(kept), removed, runs


def dedup(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and text (bytes, what is left) for every row of `docs`.

    NULL and empty texts stay as they are (NULL as empty). Rows with a NULL doc_id lose nothing and take nothing from others. Of
    equal texts all but those with the least id are removed as a whole if they have 50 bytes. Rows that repeat a doc_id are the same
    document: they take nothing from each other. No rows give no rows.
    """
    shared = shared_tokens(docs.where("doc_id is not null"), anchors, by_text=True)
    ids = pin(shared.rows.groupBy("class").agg(F.min("doc_id").alias("least")))
    sets = pin(shared.sets.select("class", "tokens").join(ids, "class"))
    shift = shared.shift

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for c, least, text, tokens in zip(*(batch.column(i) for i in range(4)), strict=True):
                wanted = tokens.values.to_numpy().view(np.uint64)
                c, least = c.as_py(), least.as_py()
                rows += [(c, least, t, a, x) for t, a, x in segments(unpacked(text.as_py()), wanted, shift)]
            kinds = [pa.int64()] * 4 + [pa.binary()]
            columns = list(zip(*rows)) if rows else [()] * 5
            columns[2] = np.array(columns[2], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(columns, kinds, strict=True)], names=["class", "doc", "token", "start", "content"])

    texts = with_class(docs.where("doc_id is not null"), packed=True)
    one = texts.join(sets.withColumnRenamed("class", "of"), (F.col("class") == F.col("of")) & (F.col("doc_id") == F.col("least"))).dropDuplicates(["class", "doc_id"])
    parts = pin(one.select("class", "least", "text", "tokens").mapInArrow(cut, "class long, doc long, token long, start long, content binary"), "zstd")  # segments overlap
    known = owners(parts.select("token", "doc", "content"))
    hits = parts.select("class", "doc", "token", "start", F.xxhash64("content").alias("name")).join(known, ["token", "name"]).where(F.array_min("owners") < F.col("doc"))

    def spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc, start, own = batch.column(1).to_numpy(), batch.column(2).to_numpy(), batch.column(3)
            n = own.value_lengths().to_numpy()
            of = np.repeat(np.arange(len(n)), n)
            early = np.flatnonzero(own.flatten().to_numpy() < doc[of])
            at, of = early - (np.cumsum(n) - n)[of[early]], of[early]
            edges = np.flatnonzero(np.concatenate([[True], (np.diff(early) > 1) | (np.diff(of) > 0), [True]])) if len(early) else early[:0]
            a, b = edges[:-1], edges[1:] - 1
            columns = [batch.column(0).take(pa.array(of[a])), pa.array(start[of[a]] + at[a]), pa.array(start[of[a]] + at[b] + LENGTH)]
            yield pa.RecordBatch.from_arrays(columns, names=["class", "a", "b"])

    found = hits.select("class", "doc", "start", "owners").mapInArrow(spans, "class long, a long, b long")
    # As many spans as the text has segments.
    gone = ids.join(found.groupBy("class").agg(F.collect_list(F.struct("a", "b")).alias("spans")), "class", "left")

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for doc, text, least, held in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                text = unpacked(text)
                if doc is not None and least is not None and doc > least:
                    cuts = [(0, len(text))] if len(text) >= LENGTH else []
                else:
                    cuts = [(s["a"], s["b"]) for s in held or []] if doc is not None else []
                kept, removed, runs = _cut(text, cuts)
                out.append((doc, len(text), removed, runs, kept))
            kinds = [pa.int64()] * 4 + [pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out) if out else [()] * 5, kinds, strict=True)], names=["doc_id", "n_bytes", "n_removed", "n_spans", "text"])

    rows = with_class(docs, packed=True).join(gone, "class", "left").select("doc_id", "text", "least", "spans")
    return rows.mapInArrow(remove, "doc_id long, n_bytes long, n_removed long, n_spans long, text binary")
