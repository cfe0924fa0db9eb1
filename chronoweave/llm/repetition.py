"""Operator 5, quality rules: repetition by suffix arrays.

The words of a text are numbered and their suffix array is built by prefix doubling, which stops as soon as all suffixes
differ. Longest common prefixes of neighbours give the maximal repeated word strings; the union of their spans and the longest
of them are limited. The ranks after three doublings number the 8-word windows exactly, so the base counts come with it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import doc_key, utf8, whole_row

SYMBOLS = b"#*$%&|<>"  # fixed values
WINDOW = 8


def suffix_ranks(words: list[bytes]) -> list[np.ndarray]:
    """ranks[k][i] numbers the string of 2**k words from i on, in word-number order; the last level has no ties."""
    number: dict[bytes, int] = {}
    rank = np.fromiter((number.setdefault(w, len(number) + 1) for w in words), np.int64, len(words))
    levels, n, step = [rank], len(words), 1
    while len(levels) < 4 or (int(levels[-1].max()) < n and step < n):
        nxt = np.zeros(n, np.int64)
        nxt[: n - step] = levels[-1][step:] if step < n else 0
        _, rank = np.unique(levels[-1] * (n + 1) + nxt, return_inverse=True)
        levels.append(rank + 1)
        step *= 2
    return levels


def neighbour_lcp(levels: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The suffix array and, for each place in it, the common prefix with the next suffix, in words."""
    n = len(levels[0])
    order = np.argsort(levels[-1], kind="stable")
    a, b = order[:-1].copy(), order[1:].copy()
    lcp = np.zeros(n - 1, np.int64)
    for k in range(len(levels) - 1, -1, -1):
        width, rank = 1 << k, levels[k]
        # Windows that reach beyond the end carry the end in their rank, so only whole windows are compared.
        fit = (a + width <= n) & (b + width <= n)
        same = np.zeros(len(a), bool)
        same[fit] = rank[a[fit]] == rank[b[fit]]
        lcp[same] += width
        a[same] += width
        b[same] += width
    return order, lcp


def union_length(starts: np.ndarray, lengths: np.ndarray, n: int) -> np.ndarray:
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + lengths, -1)
    return np.cumsum(edge[:n]) > 0


def measure(text: bytes, least: int) -> tuple[int, int, int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, covered words, longest repeat in words."""
    lines, words = text.split(b"\n"), text.split()
    n = len(words)
    chars = len(b"".join(words).decode("utf-8", "replace"))
    symbols = len(text) - len(text.translate(None, SYMBOLS))
    held = [x for x in lines if x and not x.isspace()]
    dup = len(held) - len(set(held))
    if n < 2:
        return n, chars, symbols, dup, 0, 0, 0
    levels = suffix_ranks(words)
    repeated = 0
    if n > WINDOW:
        windows = levels[3][: n - WINDOW + 1]
        often = np.bincount(windows)[windows] > 1
        if often.any():
            at = np.flatnonzero(often)
            repeated = int(union_length(at, np.full(len(at), WINDOW), n).sum())
    order, lcp = neighbour_lcp(levels)
    long = lcp >= least
    covered = 0
    if long.any():
        # An interval of suffixes with a common prefix is covered by its neighbours' prefixes: the longest at each suffix.
        starts = np.concatenate([order[:-1][long], order[1:][long]])
        covered = int(union_length(starts, np.concatenate([lcp[long], lcp[long]]), n).sum())
    return n, chars, symbols, dup, repeated, covered, int(lcp.max())


SCHEMA = (
    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "base_failed boolean, covered_words long, longest_repeat long, kept boolean"
)


def rules(
    docs: DataFrame, least_words: int = 6, most_covered: float = 0.4, longest: int = 40, longest_share: float = 0.25, columns=("doc_id", "text"),
    rows: bool = False,
) -> DataFrame:
    """One row per document with its counts and verdict.

    Beyond the base rule, a document fails when repeats of at least `least_words` words cover more than `most_covered` of it,
    or when one repeat has over `longest` words and over `longest_share` of all. NULL and empty texts have no words and fail.
    Rows are judged one by one, so repeated rows and ids get equal verdicts; no rows give no rows. With `rows` each verdict has
    its row beside it as the struct `row` (see `common.from_row`).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                n, chars, symbols, dup, repeated, covered, most = measure(text.as_py() or b"", least_words)
                failed = n < 20 or 100 * repeated > 30 * n
                repetitive = covered > most_covered * n or (most > longest and most > longest_share * n)
                out.append((key, n, chars, symbols, dup, repeated, failed, covered, most, not failed and not repetitive))
            kinds = [pa.int64()] * 6 + [pa.bool_(), pa.int64(), pa.int64(), pa.bool_()]
            found = [pa.array(c, t) for c, t in zip(zip(*out) if out else [()] * 10, kinds, strict=True)]
            names = [f.split()[0] for f in SCHEMA.split(", ")]
            yield pa.RecordBatch.from_arrays([*found, *batch.columns[2:]], names=[*names, *["row"][: batch.num_columns - 2]])

    if not rows:
        return doc_key(docs, *columns).mapInArrow(run, SCHEMA)
    beside = docs.select(F.col(columns[0]).cast("long").alias("doc_id"), utf8(F.col(columns[1])).alias("text"), whole_row(docs).alias("row"))
    return beside.mapInArrow(run, T.StructType([*T.StructType.fromDDL(SCHEMA), beside.schema["row"]]))
