"""Operator 4, benchmark decontamination: a BM25 index of the test items, searched with block-max WAND by every passage.

Impacts are divided by the score that an item has with itself, so one threshold fits items of all lengths. Overlapping windows
of every text are the queries. A window whose best impacts sum up to less than the threshold can't reach it and is skipped for
all items at once; for the others, postings are walked with WAND pivots and block maxima. What is found is verified by the
overlap of word triples with the item's question and with its answer; an answer so short that one changed word spoils too many of
its triples is held word by word against the stretches around the question.
"""

from __future__ import annotations

import math
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import LOWER, doc_key, utf8, whole_row

K1, B = 1.2, 0.75
BLOCK = 4
TRIM = b".,;:!?\"'()[]{}"
MOST_INDEX_BYTES = 64 << 20


def norm(word: bytes) -> bytes:
    return word.translate(LOWER).strip(TRIM)


def words_of(text: bytes) -> list[bytes]:
    return [w for w in map(norm, text.split()) if w]


def triples(words: list[bytes]) -> set[tuple]:
    size = min(3, len(words))
    return {tuple(words[i : i + size]) for i in range(len(words) - size + 1)} if size else set()


def parts(text: bytes) -> tuple[list[bytes], list[bytes]]:
    """Question and answer: the last sentence or line is the answer; of a single sentence, the last third of its words."""
    ends = [i + 1 for i, c in enumerate(text[:-1]) if c == 10 or (c in b".!?" and text[i + 1 : i + 2].isspace())]
    for end in reversed(ends):
        question, answer = words_of(text[:end]), words_of(text[end:])
        if len(question) >= 3 and len(answer) >= 3:
            return question, answer
    words = words_of(text)
    cut = len(words) - max(1, len(words) // 3)
    return words[:cut], words[cut:]


@dataclass
class Index:
    """Postings by term number and block of items; similar items are neighbours, so that block maxima are tight."""

    terms: dict[bytes, int]
    postings: list[dict[int, tuple[list[int], list[float]]]]
    block_max: np.ndarray
    best: np.ndarray
    ids: list[int]
    questions: list[set]
    answers: list[set]
    said: list[list[bytes]]
    window: int

    @classmethod
    def build(cls, rows: list[tuple[int, bytes]]) -> Index:
        """Items without words are left out; equal item ids stay separate items."""
        held = [(i, words_of(t), *map(triples, (p := parts(t))), p[1]) for i, t in sorted(rows)]
        held = [x for x in held if x[1]]
        n, mean = len(held), sum(len(x[1]) for x in held) / max(1, len(held))
        holders = Counter(w for x in held for w in set(x[1]))
        held.sort(key=lambda x: (sorted(set(x[1]), key=lambda w: (-holders[w], w))[:3], x[0]))
        idf = {w: math.log(1 + (n - d + 0.5) / (d + 0.5)) for w, d in holders.items()}
        terms = {w: k for k, w in enumerate(sorted(holders))}
        postings: list[dict[int, tuple[list[int], list[float]]]] = [{} for _ in terms]
        block_max = np.zeros((len(terms) + 1, -(-n // BLOCK)), np.float32)
        for at, (_, words, *_) in enumerate(held):
            tf = Counter(words)
            raw = {w: idf[w] * f * (K1 + 1) / (f + K1 * (1 - B + B * len(words) / mean)) for w, f in tf.items()}
            own = sum(raw.values())
            for w, x in raw.items():
                items, impacts = postings[terms[w]].setdefault(at // BLOCK, ([], []))
                items.append(at)
                impacts.append(x / own)
                block_max[terms[w], at // BLOCK] = max(block_max[terms[w], at // BLOCK], np.nextafter(np.float32(x / own), np.float32(1)))
        longest = max((len(x[1]) for x in held), default=1)
        return cls(terms, postings, block_max, block_max.max(1, initial=0), [x[0] for x in held], [x[2] for x in held], [x[3] for x in held], [x[4] for x in held], max(32, longest))

    def search(self, query: list[int], blocks: list[int], threshold: float) -> list[tuple[int, float]]:
        """All items of `blocks` whose score reaches `threshold`, by WAND under the block's maxima. `query`: distinct terms."""
        found = []
        for block in blocks:
            # [item, place, items, impacts, bound] of every term that occurs in the block
            lists = [[p[0][0], 0, p[0], p[1], float(self.block_max[t, block])] for t in query if (p := self.postings[t].get(block))]
            while lists:
                lists.sort(key=lambda x: x[0])
                bound, pivot = 0.0, -1
                for k, x in enumerate(lists):
                    bound += x[4]
                    if bound >= threshold:
                        pivot = k
                        break
                if pivot < 0:
                    break
                item = lists[pivot][0]
                if lists[0][0] == item:
                    score = sum(x[3][x[1]] for x in lists if x[0] == item)
                    if score >= threshold:
                        found.append((item, score))
                    item += 1
                for x in lists:
                    if x[0] < item:
                        x[1] = bisect_left(x[2], item, x[1])
                        x[0] = x[2][x[1]] if x[1] < len(x[2]) else -1
                lists = [x for x in lists if x[0] >= 0]
        return found


class _Numbers(dict):
    """Word as it stands -> term number, -1 for words of no item; a bounded number of words is kept."""

    def __init__(self, terms: dict[bytes, int], most: int = 300_000):
        super().__init__()
        self.terms, self.most = terms, most

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.most:
            self.clear()
        self[word] = number = self.terms.get(norm(word), -1)
        return number


def windows_of(numbers: np.ndarray, index: Index, threshold: float) -> Iterator[tuple[int, list[int], list[int]]]:
    """(first word, distinct terms, blocks) of windows and the blocks whose maxima sum up to the threshold.

    Windows are two item lengths long and begin one item length apart, so that every item lies in one as a whole.
    """
    none, step = len(index.block_max) - 1, index.window
    n = max(1, -(-max(0, len(numbers) - step) // step))
    padded = np.full((n + 1) * step, none, np.int32)
    padded[: len(numbers)] = np.where(numbers < 0, none, numbers)
    rows = np.sort(np.lib.stride_tricks.sliding_window_view(padded, 2 * step)[::step], axis=1)
    rows[:, 1:][rows[:, 1:] == rows[:, :-1]] = none
    may = np.flatnonzero(index.best[rows].sum(1) >= threshold)
    for at in range(0, len(may), 256):
        some = rows[may[at : at + 256]]
        bounds = index.block_max[some].sum(1) >= threshold
        for i in np.flatnonzero(bounds.any(1)):
            yield int(may[at + i]) * step, [int(t) for t in some[i] if t != none], np.flatnonzero(bounds[i]).tolist()


def verified(words: list[bytes], index: Index, item: int, question: float, answer: float) -> tuple[float, float] | None:
    own = triples(words) | (triples(words[-2:]) if len(words) > 2 else set())
    asked, said = index.questions[item], index.answers[item]
    flat = set(words)

    def share(part: set) -> float:
        if not part:
            return 0.0
        size = len(next(iter(part)))
        return sum((x in own) if size == 3 else all(w in flat for w in x) for x in part) / len(part)

    q, a = share(asked), share(said)
    m = len(index.said[item])
    if q >= question and a < answer and m - 5 < answer * (m - 2):  # a word in the middle is in three of m - 2 triples
        a = max(a, aligned(words, asked, index.said[item]))
    return (q, a) if q >= question and a >= answer else None


def aligned(words: list[bytes], asked: set, said: list[bytes]) -> float:
    """Share of the answer's words that a stretch of as many words holds in their order; the question's own words don't count."""
    of_question = [False] * len(words)
    size = len(next(iter(asked), ()))
    for i in range(len(words) - size + 1):
        if size and tuple(words[i : i + size]) in asked:
            of_question[i : i + size] = [True] * size
    free = [b"" if taken else w for w, taken in zip(words, of_question)]
    m, best, wanted = len(said), 0, set(said)
    held = [w in wanted for w in free]
    for i in range(max(1, len(free) - m + 1)):
        if sum(held[i : i + m]) <= best:
            continue
        row = [0] * (m + 1)
        for w in free[i : i + m]:
            row = _next_row(row, w, said)
        best = max(best, row[-1])
    return best / m if m else 0.0


def _next_row(row: list[int], word: bytes, said: list[bytes]) -> list[int]:
    """One step of the longest common subsequence."""
    out = [0]
    for k, w in enumerate(said):
        out.append(row[k] + 1 if w == word else max(row[k + 1], out[k]))
    return out


def index_of(items: DataFrame) -> Index:
    """The benchmark is a fixed set of test items; its size is checked, and a larger one must be searched in parts."""
    narrow = items.select(F.col("item_id").cast("long").alias("item_id"), F.coalesce(F.col("text").cast("binary"), F.lit(b"")).alias("text"))
    size = narrow.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    if size > MOST_INDEX_BYTES:
        raise ValueError(f"benchmark texts of {size} bytes: pass at most {MOST_INDEX_BYTES} at a time and unite the results")
    return Index.build([(-1 if r.item_id is None else r.item_id, bytes(r.text)) for r in narrow.collect()])


def leaks(docs: DataFrame, items: DataFrame, threshold: float = 0.6, question: float = 0.6, answer: float = 0.6, rows: bool = False) -> DataFrame:
    """One row per row of `docs`: doc_id, n_retrieved, n_verified, items (ids of verified items, ascending), contaminated.

    Every window of every whole text is a query. NULL and empty texts, and an empty benchmark, retrieve nothing. Repeated rows are
    searched each; a NULL doc_id is carried through. With `rows` each result has its row beside it as the struct `row` (see
    `common.from_row`).
    """
    spark: SparkSession = docs.sparkSession
    shared = spark.sparkContext.broadcast(index_of(items))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index: Index = shared.value
        numbers = _Numbers(index.terms)
        for batch in batches:
            retrieved, right = [], []
            for text in batch.column(1):
                words = (text.as_py() or b"").split()
                hits, good = set(), set()
                if words and index.ids:
                    terms = np.fromiter(map(numbers.__getitem__, words), np.int32, len(words))
                    for first, query, blocks in windows_of(terms, index, threshold):
                        for item, _ in index.search(query, blocks, threshold):
                            hits.add(item)
                            if item not in good and verified([w for w in map(norm, words[first : first + 2 * index.window]) if w], index, item, question, answer):
                                good.add(item)
                retrieved.append(len(hits))
                right.append(sorted({index.ids[i] for i in good}))
            found = [pa.array(retrieved, pa.int64()), pa.array([len(x) for x in right], pa.int64()), pa.array(right, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *found, pa.array([bool(x) for x in right], pa.bool_()), *batch.columns[2:]],
                names=["doc_id", "n_retrieved", "n_verified", "items", "contaminated", *["row"][: batch.num_columns - 2]],
            )

    schema = "doc_id long, n_retrieved long, n_verified long, items array<long>, contaminated boolean"
    if not rows:
        return doc_key(docs).mapInArrow(run, schema)
    beside = docs.select(F.col("doc_id").cast("long").alias("doc_id"), utf8(F.col("text")).alias("text"), whole_row(docs).alias("row"))
    return beside.mapInArrow(run, T.StructType([*T.StructType.fromDDL(schema), beside.schema["row"]]))
