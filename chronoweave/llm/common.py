"""What the operators share: the intended input, byte texts in tasks, and word hashes."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
SPACE = b" \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def doc_key(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The two columns an operator reads, the text as bytes with NULL as empty; other columns never clash."""
    return docs.select(F.col(key).cast("long").alias("doc_id"), utf8(F.col(text)).alias("text"))


def whole_row(docs: DataFrame) -> Column:
    """All columns of a row as one struct, by place, so that no name of theirs can clash; see `from_row`."""
    return F.struct(*[F.col(_quoted(c)).alias(f"c{i}") for i, c in enumerate(docs.columns)])


def from_row(row: str, columns: list[str]) -> list[Column]:
    return [F.col(f"{row}.c{i}").alias(c) for i, c in enumerate(columns)]


def _quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def utf8(text: Column) -> Column:
    return F.coalesce(text.cast("binary"), F.lit(b""))


def groups_of_bytes(batches: Iterator[pa.RecordBatch], most: int = 8 << 20) -> Iterator[tuple[list, list[bytes]]]:
    """(ids, texts) in pieces of about `most` bytes, so that a task's memory doesn't follow its input."""
    ids, texts, held = [], [], 0
    for batch in batches:
        keys, column = batch.column(0), batch.column(1)
        for i in range(batch.num_rows):
            text = column[i].as_py() or b""
            ids.append(keys[i].as_py())
            texts.append(text)
            held += len(text) + 64
            if held >= most:
                yield ids, texts
                ids, texts, held = [], [], 0
    if ids:
        yield ids, texts


_kept: dict[object, object] = {}


def kept(name: object, make: Callable[[], object]):
    """What a worker process keeps for its next tasks. It keeps one thing: when another operator's tasks come, the last one's goes."""
    if name not in _kept:
        _kept.clear()
        _kept[name] = make()
    return _kept[name]


class WordHashes(dict):
    """Word -> 64-bit hash, kept for at most `most` words."""

    def __init__(self, most: int = 300_000):
        super().__init__()
        self.most = most

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.most:
            self.clear()
        self[word] = value = xxhash.xxh3_64_intdigest(word)
        return value


def word_hashes(words: list[bytes], cache: WordHashes) -> np.ndarray:
    return np.fromiter(map(cache.__getitem__, words), np.uint64, len(words))


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values (the murmur3 finaliser)."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


_ODD = [0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F]


def shingle_hashes(words: np.ndarray, size: int = 5) -> np.ndarray:
    """One 64-bit hash for each `size` words in a row; fewer words make one shingle, none make none."""
    n = len(words)
    if n == 0:
        return words
    size = min(size, n)
    total = np.full(n - size + 1, size, np.uint64)
    for j in range(size):
        total += words[j : n - size + 1 + j] * np.uint64(_ODD[j % 5] + 2 * (j // 5))
    return mix(total)
