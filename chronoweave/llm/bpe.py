"""Operator 9, byte-level BPE encoding and decoding with a contiguous rank array.

A word is a row of parts; beside it lies a row with the rank of each adjacent pair. The lowest rank is found by scanning the
row, its boundary is deleted, and the ranks of the two neighbours are looked up again. Words are short, so scanning a few
numbers beats any queue; words longer than LONG bytes take a heap instead, which merges in the same order.
"""

from __future__ import annotations

import heapq
import json
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import doc_key, kept

# What counts as white space, and the pattern of the public vocabulary's words.
WHITE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
WORDS = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{WHITE}\p{{L}}\p{{N}}]+|[{WHITE}]+")
#: Cuts a text where every match of WORDS begins or ends whatever stands around, so that a piece can be looked up whole.
PIECES = re.compile(rf"[{WHITE}]+(?![^{WHITE}])| ?[^{WHITE}]+|[{WHITE}]+")
#: Texts without these have single spaces and newlines only, each next to something else: cutting before them is enough.
UNEVEN = ["  ", "\n\n", " \n", "\n ", *"\t\x0b\x0c\r\x85\xa0\x00\u1680\u2028\u2029\u202f\u205f\u3000", *map(chr, range(0x2000, 0x200B))]
LONG = 200
NEVER = 1 << 60


def byte_names() -> dict[str, int]:
    """Printable stand-ins of the 256 bytes in a byte-level vocabulary: printable Latin-1 stays, the rest follow from 256 on."""
    stay = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(stay)]
    return {chr(b): b for b in stay} | {chr(256 + i): b for i, b in enumerate(rest)}


class Tokenizer:
    """A vocabulary file in the JSON form of the public tokenizers library."""

    def __init__(self, content: str, most: int = 300_000):
        spec = json.loads(content)
        names, vocab = byte_names(), spec["model"]["vocab"]
        self.bytes_of = {i: bytes(names[c] for c in name) for name, i in vocab.items()}
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.bytes_of |= {i: name.encode() for name, i in self.special.items()}
        self.first = [vocab[c] for c, _ in sorted(names.items(), key=lambda x: x[1])]
        self.ranks: dict[tuple[int, int], int] = {}
        self.made: list[int] = []
        for rank, pair in enumerate(spec["model"]["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self.ranks[vocab[a], vocab[b]] = rank
            self.made.append(vocab[a + b])
        longest = sorted(self.special, key=len, reverse=True)
        self.cut = re.compile("(" + "|".join(map(re.escape, longest)) + ")") if longest else None
        self.pieces = _Pieces(self, most)
        # all tokens' bytes end to end, and where each begins; an id without a token has no bytes
        size = max(self.bytes_of) + 1
        widths = np.zeros(size, np.int64)
        widths[list(self.bytes_of)] = [len(b) for b in self.bytes_of.values()]
        self.widths, self.starts = widths, np.cumsum(widths) - widths
        self.data = np.frombuffer(b"".join(self.bytes_of.get(i, b"") for i in range(size)), np.uint8)

    def merge(self, word: bytes) -> list[int]:
        """The ids of one word."""
        if len(word) > LONG:
            return self.merge_long(word)
        first, ranks_of, made = self.first, self.ranks, self.made
        parts = [first[b] for b in word]
        get = ranks_of.get
        ranks = [get(pair, NEVER) for pair in zip(parts, parts[1:])]
        while ranks:
            least = min(ranks)
            if least == NEVER:
                break
            i = ranks.index(least)
            parts[i] = new = made[least]
            del parts[i + 1], ranks[i]
            if i:
                ranks[i - 1] = get((parts[i - 1], new), NEVER)
            if i < len(ranks):
                ranks[i] = get((new, parts[i + 1]), NEVER)
        return parts

    def merge_long(self, word: bytes) -> list[int]:
        parts = [self.first[b] for b in word]
        n = len(parts)
        after, before = [*range(1, n), -1], [-1, *range(n - 1)]
        get, made = self.ranks.get, self.made
        heap = [(r, i, parts[i], parts[i + 1]) for i in range(n - 1) if (r := get((parts[i], parts[i + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            rank, i, a, b = heapq.heappop(heap)
            j = after[i] if parts[i] == a else -1
            if j < 0 or parts[j] != b:
                continue
            parts[i], parts[j], after[i] = made[rank], None, after[j]
            if after[j] >= 0:
                before[after[j]] = i
            for x in (before[i], i):
                y = after[x] if x >= 0 else -1
                if y >= 0 and (r := get((parts[x], parts[y]))) is not None:
                    heapq.heappush(heap, (r, x, parts[x], parts[y]))
        return [p for p in parts if p is not None]

    def encode(self, text: str) -> np.ndarray:
        if self.cut is None or not self.cut.search(text):
            return self._plain(text)
        runs = self.cut.split(text)  # odd places hold special tokens
        return np.concatenate([np.array([self.special[r]], np.int32) if i % 2 else self._plain(r) for i, r in enumerate(runs)])

    def _plain(self, text: str) -> np.ndarray:
        if any(map(text.__contains__, UNEVEN)):
            cut = PIECES.findall(text)
        else:
            cut = text.replace("\n", "\x00\n\x00").replace(" ", "\x00 ").split("\x00")
        return np.frombuffer(b"".join(map(self.pieces.__getitem__, cut)), np.int32)

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", "replace")


    def decode_all(self, ids: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of all texts end to end, and where each text ends; text k has the ids up to `ends[k]`.

        Every byte's place in the vocabulary's bytes is the place before it plus one, except where a token begins, so the
        places are one running sum.
        """
        width = self.widths[ids]
        if not width.all():  # ids without a token have no bytes
            kept = width > 0
            ends = np.concatenate([[0], np.cumsum(kept)])[ends]
            ids, width = ids[kept], width[kept]
        after = np.cumsum(width)
        step = np.ones(int(after[-1]) if len(after) else 0, np.int32)
        if len(ids):
            first = self.starts[ids]
            step[0] = first[0]
            step[after[:-1]] = first[1:] - (first[:-1] + width[:-1] - 1)
        upto = np.concatenate([[0], after])
        return self.data[np.cumsum(step, dtype=np.int32)], upto[ends]


class _Pieces(dict):
    """Piece -> its ids as packed 32-bit numbers, of `most` pieces at most, even within one text.

    When half as many have come, they become the older ones, and the older ones that nobody has looked up since are forgotten; so
    frequent pieces stay.
    """

    def __init__(self, tokenizer: Tokenizer, most: int):
        super().__init__()
        self.tokenizer, self.half, self.older = tokenizer, most // 2, {}

    def __missing__(self, piece: str) -> bytes:
        packed = self.older.get(piece)
        if packed is None:
            packed = self._ids(piece)
        if len(piece) <= 64:
            if len(self) >= self.half:
                self.older = dict(self)
                self.clear()
            self[piece] = packed
        return packed

    def _ids(self, piece: str) -> bytes:
        merge = self.tokenizer.merge
        if piece[1:].isalpha() and (piece[0] == " " or piece[0].isalpha()):
            return array("i", merge(piece.encode())).tobytes()
        if piece[1:-1].isalpha() and piece[-1] in ".,;:!?" and (piece[0] == " " or piece[0].isalpha()):
            return self[piece[:-1]] + self[piece[-1]]
        return self._words(piece)

    def _words(self, piece: str) -> bytes:
        return b"".join(array("i", self.tokenizer.merge(w.encode())).tobytes() for w in WORDS.findall(piece))


def _tokenizer(content: str) -> Tokenizer:
    """One per worker process, so that its pieces serve the next task too."""
    return kept(("tokenizer", hash(content)), lambda: Tokenizer(content))


def _load(docs: DataFrame, path: str):
    """The vocabulary file has a fixed size (under 2 MB); its content goes to the executors, which needn't hold the file."""
    with open(path, encoding="utf-8") as f:
        return docs.sparkSession.sparkContext.broadcast(f.read())


def encode(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, ids (array<int>) of every text. NULL and empty texts have no ids; rows are kept as they are, repeated ones too."""
    shared = _load(docs, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = _tokenizer(shared.value)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                ids = [tokenizer.encode((t or b"").decode("utf-8", "replace")) for t in part.column(1).to_pylist()]
                ends = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
                values = np.concatenate(ids) if ids else np.empty(0, np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(values.astype(np.int32, copy=False)))
                yield pa.RecordBatch.from_arrays([part.column(0), lists], names=["doc_id", "ids"])

    return doc_key(docs).mapInArrow(run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id, ids, text from the ids alone; ids that split a character give the replacement character."""
    shared = _load(encoded, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = _tokenizer(shared.value)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                lists = part.column(1)
                sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy().astype(np.int64)
                data, ends = tokenizer.decode_all(lists.flatten().to_numpy(), np.cumsum(sizes))
                yield pa.RecordBatch.from_arrays([part.column(0), lists, _texts(data, ends)], names=["doc_id", "ids", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, ids array<int>, text string")


def _texts(data: np.ndarray, ends: np.ndarray) -> pa.Array:
    """Texts that lie end to end; where one isn't UTF-8 its broken characters become replacement characters."""
    offsets = np.concatenate([[0], ends]).astype(np.int32)
    texts = pa.Array.from_buffers(pa.string(), len(ends), [None, pa.py_buffer(offsets), pa.py_buffer(data.tobytes())])
    try:
        texts.validate(full=True)
        return texts
    except pa.ArrowInvalid:
        return pa.array([data[a:b].tobytes().decode("utf-8", "replace") for a, b in zip(offsets, ends)], pa.string())


def digest(decoded: DataFrame) -> DataFrame:
    return decoded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("text").cast("binary"), 256).alias("decoded_sha256"),
    )
