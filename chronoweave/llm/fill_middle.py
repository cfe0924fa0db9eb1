"""Operator 13, fill-in-middle: cuts found by ranks in a wavelet matrix over character classes.

Every byte of a text gets a class of three bits: does it end a unit, is it white, does it start a code point. A wavelet matrix
over the classes of many texts, laid end to end, answers how many bytes of a class stand before a place. Sums of such ranks
count the units and the code points up to any place, and bisection on the unit count finds both cuts of all texts at once.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, doc_key, groups_of_bytes

ENDS, WHITE, LEAD = 4, 2, 1
BITS = 3
ENDING = [c for c in range(1 << BITS) if c & ENDS]
LEADING = [c for c in range(1 << BITS) if c & LEAD]
MARKS = {"prefix": "<P>", "suffix": "<S>", "middle": "<M>"}

_white = np.zeros(256, bool)
_white[list(SPACE)] = True
_lead = (np.arange(256) & 0xC0) != 0x80


class BitRow:
    """A row of bits that counts its ones before any place: packed words, and a running count per word."""

    def __init__(self, bits: np.ndarray):
        packed = np.packbits(bits, bitorder="little")
        self.words = np.zeros(len(bits) // 64 + 1, np.uint64)
        self.words.view(np.uint8)[: len(packed)] = packed
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words), dtype=np.int64)])

    def ones(self, at: np.ndarray) -> np.ndarray:
        word = at >> 6
        low = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[word] + np.bitwise_count(self.words[word] & low)


class WaveletMatrix:
    """Ranks in a row of small numbers; level by level, from the highest bit, zeros move to the front and ones behind them."""

    def __init__(self, symbols: np.ndarray, bits: int = BITS):
        self.levels: list[tuple[int, BitRow, int]] = []
        for bit in reversed(range(bits)):
            one = (symbols >> bit & 1).astype(bool)
            self.levels.append((bit, BitRow(one), int(len(one) - one.sum())))
            symbols = np.concatenate([symbols[~one], symbols[one]])

    def rank(self, symbol: int, at: np.ndarray) -> np.ndarray:
        """How often `symbol` stands before each place of `at`."""
        first = np.zeros(1, np.int64)
        for bit, row, zeros in self.levels:
            if symbol >> bit & 1:
                first, at = zeros + row.ones(first), zeros + row.ones(at)
            else:
                first, at = first - row.ones(first), at - row.ones(at)
        return at - first

    def count(self, symbols: list[int], at: np.ndarray) -> np.ndarray:
        return sum(self.rank(s, at) for s in symbols)


def classes(data: np.ndarray, ends: np.ndarray, unit: str) -> np.ndarray:
    """The class of every byte of texts that end at `ends`.

    A unit is a word with the white space before it, or the white space at a text's end ("words"); or a line with its
    newline, the last one perhaps without ("lines").
    """
    white = _white[data]
    last = np.zeros(len(data), bool)
    last[ends[ends > np.concatenate([[0], ends[:-1]])] - 1] = True
    if unit == "lines":
        end = last | (data == 10)
    else:
        end = last | (~white & np.append(white[1:], True))
    return (end * ENDS + white * WHITE + _lead[data] * LEAD).astype(np.uint8)


def cuts(texts: list[bytes], draws: np.ndarray, unit: str = "words") -> dict[str, np.ndarray]:
    """Per text: its number of units, where its prefix and its middle end (bytes), and their code points.

    `draws` has two numbers per text; modulo n + 1 they are the units in the prefix, and in prefix and middle (sorted).
    """
    size = np.fromiter(map(len, texts), np.int64, len(texts))
    end = np.cumsum(size)
    start = end - size
    matrix = WaveletMatrix(classes(np.frombuffer(b"".join(texts), np.uint8), end, unit))
    before = matrix.count(ENDING, start)
    n = matrix.count(ENDING, end) - before
    wanted = np.sort(draws % (n + 1)[:, None], axis=1)
    places = []
    for k in range(2):
        low, high = start.copy(), end.copy()  # the least place with enough unit ends before it
        for _ in range(int(size.max(initial=0)).bit_length() + 1):
            middle = (low + high) >> 1
            enough = matrix.count(ENDING, middle) - before >= wanted[:, k]
            low, high = np.where(enough, low, np.minimum(middle + 1, high)), np.where(enough, middle, high)
        places.append(high)
    chars = [matrix.count(LEADING, p) for p in (start, *places)]
    return {
        "n": n, "first": places[0] - start, "second": places[1] - start,
        "prefix_chars": chars[1] - chars[0], "middle_chars": chars[2] - chars[1],
    }


def transform(
    docs: DataFrame, rate: int = 50, spm: int = 80, seed: int = 42, unit: str = "words", marks: dict[str, str] = MARKS
) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars, text: every text with its middle moved to the end, or plain.

    `rate` of 100 texts are cut, `spm` of 100 of those with the suffix first. The choices and both cuts come from the SHA-256 of
    seed and doc_id alone, so repeated rows, retries and other partitions give the same. NULL counts as empty text, a NULL
    doc_id as an empty string in the hash; empty texts and texts that hold a mark stay plain, with NULL prefix_chars and
    middle_chars. Rows are kept as they are, a text of any length is worked whole, no rows give no rows, other columns are not read.
    """
    p, s, m = (marks[k].encode() for k in ("prefix", "suffix", "middle"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in groups_of_bytes(batches, 4 << 20):
            hashes = [hashlib.sha256(b"%d:%s" % (seed, b"" if i is None else b"%d" % i)).digest()[:16] for i in ids]
            h = np.frombuffer(b"".join(hashes), ">u4").reshape(-1, 4).astype(np.int64)
            found = cuts(texts, h[:, :2], unit)
            forms, made = [], []
            for text, (_, _, h3, h4), a, b in zip(texts, h.tolist(), found["first"].tolist(), found["second"].tolist()):
                if not text or h3 % 100 >= rate or p in text or s in text or m in text:
                    forms.append("plain")
                    made.append(text)
                elif h4 % 100 < spm:
                    forms.append("spm")
                    made.append(b"".join((s, text[b:], p, text[:a], m, text[a:b])))
                else:
                    forms.append("psm")
                    made.append(b"".join((p, text[:a], s, text[b:], m, text[a:b])))
            plain = np.array([f == "plain" for f in forms], bool)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(ids, pa.int64()), pa.array(found["n"]), pa.array(forms, pa.string()),
                    *[pa.array(found[c], mask=plain) for c in ("prefix_chars", "middle_chars")], pa.array(made, pa.binary()),
                ],
                names=["doc_id", "n", "form", "prefix_chars", "middle_chars", "text"],
            )

    made = doc_key(docs).mapInArrow(run, "doc_id long, n long, form string, prefix_chars long, middle_chars long, text binary")
    return made.withColumn("text", F.col("text").cast("string"))


def restore(text: Column, form: Column, marks: dict[str, str] = MARKS) -> Column:
    """The original text from a transformed one and its form; a mark's first place is its own, as no text holds a mark."""
    p, s, m = (marks[k] for k in ("prefix", "suffix", "middle"))

    def parts(first: str, second: str) -> tuple[Column, Column, Column]:
        two, three = F.instr(text, second), F.instr(text, m)
        head = len(first)
        return (
            F.substr(text, F.lit(head + 1), two - head - 1),
            F.substr(text, two + len(second), three - two - len(second)),
            F.substr(text, three + len(m)),
        )

    prefix, suffix, middle = parts(p, s)
    psm = F.concat(prefix, middle, suffix)
    suffix, prefix, middle = parts(s, p)
    return F.when(form == "psm", psm).when(form == "spm", F.concat(prefix, middle, suffix)).otherwise(text)


def digest(made: DataFrame) -> DataFrame:
    return made.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars",
        F.sha2(F.col("text").cast("binary"), 256).alias("output_sha256"),
        F.sha2(restore(F.col("text"), F.col("form")).cast("binary"), 256).alias("restored_sha256"),
    )


SQL = r"""
WITH hashed AS (
  SELECT doc_id, coalesce(text, '') AS t, sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents
), drawn AS (
  SELECT doc_id, t, regexp_extract_all(t, '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS units,
         CAST('0x' || substr(h, 1, 8) AS BIGINT) AS h1, CAST('0x' || substr(h, 9, 8) AS BIGINT) AS h2,
         CAST('0x' || substr(h, 17, 8) AS BIGINT) AS h3, CAST('0x' || substr(h, 25, 8) AS BIGINT) AS h4
  FROM hashed
), chosen AS (
  SELECT doc_id, t, units, len(units) AS n,
         least(h1 % (len(units) + 1), h2 % (len(units) + 1)) AS a, greatest(h1 % (len(units) + 1), h2 % (len(units) + 1)) AS b,
         CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 50 THEN 'plain'
              WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form
  FROM drawn
), cut AS (
  SELECT doc_id, t, n, form, array_to_string(units[1:a], '') AS p, array_to_string(units[a + 1:b], '') AS m,
         array_to_string(units[b + 1:], '') AS s
  FROM chosen
)
SELECT doc_id, CAST(n AS BIGINT) AS n, form,
       CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m
              ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
       sha256(p || m || s) AS restored_sha256
FROM cut
"""
