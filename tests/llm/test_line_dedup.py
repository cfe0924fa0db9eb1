import hashlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronoweave.llm import line_dedup

from .conftest import by_doc, pairs

STRIP = " \t\n\x0b\x0c\r"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, most=5):
    holders = defaultdict(set)
    for d, t in rows:
        for line in (t or "").split("\n"):
            if d is not None and len(k := line.strip(STRIP).translate(LOWER)) >= 40:
                holders[k].add(d)
    out = []
    for d, t in rows:
        lines = (t or "").split("\n")
        kept = []
        for line in lines:
            held = holders.get(line.strip(STRIP).translate(LOWER), ())
            if d is None or len(held) < most or d == max(held):
                kept.append(line)
        out.append((d, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out, key=repr)


def digest(cleaned):
    return by_doc(cleaned.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit(b"")), 256)))


@pytest.mark.parametrize("docs", ["edge_docs", "some_docs", "no_docs"])
def test_agrees_with_brute_force(docs, request):
    docs = request.getfixturevalue(docs)
    assert digest(line_dedup.build(docs, bytes_per_shard=2000).clean(docs)) == brute(pairs(docs))


def test_increments_and_deletions_are_reversible(some_docs):
    a, b = some_docs.where("doc_id < 120"), some_docs.where("doc_id >= 120")
    first = line_dedup.build(a)
    both = first.insert(b)
    assert digest(both.clean(some_docs)) == brute(pairs(some_docs))
    back = both.delete(b)
    assert by_doc(back.counts) == by_doc(first.counts)
    assert digest(back.clean(a)) == brute(pairs(a))
    assert by_doc(back.insert(b).counts) == by_doc(both.counts)
    assert by_doc(both.insert(a).counts) == by_doc(both.counts)  # nothing is counted twice


def test_filter_holds_what_was_added_and_forgets_what_was_removed():
    keys = np.random.default_rng(1).integers(0, 1 << 63, 30_000).astype(np.uint64)
    held = line_dedup.CuckooFilter().add(keys[:20_000])
    assert held.has(keys[:20_000]).all()
    assert held.has(keys[20_000:]).mean() < 0.01
    held = line_dedup.CuckooFilter.loads(held.dumps()).add(keys[20_000:], lambda: keys[:20_000])
    assert held.has(keys).all()
    held.remove(keys[:20_000])
    assert held.has(keys[20_000:]).all()
    assert held.has(keys[:20_000]).mean() < 0.02
