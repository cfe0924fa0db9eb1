import re
import zlib
from collections import Counter, defaultdict

import pytest

from chronoweave.llm import splitters

from .conftest import pairs


@pytest.mark.parametrize("docs", ["edge_docs", "some_docs", "no_docs", "hot"])
def test_shards_are_near_equal_and_slots_gapless(spark, docs, request):
    hot = spark.createDataFrame([(i, "the same text " * 20 if i % 3 else f"text {i}" * (i % 50)) for i in range(3000)], "doc_id long, text string")
    docs = hot if docs == "hot" else request.getfixturevalue(docs)
    got = splitters.shard(docs, 8).collect()
    rows = Counter((d, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for d, t in pairs(docs))
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in got) == rows
    sizes, slots = Counter(), defaultdict(list)
    for r in got:
        assert r.law == "bytes" and r.grown_shard is None and 0 <= r.shard < 8
        sizes[r.shard] += r["size"]
        slots[r.shard].append(r.slot)
    for s in slots.values():
        assert sorted(s) == list(range(len(s)))
    if got:
        total, most = sum(sizes.values()), max(r["size"] for r in got)
        assert all(abs(sizes[i] - total / 8) <= most for i in range(8))


def test_equal_texts_lie_together_unless_their_range_is_overfull(spark):
    docs = spark.createDataFrame([(i, f"text number {i // 4}") for i in range(4000)], "doc_id long, text string")
    shards = defaultdict(set)
    for r in splitters.shard(docs, 8).collect():
        shards[r.text_crc32].add(r.shard)
    assert sum(len(s) > 1 for s in shards.values()) <= 7


def test_result_does_not_depend_on_the_layout_of_the_input(some_docs):
    one = sorted(map(tuple, splitters.shard(some_docs.coalesce(1)).collect()), key=repr)
    assert one == sorted(map(tuple, splitters.shard(some_docs.repartition(7)).collect()), key=repr)


def test_plan_has_no_python(some_docs):
    plan = splitters.shard(some_docs)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
