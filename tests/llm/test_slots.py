import numpy as np
import pytest
from pyspark.sql import functions as F

from chronoweave.llm import bpe, queries, slots

from .conftest import pairs


@pytest.mark.parametrize("n", [1, 2, 3, 5, 64, 1000, 4097])
def test_permutation_is_a_bijection_with_an_inverse(n):
    p = slots.Permutation(n, 42)
    there = p.slot(np.arange(n))
    assert sorted(there.tolist()) == list(range(n))
    assert p.index(there).tolist() == list(range(n))
    if n > 500:
        assert there.tolist() != slots.Permutation(n, 43).slot(np.arange(n)).tolist()
        assert abs(np.corrcoef(there, np.arange(n))[0, 1]) < 0.15


@pytest.mark.parametrize("docs", ["edge_docs", "some_docs", "no_docs"])
def test_shards_hold_every_text_once(spark, docs, request, tmp_path):
    stored = str(tmp_path / "docs")
    request.getfixturevalue(docs).write.parquet(stored)
    docs = spark.read.parquet(stored)
    layout = slots.materialise(docs, length=64, per_shard=100, key=7)
    rows = {r.slot: r for r in slots.read(spark, layout).collect()}
    assert sorted(rows) == list(range(layout.sequences))
    assert all(len(r.ids) == 64 and r.shard == r.slot // 100 for r in rows.values())
    order = slots.Permutation(layout.sequences, 7).slot(np.arange(layout.sequences)).tolist()
    stream = b"".join(bytes(rows[s].ids) for s in order)
    texts = sorted((t or "").encode() for _, t in pairs(docs))
    assert sorted(x for x in stream.split(b"\xff") if x) == [t for t in texts if t]


def test_a_reader_goes_on_from_any_slot(spark, some_docs):
    layout = slots.materialise(some_docs, length=128, per_shard=64)
    whole = {r.slot: bytes(r.ids) for r in slots.read(spark, layout).collect()}
    start = layout.sequences // 3
    rest = {r.slot: bytes(r.ids) for r in slots.read(spark, layout, start).collect()}
    assert rest == {s: x for s, x in whole.items() if s >= start}
    assert slots.read(spark, layout, layout.sequences).count() == 0


def test_files_have_a_fixed_stride(spark, some_docs):
    layout = slots.materialise(some_docs, length=128, per_shard=64)
    whole = {r.slot: bytes(r.ids) for r in slots.read(spark, layout).collect()}
    for f in spark.read.format("binaryFile").load(layout.folder).collect():
        held = min(64, layout.sequences - f.shard * 64)
        assert f.length == held * 128 + 1
        for i in (0, held - 1):
            assert bytes(f.content[i * 128 : (i + 1) * 128]) == whole[f.shard * 64 + i]


@pytest.mark.parametrize("most,dtype", [(50_000, "<u2"), (65_534, "<u2"), (65_535, "<u4"), (2**31 - 1, "<u4")])
def test_token_ids_are_written_as_they_are(spark, tmp_path, most, dtype):
    lists = [[], None, [0, most], [255, 10, 13], list(range(0, 3000, 7)), [most] * 64, [10] * 63]
    stored = str(tmp_path / "ids")
    spark.createDataFrame([(i, x) for i, x in enumerate(lists)], "doc_id long, ids array<int>").write.parquet(stored)
    layout = slots.materialise(spark.read.parquet(stored), length=64, per_shard=3, key=7, ids="ids")
    rows = {r.slot: np.frombuffer(bytes(r.ids), layout.dtype) for r in slots.read(spark, layout).collect()}
    assert layout.dtype == dtype and sorted(rows) == list(range(layout.sequences)) and {len(x) for x in rows.values()} == {64}
    order = slots.Permutation(layout.sequences, 7).slot(np.arange(layout.sequences)).tolist()
    texts, end = [[]], np.iinfo(dtype).max
    for i in np.concatenate([rows[s] for s in order]).tolist():
        texts.append([]) if i == end else texts[-1].append(i)
    assert sorted(x for x in texts if x) == sorted(x for x in lists if x)


def test_the_query_writes_the_tokenizers_ids(spark):
    sf_dir, length = "/root/testdata/sf0.001", 1024
    rows = queries.op8_training_order(spark, sf_dir).collect()
    encoded = bpe.encode(spark.read.parquet(f"{sf_dir}/documents.parquet"), queries.tokenizer_path())
    n_ids = sum(len(r.ids) + 1 for r in encoded.collect())
    assert {r.n_ids for r in rows} == {length} and n_ids <= length * len(rows) < n_ids + length * 16


@pytest.mark.parametrize("docs", ["edge_docs", "some_docs", "no_docs"])
def test_ids_made_on_the_way_are_those_of_the_encoding_operator(spark, docs, request, tmp_path):
    docs, path = request.getfixturevalue(docs), queries.tokenizer_path()
    shuffled = docs.repartition(5, F.rand(3))  # the rows needn't come in one order twice
    layout = slots.materialise(shuffled, length=32, per_shard=16, key=3, vocabulary_file=path)
    rows = {r.slot: np.frombuffer(bytes(r.ids), layout.dtype) for r in slots.read(spark, layout).collect()}
    assert sorted(rows) == list(range(layout.sequences))
    order = slots.Permutation(layout.sequences, 3).slot(np.arange(layout.sequences)).tolist()
    texts, end = [[]], np.iinfo(layout.dtype).max
    for i in np.concatenate([rows[s] for s in order]).tolist() if order else []:
        texts.append([]) if i == end else texts[-1].append(i)
    assert sorted(x for x in texts if x) == sorted(list(r.ids) for r in bpe.encode(docs, path).collect() if r.ids)


def test_wide_and_narrow_pieces_meet_in_one_layout(spark):
    lists = [[i, 7] for i in range(6)] + [[70_000, 65_535]]
    df = spark.createDataFrame(list(enumerate(lists)), "doc_id long, ids array<int>").repartition(7, "doc_id")
    layout = slots.materialise(df, length=2, per_shard=3, ids="ids")
    flat = np.concatenate([np.frombuffer(bytes(r.ids), "<u4") for r in slots.read(spark, layout).collect()]).tolist()
    end = 2**32 - 1
    assert layout.dtype == "<u4" and sorted(x for x in flat if x != end) == sorted(x for t in lists for x in t)
