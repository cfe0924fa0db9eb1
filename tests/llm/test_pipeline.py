import random

import pytest

import __spark_entry__
import corpus_pipeline
from chronoweave.llm import queries

from . import test_line_dedup, test_prefix_join, test_repetition
from .conftest import pairs, prose


def stage(name):
    return dict(corpus_pipeline.STAGES)[name]


@pytest.fixture(scope="module")
def corpus(some_docs):
    return some_docs.where("length(text) < 2500")


def test_stages_keep_the_columns_and_what_they_should(spark, corpus):
    sf_dir = "/root/testdata/sf0.001"
    docs = stage("quality rules")(spark, corpus, sf_dir)
    assert docs.columns == corpus.columns
    kept = {d for d, _ in pairs(docs)}
    failed = {d for d, t in pairs(corpus) if test_repetition.brute(d, t)[6]}
    assert not kept & failed and len(kept) >= 0.97 * (corpus.count() - len(failed))

    lines = stage("line dedup")(spark, docs, sf_dir)
    assert lines.columns == corpus.columns
    expected = {r[0]: r[3] for r in test_line_dedup.brute(pairs(docs))}
    for d, t in pairs(lines):
        assert test_line_dedup.hashlib.sha256(t.encode()).hexdigest() == expected[d]

    single = stage("n-gram Jaccard join")(spark, lines, sf_dir)
    assert sorted(d for d, _ in pairs(single)) == sorted({c for _, _, c in test_prefix_join.brute(pairs(lines))})

    clean = stage("benchmark decontamination")(spark, single, sf_dir)
    items = [r.text for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    assert {d for d, t in pairs(single) if not any(i in t for i in items)} == {d for d, _ in pairs(clean)}
    assert stage("BPE")(spark, clean, sf_dir).count() == clean.count()


@pytest.mark.parametrize("docs", ["edge_docs", "no_docs"])
def test_odd_rows_pass_through_every_stage(spark, docs, request):
    docs = request.getfixturevalue(docs)
    for name, f in corpus_pipeline.STAGES:
        out = f(spark, docs, "/root/testdata/sf0.001")
        assert out.count() <= docs.count()
        if name != "BPE":
            assert out.columns == docs.columns


def test_every_operator_and_the_pipeline_are_registered():
    names = list(__spark_entry__.queries())
    assert all(sum(n.startswith(f"op{i}_") for n in names) == 1 for i in range(1, 14))
    assert "pipeline" in names and len(corpus_pipeline.STAGES) == 5
    assert set(queries.ORACLES) <= set(queries.QUERIES)


def test_rows_of_one_id_are_judged_each_by_itself(spark):
    """A rejected or leaking row doesn't take other rows of its id along, nor of no id."""
    rnd = random.Random(9)
    item = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").first().text
    good = [prose(rnd, 80) for _ in range(2)]
    bad = ["short", None]
    docs = spark.createDataFrame([(1, good[0]), (1, bad[0]), (None, good[1]), (None, bad[1])], "doc_id long, text string")
    assert {r.text for r in stage("quality rules")(spark, docs, "").collect()} == set(good)
    leaking = prose(rnd, 30) + " " + item + " " + prose(rnd, 30)
    docs = spark.createDataFrame([(1, good[0]), (1, leaking), (None, good[1]), (None, leaking), (None, None)], "doc_id long, text string")
    left = [r.text for r in stage("benchmark decontamination")(spark, docs, "/root/testdata/sf0.001").collect()]
    assert sorted(left, key=str) == sorted([*good, None], key=str)


def test_names_that_the_stages_use_themselves(spark):
    rnd = random.Random(10)
    line = "a line of more than forty characters that all of these documents share"
    rows = [(i, prose(rnd, 60) + "\n" + line, 7, 8, 9, 10, 11, 0) for i in range(6)] + [(6, None, 7, 8, 9, 10, 11, None)]
    names = "doc_id long, text string, n_lines long, n_dropped int, `a.b` long, row long, kept long, n_chars long"
    docs = spark.createDataFrame(rows, names)
    for name, f in corpus_pipeline.STAGES[:-1]:
        out = f(spark, docs, "/root/testdata/sf0.001")
        assert out.columns == docs.columns
        got = out.collect()
        assert all(tuple(r)[2:7] == (7, 8, 9, 10, 11) for r in got) and len(got) == (6 if name == "quality rules" else 7)
        if name == "line dedup":
            assert {r.doc_id: r.n_chars for r in got} == {r.doc_id: 0 if r.doc_id == 5 else r.text and len(r.text) for r in got}
            assert sum(line in (r.text or "") for r in got) == 1
