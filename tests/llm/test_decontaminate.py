import random

import numpy as np
import pytest

from chronoweave.llm import decontaminate as dc

from .conftest import pairs, prose


@pytest.fixture(scope="module")
def items(spark, rnd):
    texts = [prose(rnd, rnd.randint(12, 50), [f"term{i}" for i in range(300)] + ["the", "of"] * 60).capitalize() for _ in range(40)]
    texts = [" ".join(t.split()[:-4]) + "? " + " ".join(t.split()[-4:]) + "." for t in texts] + [None, "", "single"]
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(3, texts[3])], "item_id long, text string")


def scored(index, words, threshold):
    """Every item's score by the definition, without blocks or pivots."""
    have, scores = {index.terms[w] for w in words if w in index.terms}, {}
    for t in have:
        for its, impacts in index.postings[t].values():
            for i, x in zip(its, impacts):
                scores[i] = scores.get(i, 0) + x
    return sorted(i for i, s in scores.items() if s >= threshold)


def test_search_agrees_with_scoring_everything(items):
    index = dc.index_of(items)
    rnd = random.Random(3)
    vocabulary = sorted(index.terms)
    for _ in range(300):
        words = [rnd.choice(vocabulary) for _ in range(rnd.randint(1, 80))]
        threshold = rnd.choice([0.05, 0.1, 0.2, 0.4])
        numbers = np.array([index.terms[w] for w in words], np.int32)
        found = set()
        for _, query, blocks in dc.windows_of(numbers, index, threshold):
            found |= {i for i, _ in index.search(query, blocks, threshold)}
        if len(words) <= 2 * index.window:
            assert sorted(found) == scored(index, words, threshold)


def test_leaks_are_found_wherever_they_stand_and_clean_texts_are_left_alone(spark, items, rnd):
    texts = {r.item_id: r.text for r in items.collect() if r.text and len(r.text) > 20}
    rows, expected = [], {}
    for i, (item, text) in enumerate(texts.items()):
        at = rnd.choice([0, 1, 37, 60, 400])
        rows.append((i, prose(rnd, at) + " " + text.upper() + "\n" + prose(rnd, rnd.choice([0, 50, 300]))))
        expected[i] = item
        words = text.split()
        words[len(words) // 2] = "other"
        rows.append((1000 + i, prose(rnd, 70) + " " + " ".join(words) + " " + prose(rnd, 70)))
        expected[1000 + i] = item
        rows.append((2000 + i, prose(rnd, 200)))
        rows.append((3000 + i, prose(rnd, 50) + " " + " ".join(words[:3]) + " " + prose(rnd, 50)))
    got = {r.doc_id: r for r in dc.leaks(spark.createDataFrame(rows, "doc_id long, text string"), items).collect()}
    assert len(got) == len(rows)
    for d, _ in rows:
        if d < 1000:
            assert expected[d] in got[d]["items"]
        elif d >= 2000:
            assert not got[d].contaminated
    assert sum(expected[d] in got[d]["items"] for d in expected) >= 0.95 * len(expected)


@pytest.mark.parametrize("docs", ["edge_docs", "some_docs", "no_docs"])
def test_odd_rows(spark, docs, request, items):
    docs = request.getfixturevalue(docs)
    assert dc.leaks(docs, items).count() == docs.count()
    assert dc.leaks(docs, items.where("false")).where("contaminated").count() == 0
    benchmark = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    got = {(r.doc_id, i) for r in dc.leaks(docs, benchmark).collect() for i in r["items"]}
    whole = {(d, r.item_id) for d, t in pairs(docs) for r in benchmark.collect() if t and r.text in t}
    assert whole <= got


def test_an_answer_with_one_changed_word_is_found(spark, rnd):
    items = {r.text: r.item_id for r in spark.read.parquet("/root/testdata/sf0.01/benchmark.parquet").collect()}
    for m in range(3, 12):
        items[prose(rnd, 30, [f"q{i}" for i in range(400)]) + "? " + prose(rnd, m, [f"a{i}" for i in range(400)]) + "."] = 100_000 + m
    rows, expected = [], {}
    for text, item in items.items():
        question, answer = dc.parts(text.encode())
        cut = len(text.split()) - len(answer)
        for k in range(len(answer) if len(answer) >= 3 else 0):
            words = text.split()
            words[cut + k] = "changed"
            expected[len(rows)] = item
            rows.append((len(rows), prose(rnd, 40) + " " + " ".join(words) + " " + prose(rnd, 40)))
        expected[len(rows)] = None  # the question alone
        rows.append((len(rows), prose(rnd, 40) + " " + " ".join(text.split()[:cut]) + " " + prose(rnd, 40)))
    table = spark.createDataFrame([(i, t) for t, i in items.items()], "item_id long, text string")
    got = {r.doc_id: r["items"] for r in dc.leaks(spark.createDataFrame(rows, "doc_id long, text string"), table).collect()}
    missed = [d for d, i in expected.items() if i is not None and i not in got[d]]
    extra = [d for d, i in expected.items() if i is None and got[d]]
    assert (missed, extra) == ([], []), (len(missed), len(extra), len(expected))
