import random

import numpy as np
import pytest

from chronoweave.llm import run_index, shared_tokens

from .conftest import by_doc, pairs, prose


def brute(rows):
    first = {}
    for d, t in rows:
        t = (t or "").encode()
        for i in range(len(t) - 49) if d is not None else ():
            first[t[i : i + 50]] = min(first.get(t[i : i + 50], d), d)
    out = []
    for d, t in rows:
        t = (t or "").encode()
        gone = np.zeros(len(t) + 1, bool)
        for i in range(len(t) - 49) if d is not None else ():
            if first[t[i : i + 50]] < d:
                gone[i : i + 50] = True
        kept = bytes(c for c, g in zip(t, gone) if not g)
        out.append((d, len(t), int(gone.sum()), int((np.diff(gone.astype(int), prepend=0) == 1).sum()), kept))
    return sorted(out, key=repr)


@pytest.mark.parametrize("docs", ["edge_docs", "some_docs", "no_docs"])
def test_agrees_with_brute_force(docs, request):
    docs = request.getfixturevalue(docs)
    got = [(a, b, c, d, bytes(e)) for a, b, c, d, e in by_doc(run_index.dedup(docs))]
    assert sorted(got, key=repr) == brute(pairs(docs))


@pytest.mark.parametrize("most", [8000, 3])
def test_repetitive_texts(spark, rnd, monkeypatch, most):
    monkeypatch.setattr(run_index, "MOST_SEGMENTS", most)
    monkeypatch.setattr(shared_tokens, "TOKENS_PER_RANGE", 300)
    base = prose(rnd, 120)
    rows = [(i, base[rnd.randrange(300) :][: rnd.randrange(40, 500)] + prose(rnd, 5) + base[rnd.randrange(500) :]) for i in range(40)]
    rows += [(50 + i, "ab" * (20 + i)) for i in range(20)] + [(80, "é" * 60), (81, "x" + "é" * 40), (82, "\x00" * 70 + "a"), (83, "a" + "\x00" * 55)]
    rnd.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = [(a, b, c, d, bytes(e)) for a, b, c, d, e in by_doc(run_index.dedup(df))]
    assert sorted(got, key=repr) == brute(rows)


def test_index_agrees_with_the_definition():
    rnd = random.Random(5)
    for _ in range(30):
        base = bytes(rnd.choice(b"ab\x00\xc3") for _ in range(200))
        texts = list({base[(a := rnd.randrange(150)) : a + rnd.randrange(50, 77)] for _ in range(40)})
        texts = [t for t in texts if len(t) >= 50] + [bytes(rnd.choice(b"ab") for _ in range(60)) for _ in range(5)]
        owners = np.array([rnd.randrange(100) for _ in texts])
        first = {}
        for t, o in zip(texts, owners):
            for i in range(len(t) - 49):
                first[t[i : i + 50]] = min(first.get(t[i : i + 50], 1000), int(o))
        found = run_index.RunIndex(texts, owners).statistics()
        assert [x.tolist() for x in found] == [[first[t[i : i + 50]] for i in range(len(t) - 49)] for t in texts]


def test_tokens_are_dealt_evenly(rnd):
    tokens = np.unique(np.concatenate([run_index.anchors(prose(rnd, 3000).encode()) for _ in range(20)]))
    held = np.bincount((tokens >> np.uint64(60)).astype(np.int64), minlength=16)
    assert held.max() < 1.3 * held.mean()  # the tasks that count them take ranges of one width


def test_periodic_runs_are_cut_into_short_segments():
    for text in (b"a" * 5000, b"ab" * 3000, bytes(4000)):
        tokens = run_index.anchors(text)
        found = list(run_index.segments(text, tokens, 0))
        assert max(len(s) for _, _, s in found) <= run_index.LENGTH + run_index.WIDTH - 1
        strings = {a + i for _, a, s in found for i in range(len(s) - run_index.LENGTH + 1)}
        assert strings == set(range(len(text) - run_index.LENGTH + 1)) and all(text[a : a + len(s)] == s for _, a, s in found)


@pytest.mark.parametrize("most", [2**20, 2**62])
def test_keys_are_sorted_with_their_places(most):
    key = np.random.default_rng(3).integers(0, 50, 1000) * (most // 50)
    assert run_index._sorted(key).tolist() == np.argsort(key, kind="stable").tolist()


def test_two_widths_of_the_index_make_a_string(rnd):
    texts = list({prose(rnd, 30).encode()[:n] for n in range(50, 77)})
    index = run_index.RunIndex(texts, np.arange(len(texts)))
    widths = index._ordered(*(np.zeros(1, np.int64),) * 2)[1]
    assert run_index.LENGTH in {a + b for a in widths for b in widths}
    assert (index.run_of == np.searchsorted(index.heads, np.arange(len(index.run_of)), "right") - 1).all()


def test_a_table_can_be_stored_smaller(spark):
    from chronoweave.session import pin

    rows = spark.range(2000).selectExpr("id", "repeat(sha2(cast(id div 50 as string), 256), 3) as text")
    stored = pin(rows, "zstd")
    assert all(".zstd." in f for f in stored.inputFiles()) and sorted(stored.collect()) == sorted(rows.collect())
