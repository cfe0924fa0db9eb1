import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronoweave.llm import fill_middle
from chronoweave.llm.queries import ORACLES, QUERIES
from registry.check import check, connect

from .conftest import pairs

UNITS = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def plainly(doc, text, rate=50):
    text = text or ""
    h = hashlib.sha256(f"42:{'' if doc is None else doc}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * i : 8 * i + 8], 16) for i in range(4))
    units = UNITS.findall(text)
    n = len(units)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h3 % 100 >= rate:
        return n, "plain", None, None, text
    if h4 % 100 < 80:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def same(docs, **kw):
    got = fill_middle.transform(docs, **kw).withColumn("restored", fill_middle.restore(F.col("text"), F.col("form"))).collect()
    want = [(d, *plainly(d, t, **kw), t or "") for d, t in pairs(docs)]
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)
    return got


def test_ranks_in_a_wavelet_matrix_equal_counting():
    rng = np.random.default_rng(1)
    for n in (0, 1, 63, 64, 65, 1000):
        row = rng.integers(0, 8, n).astype(np.uint8)
        matrix = fill_middle.WaveletMatrix(row)
        at = np.arange(n + 1)
        for symbol in range(8):
            assert matrix.rank(symbol, at).tolist() == [int((row[:i] == symbol).sum()) for i in at]


@pytest.mark.parametrize("docs", ["edge_docs", "some_docs"])
def test_documents_equal_plain_python(docs, request):
    same(request.getfixturevalue(docs))
    assert {r.form for r in same(request.getfixturevalue(docs), rate=100)} >= {"psm", "spm"}


def test_odd_texts(spark):
    rnd = random.Random(5)
    texts = ["".join(rnd.choice([" ", "\n", "\t", "a", "é", "日", "💩", "<", "P", "S>", "<M", "\x1c", "\x85", " "]) for _ in range(rnd.randint(0, 30))) for _ in range(600)]
    texts += ["<P>", "a <S> b", "x<M", "<S", "\x00", "é" * 100_000, " " * 5000 + "x", "w " * 50_000]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    same(docs, rate=100)


def test_no_documents(no_docs):
    assert fill_middle.transform(no_docs).count() == 0


def test_lines_as_units(spark):
    text = "first line\nsecond\n\nlast without end"
    docs = spark.createDataFrame([(i, text) for i in range(40)], "doc_id long, text string")
    starts = {0, 11, 18, 19, len(text)}
    for r in fill_middle.transform(docs, rate=100, unit="lines").collect():
        assert r.n == 4 and {r.prefix_chars, r.prefix_chars + r.middle_chars} <= starts


def test_query_agrees_with_sql(spark):
    sf = "/root/testdata/sf0.001"
    assert check(spark, connect(sf), sf, "op13_fill_middle", QUERIES["op13_fill_middle"], ORACLES["op13_fill_middle"]) == ""
