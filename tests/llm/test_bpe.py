import random

import numpy as np
import pytest
from tokenizers import Tokenizer

from chronoweave.llm import bpe, common, prefix_join
from chronoweave.llm.queries import tokenizer_path

from .conftest import pairs

ODD = [
    "", " ", "  a", "a\n\n b\t c  ", "it's I'LL 've <|endoftext|> x<|endoftext|><|endoftext|>", "\x1c\x1d a\x1f\x85b c　 d", "é́ 日本語 ١٢ Ⅷ ²",
    "x" * 500 + "thethethe" * 60, "a\r\n b", "'s 's'", "﻿a​b᠎ c", "💩 👩‍👩‍👧 ", "a\x00b", "word.\nNext (one), 12ab!",
]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(tokenizer_path())


def test_ids_and_texts_equal_the_library(library):
    with open(tokenizer_path(), encoding="utf-8") as f:
        own = bpe.Tokenizer(f.read(), most=50)
    rnd = random.Random(2)
    for text in ODD + ["".join(rnd.choice("ab 'st\n\t<|endoftext|>1é  .!\x0b\x1c") for _ in range(rnd.randint(1, 60))) for _ in range(2000)]:
        ids = own.encode(text).tolist()
        expected = library.encode(text, add_special_tokens=False).ids
        assert ids == expected, text
        assert own.decode(ids) == library.decode(expected, skip_special_tokens=False), text


def test_long_words_merge_alike():
    with open(tokenizer_path(), encoding="utf-8") as f:
        own = bpe.Tokenizer(f.read())
    rnd = random.Random(4)
    for _ in range(300):
        word = "".join(rnd.choice(["th", "e", "on", "ing", "a"]) for _ in range(rnd.randint(1, 40))).encode()
        assert own.merge_long(word) == own.merge(word)


@pytest.mark.parametrize("docs", ["edge_docs", "some_docs", "no_docs"])
def test_documents_round_trip(docs, request, library):
    docs = request.getfixturevalue(docs)
    got = bpe.decode(bpe.encode(docs, tokenizer_path()), tokenizer_path()).collect()
    assert sorted((r.doc_id, r.text) for r in got if r.doc_id is not None) == sorted((d, t or "") for d, t in pairs(docs) if d is not None)
    for r in got:
        assert r.ids == library.encode(r.text, add_special_tokens=False).ids
    assert len(got) == docs.count()


def test_split_characters_decode_to_replacements(spark):
    with open(tokenizer_path(), encoding="utf-8") as f:
        own = bpe.Tokenizer(f.read())
    half = own.encode("日").tolist()[:1]
    df = spark.createDataFrame([(1, half), (2, None)], "doc_id long, ids array<int>")
    assert [r.text for r in bpe.decode(df, tokenizer_path()).orderBy("doc_id").collect()] == ["�", ""]


def test_batches_decode_as_single_texts(library):
    with open(tokenizer_path(), encoding="utf-8") as f:
        own = bpe.Tokenizer(f.read())
    rnd = random.Random(8)
    texts = [*ODD, "", ""] + ["".join(rnd.choice("ab é日💩\n") for _ in range(rnd.randint(0, 40))) for _ in range(200)]
    rows = [own.encode(t).tolist() for t in texts] + [[rnd.randrange(50257) for _ in range(rnd.randint(0, 30))] for _ in range(200)]
    ids, ends = np.array([i for r in rows for i in r], np.int32), np.cumsum([len(r) for r in rows])
    got = bpe._texts(*own.decode_all(ids, ends)).to_pylist()
    assert got == [library.decode(r, skip_special_tokens=False) for r in rows]
    whole = bpe._texts(*own.decode_all(*[np.array(x) for x in (sum(rows[:4], []), [len(sum(rows[: k + 1], [])) for k in range(4)])])).to_pylist()
    assert whole == texts[:4]
    assert bpe._texts(*own.decode_all(np.array([], np.int32), np.array([0, 0]))).to_pylist() == ["", ""]


def test_a_worker_keeps_few_pieces_and_the_frequent_ones():
    """One text with more different words than the tokenizer may hold, and one word between all of them."""
    with open(tokenizer_path(), encoding="utf-8") as f:
        own = bpe.Tokenizer(f.read(), most=100)
    merged, merge = [], own.merge
    own.merge = lambda word: merged.append(word) or merge(word)
    own.encode(" ".join(f"often {chr(97 + i // 26 % 26)}{chr(97 + i % 26)}{'xyz'[i // 676]}" for i in range(2000)))
    assert len(own.pieces) + len(own.pieces.older) <= 100
    assert merged.count(b" often") == 1 and len(merged) >= 2000


def test_a_worker_keeps_one_operators_cache():
    with open(tokenizer_path(), encoding="utf-8") as f:
        content = f.read()
    prefix_join.shingle_set(b"some words of an earlier stage")
    own = bpe._tokenizer(content)
    assert list(common._kept.values()) == [own] and bpe._tokenizer(content) is own
    prefix_join.shingle_set(b"some words of the next stage, once more")
    assert own not in common._kept.values()
