import re

import pytest

from chronoweave.llm import repetition

from .conftest import pairs

COLUMNS = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "covered_words", "longest_repeat"]


def longest_common(words, i, j):
    k = 0
    while max(i, j) + k < len(words) and words[i + k] == words[j + k]:
        k += 1
    return k


def brute(d, text, least=6):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    n, seen, dup = len(words), set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    at = {}
    for i in range(n - 7):
        at.setdefault(tuple(words[i : i + 8]), []).append(i)
    repeated = {j for v in at.values() if len(v) > 1 for i in v for j in range(i, i + 8)}
    covered, most = set(), 0
    for i in range(n):
        for j in range(i + 1, n):
            k = longest_common(words, i, j)
            most = max(most, k)
            if k >= least:
                covered |= {*range(i, i + k), *range(j, j + k)}
    failed = n < 20 or 100 * len(repeated) > 30 * n
    return (d, n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(repeated), failed, len(covered), most)


@pytest.mark.parametrize("docs", ["edge_docs", "some_docs", "no_docs"])
def test_agrees_with_brute_force(docs, request):
    docs = request.getfixturevalue(docs)
    short = docs.where("text is null or length(text) < 2500")
    got = repetition.rules(short).select(*COLUMNS).collect()
    assert sorted(map(tuple, got), key=repr) == sorted((brute(*p) for p in pairs(short)), key=repr)
    assert repetition.rules(docs).count() == docs.count()


def test_verdicts(spark, rnd):
    words = [f"w{i}" for i in range(400)]
    block = " ".join(words[:60])
    texts = {
        1: " ".join(words), 2: block + " " + " ".join(words[100:160]) + " " + block, 3: " ".join(words[:10]), 4: None,
        5: "\n".join(" ".join(words[i : i + 9]) for i in range(0, 396, 9)) + "\n" + " ".join(words[:9]),
    }
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    assert {r.doc_id: r.kept for r in repetition.rules(df).collect()} == {1: True, 2: False, 3: False, 4: False, 5: True}


def test_one_word_over_and_over_has_every_repeat():
    assert repetition.measure(b"a " * 50, 6)[4:] == (50, 50, 49)
