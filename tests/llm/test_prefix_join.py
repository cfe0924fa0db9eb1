import re

import pytest

from chronoweave.llm import prefix_join

from .conftest import by_doc, pairs, prose

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def brute(rows):
    """Rows are nodes; a component's name is its least doc_id."""
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= 75 * len(a | sets[j]):
                root[top(i)] = top(j)
    names = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            names[top(i)] = min(names.get(top(i), d), d)
    return sorted(((d, len(s), names.get(top(i)) if s else d) for i, ((d, _), s) in enumerate(zip(rows, sets))), key=repr)


@pytest.mark.parametrize("docs", ["edge_docs", "some_docs", "no_docs"])
def test_agrees_with_brute_force(docs, request):
    docs = request.getfixturevalue(docs)
    assert by_doc(prefix_join.similar(docs)) == brute(pairs(docs))


def edited(rnd, words, edits):
    out = list(words)
    for i in rnd.sample(range(len(out)), edits):
        out[i] = f"new{rnd.randrange(10**6)}"
    return " ".join(out)


@pytest.fixture(scope="module")
def families(spark, rnd):
    """Stars (copies that only a base links), chains, equal sets in another order, and a group of very many copies."""
    rows, n = [], 0
    for family in range(6):
        base = prose(rnd, 160).split()
        texts = [edited(rnd, base, k) for k in (3, 3, 4, 4, 5, 2, 1)] + ([" ".join(base)] if family % 2 else [])
        chain = base
        for _ in range(4):
            chain = edited(rnd, chain, 4).split()
            texts.append(" ".join(chain))
        texts += [" ".join(base)] * (30 if family == 2 else 0) + [" ".join(base + base[:20])]
        passage = " ".join(base[:60])
        texts += [passage + " " + prose(rnd, k) for k in (5, 10, 18, 25, 80, 90)] + [passage] * 2
        rows += [(100 + n + i, t) for i, t in enumerate(texts)]
        n += len(texts)
    rnd.shuffle(rows)
    return spark.createDataFrame(rows, "doc_id long, text string")


@pytest.mark.parametrize("hot", [1000, 3])
def test_families_agree_with_brute_force(families, monkeypatch, hot):
    from chronoweave.llm import shared_tokens

    monkeypatch.setattr(shared_tokens, "LEAST_HOT", hot)
    monkeypatch.setattr(shared_tokens, "TOKENS_PER_RANGE", 300)
    assert by_doc(prefix_join.similar(families)) == brute(pairs(families))


def test_one_document_of_each_group_stays(families):
    kept = {r.doc_id for r in prefix_join.one_of_each(families).collect()}
    expected = brute(pairs(families))
    assert kept == {c for _, _, c in expected}
    assert prefix_join.one_of_each(families).columns == families.columns
