import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from chronoweave.llm import packing
from chronoweave.llm.queries import QUERIES, tokenizer_path

from .conftest import pairs


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(tokenizer_path())


def one_by_one(sizes, capacity):
    """Best-fit decreasing with one piece at a time."""
    rooms, where = [], {}
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        fit = [b for b, room in enumerate(rooms) if room >= sizes[i]]
        if fit:
            b = min(fit, key=lambda b: rooms[b])
        else:
            b = len(rooms)
            rooms.append(capacity)
        rooms[b] -= sizes[i]
        where[i] = b
    return sorted(rooms)


def fewest(sizes, capacity):
    """The least number of bins, by trying everything."""
    best = len(sizes)
    sizes = sorted(sizes, reverse=True)

    def place(i, rooms):
        nonlocal best
        if len(rooms) >= best:
            return
        if i == len(sizes):
            best = len(rooms)
            return
        for b in {room: k for k, room in enumerate(rooms)}.values():
            if rooms[b] >= sizes[i]:
                rooms[b] -= sizes[i]
                place(i + 1, rooms)
                rooms[b] += sizes[i]
        place(i + 1, [*rooms, capacity - sizes[i]])

    place(0, [])
    return best


def test_counted_packing_is_best_fit_decreasing():
    rnd = random.Random(1)
    for _ in range(300):
        capacity = rnd.choice([7, 10, 20, 100])
        sizes = [rnd.randint(1, capacity) for _ in range(rnd.randint(1, 60))]
        where, offset = packing.best_fit_decreasing(np.array(sizes), capacity)
        used, places = defaultdict(int), defaultdict(list)
        for s, b, o in zip(sizes, where.tolist(), offset.tolist()):
            used[b] += s
            places[b].append((o, s))
        assert sorted(capacity - u for u in used.values()) == one_by_one(sizes, capacity)
        for rows in places.values():
            end = 0
            for o, s in sorted(rows):
                assert o == end
                end += s


def test_bounds_never_pass_the_fewest_bins_and_beat_the_plain_sum():
    rnd, better = random.Random(2), 0
    for _ in range(150):
        capacity = rnd.choice([10, 12, 30])
        sizes = [rnd.randint(1 + capacity // 5, capacity) for _ in range(rnd.randint(1, 11))]
        bound = packing.lower_bound(np.bincount(sizes, minlength=capacity + 1), capacity)
        best = fewest(sizes, capacity)
        assert -(-sum(sizes) // capacity) <= bound <= best
        better += bound > -(-sum(sizes) // capacity)
    assert better > 40


def checked(docs, placed, library, capacity):
    ids_of = {}
    texts = defaultdict(list)
    for d, t in pairs(docs):
        texts[d].append(t or "")
        ids_of.setdefault(t or "", [*library.encode(t or "", add_special_tokens=False).ids, 0])
    want = defaultdict(int)
    for d, t in pairs(docs):
        ids = ids_of[t or ""]
        first = len(ids) % capacity or capacity
        bounds = [0, len(ids)] if len(ids) <= capacity else [0, *range(first, len(ids) + 1, capacity)]
        for k, (a, b) in enumerate(zip(bounds, bounds[1:])):
            want[d, k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())] += 1
    got, bins = defaultdict(int), defaultdict(list)
    for r in placed:
        got[r.doc_id, r.piece, r.start, r.length, r.ids_crc32] += 1
        bins[r.sequence_id].append((r.offset, r.length))
    assert got == want
    for rows in bins.values():
        end = 0
        for o, n in sorted(rows):
            assert o == end
            end += n
        assert end <= capacity
    return len(bins)


@pytest.mark.parametrize("capacity", [2048, 100])
@pytest.mark.parametrize("docs", ["edge_docs", "some_docs"])
def test_documents_are_packed_whole(docs, request, library, capacity):
    docs = request.getfixturevalue(docs)
    cut = packing.pieces(docs, tokenizer_path(), capacity)
    packed = packing.pack(cut, capacity, rows=60)
    assert checked(docs, packed.placed.collect(), library, capacity) == packed.sequences
    assert packed.bound <= packed.sequences <= packed.bound + 2
    got = {}
    for r in packing.sequences(packed, cut).collect():
        assert len(r.ids) == 2 * r.length
        got[r.sequence_id] = np.frombuffer(r.ids, "<u2").astype("<u4")
    for r in packed.placed.collect():
        assert zlib.crc32(got[r.sequence_id][r.offset : r.offset + r.length].tobytes()) == r.ids_crc32


def test_gaps_are_closed_by_exchange(spark):
    """Alone, each part of 7 pieces rounds up; together they reach the bound."""
    rnd = random.Random(4)
    rows = [(i, rnd.choice([30, 40, 50, 20, 10, 60])) for i in range(400)]
    items = spark.createDataFrame(rows, "_uid long, length long")
    alone = packing.pack(items, 100, rows=7, rounds=0)
    packed = packing.pack(items, 100, rows=7)
    total = sum(n for _, n in rows)
    assert packed.bound == -(-total // 100) and alone.sequences > packed.bound + 10
    assert packed.sequences <= packed.bound + 2
    assert packed.placed.count() == 400
    sizes = packed.placed.groupBy("sequence_id").agg(F.sum("length").alias("n"), F.max(F.col("offset") + F.col("length")).alias("end"))
    assert sizes.where("n <> end or n > 100").count() == 0 and sizes.count() == packed.sequences


def test_pieces_that_leave_no_choice(spark):
    items = spark.createDataFrame([(i, 51) for i in range(50)] + [(100 + i, 100) for i in range(5)], "_uid long, length long")
    packed = packing.pack(items, 100, rows=8)
    assert packed.sequences == packed.bound == 55


def test_no_documents(no_docs):
    cut = packing.pieces(no_docs, tokenizer_path())
    packed = packing.pack(cut)
    assert (packed.placed.count(), packed.sequences, packed.bound) == (0, 0, 0)
    assert packing.sequences(packed, cut).count() == 0


def test_a_vocabulary_without_order_goes_to_the_library(library):
    content = open(tokenizer_path(), encoding="utf-8").read()
    fast = packing.encoder(packing.vocabulary(content))
    import json

    spec = json.loads(content)
    vocab = spec["model"]["vocab"]
    vocab["Ġt"], vocab["he"] = vocab["he"], vocab["Ġt"]  # ids no longer follow the merges
    slow = packing.encoder(packing.vocabulary(json.dumps(spec)))
    for text in ("the tail <|endoftext|> of it", "  a\n\n é", ""):
        assert fast(text).tolist() == library.encode(text, add_special_tokens=False).ids
        assert len(slow(text)) == len(fast(text))


def test_query_covers_the_whole_table(spark, library):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    checked(docs, QUERIES["op11_certified_packing"](spark, sf).collect(), library, 2048)
