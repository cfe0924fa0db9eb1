import random

import pytest

from chronoweave.llm import components


def roots(links):
    of = {}
    for link in links:
        nodes = set(link).union(*(of.get(x, ()) for x in link))
        of.update(dict.fromkeys(nodes, nodes))
    return {x: min(nodes) for x, nodes in of.items() if len(nodes) > 1}


def some_links():
    rnd = random.Random(5)
    chain = list(range(-30, 30))
    rnd.shuffle(chain)
    links = list(zip(chain, chain[1:])) + [(1000 + rnd.randrange(80), 1000 + rnd.randrange(80)) for _ in range(50)]
    return links + [(b, a) for a, b in links[:20]] + [(7000, 7000), (2**63 - 1, -(2**63))]


@pytest.mark.parametrize("piece", [components.PIECE, 40, 1])
def test_pieces_and_rounds_find_the_same_components(spark, piece):
    links = some_links()
    found = components.components(spark.createDataFrame(links, "u long, v long").repartition(5), piece).collect()
    assert sorted(map(tuple, found)) == sorted(roots(links).items())


def test_links_of_one_piece_need_no_rounds(spark, monkeypatch):
    stored = []
    monkeypatch.setattr(components, "pin", lambda df, pin=components.pin: stored.append(1) or pin(df))
    found = components.components(spark.createDataFrame(some_links(), "u long, v long"))
    assert found.count() == len(roots(some_links())) and len(stored) <= 1


def test_no_links(spark):
    assert components.components(spark.createDataFrame([(3, 3)], "u long, v long")).count() == 0
    assert components.components(spark.createDataFrame([], "u long, v long").where("false")).count() == 0
