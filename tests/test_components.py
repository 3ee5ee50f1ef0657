"""Components by stars against a plain union of sets."""

import random

import pytest

from tidewatch.functions.components import components, linked_by


def plain(links):
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in links:
        if a is not None and b is not None and a != b:
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    return {x: find(x) for x in parent}


def chain(n):
    order = list(range(n))
    random.Random(3).shuffle(order)
    return list(zip(order, order[1:]))


@pytest.mark.parametrize("links", [[], [(1, 1), (None, 2), (3, None)], chain(400), [(random.Random(i).randrange(300), random.Random(-i).randrange(300)) for i in range(1, 200)] * 2, [(0, i) for i in range(1, 300)] + [(i, 500) for i in range(300, 350)]])
def test_components(spark, links):
    got = components(spark.createDataFrame(links, "a long, b long")).collect()
    assert len(got) == len({r["node"] for r in got}) and {r["node"]: r["root"] for r in got} == plain(links)


def test_links_of_tokens(spark):
    """A token of many nodes gives as many links as nodes, and joins them all."""
    rows = [(i, "hot") for i in range(200)] + [(200, None), (201, "x"), (202, "x"), (202, "y"), (203, "y"), (203, "y"), (None, "x")]
    links = linked_by(spark.createDataFrame(rows, "id long, t string"), "id", "t")
    assert links.count() == 199 + 2
    roots = {r["node"]: r["root"] for r in components(links).collect()}
    assert {roots[i] for i in range(200)} == {0} and roots[201] == roots[202] == roots[203] == 201 and 200 not in roots
