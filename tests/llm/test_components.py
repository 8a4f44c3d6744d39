import random

import pytest

from levelgraph.llm.components import _groups, connected_groups
from tests.conftest import rows


def brute(pairs):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in pairs:
        for x in (a, b):
            if x is not None:
                find(x)
        if a is not None and b is not None:
            a, b = sorted((find(a), find(b)))
            parent[b] = a
    return sorted((find(x), x) for x in list(parent))


def shapes(seed):
    rnd, pairs, at = random.Random(seed), [], 0
    def some(n):
        nonlocal at
        ids = list(range(at, at + n))
        rnd.shuffle(ids)
        at += n + rnd.randrange(3)
        return ids
    p = some(120); pairs += list(zip(p, p[1:]))  # a chain
    c = some(50); pairs += list(zip(c, c[1:] + c[:1]))  # a ring
    s = some(150); pairs += [(s[0], x) for x in s[1:]]  # a star
    t = some(150); pairs += [(t[rnd.randrange(i)], t[i]) for i in range(1, 150)]  # a tree
    k = some(14); pairs += [(a, b) for a in k for b in k if a < b]  # a dense core
    for _ in range(15):
        q = some(2); pairs.append(tuple(q))
    pairs += [(b, a) for a, b in pairs[:60]] + pairs[:40] + [(7, 7), (at + 5, at + 5), (None, at + 9), (3, None), (None, None)]
    rnd.shuffle(pairs)
    return pairs


@pytest.mark.parametrize("finish_arcs", [0, 10, 100_000])
def test_against_union_find(spark, finish_arcs):
    pairs = shapes(finish_arcs)
    df = spark.createDataFrame([(a, b, 0.5, 1, 2, 3) for a, b in pairs], "tail long, head long, weight float, src int, dst int, node int")
    assert rows(connected_groups(df, finish_arcs=finish_arcs)) == brute(pairs)


def test_edge_cases(spark):
    make = lambda p: rows(connected_groups(spark.createDataFrame(p, "tail long, head long"), finish_arcs=0))
    assert make([]) == []
    assert make([(None, None)]) == []
    assert make([(4, 4)]) == [(4, 4)]
    assert make([(None, 2), (1, None)]) == [(1, 1), (2, 2)]
    assert make([(2, 1)] * 5 + [(1, 2)] * 5) == [(1, 1), (1, 2)]


def test_every_way_is_taken(spark):
    pairs = shapes(5) + [(5000 + i % 40, 5000 + (i * i + 7 * i + 3) % 41) for i in range(900)]  # a large core
    df = spark.createDataFrame(pairs, "tail long, head long")
    for most in (0, 10_000):
        got, rounds = _groups(df, "tail", "head", most)
        assert rows(got) == brute(pairs)
        assert rounds["strip"] > 2 and (rounds["mate"] > 1 and not rounds["finish"]) == (most == 0)


def test_a_hub_that_most_links_have(spark):
    star = [(0, i) for i in range(1, 3001)]
    rest = [(10_000 + 2 * i, 10_001 + 2 * i) for i in range(500)] + [(20_000 + i, 20_000 + j) for i in range(12) for j in range(i)]
    got, rounds = _groups(spark.createDataFrame(star + rest, "tail long, head long"), "tail", "head", 0)
    assert rows(got) == brute(star + rest) and rounds["mate"]
