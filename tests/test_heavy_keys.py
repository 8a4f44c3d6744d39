import math
import random
from collections import Counter, defaultdict

import pytest

from levelgraph.operators.heavy_keys import heavy_keys, node_totals

from .conftest import rows

SCHEMA = "tail long, head long, weight float"


def brute(data, share):
    out = {}
    for side, a, b in (("tail", 0, 1), ("head", 1, 0)):
        total = sum(r[a] is not None for r in data)
        groups = defaultdict(list)
        for r in data:
            if r[a] is not None:
                groups[r[a]].append(r)
        for node, g in groups.items():
            w = [r[2] for r in g if r[2] is not None and not math.isnan(r[2])]
            others = {r[b] for r in g if r[b] is not None}
            out[side, node] = (len(g), len(w), round(sum(w), 3) if w else None, len(others), len(g) >= share * total)
    return out


def got(df):
    return {(r.side, r.node): (r.n_records, r.n_weights, None if r.sum_weight is None else round(r.sum_weight, 3), r.n_others, r.is_heavy) for r in df.collect()}


def test_totals_with_skew_nulls_and_repeats(spark):
    rnd = random.Random(1)
    data = []
    for _ in range(3000):
        tail = 7 if rnd.random() < 0.35 else rnd.choice([None, rnd.randrange(400)])
        head = 9 if rnd.random() < 0.3 else rnd.choice([None, rnd.randrange(400)])
        data.append((tail, head, rnd.choice([None, float("nan"), 0.0, -0.0, -2.5, float(rnd.randrange(50))])))
    data += data[:100] * 3
    df = spark.createDataFrame(data, SCHEMA)
    assert got(node_totals(df, share=0.1, salts=4)) == brute(data, 0.1)
    # extra columns whose names the operator uses itself
    clash = df.selectExpr("*", "tail as node", "head as other", "'x' as side", "1 as n", "2 as _hot", "3 as _salt")
    assert got(node_totals(clash, share=0.1)) == brute(data, 0.1)


def test_empty_and_all_null(spark):
    assert rows(node_totals(spark.createDataFrame([], SCHEMA))) == []
    assert rows(node_totals(spark.createDataFrame([(None, None, 1.0)] * 3, SCHEMA))) == []
    one = node_totals(spark.createDataFrame([(1, None, None)], SCHEMA)).collect()
    assert [(r.side, r.node, r.n_records, r.n_others, r.sum_weight, r.is_heavy) for r in one] == [("tail", 1, 1, 0, None, True)]


def test_share_at_the_border(spark):
    data = [(1, 0, 1.0)] * 25 + [(2, 0, 1.0)] * 24 + [(100 + i, 0, 1.0) for i in range(951)]
    heavy = node_totals(spark.createDataFrame(data, SCHEMA), share=0.025).where("is_heavy and side = 'tail'")
    assert rows(heavy, "node") == [(1,)]


def test_candidates_miss_no_heavy_key(spark):
    rnd = random.Random(2)
    keys = [rnd.randrange(20_000) for _ in range(30_000)] + [5] * 900 + [6] * 700
    rnd.shuffle(keys)
    df = spark.createDataFrame([(k, i % 2) for i, k in enumerate(keys)], "k long, part int").repartition(16)
    found = {(r.part, r.k) for r in heavy_keys(df, "k", 0.02, by=("part",)).collect()}
    for part in (0, 1):
        own = [k for i, k in enumerate(keys) if i % 2 == part]
        assert {(part, k) for k, n in Counter(own).items() if n >= 0.02 * len(own)} <= found
    assert len(found) <= 200


def test_bad_arguments(spark):
    df = spark.createDataFrame([], SCHEMA)
    with pytest.raises(ValueError):
        heavy_keys(df, "nothing", 0.1)
    with pytest.raises(ValueError):
        heavy_keys(df, "tail", 0)
