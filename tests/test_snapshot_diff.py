import math
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from levelgraph.functions.hashing import np_xxhash64
from levelgraph.operators.snapshot_diff import peel, snapshot_changes

from .conftest import rows

SCHEMA = "rec_no long, snapshot_no int, delivery_no int, tail long, head long, weight float"


def same(a, b):
    if a is None or b is None:
        return a is b
    return (math.isnan(a) and math.isnan(b)) or a == b


def brute(data):
    last = {}
    for r in data:
        if r[1] is not None:
            last[r[1]] = max(last.get(r[1], r[2]), r[2])
    content = {s: {} for s in last}
    for r in sorted(data):
        if r[1] is not None and r[2] == last[r[1]] and r[3] is not None and r[4] is not None:
            content[r[1]][r[3], r[4]] = r[5]
    out, order = [], sorted(content)
    for a, b in zip(order, order[1:]):
        x, y = content[a], content[b]
        out += [(b, *k, "added") for k in y.keys() - x.keys()] + [(b, *k, "removed") for k in x.keys() - y.keys()]
        out += [(b, *k, "changed") for k in x.keys() & y.keys() if not same(x[k], y[k])]
    return sorted(out)


def sample(seed, n=400):
    rnd, data, no = random.Random(seed), [], 0
    for s in (2, 3, 7, 9):
        for delivery in range(1, rnd.choice([2, 3])):
            for _ in range(n):
                end = lambda: rnd.choice([None] + list(range(30)))
                data.append((no, s, delivery, end(), end(), rnd.choice([None, float("nan"), 0.0, -0.0, 1.0, 2.0])))
                no += 1
    return data


@pytest.mark.parametrize("cells", [3, 48, 4096])
def test_against_brute_force(spark, cells):
    """Few cells make buckets fail, be enlarged, and in the end be compared exactly."""
    data = sample(cells)
    df = spark.createDataFrame(data, SCHEMA)
    assert rows(snapshot_changes(df, bucket_pairs=64, cells=cells)) == brute(data)


def test_exact_way_alone_and_clashing_names(spark):
    data = sample(5, 100)
    df = spark.createDataFrame(data, SCHEMA).selectExpr("*", "1 as bucket", "2 as vh", "3 as cell", "4 as sign", "5 as n")
    assert rows(snapshot_changes(df, cells=3, rounds=1)) == brute(data)


def test_edge_cases(spark):
    make = lambda d: rows(snapshot_changes(spark.createDataFrame(d, SCHEMA)))
    assert make([]) == []
    assert make([(1, 1, 1, 1, 1, 1.0)]) == []
    nan = float("nan")
    equal = [(0, 1, 1, 1, 1, nan), (1, 1, 1, 2, 2, None), (2, 1, 1, 3, 3, 0.0), (3, 2, 1, 1, 1, nan), (4, 2, 1, 2, 2, None), (5, 2, 1, 3, 3, -0.0)]
    assert make(equal) == []
    assert make([(0, 1, 1, 1, 1, None), (1, 2, 1, 1, 1, nan)]) == [(2, 1, 1, "changed")]
    # a snapshot whose rows all lack an end is there, and empty
    assert make([(0, 1, 1, 1, 1, 1.0), (1, 2, 1, None, 1, 1.0), (2, 3, 1, 1, 1, 1.0)]) == [(2, 1, 1, "removed"), (3, 1, 1, "added")]
    assert make([(0, 1, 1, 1, 1, 1.0), (1, 1, 1, 4, 4, 1.0), (2, 2, 1, 1, 1, 1.0), (3, 3, 1, 1, 1, 2.0)]) == [(2, 4, 4, "removed"), (3, 1, 1, "changed")]


def test_a_pair_that_is_most_rows(spark):
    data = [(i, 1, 1, 5, 6, float(i)) for i in range(2000)] + [(5000 + i, 2, 1, 5, 6, 7.0) for i in range(2000)]
    assert rows(snapshot_changes(spark.createDataFrame(data, SCHEMA))) == [(2, 5, 6, "changed")]


def test_hash_is_sparks(spark):
    values = [0, 1, -1, 2**63 - 1, -(2**63), 42]
    df = spark.createDataFrame([(a, b) for a in values for b in values], "a long, b long").select("a", "b", F.xxhash64("a", "b").alias("h")).toPandas()
    assert (np_xxhash64(df["a"].to_numpy(), df["b"].to_numpy()) == df["h"].to_numpy()).all()


@settings(max_examples=30, deadline=None)
@given(st.sets(st.tuples(st.integers(0, 50), st.integers(0, 50), st.integers(-(2**62), 2**62), st.sampled_from([-1, 1])), max_size=12))
def test_peel_round_trip(pairs):
    cells = 96
    tail, head, vh, sign = (np.array(x, np.int64) for x in zip(*pairs)) if pairs else (np.zeros(0, np.int64),) * 4
    count, table = np.zeros(cells + 1, np.int64), np.zeros((cells + 1, 4), np.int64)
    one = lambda k: np.full(len(tail), k, np.int64)
    for i in range(3):
        c = i * 32 + np.mod(np_xxhash64(tail, head, vh, one(i)), 32)
        np.add.at(count, c, sign)
        for j, x in enumerate((tail, head, vh, np_xxhash64(tail, head, vh, one(11)))):
            np.bitwise_xor.at(table[:, j], c, x)
    count[cells] = sign.sum()
    table[cells, 3] = np.bitwise_xor.reduce(np_xxhash64(tail, head, vh, one(12)), initial=0)
    cell = np.r_[np.arange(cells), -1]
    which, t, h, v, s, ok = peel(np.zeros(cells + 1, np.int64), cell, count, table, cells)
    opposite = {(a, b, c) for a, b, c, _ in pairs if (a, b, c, 1) in pairs and (a, b, c, -1) in pairs}
    want = {p for p in pairs if p[:3] not in opposite}
    if ok.all():
        assert set(zip(t.tolist(), h.tolist(), v.tolist(), s.tolist())) == want
