import random
from collections import Counter

import numpy as np
import pytest

from levelgraph.llm.frequent_items import WORD, decode, encode, frequent_items
from tests.conftest import rows


def brute(values, share):
    there = [v for v in values if v is not None]
    return sorted((v, n) for v, n in Counter(there).items() if n >= share * len(there))


def test_decodes_with_wrong_and_missing_symbols():
    rnd = np.random.default_rng(1)
    for value in [0, -1, 5, 2**63 - 1, *rnd.integers(-(2**62), 2**62, 20).tolist()]:
        word = encode(np.array([value], np.int64))[0]
        assert decode(word, np.ones(WORD)) == [value]
        spoilt, trust = word.copy(), np.ones(WORD)
        for i in rnd.choice(WORD, 2, replace=False):
            spoilt[i] ^= 77
        assert decode(spoilt, trust) == [value]
        spoilt = word.copy()
        for i in rnd.choice(WORD, 3, replace=False):  # known to be doubtful
            spoilt[i], trust[i] = 0, 0
        assert value in decode(spoilt, trust)


@pytest.mark.parametrize("share", [0.01, 0.05])
def test_against_brute_force(spark, share):
    rnd = random.Random(3)
    values = [rnd.randrange(10**12) for _ in range(20_000)] + [None] * 500
    for k in range(12):
        values += [k * 7 if k % 2 else -k * 10**15 - 1] * (150 + 90 * k)
    rnd.shuffle(values)
    small = [rnd.choice([-1, 0, 1, 2, 3, 500]) if rnd.random() < 0.5 else rnd.randrange(3000) for _ in range(5000)]
    a = spark.createDataFrame([(v,) for v in values], "v long").repartition(7)
    b = spark.createDataFrame([(v, 1, 2) for v in small], "w int, key int, n int")
    got = frequent_items({"a": (a, "v"), "b": (b, "w")}, share).collect()
    assert sorted((r.item, r.n_rows) for r in got if r.field_name == "a") == brute(values, share)
    assert sorted((r.item, r.n_rows) for r in got if r.field_name == "b") == brute(small, share)
    assert all(0 < r.share <= 1 for r in got)


def test_strings_ties_and_edge_cases(spark):
    words = ["x"] * 40 + ["y"] * 40 + [""] * 30 + [None] * 10 + [str(i) for i in range(200)]
    df = spark.createDataFrame([(w,) for w in words], "w string")
    assert rows(frequent_items({"w": (df, "w")}, 0.1), "item", "n_rows") == brute([w for w in words], 0.1) == [("x", 40), ("y", 40)]
    empty = spark.createDataFrame([], "w long")
    assert rows(frequent_items({"w": (empty, "w")})) == []
    assert rows(frequent_items({"w": (spark.createDataFrame([(None,)] * 3, "w long"), "w")})) == []
    assert rows(frequent_items({"w": (spark.createDataFrame([(5,)], "w long"), "w")}), "item", "n_rows") == [(5, 1)]


def test_many_frequent_values_in_few_groups(spark):
    """More frequent values than groups can part at once: later rounds find the rest."""
    values = [v for v in range(40) for _ in range(100)]
    df = spark.createDataFrame([(v * 1_000_003,) for v in values], "v long")
    for rounds in (6, 1):  # after the last one the rest is counted value by value
        assert rows(frequent_items({"v": (df, "v")}, 0.02, rounds), "item", "n_rows") == [(v * 1_000_003, 100) for v in range(40)]
