import math
import random
from collections import defaultdict

import pytest

from levelgraph.llm import top_n
from levelgraph.llm.top_n import beyond, row_group_size, top_n_per_group, top_n_read
from tests.conftest import rows

SCHEMA = "tail long, head long, weight float"


def brute(data, n):
    best = defaultdict(dict)
    for t, h, w in data:
        if t is not None and h is not None and w is not None and not math.isnan(w):
            best[t][h] = max(best[t].get(h, -math.inf), w + 0.0)
    out = []
    for t, heads in best.items():
        ranked = sorted(heads.items(), key=lambda x: (-x[1], x[0]))[:n]
        out += [(t, h, s, k) for k, (h, s) in enumerate(ranked, 1)]
    return sorted(out)


def sample(n=6000):
    rnd = random.Random(4)
    return [
        (1 if rnd.random() < 0.4 else rnd.choice([None, rnd.randrange(80)]), rnd.choice([None, rnd.randrange(900)]), rnd.choice([None, float("nan"), 0.0, -0.0, -1.0, 3.0, rnd.random() * 50]))
        for _ in range(n)
    ]


@pytest.mark.parametrize("n", [1, 5])
def test_against_brute_force(spark, n, monkeypatch):
    monkeypatch.setattr(top_n, "LEAST_ROWS", 100)
    data = [(t, h, None if w is None else float(__import__("numpy").float32(w))) for t, h, w in sample()]
    df = spark.createDataFrame(data, SCHEMA).selectExpr("*", "1 as grp", "2 as item", "3 as score", "4 as place")
    assert rows(top_n_per_group(df.select(*df.columns[:-1]), "tail", "head", "weight", n)) == brute(data, n)


def read_of(df, n=5):
    top, counts = top_n_read(df, "tail", "head", "weight", n)
    return rows(top), tuple(counts.first())


def test_skips_row_groups_of_a_hot_group_across_files(spark, monkeypatch):
    monkeypatch.setattr(top_n, "LEAST_ROWS", 1000)
    hot = spark.range(120_000).selectExpr("if(id % 3 = 0, id, -1) as tail", "id as head", "cast(id % 50000 as float) as weight").repartition(6)
    got, (read, there) = read_of(hot)
    assert there >= 100 and read <= there - 70  # 80,000 rows of one group, of whose row groups only the first are read
    assert got == brute([(-1 if h % 3 else h, h, float(h % 50000)) for h in range(120_000)], 5)


def test_ties_repeated_items_and_one_row_very_often(spark, monkeypatch):
    monkeypatch.setattr(top_n, "LEAST_ROWS", 500)
    tied = spark.range(20_000).selectExpr("1L as tail", "id as head", "cast(2 as float) as weight")
    got, (read, there) = read_of(tied)
    assert got == [(1, h, 2.0, h + 1) for h in range(5)] and there >= 40 and read < 10  # ties are told apart by item
    often = spark.range(30_000).selectExpr("1L as tail", "if(id < 29000, 7, id) as head", "cast(if(id < 29000, 100 + id % 3, id % 40) as float) as weight")
    got, (read, there) = read_of(often)
    assert got[0] == (1, 7, 102.0, 1) and [r[2] for r in got[1:]] == [39.0] * 4  # the first row groups hold one item alone


def test_bounds():
    assert beyond(1.0, 5, (2.0, 3)) and beyond(2.0, 4, (2.0, 3))
    assert not beyond(2.0, 3, (2.0, 3)) and not beyond(3.0, 9, (2.0, 3)) and not beyond(0.0, 0, None)
    assert [row_group_size(n) for n in (0, 408_000, 4_080_000, 10**11)] == [1024, 1024, 2040, 1_000_000]


def test_all_tied_and_edge_cases(spark):
    tied = [(1, h, 2.0) for h in range(50)] * 2
    assert rows(top_n_per_group(spark.createDataFrame(tied, SCHEMA), "tail", "head", "weight", 5)) == [(1, h, 2.0, h + 1) for h in range(5)]
    assert rows(top_n_per_group(spark.createDataFrame([], SCHEMA), "tail", "head", "weight", 5)) == []
    assert rows(top_n_per_group(spark.createDataFrame([(None, 1, 1.0), (1, None, 1.0), (1, 1, None)], SCHEMA), "tail", "head", "weight", 5)) == []
    with pytest.raises(ValueError):
        top_n_per_group(spark.createDataFrame([], SCHEMA), "tail", "head", "weight", 0)
