import random
from collections import Counter
from types import SimpleNamespace

import numpy as np
import pandas as pd
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from levelgraph.llm import packing
from levelgraph.llm.packing import GAP, ITEM, MATCH, SUMMARY, chunked, decide, fill_report, hand_down, pack, pack_runs
from levelgraph.llm.tokens import VOCABULARY, counter
from levelgraph.workspace import Workspace
from tests.conftest import rows


def swept(sizes, capacity, parts):
    """Matches of all supersteps over parts, and how many these were, without Spark."""
    runs = sorted(Counter(sizes).items())
    bounds = np.array([runs[i * len(runs) // parts][0] for i in range(parts)] if runs else [0], np.int64)
    home = lambda v: max(0, int(np.searchsorted(bounds, v, "right")) - 1)
    state = [(ITEM, s, 0, n, home(s), 0) for s, n in runs]
    opened, following, grants, least, out, k = {}, [1], [], {}, [], 0
    for p in range(len(bounds) - 1, -1, -1):
        large = sum(n for s, n in runs if 2 * s > capacity and home(s) == p)
        if large:
            opened[p, 0] = (large, following[0])
            following[0] += large
    while state:
        k += 1
        sent = []
        for kind, key, first, n, h, pre in state:
            own = [g for g in grants if g[1] == h] if kind == GAP and pre >= 0 else []
            if not own:
                sent.append((kind, key, first, n, h))
            for _, _, lo, hi, to in own:
                a, b = max(lo, pre), min(hi, pre + n)
                if a < b:
                    sent.append((kind, key, first + a - pre, b - a, to))
        table = pd.DataFrame(sent, columns=["kind", "key", "first", "n", "dest"])
        step = packing._sweeper(bounds, [capacity], opened, least)
        got = [r for _, part in table.groupby("dest") for r in step(part).to_dict("records")]
        out += [r for r in got if r["kind"] == MATCH]
        seen = [SimpleNamespace(**r) for r in got if r["kind"] == SUMMARY]
        opened, grants, least, left = decide(seen, [capacity], following)
        state = [tuple(r[c] for c in ("kind", "key", "first", "n", "home", "pre")) for r in got if r["kind"] <= ITEM] if left else []
    return out, k


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 100), max_size=80), st.integers(1, 6))
def test_every_item_in_one_container(sizes, parts):
    load, seen = {}, set()
    for r in swept(sizes, 100, parts)[0]:
        for i in range(r["each"] * r["n"]):
            assert (r["key"], r["first"] + i) not in seen
            seen.add((r["key"], r["first"] + i))
            c = r["container"] + i // r["each"]
            load[c] = load.get(c, 0) + r["key"]
    assert len(seen) == len(sizes) and all(v <= 100 for v in load.values())
    assert not load or sorted(load) == list(range(1, len(load) + 1))
    full = sorted(load.values())
    assert len(full) < 2 or full[0] + full[1] > 100 or sum(sizes) > 50 * len(full)


def test_fills_well_however_many_parts():
    rnd = random.Random(1)
    sizes = [min(1000, int(rnd.lognormvariate(5, 1))) + 1 for _ in range(5000)]
    for parts in (1, 4, 32):
        found, steps = swept(sizes, 1024, parts)
        used = max(r["container"] + r["n"] - 1 for r in found)
        assert used <= 1.01 * -(-sum(sizes) // 1024) and steps < 100


def test_gaps_are_handed_down():
    part = lambda home, items, most, over, least_gap: {"home": home, "items": items, "most": most, "over": over, "least_gap": least_gap}
    parts = [part(3, 0, 0, 10, 90), part(2, 4, 60, 3, 40), part(1, 8, 20, 0, 0), part(0, 1, 5, 0, 0)]
    # 4 of part 3's smallest go to part 2; part 1 takes part 2's, which hold two each, then part 3's next ones
    assert hand_down(parts) == [(3, 0, 4, 2), (2, 0, 3, 1), (3, 4, 5, 1), (3, 5, 6, 0)]
    assert hand_down([part(1, 5, 9, 0, 0), part(0, 0, 0, 7, 3)]) == []


def test_supersteps_on_spark(spark):
    rnd = random.Random(3)
    sizes = {0: [rnd.randrange(1, 200) for _ in range(900)], 1: [rnd.randrange(1, 1000) for _ in range(700)] + [1000] * 500}
    runs = spark.createDataFrame([(c, s, n) for c, own in sizes.items() for s, n in Counter(own).items()], "cap int, size long, n long")
    found, rounds = pack_runs(Workspace(spark, "test"), runs, [256, 1000], part_runs=64)
    load, placed = Counter(), Counter()
    for r in found.collect():
        placed[r.cap, r["size"]] += r.each * r.containers
        for k in range(r.containers):
            load[r.cap, r.container + k] += r.each * r["size"]
    assert placed == Counter((c, s) for c, own in sizes.items() for s in own) and rounds > 3
    for c, most in ((0, 256), (1, 1000)):
        own = [t for (cap, _), t in load.items() if cap == c]
        assert max(own) <= most and len(own) <= 1.02 * -(-sum(sizes[c]) // most)


def test_a_run_of_very_many_ranks(spark):
    one = spark.createDataFrame([(0, 1024, 7, 1, 100_000_000, 5)], "cap int, size long, first_rank long, each long, containers long, container long")
    got = chunked(one).agg(F.count(F.lit(1)), F.min("chunk"), F.max("chunk"), F.count_distinct("chunk")).first()
    assert tuple(got) == (1_562_501, 0, 1_562_500, 1_562_501)


def test_pack_documents(spark):
    rnd = random.Random(2)
    texts = [None, "", "word"] + [" ".join(rnd.choice(["alpha", "beta", "12", "gamma delta\n"]) for _ in range(rnd.randrange(1, 400))) for _ in range(120)]
    data = [(i, t) for i, t in enumerate(texts)] + [(None, texts[5])] * 3 + [(7, texts[7])] + [(900, "x y " * 5000)]
    docs = spark.createDataFrame(data, "doc_id long, text string").selectExpr("*", "1 as size", "2 as sub", "3 as rank", "4 as tokens", "5 as row")
    caps = spark.createDataFrame([("a", 64), ("b", 300), ("b", 200), ("c", None), (None, 5), ("d", 0)], "capacity_name string, capacity_tokens int")
    got = pack(docs, caps).collect()
    count = counter(VOCABULARY)
    for name, cap in (("a", 64), ("b", 300)):
        own = [r for r in got if r.capacity_name == name]
        load = {}
        for r in own:
            load[r.container_no] = load.get(r.container_no, 0) + r.tokens
        assert max(load.values()) <= cap
        want = sorted((-1 if i is None else i, p, min(cap, n - p * cap)) for i, t in data for n in [count(t)] for p in range(max(1, -(-n // cap))))
        assert sorted((-1 if r.doc_id is None else r.doc_id, r.part_no, r.tokens) for r in own) == want
        assert {r.container_no for r in own if not r.tokens} == {0}
    assert {r.capacity_name for r in got} == {"a", "b"}
    report = {r.capacity_name: r for r in fill_report(pack(docs, caps), caps).collect()}
    assert all(r.fullest <= r.capacity_tokens and r.n_containers >= r.least_containers and r.filled > 0.9 for r in report.values())


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    caps = spark.createDataFrame([("a", 64)], "capacity_name string, capacity_tokens int")
    assert rows(pack(docs, caps)) == []
    assert rows(pack(spark.createDataFrame([(1, "x")], docs.schema), caps.limit(0))) == []
    assert rows(pack(spark.createDataFrame([(1, None)], docs.schema), caps)) == [("a", 0, 1, 0, 0)]
