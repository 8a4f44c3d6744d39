import math
import random

from hypothesis import given, settings
from hypothesis import strategies as st

from levelgraph.llm.mixing import budgets, fill, largest_total, mix, tree
from tests.conftest import rows

TARGETS = "source string, target_share double, max_repeat int"
DOCS = "doc_id long, text string, source string, lang string"


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.floats(0, 5), st.floats(0, 100)), min_size=1, max_size=8), st.floats(0, 300))
def test_fill_keeps_room_and_total(kids, total):
    got = fill(total, {i: w for i, (w, _) in enumerate(kids)}, {i: r for i, (_, r) in enumerate(kids)})
    able = sum(r for w, r in kids if w > 0)
    assert all(got[i] <= r + 1e-6 for i, (_, r) in enumerate(kids))
    assert math.isclose(sum(got.values()), min(total, able), rel_tol=1e-6, abs_tol=1e-6)


def test_siblings_before_ancestors():
    leaves = {("a", "x"): (0.3, 0.0), ("a", "y"): (0.3, 1000.0), ("b", "z"): (0.4, 1000.0)}
    assert budgets(leaves, 100) == {("a", "x"): 0.0, ("a", "y"): 60.0, ("b", "z"): 40.0}
    leaves[("a", "y")] = (0.3, 50.0)  # its siblings can't take it all: the rest goes to the other domain
    assert budgets(leaves, 100) == {("a", "x"): 0.0, ("a", "y"): 50.0, ("b", "z"): 50.0}
    assert largest_total(leaves) == 50 / 0.6


def test_tree():
    stats = [("d", "en", "s", 30), ("d", "de", "s", 10), ("e", "en", "t", 60)]
    leaves = tree(stats, {"s": (0.4, 2), "t": (0.5, 1), "none": (0.1, 5)})
    assert leaves["d", "en", "s"] == (0.4 * 30 / 40, 60.0) and leaves["e", "en", "t"] == (0.5, 60.0)
    assert leaves["d", "de", "none"] == (0.1 * 10 / 100, 0.0) and leaves["e", "en", "none"] == (0.1 * 60 / 100, 0.0)
    # s runs short in both languages of d: no sibling there has room, so that the other domain takes the rest
    got = budgets(leaves, 150)
    assert got["d", "en", "s"] == 60.0 and got["d", "de", "s"] == 20.0 and got["e", "en", "t"] == 60.0
    stats.append(("d", "en", "u", 1000))
    got = budgets(tree(stats, {"s": (0.4, 1), "t": (0.5, 1), "u": (0.1, 1)}), 100)
    assert got["d", "en", "u"] + got["d", "en", "s"] == 40.0 and got["e", "en", "t"] == 50.0 and got["d", "de", "s"] == 10.0


def test_the_last_epoch_is_a_prefix(spark):
    docs = spark.createDataFrame([(i, "tok " * (1 + i % 9), "a", "en") for i in range(300)] + [(i, "tok", "b", "en") for i in range(300, 600)], DOCS)
    goal = spark.createDataFrame([("a", 0.6, 2), ("b", 0.4, 1)], TARGETS)
    mixture, _ = mix(docs, goal, total_tokens=500)
    drawn = docs.where("source = 'a'").selectExpr("doc_id", "xxhash64(1, 0, doc_id, cast(null as long)) as draw").orderBy("draw").collect()
    taken = {r.doc_id for r in mixture.where("source = 'a'").collect()}
    assert {r.doc_id for r in drawn[: len(taken)]} == taken
    assert abs(sum(r.tokens for r in mixture.where("source = 'a'").collect()) - 300) <= 5


def make(spark, n=600, seed=1):
    rnd = random.Random(seed)
    spelled = ["Web-Site", " web_site", "WEB SITE", "book", "Book", "other", None]
    data = [(i, "tok " * rnd.randrange(1, 60), rnd.choice(spelled), rnd.choice(["en", "EN", "de", None])) for i in range(n)]
    data += [(1000, None, "book", "en"), (1001, "", "book", "en"), (None, "tok tok", "book", "en")]
    return spark.createDataFrame(data, DOCS).selectExpr("*", "1 as tokens", "2 as part", "3 as epoch", "4 as row", "5 as share")


def test_shares_and_repeats(spark):
    goal = spark.createDataFrame([("web-site", 0.2, 1), ("BOOK", 0.5, 3), ("nothing", 0.1, 9), ("other", 0.2, 1), (None, 0.5, 1)], TARGETS)
    mixture, report = mix(make(spark), goal)
    got = {r.source: r for r in report.collect()}
    for source, share in (("web-site", 0.2), ("book", 0.5), ("other", 0.2)):  # each with its part of the missing one's
        assert abs(got[source].reached_share - share / 0.9) < 0.015
    assert got["nothing"].n_uses == 0 and got["nothing"].target_share == 0.1
    uses = {}
    for r in mixture.collect():
        uses.setdefault((r.source, r.doc_id), []).append(r.epoch)
    assert max(map(len, uses.values())) <= 3
    assert all(len(set(e)) == len(e) for e in uses.values())
    assert not {1000, 1001} & {i for _, i in uses}


def test_same_seed_same_mixture(spark):
    goal = spark.createDataFrame([("web-site", 0.5, 1), ("book", 0.5, 2)], TARGETS)
    docs = make(spark)
    one, two, three = (rows(mix(d, goal, seed=s)[0].where("doc_id is not null")) for d, s in ((docs, 1), (docs.repartition(3), 1), (docs, 2)))
    assert one == two != three


def test_total_beyond_reach_and_empty(spark):
    goal = spark.createDataFrame([("web-site", 0.5, 1), ("book", 0.5, 2)], TARGETS)
    mixture, report = mix(make(spark), goal, total_tokens=10**9)
    got = {r.source: r for r in report.collect()}
    assert got["book"].tokens == 2 * got["book"].available_tokens and got["web-site"].tokens == got["web-site"].available_tokens
    none, report = mix(spark.createDataFrame([], DOCS), goal)
    assert rows(none) == [] and [r.reached_share for r in report.collect()] == [0.0, 0.0]
    none, report = mix(make(spark), goal.limit(0))
    assert rows(none) == [] and rows(report) == []
