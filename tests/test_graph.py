import random

import pytest
from pyspark.sql import functions as F

from levelgraph import Graph
from levelgraph.graph import edge_id, level_of
from levelgraph.operators import transform
from levelgraph.operators.mutation import Delta, delete_by_visible_level, set_edge_property, set_node_property
from levelgraph.plans.ordering import with_row_number
from levelgraph.store import Store, flatten
from levelgraph.tools import inspect

from .conftest import rows


def graph(spark, edges, nodes=None, level=0):
    """edges: (src, dst[, level[, weight]])"""
    made = [(e[0], e[1], e[2] if len(e) > 2 else level, float(e[3]) if len(e) > 3 else 1.0, i) for i, e in enumerate(edges)]
    df = spark.createDataFrame(made, "src long, dst long, created_level int, weight double, edge_id long")
    return Graph(df, spark.createDataFrame(nodes, "id long, level int, age int") if nodes else None)


def pairs(g):
    return rows(g.view, "src", "dst")


def test_levels_windows_and_deletions(spark):
    g = graph(spark, [(0, 1, 0), (0, 2, 0), (0, 3, 1)])
    g.edges = g.edges.withColumn("deleted_level", F.when(F.col("dst") == 1, 1))
    assert pairs(g.at(0)) == [(0, 1), (0, 2)]
    assert pairs(g.at(1)) == [(0, 2), (0, 3)]
    assert pairs(g.window(1, 1)) == [(0, 3)]
    spread = {r.n_levels: (r.n_nodes, r.mean_degree) for r in inspect.level_spread(g.at(1)).collect()}
    assert spread == {2: (1, 2.0), 0: (3, 0.0)}
    assert pairs(g.reverse().at(1)) == [(2, 0), (3, 0)]
    with pytest.raises(ValueError):
        g.window(2, 1)
    with pytest.raises(ValueError):
        g.window(1, 1).window(0, 1)


def test_sizes_and_degrees(spark):
    g = graph(spark, [(0, 1), (0, 1), (0, 2), (4, 4, 3)])
    assert (g.max_nodes, g.num_levels) == (5, 4)
    assert rows(g.out_degree()) == [(0, 3), (1, 0), (2, 0), (3, 0), (4, 1)]
    assert rows(g.in_degree()) == [(0, 0), (1, 2), (2, 1), (3, 0), (4, 1)]
    assert rows(g.existing()) == [(0,), (1,), (2,), (4,)]
    assert rows(g.top_degree(2)) == [(0, 3, 1), (4, 1, 2)]
    assert rows(g.level_sizes()) == [(0, 3, 3), (3, 1, 5)]
    assert rows(g.modified_nodes(3)) == [(4,)]
    assert [r.id for r in g.random_nodes(3, 1).collect()] == [r.id for r in g.random_nodes(3, 1).collect()]
    empty = graph(spark, [])
    assert (empty.max_nodes, empty.num_levels, rows(empty.out_degree())) == (0, 0, [])


def test_lookups(spark):
    g = graph(spark, [(0, 1, 0), (0, 1, 2), (0, 2, 1), (3, 1, 0), (3, 2, 0)])
    asked = spark.createDataFrame([(0, 1), (1, 0)], "src long, dst long")
    assert rows(g.find(asked)) == [(0, 1, 1, 2), (1, 0, None, None)]
    assert rows(g.at(0).find(asked)) == [(0, 1, 0, 0), (1, 0, None, None)]
    ids = spark.createDataFrame([(0,), (9,)], "id long")
    assert rows(g.out_neighbours(ids)) == [(0, 1, 0), (0, 1, 2), (0, 2, 1)]
    assert rows(g.in_neighbours(spark.createDataFrame([(2,)], "id long")), "neighbour") == [(0,), (3,)]
    assert rows(g.common_neighbours(spark.createDataFrame([(0, 3)], "a long, b long"))) == [(0, 3, 1), (0, 3, 2)]
    assert [(r.id, r.out, r["in"]) for r in g.adjacency(0, 1).orderBy("id").collect()] == [(0, [1, 1, 2], []), (1, [], [0, 0, 3])]
    assert rows(g.edges_exist(spark.createDataFrame([(0,), (1,), (77,)], "edge_id long"), 1)) == [(0, True), (1, False), (77, False)]


def test_properties(spark):
    g = graph(spark, [(0, 1), (2, 1)], [(0, 0, 30), (0, 2, 31), (1, 1, None)])
    assert rows(g.node_property("age")) == [(0, 31), (1, 0), (2, 0)]
    assert rows(g.at(1).node_property("age")) == [(0, 30), (1, 0), (2, 0)]
    assert g.properties() == {"edges": ["weight"], "nodes": ["age"]}
    with pytest.raises(ValueError):
        g.node_property("height")
    more = set_edge_property(g, spark.createDataFrame([(0, 2.5), (0, 1.0)], "edge_id long, weight double"), "weight", add=True)
    assert rows(more.view, "src", "weight") == [(0, 4.5), (2, 1.0)]


def test_transforms(spark):
    loop = graph(spark, [(0, 0), (0, 1)])
    assert rows(transform.undirected_double(loop.edges), "src", "dst") == [(0, 0), (0, 1), (1, 0)]
    assert rows(transform.deduplicate(loop.edges), "src", "dst") == [(0, 0), (0, 1)]
    many = graph(spark, [(3, 1, 0, 5), (3, 1, 0, 2), (3, 1, 1, 9), (1, 3, 0, 1)])
    assert rows(transform.deduplicate(many.edges), "src", "dst", "created_level", "weight") == [(1, 3, 0, 1.0), (3, 1, 0, 2.0), (3, 1, 1, 9.0)]
    assert rows(transform.undirected_ordered(many.edges), "src", "dst") == [(1, 3)] * 4
    sparse = graph(spark, [(10, 500), (500, 7)])
    assert rows(transform.renumber(sparse.edges, transform.compact_ids(sparse.edges)), "src", "dst") == [(1, 2), (2, 0)]
    assert rows(transform.degree_order_ids(graph(spark, [(5, 6), (5, 7), (6, 7)]).edges)) == [(5, 2), (6, 1), (7, 0)]
    e = spark.range(100).selectExpr("id as src", "id + 1 as dst", "0 as created_level")
    back = transform.undirected_double(e)
    parts = [rows(p, "src", "dst") for p in transform.split_edges(back, [0.7, 0.3], 1, keep_pairs=True)]
    assert sum(map(len, parts)) == 200 and all((b, a) in p for p in map(set, parts) for a, b in p)
    assert sorted(sum((rows(transform.part_of(e, ["src"], k, 3), "src") for k in range(3)), [])) == [(i,) for i in range(100)]
    assert rows(with_row_number(e.repartition(7), ["src"], "n"), "src", "n") == [(i, i + 1) for i in range(100)]
    assert rows(with_row_number(e.limit(0), ["src"], "n")) == []


def test_degree_buckets(spark):
    g = graph(spark, [(k, 0) for k in range(1, 5) for _ in range(k)])
    got = {(r.low, r.high): r.n_nodes for r in inspect.degree_distribution(g).collect()}
    assert got == {(0, 1): 2, (2, 3): 2, (4, 7): 1}


def test_delete_every_tenth_node_of_a_star(spark):
    g = graph(spark, [(10, i) for i in range(20) if i != 10])
    d = Delta(g).delete_nodes(g.vertices().where("id % 10 = 0"))
    for after in (d.merged(), d.delete_nodes(g.vertices().where("id = 0")).checkpoint()):
        assert pairs(after) == []
        assert {r.out_degree for r in after.out_degree().collect()} == {0}
        assert len(pairs(after.at(0))) == 19  # the earlier snapshot still has them


def test_delete_every_tenth_edge(spark):
    g = graph(spark, [(i % 7, i % 5) for i in range(95)])
    gone = g.edges.where("edge_id % 10 = 0")
    d = Delta(g).delete_edges(gone).delete_edges(gone)
    for after in (d.merged(), d.checkpoint()):
        assert after.view.where("edge_id % 10 = 0").count() == 0
        assert after.out_degree().agg(F.sum("out_degree")).first()[0] == after.view.count() == 85
    assert pairs(g) == sorted((i % 7, i % 5) for i in range(95))  # without a checkpoint nothing happened
    assert Delta(g).checkpoint() is g


def test_additions(spark):
    g = graph(spark, [(0, 1), (1, 2)])
    new = spark.createDataFrame([(0, 1), (5, 0), (5, 0)], "src long, dst long")
    bag = Delta(g).add_edges(new).merged()
    assert pairs(bag) == [(0, 1), (0, 1), (1, 2), (5, 0), (5, 0)] and bag.max_nodes == 6 and bag.num_levels == 2
    assert bag.edges.select("edge_id").distinct().count() == 5
    absent = Delta(g).add_edges_if_absent(new).add_edges_if_absent(new).merged()
    assert pairs(absent) == [(0, 1), (1, 2), (5, 0)]
    d = Delta(g).add_edges(new)
    assert (Delta(g).next_node_id(), d.next_node_id()) == (3, 6)
    assert pairs(d.delete_nodes(spark.createDataFrame([(5,)], "id long")).merged()) == [(0, 1), (0, 1), (1, 2)]
    weighed = Delta(g).add_weighted(new)
    assert rows(weighed.merged().view, "src", "dst", "stream_weight") == [(0, 1, 2), (1, 2, None), (5, 0, 2)]
    people = graph(spark, [(0, 1)], [(0, 0, 20)])
    assert rows(Delta(people).add_nodes(spark.createDataFrame([(1, 40)], "id long, age int")).merged().node_property("age")) == [(0, 20), (1, 40)]
    ids = g.edges.where("src = 0")
    assert pairs(delete_by_visible_level(g, ids, 1).at(1)) == [(1, 2)] and len(pairs(delete_by_visible_level(g, ids, 1).at(0))) == 2


def test_weights_add_up_over_calls(spark):
    g = graph(spark, [(0, 1)])
    new = spark.createDataFrame([(5, 6), (5, 6), (0, 1), (None, 1)], "src long, dst long")
    d = Delta(g).add_weighted(new).add_weighted(new.where("src = 5").limit(1)).add_weighted(new.where("src = 0"))
    assert rows(d.merged().view, "src", "dst", "stream_weight") == [(0, 1, 3), (5, 6, 3)]
    assert rows(d.checkpoint().at(0).view, "src", "dst") == [(0, 1)]


def test_pending_edges_can_go(spark):
    g = graph(spark, [(0, 1)])
    d = Delta(g).add_edges(spark.createDataFrame([(2, 3), (2, 3), (4, 5)], "src long, dst long"))
    ids = d.merged().view.where("src = 2").select("edge_id").orderBy("edge_id")
    first = ids.limit(1)
    one = d.delete_edges(first)
    assert pairs(one.merged()) == [(0, 1), (2, 3), (4, 5)]
    again = one.add_edges(spark.createDataFrame([(7, 8)], "src long, dst long"))  # ids stay, and aren't used twice
    kept = rows(again.merged().edges, "src", "edge_id")
    assert kept == sorted(rows(d.merged().edges.join(first, "edge_id", "left_anti"), "src", "edge_id") + [(7, (1 << 38) + 3)])
    assert pairs(again.delete_edges(ids).checkpoint()) == [(0, 1), (4, 5), (7, 8)]


def test_nodes_without_edges(spark, tmp_path):
    g = graph(spark, [(0, 1)])
    d = Delta(g).add_nodes(spark.createDataFrame([(9, 40), (4, 1)], "id long, age int")).delete_nodes(spark.createDataFrame([(4,)], "id long"))
    for after in (d.merged(), d.checkpoint()):
        assert after.vertices().count() == 10 and rows(after.existing()) == [(0,), (1,), (9,)] and rows(after.at(0).existing()) == [(0,), (1,)]
    store = Store(spark, str(tmp_path / "db"))
    store.save(g)
    assert rows(Delta(store.open()).add_nodes(spark.createDataFrame([(9, 40)], "id long, age int")).checkpoint(store).existing()) == [(0,), (1,), (9,)]
    last = Delta(store.open()).delete_nodes(spark.createDataFrame([(9,)], "id long")).checkpoint(store)
    assert rows(last.existing()) == [(0,), (1,)] and rows(last.at(1).existing()) == [(0,), (1,), (9,)]


def test_levels_of_deletions_alone(spark, tmp_path):
    g = graph(spark, [(0, 1), (1, 2), (2, 3)])
    store = Store(spark, str(tmp_path / "db"))
    store.save(g)
    for k in range(2):
        Delta(store.open()).delete_edges(g.edges.where(f"src = {k}")).checkpoint(store)
    assert pairs(store.open()) == [(2, 3)] and pairs(store.open(max_level=1)) == [(1, 2), (2, 3)] and store.open().num_levels == 3


def test_node_property_add(spark):
    g = graph(spark, [(0, 1, 0), (1, 2, 1)], [(0, 0, 30), (1, 1, 5)])
    values = spark.createDataFrame([(0, 2), (0, 1), (1, 1), (2, 7), (2, None)], "id long, age int")
    assert rows(set_node_property(g, values, "age", add=True).node_property("age")) == [(0, 33), (1, 6), (2, 7)]
    assert rows(set_node_property(g, values, "age").node_property("age")) == [(0, 2), (1, 1), (2, 7)]
    assert rows(set_node_property(g, values, "age").at(0).node_property("age")) == [(0, 30), (1, 0), (2, 0)]


def replayed(edges, log):
    """The log row by row; edges are [src, dst, weight or None]."""
    kinds = ["delete_node", "delete_edge", "add_edge", "add_edge_if_absent", "add_weighted"]
    for op, a, b, _ in sorted(log, key=lambda r: (r[3], kinds.index(r[0]))):
        same = [e for e in edges if e[:2] == [a, b]]
        if op == "delete_node":
            edges = [e for e in edges if a not in e[:2]]
        elif op == "delete_edge":
            edges = [e for e in edges if e not in same]
        elif op == "add_edge" or (op == "add_edge_if_absent" and not same):
            edges = edges + [[a, b, None]]
        elif op == "add_weighted":
            edges = [e for e in edges if e not in same] + [[a, b, 1 + sum(1 if e[2] is None else e[2] for e in same)]]
    return sorted(map(tuple, edges), key=str)


@pytest.mark.parametrize("seed", [1, 2])
def test_log_in_order(spark, seed):
    rnd = random.Random(seed)
    old = [(rnd.randrange(4), rnd.randrange(4)) for _ in range(12)]
    ops = ["delete_node"] + ["delete_edge"] * 4 + ["add_edge", "add_edge_if_absent", "add_weighted"] * 5
    log = [(rnd.choice(ops), rnd.randrange(4), rnd.randrange(4), rnd.randrange(40)) for _ in range(60)]
    g = graph(spark, old)
    g.edges = g.edges.drop("weight")
    got = Delta(g).apply(spark.createDataFrame(log, "op string, src long, dst long, seq int")).merged().view
    assert sorted((tuple(r) for r in got.select("src", "dst", "stream_weight").collect()), key=str) == replayed([[a, b, None] for a, b in old], log)


def test_log_of_operations(spark):
    g = graph(spark, [(0, 1), (1, 2), (2, 3), (3, 0)])
    log = spark.createDataFrame(
        [("delete_edge", 0, 1), ("delete_edge", 0, 1), ("delete_edge", 9, 9), ("delete_node", 3, None), ("add_edge", 0, 5), ("add_edge_if_absent", 1, 2), ("add_edge_if_absent", 2, 1)],
        "op string, src long, dst long",
    )
    assert pairs(Delta(g).apply(log).checkpoint()) == [(0, 5), (1, 2), (2, 1)]
    assert pairs(Delta(g).apply(log.limit(0)).merged()) == pairs(g)
    with pytest.raises(ValueError):
        Delta(g).apply(spark.createDataFrame([("burn", 1, 2)], "op string, src long, dst long"))


def test_handles(spark):
    e = spark.createDataFrame([(5, 77)], "l int, n long").select(edge_id(F.col("l"), F.col("n")).alias("e"))
    assert e.select(level_of(F.col("e"))).first()[0] == 5


def test_store(spark, tmp_path):
    g = graph(spark, [(0, 1, 0), (1, 2, 1), (2, 3, 2)], [(0, 0, 20), (0, 1, 21), (1, 1, 30), (0, 2, 22)])
    store = Store(spark, str(tmp_path / "db"))
    with pytest.raises(ValueError):
        store.open()
    store.save(g)
    assert store.levels() == [0, 1, 2] and pairs(store.open()) == [(0, 1), (1, 2), (2, 3)]
    assert pairs(store.open(max_level=1)) == [(0, 1), (1, 2)]
    gone = Delta(store.open()).delete_edges(g.edges.where("src = 0")).add_edges(spark.createDataFrame([(7, 8, 2.0)], "src long, dst long, weight double"))
    after = gone.checkpoint(store)
    assert pairs(after) == [(1, 2), (2, 3), (7, 8)] and len(pairs(after.at(2))) == 3
    flat = flatten(after)
    assert rows(flat.view, "src", "created_level") == [(1, 0), (2, 0), (7, 0)] and rows(flat.nodes) == [(0, 0, 22), (1, 0, 30)]
    assert store.delete_level(0) and not store.delete_level(0)
    assert pairs(store.open()) == [(1, 2), (2, 3), (7, 8)]
    before = rows(store.open().node_property("age"))
    assert store.keep_recent(1) == [0, 1] and store.levels("nodes") == [2]
    assert rows(store.open().node_property("age")) == before


def test_validation_and_dump(spark):
    a, b = graph(spark, [(0, 1), (0, 1), (1, 2)]), graph(spark, [(1, 2), (0, 1), (0, 3)])
    assert rows(inspect.cross_validate(a, a)) == []
    assert rows(inspect.cross_validate(a, b)) == [("first", 0, 3, 1), ("second", 0, 1, 1)]
    c, d = (graph(spark, [(0, 1)], [(0, 0, 1), (0, 1, n), (1, 0, None)]) for n in (5, 6))
    assert rows(inspect.cross_validate_nodes(c, c)) == [] == rows(inspect.cross_validate_nodes(c.at(0), d.at(0))) == rows(inspect.cross_validate_nodes(a, c))
    assert rows(inspect.cross_validate_nodes(c, d)) == [("first", 0), ("second", 0)]
    assert rows(inspect.dump(a), "line") == [("0\t1 1\t--",), ("1\t2\t0 0",), ("2\t--\t1",)]
    got = inspect.edge_property_stats(graph(spark, [(0, 1, 0, 5), (0, 2, 0, 1), (1, 2, 0, float("nan"))]), "weight").first()
    assert (got.n, got.least, got.most, got.total, got["mean"]) == (2, 1.0, 5.0, 6.0, 3.0)
