"""Registered queries over a small table of edges, against brute force over all of its edges."""

import math
import random
from collections import Counter, defaultdict
from datetime import datetime, timedelta

import pytest

import __spark_entry__
from levelgraph.plans import betweenness, triangles
from levelgraph.queries.projections import g_ev

from .conftest import rows
from .test_analyses import brute_bfs, scattered
from .test_graph import graph

EDGES = [(a + 2, b + 2) for a, b in scattered(40, 110, 11)]
EDGES += EDGES[:25] + EDGES[:5] + [(3, 3)]
USERS = random.Random(4).choices(range(15), k=60) + [0, 60]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("tables"))
    made = [(i, a, b, 1.0, i % 8) for i, (a, b) in enumerate(EDGES)] + [(900, None, 1, 1.0, 0), (901, 1, None, 1.0, 0)]
    spark.createDataFrame(made, "rec_no long, tail long, head long, weight float, created_level int").write.parquet(f"{d}/xs1.parquet")
    spark.createDataFrame([], "id long, level int, age int, node_kind string").write.parquet(f"{d}/nodes.parquet")
    seen = [(i, datetime(2024, 1, 1) + timedelta(minutes=i), u, 1.0) for i, u in enumerate(USERS)]
    spark.createDataFrame(seen, "event_id long, ts timestamp_ntz, user_id long, value double").write.parquet(f"{d}/events.parquet")
    orders = [(k, a) for k, (a, _) in enumerate(EDGES)]
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long").write.parquet(f"{d}/orders.parquet")
    lines = [(k, b, 1, 1.0) for k, (_, b) in enumerate(EDGES)]
    spark.createDataFrame(lines, "l_orderkey long, l_partkey long, l_linenumber int, l_quantity double").write.parquet(f"{d}/lineitem.parquet")
    matched = [(2, 3), (3, 2), (70, 71), (None, 2)]
    spark.createDataFrame(matched, "tail long, head long").write.parquet(f"{d}/xs1_match.parquet")
    return d


def brute_bc(edges, n, sources):
    """Shares of the shortest paths between each source and each other vertex, from the numbers of paths of all pairs."""
    m, far = Counter(edges), [brute_bfs(edges, v) for v in range(n)]
    paths = [[0] * n for _ in range(n)]
    for s in range(n):
        paths[s][s] = 1
        for v in sorted(far[s], key=far[s].get)[1:]:
            paths[s][v] = sum(paths[s][u] * k for (u, w), k in m.items() if w == v and far[s].get(u) == far[s][v] - 1)
    bc = [0.0] * n
    for s in sources:
        for v in far[s]:
            for t in far[v]:
                if v != s and t != v and far[s][v] + far[v][t] == far[s][t]:
                    bc[v] += paths[s][v] * paths[v][t] / paths[s][t]
    return bc


def query(spark, folder, name):
    return __spark_entry__.queries()[name](spark, folder)


def test_searches_use_every_edge(spark, folder):
    root = min(a for a, _ in EDGES)
    want = brute_bfs(EDGES, root)
    assert dict(rows(query(spark, folder, "bfs_levels"))) == want
    assert rows(query(spark, folder, "bfs_count")) == [(len(want),)]
    assert dict(rows(query(spark, folder, "bfs_reverse"))) == brute_bfs([(b, a) for a, b in EDGES], min(b for _, b in EDGES))
    down = sorted((a, b, want[a]) for a, b in EDGES if a in want and want.get(b) == want[a] + 1)
    assert rows(query(spark, folder, "bfs_down_edges")) == down and len(set(down)) < len(down)
    for name in ("sssp_unweighted", "sssp_unweighted_iter"):
        assert dict(rows(query(spark, folder, name))) == want


def test_depth_first_order_uses_every_edge(spark, folder):
    to, pre, post, parent = defaultdict(set), {}, {}, {}
    for a, b in EDGES:
        to[a].add(b)

    def walk(v, came):
        pre[v], parent[v] = len(pre), came
        for u in sorted(to[v]):
            if u not in pre:
                walk(u, v)
        post[v] = len(post)

    walk(min(to), None)
    assert rows(query(spark, folder, "dfs_order")) == sorted((v, parent[v], pre[v], post[v]) for v in pre)


def test_pushed_ranks_count_parallel_edges(spark, folder):
    n = 1 + max(max(e) for e in EDGES)
    out, r = Counter(a for a, _ in EDGES), [1 / n] * n
    for _ in range(10):
        new = [0.15 / n] * n
        for a, b in EDGES:
            new[b] += 0.85 * r[a] / out[a]
        r = new
    got = dict(rows(query(spark, folder, "pagerank_push")))
    assert len(got) == n and all(math.isclose(got[i], r[i], abs_tol=2e-6) for i in range(n))


def test_betweenness_uses_every_edge(spark, folder):
    edges = list(zip(USERS, USERS[1:]))
    n = 1 + max(USERS)
    assert len(set(edges)) < len(edges)
    got = dict(rows(query(spark, folder, "bc_adj_events")))
    assert len(got) == n and all(math.isclose(got[i], x, abs_tol=1e-6) for i, x in enumerate(brute_bc(edges, n, range(n))))
    drawn = [i for (i,) in rows(betweenness.drawn_sources(g_ev(spark, folder), 100, seed=1))]
    assert len(drawn) == 100
    want = brute_bc(edges, n, drawn)
    got = dict(rows(query(spark, folder, "bc_random")))
    assert len(got) == n and all(math.isclose(got[i], x, abs_tol=1e-6) for i, x in enumerate(want))


def test_components_use_every_edge(spark, folder):
    reach = {v: set(brute_bfs(EDGES, v)) for v in range(1 + max(max(e) for e in EDGES))}
    want = {v: min(u for u in reach[v] if v in reach[u]) for v in reach}
    assert 2 < len(set(want.values())) < len(want)
    assert dict(rows(query(spark, folder, "tarjan_scc"))) == want
    assert dict(rows(query(spark, folder, "scc_many"))) == want


def test_doubled_triangles_use_every_edge(spark, folder):
    m = Counter((min(e), max(e)) for e in EDGES if e[0] != e[1])
    n = 1 + max(max(e) for e in EDGES)
    want = sum(m[a, b] * m[a, c] * m[b, c] for a in range(n) for b in range(a + 1, n) for c in range(b + 1, n))
    assert want > 0 and max(m.values()) > 2
    assert rows(query(spark, folder, "triangle_count_u")) == [(want,)]


def test_a_hub_of_low_id_makes_no_wedges(spark):
    star = spark.range(1, 30_001).selectExpr("0L as src", "id as dst")
    ahead = triangles._ahead(star.withColumnsRenamed({"src": "a", "dst": "b"}))
    assert ahead.groupBy("x").count().where("count > 1").count() == 0
    g = graph(spark, [(0, i) for i in range(1, 9)] + [(1, 2), (1, 2), (0, 1)])
    assert rows(triangles.triangles_doubled(g)) == [(4,)]


def test_every_edge_is_found(spark, folder):
    want = {(2, 3): (None, None), (3, 2): (None, None), (70, 71): (None, None)}
    for e in EDGES:
        level, best = max((k % 8, k) for k, other in enumerate(EDGES) if other == e)
        want[e] = (best, level)
    got = rows(query(spark, folder, "find_edge"), "src", "dst", "edge_id", "created_level")
    assert got == sorted((*k, *v) for k, v in want.items())


def test_every_id_is_printed(spark, folder):
    edges = list(zip(USERS, USERS[1:]))
    lists = lambda v, here, there: " ".join(map(str, sorted(e[there] for e in edges if e[here] == v)))
    assert max(USERS) > 50
    assert rows(query(spark, folder, "adjacency_print")) == [(v, lists(v, 0, 1), lists(v, 1, 0)) for v in range(max(USERS) + 1)]
