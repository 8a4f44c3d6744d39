import math
import random
from collections import Counter, defaultdict, deque

import numpy as np
import pytest
from pyspark.sql import functions as F

from levelgraph import tasks
from levelgraph.plans import betweenness, components, near, pagerank, paths, supersteps, traversal, triangles
from levelgraph.workspace import Workspace

from .conftest import rows
from .test_graph import graph

PATH5 = [(0, 1), (1, 2), (2, 3), (3, 4)]
CYCLE3 = [(0, 1), (1, 2), (2, 0)]


def scattered(n=40, m=90, seed=5):
    rnd = random.Random(seed)
    return [(rnd.randrange(n), rnd.randrange(n)) for _ in range(m)]


def brute_bfs(edges, root):
    to, level, q = defaultdict(list), {root: 0}, deque([root])
    for a, b in edges:
        to[a].append(b)
    while q:
        v = q.popleft()
        for u in to[v]:
            if u not in level:
                level[u] = level[v] + 1
                q.append(u)
    return level


def brute_bc(edges, n, sources=None):
    to, bc = defaultdict(list), [0.0] * n
    for a, b in edges:
        to[a].append(b)
    for s in range(n) if sources is None else sources:
        dist, sigma, order, q = {s: 0}, defaultdict(float, {s: 1.0}), [], deque([s])
        while q:
            v = q.popleft()
            order.append(v)
            for u in to[v]:
                if u not in dist:
                    dist[u] = dist[v] + 1
                    q.append(u)
                if dist[u] == dist[v] + 1:
                    sigma[u] += sigma[v]
        delta = defaultdict(float)
        for v in reversed(order):
            for u in to[v]:
                if dist[u] == dist[v] + 1:
                    delta[v] += sigma[v] / sigma[u] * (1 + delta[u])
            if v != s:
                bc[v] += delta[v]
    return bc


def test_pagerank(spark):
    assert [round(r[1], 9) for r in rows(pagerank.pagerank(graph(spark, CYCLE3)))] == [round(1 / 3, 9)] * 3
    assert [round(r[1], 9) for r in rows(pagerank.pagerank(graph(spark, [(0, 1)]), 1))] == [0.075, 0.5]
    one = dict(rows(pagerank.pagerank(graph(spark, [(0, 1), (0, 1), (0, 2)]), 1)))
    assert math.isclose(one[1], 0.05 + 0.85 * 2 / 9) and math.isclose(one[2], 0.05 + 0.85 / 9)
    edges = scattered()
    n = 1 + max(max(e) for e in edges)
    out, r = defaultdict(int), [1 / n] * n
    for a, _ in edges:
        out[a] += 1
    for _ in range(12):
        new = [0.15 / n] * n
        for a, b in edges:
            new[b] += 0.85 * r[a] / out[a]
        r = new
    got = dict(rows(pagerank.pagerank(graph(spark, edges), 12)))
    assert all(math.isclose(got[i], r[i], rel_tol=1e-9) for i in range(n))
    steady = dict(rows(pagerank.pagerank(graph(spark, CYCLE3), 50, tolerance=1e-6)))
    assert math.isclose(sum(steady.values()), 1.0)
    assert rows(pagerank.pagerank(graph(spark, []))) == []
    assert [r.id for r in pagerank.top_ranks(pagerank.pagerank(graph(spark, CYCLE3)), 2).collect()] == [0, 1]


def test_bfs(spark):
    edges = scattered()
    g = graph(spark, edges)
    assert dict(rows(traversal.bfs(g, edges[0][0]))) == brute_bfs(edges, edges[0][0])
    assert dict(rows(traversal.bfs(g, 3, reverse=True))) == brute_bfs([(b, a) for a, b in edges], 3)
    assert dict(rows(traversal.bfs(g, 3, edge_filter=F.col("dst") % 2 == 1))) == brute_bfs([e for e in edges if e[1] % 2], 3)
    assert dict(rows(traversal.bfs(graph(spark, PATH5), 0, on_level=lambda f, k: f.where(F.lit(k < 2))))) == {0: 0, 1: 1, 2: 2}
    assert rows(traversal.bfs_count(graph(spark, PATH5))) == [(5,)]
    long = [(i, i + 1) for i in range(30)]
    assert dict(rows(traversal.bfs(graph(spark, long)))) == {i: i for i in range(31)}
    with pytest.raises(ValueError):
        traversal.bfs(graph(spark, PATH5), 9)
    levels = traversal.bfs(graph(spark, [(0, 1), (0, 1), (1, 0)]))
    assert rows(traversal.down_edges(graph(spark, [(0, 1), (0, 1), (1, 0)]), levels)) == [(0, 1, 0), (0, 1, 0)]


def test_shortest_paths(spark):
    g = graph(spark, [(0, 1, 0, 5), (0, 2, 0, 1), (2, 1, 0, 2), (4, 0, 0, 1)])
    d = traversal.shortest_paths(g, 0, "weight")
    assert rows(d) == [(0, 0.0), (1, 3.0), (2, 1.0)] and traversal.farthest(d).first()[0] == 3
    assert rows(traversal.all_distances(g, d, traversal.UNREACHABLE))[3:] == [(3, 2147483646.0), (4, 2147483646.0)]
    edges = scattered()
    assert {k: int(v) for k, v in rows(traversal.shortest_paths(graph(spark, edges), 3))} == brute_bfs(edges, 3)
    with pytest.raises(ValueError):
        traversal.shortest_paths(graph(spark, [(0, 1, 0, -1), (1, 0, 0, -1)]), 0, "weight")
    negative = graph(spark, [(0, 1, 0, -1), (1, 2, 0, float("nan"))])
    assert rows(traversal.shortest_paths(negative, 0, "weight")) == [(0, 0.0), (1, -1.0)]
    with pytest.raises(ValueError):
        traversal.shortest_paths(g, 0, "nothing")


def test_dfs(spark):
    got = rows(traversal.dfs(graph(spark, [(0, 2), (0, 1), (1, 3), (3, 0), (4, 0)])))
    assert got == [(0, None, 0, 3), (1, 0, 1, 1), (2, 0, 3, 2), (3, 1, 2, 0)]
    assert rows(traversal.dfs(graph(spark, PATH5), navigator=lambda v: v < 3), "id") == [(0,), (1,), (2,)]


def test_betweenness(spark):
    assert rows(betweenness.betweenness(graph(spark, PATH5))) == [(0, 0.0), (1, 3.0), (2, 4.0), (3, 3.0), (4, 0.0)]
    assert [b for _, b in rows(betweenness.betweenness(graph(spark, CYCLE3)))] == [1.0] * 3
    edges = scattered(30, 80)
    want = brute_bc(edges, 1 + max(max(e) for e in edges))
    for batch in (7, 256):
        got = dict(rows(betweenness.betweenness(graph(spark, edges), batch=batch)))
        assert all(math.isclose(got[i], x, abs_tol=1e-9) for i, x in enumerate(want))
    twice = spark.createDataFrame([(0,), (0,)], "id long")
    assert rows(betweenness.betweenness(graph(spark, PATH5), twice))[1] == (1, 6.0)
    assert betweenness.drawn_sources(graph(spark, PATH5), 30).count() == 30


def test_betweenness_of_paths_needs_no_search(spark, monkeypatch):
    monkeypatch.setattr(betweenness, "_searched", None, raising=False)
    monkeypatch.setattr(betweenness, "run", None)
    chain = [(7 * i % 101, 7 * (i + 1) % 101) for i in range(100)]
    edges = chain + chain[:9] + [(200, 201), (5, 5), (210, 210)]
    got = dict(rows(betweenness.betweenness(graph(spark, edges))))
    assert got == dict(enumerate(float(x) for x in brute_bc(edges, 211))) and max(got.values()) == 2500


def test_paths_are_told_from_other_components(spark):
    def path(first, n):
        return [(i, i + 1) for i in range(first, first + n - 1)]

    alone = path(0, 2) + path(10, 8) + path(20, 9) + path(30, 14) + [(30, 31), (11, 11)]
    ring = [(50, 51), (51, 52), (52, 50), (60, 61), (61, 60)]
    tied = path(70, 6) + [(75, 80), (80, 81), (80, 90)] + path(90, 5) + path(100, 6) + [(105, 102)] + path(110, 5) + [(114, 115), (116, 115)]
    edges = alone + ring + tied
    got, found, others = paths.path_places(Workspace(spark, "test"), spark.createDataFrame(edges, "src long, dst long"))
    want = sorted((a + i, i, n - 1 - i) for a, n in ((0, 2), (10, 8), (20, 9), (30, 14)) for i in range(n))
    assert rows(got, "id", "before", "after") == want and found == len(want)
    assert others == len({v for e in ring + tied for v in e})
    bc = dict(rows(betweenness.betweenness(graph(spark, edges))))
    assert len(bc) == 117 and all(math.isclose(bc[i], x, abs_tol=1e-9) for i, x in enumerate(brute_bc(edges, 117)))
    none = paths.path_places(Workspace(spark, "test"), spark.createDataFrame(ring, "src long, dst long"))
    assert none == (None, 0, 5) and rows(betweenness.betweenness(graph(spark, [(1, 1)]))) == [(0, 0.0), (1, 0.0)]


def test_betweenness_of_a_graph_that_a_task_holds(spark, monkeypatch):
    edges = scattered(30, 80) + scattered(30, 80)[:20] + [(4, 4)]
    n = 1 + max(max(e) for e in edges)
    want = brute_bc(edges, n)
    close = lambda df: all(math.isclose(x, want[i], abs_tol=1e-9) for i, x in rows(df))
    with monkeypatch.context() as m:
        m.setattr(betweenness, "run", None)
        assert close(betweenness.betweenness(graph(spark, edges), batch=7))
    monkeypatch.setattr(betweenness, "NEAR_VERTICES", 5)
    monkeypatch.setattr(betweenness, "_searched_near", None)
    assert close(betweenness.betweenness(graph(spark, edges)))


@pytest.mark.parametrize("pairs, piece", [(1, 1), (100, 7), (1 << 20, 1 << 20)])
def test_near_edges_are_walked_from_either_end(monkeypatch, pairs, piece):
    monkeypatch.setattr(near, "PAIRS", pairs)
    monkeypatch.setattr(near, "SLICE", piece)
    for n, m in ((12, 90), (40, 50), (40, 200), (2, 1)):
        edges = scattered(n, m, m) + [(0, 1), (1, 0)]
        sources = random.Random(m).choices(range(n), k=25)
        drawn, many = Counter(sources), Counter(edges)
        a, b, k = (np.array(x) for x in zip(*((*e, c) for e, c in many.items())))
        net = near.Near(a, b, k.astype(float))
        net.add(np.array([*drawn, n + 5]), np.array([*drawn.values(), 1]))
        want = brute_bc(edges, n, sources)
        assert np.allclose(net.score, [want[i] for i in net.ids]) and not net.sigma.any() and not net.told.any() and not net.got.any()


def test_components(spark):
    label = lambda e: [c for _, c in rows(components.strong_components(graph(spark, e)))]
    assert label(PATH5) == [0, 1, 2, 3, 4]
    assert label(CYCLE3) == [0, 0, 0]
    assert label([(0, 2), (2, 1), (1, 2)]) == [0, 1, 1]
    assert label([(1, 0)]) == [0, 1]
    edges = scattered(40, 75)
    reach = {v: set(brute_bfs(edges, v)) for v in range(1 + max(max(e) for e in edges))}
    assert label(edges) == [min(u for u in reach[v] if v in reach[u]) for v in sorted(reach)]


def test_triangles_and_followers(spark):
    k4 = [(0, 1), (0, 2), (0, 3), (1, 2), (1, 3), (2, 3)]
    count = lambda e: triangles.triangles(graph(spark, e)).first()[0]
    assert (count(k4), count(CYCLE3), count(PATH5), count(k4 + [(b, a) for a, b in k4] + [(1, 1)])) == (4, 1, 0, 4)
    assert triangles.triangles_doubled(graph(spark, k4 + k4[:1])).first()[0] == 6
    g = graph(spark, [(1, 0), (2, 0)], [(0, 0, 30), (1, 0, 12), (2, 0, 25)])
    assert rows(triangles.teen_followers(g)) == [(0, 1), (1, 0), (2, 0)]
    assert math.isclose(triangles.avg_teen_followers(g).first()[0], 1 / 3)
    assert triangles.avg_teen_followers(g, older_than=99).first()[0] == 0


def test_task_registry(spark, tmp_path):
    g = graph(spark, CYCLE3)
    done = tasks.run("bfs_count", g, repeat=2)
    assert done.scalar == 3 and len(done.seconds) == 2
    done.save_stats(str(tmp_path / "s.csv"))
    assert (tmp_path / "s.csv").read_text().startswith("task,scalar,mean")
    assert tasks.run("tc_od", g).scalar == 1 and abs(tasks.run("pagerank", g).scalar - 1) < 1e-6
    with pytest.raises(ValueError):
        tasks.run("nothing", g)
    assert tasks.main(["ER(20, 60, 1)", "-r", "tarjan_scc", "-P", "0-2", "-o", str(tmp_path / "out")]) == 0


def test_a_hub_is_spread_over_parts(spark):
    edges = [(0, i) for i in range(1, 400)] + [(i, i + 1) for i in range(1, 30)] + [(30, 0), (399, 500), (500, 399)]
    g = graph(spark, edges)
    ws = Workspace(spark, "test")
    laid = supersteps.parted(ws, g.view.select("src", "dst"), "src", "laid")
    assert set(laid.hubs) == {0} and laid.hubs[0] >= 2 and laid.edges.where("src = 0").select("_salt").distinct().count() == laid.hubs[0]
    assert sorted((r.id, r.dst) for r in laid.meet(spark.range(32), "id", how="inner").select("id", "dst").collect()) == sorted(e for e in edges if e[0] < 32)
    want = brute_bfs(edges, 1)
    assert dict(rows(traversal.bfs(g, 1))) == want
    assert {k: int(v) for k, v in rows(traversal.shortest_paths(g, 1))} == want
    n, out, r = 501, Counter(a for a, _ in edges), [1 / 501] * 501
    for _ in range(4):
        new = [0.15 / n] * n
        for a, b in edges:
            new[b] += 0.85 * r[a] / out[a]
        r = new
    assert all(abs(x - r[i]) < 1e-12 for i, x in rows(pagerank.pagerank(g, 4)))
    component = dict(rows(components.strong_components(g)))
    assert all(component[v] == 0 for v in range(31)) and component[399] == component[500] == 399 and component[200] == 200
    back = dict(rows(betweenness.betweenness(g, spark.createDataFrame([(1,)], "id long"))))
    assert all(abs(back[v] - x) < 1e-9 for v, x in enumerate(brute_bc(edges, n, [1]))) and back[30] > 300


def test_long_paths_are_trimmed_in_blocks(spark):
    edges = [(i, i + 1) for i in range(40)] + [(50, 51), (51, 52), (52, 50), (52, 0)]
    want = {i: i for i in range(53)} | {51: 50, 52: 50}
    assert dict(rows(components.strong_components(graph(spark, edges)))) == want


def test_events_of_a_depth_first_search(spark):
    g = graph(spark, [(0, 1), (1, 2), (0, 3), (3, 1), (2, 0)])
    want = [(0, 0, "enter"), (1, 1, "enter"), (2, 2, "enter"), (3, 2, "leave"), (4, 1, "leave"), (5, 3, "enter"), (6, 3, "leave"), (7, 0, "leave")]
    assert rows(traversal.dfs_events(g, 0)) == want


def test_levels_swept_back(spark):
    seen = []
    traversal.sweep_back(traversal.bfs(graph(spark, PATH5), 1), lambda df, k: seen.append((k, rows(df, "id"))))
    assert seen == [(3, [(4,)]), (2, [(3,)]), (1, [(2,)]), (0, [(1,)])]
