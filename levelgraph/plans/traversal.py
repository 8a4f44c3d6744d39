"""Breadth- and depth-first search and shortest paths, as loops over a frontier."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import require_columns
from ..graph import Graph
from ..workspace import Workspace
from .supersteps import parted, run, superstep

#: What the distance of an unreachable vertex reads as, if asked for.
UNREACHABLE = 2147483646


def _checked(graph: Graph, root: int) -> None:
    if not 0 <= root < graph.max_nodes:
        raise ValueError(f"there is no vertex {root}")


def bfs(graph: Graph, root: int = 0, edge_filter: Column | None = None, reverse: bool = False, on_level: Callable[[DataFrame, int], DataFrame] | None = None) -> DataFrame:
    """(id, level) of the vertices reached from root; root has level 0.

    edge_filter: condition on edges that may be walked. reverse: walk them backwards. on_level: gets each frontier and
    its level, and returns the rows of it from which the search goes on. ValueError for a root that isn't there.
    """
    _checked(graph, root)
    spark = graph.edges.sparkSession
    ws = Workspace(spark, "bfs")
    e = (graph.reverse() if reverse else graph).view
    e = (e if edge_filter is None else e.where(edge_filter)).select("src", "dst").distinct()
    front = spark.createDataFrame([(root, 0)], "id long, level int")
    if on_level is not None:
        return _visited(ws, e.persist(), front, on_level)
    e = parted(ws, e, "src", "edges")

    def step(state: DataFrame, k: int) -> DataFrame:
        keep, send = F.struct("id", "level"), F.struct(F.col("dst").alias("id"), F.lit(k + 1).alias("level"))
        return superstep(state, e, "id", F.col("level") == k, keep, send, ["id"], [F.min("level").alias("level")])

    found, _ = run(ws, front, step, lambda k: F.col("level") == k)
    e.unpersist()
    return found


def _visited(ws: Workspace, e: DataFrame, front: DataFrame, on_level: Callable[[DataFrame, int], DataFrame]) -> DataFrame:
    """As bfs, level by level, with a visitor between levels."""
    seen, level = front, 0
    while True:
        walk = on_level(front, level)
        level += 1
        met = e.join(walk.select(F.col("id").alias("src")), "src", "left_semi").select(F.col("dst").alias("id")).distinct()
        new = met.join(seen, "id", "left_anti").select("id", F.lit(level).alias("level"))
        front, got = ws.save_counted(new, f"level{level}")
        if not got["n"]:
            e.unpersist()
            return seen
        seen = seen.unionByName(front)


def sweep_back(levels: DataFrame, visit: Callable[[DataFrame, int], None]) -> None:
    """Shows the levels of a search to a visitor, the deepest first: (its rows, level)."""
    deepest = levels.agg(F.max("level")).first()[0]
    for k in range(-1 if deepest is None else deepest, -1, -1):
        visit(levels.where(F.col("level") == k), k)


def bfs_count(graph: Graph, root: int = 0) -> DataFrame:
    """(n_reached): vertices that root reaches over out-edges, itself among them."""
    return bfs(graph, root).agg(F.count(F.lit(1)).alias("n_reached"))


def down_edges(graph: Graph, levels: DataFrame) -> DataFrame:
    """Visible edges from a level to the next one; every parallel edge counts."""
    a = levels.select(F.col("id").alias("src"), F.col("level").alias("_a"))
    b = levels.select(F.col("id").alias("dst"), F.col("level").alias("_b"))
    return graph.view.join(a, "src").join(b, "dst").where("_b = _a + 1").select("src", "dst", F.col("_a").alias("level"))


def shortest_paths(graph: Graph, root: int = 0, weight: str | None = None, max_rounds: int | None = None) -> DataFrame:
    """(id, dist) of the vertices root reaches: the least sum of weights, or without a weight column of edges.

    Relaxation from the vertices that got nearer in the last round, until none did. Weights are added as doubles; an edge
    of null or NaN weight isn't walked. A negative cycle is told by a ValueError once more rounds have passed than there
    are vertices, or than max_rounds, up to the end of a block of rounds.
    """
    _checked(graph, root)
    spark = graph.edges.sparkSession
    ws = Workspace(spark, "paths")
    if weight is None:
        e = graph.view.select("src", "dst", F.lit(1.0).alias("w")).distinct()
    else:
        require_columns(graph.edges, weight)
        w = F.col(weight).cast("double")
        e = graph.view.where(w.isNotNull() & ~F.isnan(w)).groupBy("src", "dst").agg(F.min(w).alias("w"))
    e = parted(ws, e, "src", "edges")
    start = spark.createDataFrame([(root, 0.0, True)], "id long, dist double, nearer boolean")

    def step(state: DataFrame, k: int) -> DataFrame:
        keep = F.struct("id", "dist", F.col("dist").alias("old"))
        send = F.struct(F.col("dst").alias("id"), (F.col("dist") + F.col("w")).alias("dist"), F.lit(None).cast("double").alias("old"))
        got = superstep(state, e, "id", F.col("nearer"), keep, send, ["id"], [F.min("dist").alias("dist"), F.min("old").alias("old")])
        return got.select("id", "dist", (F.col("old").isNull() | (F.col("dist") < F.col("old"))).alias("nearer"))

    dist, _ = run(ws, start, step, lambda k: F.col("nearer"), limit=max_rounds or graph.max_nodes)
    e.unpersist()
    return dist.select("id", "dist")


def farthest(distances: DataFrame) -> DataFrame:
    """(max_dist): the greatest distance, its fraction cut off; 0 if there are none."""
    return distances.agg(F.coalesce(F.floor(F.max("dist")), F.lit(0)).cast("int").alias("max_dist"))


def all_distances(graph: Graph, distances: DataFrame, unreachable: int | None = None) -> DataFrame:
    """(id, dist) of every vertex: null, or the given number, where root doesn't reach."""
    return graph.vertices().join(distances, "id", "left").select("id", F.coalesce("dist", F.lit(unreachable).cast("double")).alias("dist"))


#: Edges that a depth-first search, which can't be parted, takes into its one task.
MOST_DFS_EDGES = 20_000_000


def dfs_events(graph: Graph, root: int = 0, reverse: bool = False, navigator: Callable[[int], bool] | None = None) -> DataFrame:
    """(tick, id, event): when each vertex is entered and left in the walk of ``dfs``, by one clock from 0.

    A vertex of depth d is entered after pre vertices, of which all but its d ancestors have been left.
    """
    walk = _walk(graph, root, reverse, navigator)
    event = lambda tick, name: F.struct(tick.alias("tick"), F.col("id"), F.lit(name).alias("event"))
    both = F.array(event(2 * F.col("pre") - F.col("depth"), "enter"), event(2 * F.col("post") + F.col("depth") + 1, "leave"))
    return walk.select(F.explode(both).alias("e")).select("e.*")


def dfs(graph: Graph, root: int = 0, reverse: bool = False, navigator: Callable[[int], bool] | None = None) -> DataFrame:
    """(id, parent, pre, post): depth-first order from root, neighbours in ascending order, numbers from 0.

    navigator tells whether to enter a vertex. The order is one of a single walk, so the edges go to one task; a
    ValueError tells if they are more than MOST_DFS_EDGES.
    """
    return _walk(graph, root, reverse, navigator).drop("depth")


def _walk(graph: Graph, root: int, reverse: bool, navigator: Callable[[int], bool] | None) -> DataFrame:
    _checked(graph, root)
    e = (graph.reverse() if reverse else graph).view.select("src", "dst").distinct()
    if e.limit(MOST_DFS_EDGES + 1).count() > MOST_DFS_EDGES:
        raise ValueError(f"more than {MOST_DFS_EDGES} edges")

    def walk(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        to: dict[int, list[int]] = {}
        for p in parts:
            for a, b in zip(p["src"].tolist(), p["dst"].tolist()):
                to.setdefault(a, []).append(b)
        rows: dict[int, list] = {root: [None, 0, 0, 0]}
        clock, done = 1, 0
        stack = [(root, iter(sorted(to.get(root, ()))))]
        while stack:
            v, rest = stack[-1]
            for u in rest:
                if u not in rows and (navigator is None or navigator(u)):
                    rows[u] = [v, clock, 0, len(stack)]
                    clock += 1
                    stack.append((u, iter(sorted(to.get(u, ())))))
                    break
            else:
                rows[v][2] = done
                done += 1
                stack.pop()
        yield pd.DataFrame([(k, *r) for k, r in rows.items()], columns=["id", "parent", "pre", "post", "depth"]).astype({"parent": "Int64"})

    return e.coalesce(1).mapInPandas(walk, "id long, parent long, pre long, post long, depth long")
