"""Betweenness centrality: by place on components that are paths, else by Brandes' accumulation over batches of sources."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..graph import Graph
from ..workspace import Workspace
from .near import Near
from .paths import path_places
from .supersteps import BLOCK, parted, run, superstep

#: Different edges, and vertices with edges, up to which every task reads the whole graph, for some of the sources.
NEAR_EDGES, NEAR_VERTICES = 6_000_000, 1 << 18


def betweenness(graph: Graph, sources: DataFrame | None = None, batch: int = 256) -> DataFrame:
    """(id, bc) of every vertex: the sum over sources s of its share of the shortest paths from s, s itself left out.

    Directed, without weights, not normalised; parallel edges are paths of their own. sources (id; a repeated one counts
    again): all vertices by default. Then a vertex of a component that is one path has as many pairs around it as vertices
    before it times those after it, and only the other components are searched: up to NEAR_EDGES and NEAR_VERTICES by
    tasks that read all their edges, for some of the sources each; beyond these in supersteps, where state is keyed by
    (source, vertex) and sources are taken in batches by hash, which bound it to about ``batch`` times the vertices.
    """
    ws = Workspace(graph.edges.sparkSession, "betweenness")
    edges = graph.view.select("src", "dst")
    if sources is not None:
        return _of_every(graph, _searched(ws, edges, sources, batch))
    paths, found, others = path_places(ws, edges)
    score = None
    if found:
        score = paths.select("id", (F.col("before").cast("double") * F.col("after")).alias("x"))
        edges = edges.join(paths.withColumnRenamed("id", "src"), "src", "left_anti")
    if others:
        ends = edges.where("src <> dst").select(F.explode(F.array("src", "dst")).alias("id")).distinct()  # the rest reaches nothing
        searched = _searched(ws, edges, ends, batch)
        score = searched if score is None else score.unionByName(searched)
    return _of_every(graph, score)


def _of_every(graph: Graph, score: DataFrame | None) -> DataFrame:
    every = graph.vertices()
    if score is None:
        return every.withColumn("bc", F.lit(0.0))
    # without a join, as both have about as many rows
    return every.select("id", F.lit(0.0).alias("x")).unionByName(score).groupBy("id").agg(F.sum("x").alias("bc"))


def _searched(ws: Workspace, edges: DataFrame, sources: DataFrame, batch: int) -> DataFrame | None:
    """(id, x): shares that add up to the betweenness from the sources over these edges."""
    e, laid = ws.save_counted(edges.groupBy("src", "dst").agg(F.count(F.lit(1)).cast("double").alias("m")), "edges")
    asked, got = ws.save_counted(sources.groupBy("id").agg(F.count(F.lit(1)).alias("times")), "sources")
    if laid["n"] <= NEAR_EDGES and e.select(F.explode(F.array("src", "dst")).alias("id")).distinct().count() <= NEAR_VERTICES:
        return _searched_near(ws, asked, got["n"])
    out = parted(ws, e, "src", "out")
    back = parted(ws, out.table, "dst", "back")
    batches = -(-got["n"] // batch)
    score = None
    keys = ["s", "v"]

    def forward(state: DataFrame, k: int) -> DataFrame:
        keep = F.struct("s", "v", "level", "sigma", F.lit(None).cast("double").alias("got"))
        send = F.struct("s", F.col("dst").alias("v"), F.lit(k + 1).alias("level"), F.lit(None).cast("double").alias("sigma"), (F.col("sigma") * F.col("m")).alias("got"))
        met = superstep(state, out, "v", F.col("level") == k, keep, send, keys, [F.min("level").alias("level"), F.max("sigma").alias("sigma"), F.sum("got").alias("got")])
        return met.select("s", "v", "level", F.coalesce("sigma", "got").alias("sigma"))  # who was there keeps its paths

    def backward(state: DataFrame, k: int) -> DataFrame:
        keep = F.struct("s", "v", "level", "sigma", "delta", F.lit(None).cast("double").alias("got"))
        part = F.col("m") * (1 + F.col("delta")) / F.col("sigma")
        none = F.lit(None).cast("double")
        send = F.struct("s", F.col("src").alias("v"), F.lit(None).cast("int").alias("level"), none.alias("sigma"), none.alias("delta"), part.alias("got"))
        most = [F.max(c).alias(c) for c in ("level", "sigma", "delta")]
        met = superstep(state, back, "v", F.col("level") == k, keep, send, keys, [*most, F.sum("got").alias("got")])
        took = F.when(F.col("level") == k - 1, F.col("sigma") * F.coalesce("got", F.lit(0.0))).otherwise(F.col("delta"))
        return met.where("level is not null").select("s", "v", "level", "sigma", took.alias("delta"))

    for b in range(batches):
        start = asked.where(F.pmod(F.xxhash64("id"), F.lit(batches)) == b)
        state = start.select(F.col("id").alias("s"), F.col("id").alias("v"), F.lit(0).alias("level"), F.lit(1.0).alias("sigma"))
        state, _ = run(ws, state, forward, lambda k: F.col("level") == k, f"b{b}f")
        deepest = state.agg(F.max("level")).first()[0] or 0
        state = state.withColumn("delta", F.lit(0.0))
        for i, k in enumerate(range(deepest, 1, -1), 1):  # sources themselves don't count, so level 0 needs nothing
            state = backward(state, k)
            if i % BLOCK == 0:
                state = ws.save(state, f"b{b}d{k}")
        own = ws.save(state.where("level > 0"), f"b{b}").join(asked.withColumnRenamed("id", "s"), "s").select(F.col("v").alias("id"), (F.col("delta") * F.col("times")).alias("x"))
        score = own if score is None else score.unionByName(own)
    out.unpersist()
    back.unpersist()
    return score


def _searched_near(ws: Workspace, asked: DataFrame, n: int) -> DataFrame:
    """The shares of the sources asked (id, times), n of them; a task has some of these and all of the edges written."""
    files = [x.replace("file:/", "file:///", 1) if not x.startswith("file://") else x for x in ws.files("edges")]

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine = [b for b in batches if b.num_rows]
        if not mine:
            return
        net = Near(*_read_edges(files))
        for b in mine:
            net.add(b.column("id").to_numpy(), b.column("times").to_numpy())
        hit = np.flatnonzero(net.score)
        for i in range(0, len(hit), 1 << 16):
            some = hit[i : i + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(net.ids[some]), pa.array(net.score[some])], names=["id", "x"])

    tasks = max(1, min(n, 4 * ws.spark.sparkContext.defaultParallelism))
    found = asked.where("id is not null").repartition(tasks, "id").mapInArrow(search, "id long, x double")
    return ws.save(found.groupBy("id").agg(F.sum("x").alias("x")), "near")


def _read_edges(files: list[str]) -> list[np.ndarray]:
    """src, dst and m of files of edges; loops and missing ends are left out, as no shortest path has them."""
    parts: dict[str, list[np.ndarray]] = {c: [np.empty(0, kind)] for c, kind in (("src", np.int64), ("dst", np.int64), ("m", np.float64))}
    for x in files:
        fs, path = pafs.FileSystem.from_uri(x.replace("s3a://", "s3://", 1))
        t = pq.read_table(path, filesystem=fs, columns=list(parts)).drop_null()
        way = t["src"].to_numpy() != t["dst"].to_numpy()
        for c, held in parts.items():
            held.append(t[c].to_numpy()[way])
    return [np.concatenate(parts.pop(c)) for c in list(parts)]  # a column at a time, to hold little twice


def drawn_sources(graph: Graph, k: int = 100, seed: int = 1) -> DataFrame:
    """k existing vertices drawn with replacement, alike for a seed."""
    from .ordering import with_row_number

    numbered = with_row_number(graph.existing(), ["id"], "n", total="all")
    all_n = numbered.agg(F.max("all")).first()[0] or 0
    if not all_n:
        return numbered.select("id")
    draws = graph.edges.sparkSession.range(k).select((F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(all_n)) + 1).alias("n"))
    return draws.join(numbered, "n").select("id")
