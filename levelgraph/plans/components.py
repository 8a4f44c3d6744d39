"""Strongly connected components by trimming and forward-backward colouring."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..graph import Graph
from ..operators.heavy_keys import hot_keys_of, hot_keys_seen, look_up
from ..workspace import Workspace
from .supersteps import Laid, parted, run, superstep


#: Share of the edges that a layer must take for the next one to be taken by itself.
LAYER = 0.1


def _trim(ws: Workspace, e: DataFrame, tag: str) -> DataFrame:
    """Edges left after vertices without in- or without out-edges have gone, again and again: those are alone.

    Layers that take many edges are taken one by one, as each has fewer left. What is left then may have long paths: there
    every vertex tells its neighbours on both sides that they have one, in supersteps.
    """
    hot = {"a": hot_keys_seen("src"), "b": hot_keys_seen("dst")}
    e, got = ws.save_counted(e, f"{tag}0", **hot)
    k = 0
    while got["n"]:
        end = lambda c, way: F.struct(F.col(c).alias("id"), F.lit(way).alias("way"))
        sides = e.select(F.explode(F.array(end("src", 1), end("dst", 2))).alias("x"))
        both = sides.groupBy(F.col("x.id").alias("id")).agg(F.bit_or("x.way").alias("way")).where("way = 3").select("id")
        many = hot_keys_of(got["a"], got["n"]) | hot_keys_of(got["b"], got["n"])
        left, now = ws.save_counted(_between(e, both, many), f"{tag}{k + 1}", **hot)
        ws.drop(f"{tag}{k}")
        e, before, got, k = left, got["n"], now, k + 1
        if now["n"] == before or not now["n"]:
            return e
        if now["n"] > (1 - LAYER) * before:
            return _trim_paths(ws, e, f"{tag}p")
    return e


def _trim_paths(ws: Workspace, e: DataFrame, tag: str) -> DataFrame:
    row = lambda a, b, way: F.struct(F.col(a).alias("src"), F.col(b).alias("dst"), F.lit(way).alias("way"))
    ways = parted(ws, e.select(F.explode(F.array(row("src", "dst", 1), row("dst", "src", 2))).alias("x")).select("x.*"), "src", f"{tag}ways")
    start = ways.table.select(F.col("src").alias("id")).distinct().select("id", F.lit(True).alias("there"), F.lit(True).alias("left"))

    def step(state: DataFrame, k: int) -> DataFrame:
        keep = F.struct("id", "there", F.lit(0).alias("way"))
        send = F.struct(F.col("dst").alias("id"), F.lit(None).cast("boolean").alias("there"), "way")
        got = superstep(state, ways, "id", F.col("there"), keep, send, ["id"], [F.max("there").alias("there"), F.bit_or("way").alias("way")])
        both = F.col("there") & (F.col("way") == 3)
        return got.select("id", both.alias("there"), (F.col("there") & ~both).alias("left"))

    state, _ = run(ws, start, step, lambda k: F.col("left"), f"{tag}s")
    ways.unpersist()
    return _between(ways.table.where("way = 1").select("src", "dst"), state.where("there").select("id"), ways.hubs)


def _between(e: DataFrame, ids: DataFrame, hot: Iterable[int], there: bool = True) -> DataFrame:
    """The edges both of whose ends are among ids, or neither; hot: ids that very many edges have."""
    for end in ("src", "dst"):
        found = look_up(e, ids.select(F.col("id").alias(end), F.lit(True).alias("_there")), end, hot)
        e = found.where(F.coalesce("_there", F.lit(False)) == there).select("src", "dst")
    return e


def _least_ahead(ws: Workspace, own: Laid, tag: str) -> DataFrame:
    """(id, colour): the least id from which each vertex on an edge can be reached, itself included."""
    start = own.table.select(F.explode(F.array("src", "dst")).alias("id")).distinct().select("id", F.col("id").alias("colour"), F.lit(True).alias("new"))

    def step(state: DataFrame, k: int) -> DataFrame:
        keep = F.struct("id", "colour", F.col("colour").alias("old"))
        send = F.struct(F.col("dst").alias("id"), F.col("colour"), F.lit(None).cast("long").alias("old"))
        got = superstep(state, own, "id", F.col("new"), keep, send, ["id"], [F.min("colour").alias("colour"), F.min("old").alias("old")])
        return got.select("id", "colour", (F.col("colour") < F.col("old")).alias("new"))

    colour, _ = run(ws, start, step, lambda k: F.col("new"), tag)
    return colour.select("id", "colour")


def _reaching_roots(ws: Workspace, inside: DataFrame, colour: DataFrame, tag: str) -> DataFrame:
    """(id, colour) of vertices that reach their colour's root inside the colour; inside has edges turned round."""
    own = parted(ws, inside, "src", f"{tag}inside")
    start = colour.where("id = colour").select("id", "colour", F.lit(0).alias("met"))

    def step(state: DataFrame, k: int) -> DataFrame:
        send = F.struct(F.col("dst").alias("id"), F.col("colour"), F.lit(k + 1).alias("met"))
        keep = F.struct("id", "colour", "met")
        return superstep(state, own, "id", F.col("met") == k, keep, send, ["id"], [F.min("colour").alias("colour"), F.min("met").alias("met")])

    found, _ = run(ws, start, step, lambda k: F.col("met") == k, tag)
    own.unpersist()
    return found.select("id", "colour")


def strong_components(graph: Graph) -> DataFrame:
    """(id, component) of every vertex: the least id that it reaches and is reached by. Deleted edges don't count.

    Each round trims, colours every vertex with the least id that reaches it, and takes out, for each colour, the vertices
    that reach its root within the colour. Isolated vertices are components of their own.
    """
    spark = graph.edges.sparkSession
    ws = Workspace(spark, "scc")
    e = graph.view.where("src <> dst").select("src", "dst").distinct()
    found: list[DataFrame] = []
    k = 0
    while True:
        own = parted(ws, _trim(ws, e, f"r{k}t"), "src", f"r{k}edges")
        if not own.n:
            break
        colour = _least_ahead(ws, own, f"r{k}c")
        own.unpersist()
        coloured = own.table
        for end in ("src", "dst"):
            coloured = look_up(coloured, colour.select(F.col("id").alias(end), F.col("colour").alias(f"_{end}")), end, own.hubs)
        inside = coloured.where("_src = _dst").select(F.col("dst").alias("src"), F.col("src").alias("dst"))
        roots = _reaching_roots(ws, inside, colour, f"r{k}f")
        found.append(roots)
        e = _between(own.table, roots.select("id"), own.hubs, there=False)
        k += 1
    every = graph.vertices()
    if not found:
        return every.withColumn("component", F.col("id"))
    known = found[0]
    for more in found[1:]:
        known = known.unionByName(more)
    return every.join(known, "id", "left").select("id", F.coalesce("colour", "id").alias("component"))
