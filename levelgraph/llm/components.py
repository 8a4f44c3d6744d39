"""Groups from pairwise matches: connected components by stripping, chain compression and a reduced core.

Each round takes out vertices of degree one (into their neighbour) and an independent set of the vertices of degree two,
drawn by random priorities as in list ranking by contraction: a chain loses a constant share of its vertices a round and
its ends stay linked by one edge. Every removed vertex points to one that outlives the round. What has no such vertex
left, the core, is contracted by random mating until it is small, and finished in one task whose input is bounded by
count. Labels then come back along the pointers, whose ways are doubled until all have reached their root. Where a join's
key may be a hub or the root of a giant group, the few ids that most rows have are looked up in a broadcast.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import require_columns
from ..operators.heavy_keys import hot_keys_of, hot_keys_seen, look_up
from ..workspace import Workspace

#: Arcs (an edge has two) that one task finishes: 16 bytes each.
FINISH_ARCS = 10_000
#: Rows of what a round of stripping writes.
_ARC, _GONE = 0, 1


def _arcs(edges: DataFrame, tail: str, head: str) -> DataFrame:
    """Both directions of every different link between two different ids."""
    a, b = F.col(tail).cast("long"), F.col(head).cast("long")
    links = edges.select(F.least(a, b).alias("u"), F.greatest(a, b).alias("v")).where(a.isNotNull() & b.isNotNull() & (a != b)).distinct()
    both = F.array(F.struct(F.col("u").alias("src"), F.col("v").alias("dst")), F.struct(F.col("v").alias("src"), F.col("u").alias("dst")))
    return links.select(F.explode(both).alias("e")).select("e.src", "e.dst")


def _strip(arcs: DataFrame, k: int) -> DataFrame:
    """(v, parent, other): vertices that leave in round k; other is a chain vertex's second neighbour, else null.

    Of neighbouring candidates only the one of highest priority leaves, leaves of a tree before vertices of chains, so
    parents stay.
    """
    degrees = arcs.groupBy("src").agg(F.count(F.lit(1)).alias("d"), F.min("dst").alias("a"), F.max("dst").alias("b"))
    # one number, so that it is combined by hashing: leaves above all others; of two equal draws neither leaves
    draw = F.xxhash64("src", F.lit(k)).bitwiseAND(F.lit((1 << 61) - 1))
    low = degrees.where("d <= 2").select("src", "a", "b", F.when(F.col("d") == 1, F.lit(1 << 61)).otherwise(F.lit(0)).cast("long").bitwiseOR(draw).alias("rank"))
    none = F.lit(None).cast("long")
    own = F.struct("src", "a", "b", "rank", none.alias("heard"))
    tell = lambda to: F.struct(F.col(to).alias("src"), none.alias("a"), none.alias("b"), none.alias("rank"), F.col("rank").alias("heard"))
    told = F.when(F.col("a") == F.col("b"), F.array(own, tell("a"))).otherwise(F.array(own, tell("a"), tell("b")))
    heard = (
        low.select(F.explode(told).alias("e"))
        .select("e.*")
        .groupBy("src")
        .agg(F.max("a").alias("a"), F.max("b").alias("b"), F.max("rank").alias("rank"), F.max("heard").alias("heard"))
        .where("rank is not null and (heard is null or rank > heard)")
    )
    return heard.select(F.col("src").alias("v"), F.col("a").alias("parent"), F.when(F.col("b") != F.col("a"), F.col("b")).alias("other"))


def _without(arcs: DataFrame, gone: DataFrame) -> DataFrame:
    """The arcs that are left when ``gone`` has been stripped, with the edges that bridge removed chain vertices."""
    p, o, v = F.col("parent"), F.col("other"), F.col("v")
    arc = lambda a, b, keep: F.struct(a.alias("src"), b.alias("dst"), F.lit(keep).alias("keep"))
    changes = gone.select(F.explode(F.array(arc(v, p, 0), arc(p, v, 0), arc(v, o, 0), arc(o, v, 0), arc(p, o, 1), arc(o, p, 1))).alias("e")).select("e.*")
    changes = changes.where("src is not null and dst is not null")
    rest = arcs.withColumn("keep", F.lit(1)).unionByName(changes)
    return rest.groupBy("src", "dst").agg(F.min("keep").alias("keep")).where("keep = 1").select("src", "dst")


def _mate(arcs: DataFrame, k: int) -> DataFrame:
    """(v, parent): vertices of tails that join a neighbour of heads, by coins of round k."""
    coin = lambda c: F.pmod(F.xxhash64(c, F.lit(k)), F.lit(2)) == 0
    return arcs.where(coin("src") & ~coin("dst")).groupBy(F.col("src").alias("v")).agg(F.min("dst").alias("parent"))


def _contract(arcs: DataFrame, mates: DataFrame, hot: list) -> DataFrame:
    """The arcs between what has been joined; hot: ids that very many arcs have, on either side, as arcs go both ways."""
    for end in ("src", "dst"):
        m = mates.select(F.col("v").alias(end), F.col("parent").alias("_to"))
        arcs = look_up(arcs, m, end, hot).withColumn(end, F.coalesce("_to", end)).drop("_to")
    return arcs.where("src <> dst").select("src", "dst").distinct()


def _finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, root) of the last arcs by repeated minimum and pointer jumping."""
    got = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches if b.num_rows]
    if not got:
        return
    src, dst = (np.concatenate(x) for x in zip(*got))
    ids, at = np.unique(np.concatenate([src, dst]), return_inverse=True)
    s, d = at[: len(src)], at[len(src) :]
    root = np.arange(len(ids))
    while True:
        before = root.copy()
        low = np.minimum(root[s], root[d])
        np.minimum.at(root, root[s], low)
        np.minimum.at(root, root[d], low)
        while not np.array_equal(root, root[root]):
            root = root[root]
        if np.array_equal(root, before):
            break
    yield pa.RecordBatch.from_pydict({"node": pa.array(ids, pa.int64()), "root": pa.array(ids[root], pa.int64())})


def _point(ws: Workspace, pointers: DataFrame, hot: dict) -> DataFrame:
    """(v, root) of pointers (v, parent), whose parents lead to roots: each round doubles the way that a pointer goes.

    Only vertices that are parents themselves take part, as no other is on a way; the others look up theirs in the end.
    Pointers whose parent is a root don't move any more. The rounds are the logarithm of those of removal.
    """
    inner = pointers.join(pointers.select(F.col("parent").alias("v")).distinct(), "v", "left_semi")
    inner, seen = ws.save_counted(inner, "inner", hot=hot_keys_seen("parent"))
    settled, moving, k, ahead = None, inner, 0, inner
    while seen["n"]:
        ways = ahead.select(F.col("v").alias("parent"), F.col("parent").alias("next"))
        moved = look_up(moving, ways, "parent", hot_keys_of(seen["hot"], seen["n"])).select("v", F.coalesce("next", "parent").alias("parent"), F.col("next").isNotNull().alias("on"))
        moved, seen = ws.save_counted(moved, f"inner{k}", on=F.sum(F.col("on").cast("long")), hot=hot_keys_seen("parent"))
        done = moved.where("not on").select("v", "parent")
        settled = done if settled is None else settled.unionByName(done)
        if not seen["on"]:
            break
        moving = moved.where("on").select("v", "parent")
        ahead, k = settled.unionByName(moving), k + 1
    if settled is None:
        return pointers.withColumnRenamed("parent", "root")
    roots = settled.select(F.col("v").alias("parent"), F.col("parent").alias("root"))
    return look_up(pointers, roots, "parent", hot).select("v", F.coalesce("root", "parent").alias("root"))


def connected_groups(pairs: DataFrame, tail: str = "tail", head: str = "head", finish_arcs: int = FINISH_ARCS) -> DataFrame:
    """(group_id, node): one row for every id in either column; group_id is the least id linked to it in any way.

    A pair with one end null links nothing, but its other end is a record; a pair of an id with itself makes a record.
    Repeated pairs, either direction, count once; extra columns are ignored; an empty table gives no rows. Ids are longs.
    finish_arcs bounds what one task takes of the core, once nothing can be stripped from it; 0 contracts it to nothing.
    """
    return _groups(pairs, tail, head, finish_arcs)[0]


def _groups(pairs: DataFrame, tail: str, head: str, finish_arcs: int) -> tuple[DataFrame, dict[str, int]]:
    """The groups, and how many rounds of stripping and mating there were and arcs that were left to finish."""
    require_columns(pairs, tail, head)
    spark = pairs.sparkSession
    ws = Workspace(spark, "groups")
    ends = F.explode(F.array(F.col(tail).cast("long"), F.col(head).cast("long"))).alias("node")
    nodes = pairs.select(ends).where("node is not null")
    arcs, seen = ws.save_counted(_arcs(pairs, tail, head), "arcs")
    removed: list[DataFrame] = []
    n, rounds = seen["n"], {"strip": 0, "mate": 0, "finish": 0}
    arcs_of = F.sum((F.col("kind") == _ARC).cast("long"))
    while n:  # strips until little is left to strip: trees and chains vanish whole
        gone = _strip(arcs, rounds["strip"])
        both = gone.select(F.lit(_GONE).alias("kind"), F.col("v").alias("src"), F.col("parent").alias("dst"))
        both = both.unionByName(_without(arcs, gone).select(F.lit(_ARC).alias("kind"), "src", "dst"))
        step, seen = ws.save_counted(both, f"strip{rounds['strip']}", arcs=arcs_of)
        rounds["strip"] += 1
        left, before = seen["arcs"] or 0, n
        removed.append(step.where(F.col("kind") == _GONE).select(F.col("src").alias("v"), F.col("dst").alias("parent")))
        arcs, n = step.where(F.col("kind") == _ARC).select("src", "dst"), left
        if seen["n"] - left <= 0.02 * before:
            break
    hot = None
    while n > finish_arcs:  # contracts the core
        k = rounds["mate"]
        if hot is None:
            arcs, seen = ws.save_counted(arcs, "core", hot=hot_keys_seen("src"))
            hot = hot_keys_of(seen["hot"], n)
        mates = ws.save(_mate(arcs, k), f"mates{k}")
        removed.append(mates)
        arcs, seen = ws.save_counted(_contract(arcs, mates, hot), f"arcs{k}", hot=hot_keys_seen("src"))
        n, hot = seen["n"], hot_keys_of(seen["hot"], seen["n"])
        rounds["mate"] += 1
    rounds["finish"] = n
    last = arcs.coalesce(1).mapInArrow(_finish, "node long, root long").where("node <> root").select(F.col("node").alias("v"), F.col("root").alias("parent"))
    pointers = last
    for gone in removed:
        pointers = pointers.unionByName(gone)
    pointers, seen = ws.save_counted(pointers, "pointers", hot=hot_keys_seen("parent"))
    roots = _point(ws, pointers, hot_keys_of(seen["hot"], seen["n"])) if seen["n"] else pointers.withColumnRenamed("parent", "root")
    # every id once, with its root if it has one besides itself
    every = nodes.select("node", F.lit(None).cast("long").alias("root")).unionByName(roots.select(F.col("v").alias("node"), "root"))
    rooted = every.groupBy("node").agg(F.max("root").alias("root")).select("node", F.coalesce("root", "node").alias("root"))
    rooted, seen = ws.save_counted(rooted, "rooted", hot=hot_keys_seen("root"))
    least = rooted.groupBy("root").agg(F.min("node").alias("group_id"))
    return look_up(rooted, least, "root", hot_keys_of(seen["hot"], seen["n"])).select("group_id", "node"), rounds
