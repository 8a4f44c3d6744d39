"""Components that are one path, found by pointers that are doubled in supersteps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..workspace import Workspace

#: Doublings of a block, which is one plan.
BLOCK = 3
#: In place of a pointer: the vertex isn't on such a path.
OFF = (1 << 63) - 1


def _on(c: str) -> Column:
    return (F.col(c) >= 0) & (F.col(c) < OFF)


def _either_off(df: DataFrame) -> DataFrame:
    off = (F.col("ahead") == OFF) | (F.col("behind") == OFF)
    return df.select("id", *(F.when(off, F.lit(OFF)).otherwise(F.col(c)).alias(c) for c in ("ahead", "behind")))


def _ends(edges: DataFrame) -> DataFrame:
    """(id, ahead, behind) of every vertex: its only successor and predecessor, -1 for none, OFF if it has several."""
    none = F.lit(None).cast("long")
    ends = F.array(F.struct(F.col("src").alias("id"), F.col("dst").alias("ahead"), none.alias("behind")), F.struct(F.col("dst").alias("id"), none.alias("ahead"), F.col("src").alias("behind")))
    both = [f(c).alias(f"{n}_{c}") for c in ("ahead", "behind") for n, f in (("least", F.min), ("most", F.max))]
    met = edges.where("src <> dst").select(F.explode(ends).alias("e")).select("e.*").groupBy("id").agg(*both)
    only = lambda c: F.when(F.col(f"least_{c}").isNull(), F.lit(-1)).when(F.col(f"least_{c}") == F.col(f"most_{c}"), F.col(f"least_{c}")).otherwise(F.lit(OFF)).cast("long").alias(c)
    return _either_off(met.select("id", only("ahead"), only("behind")))


def _doubled(state: DataFrame, k: int) -> DataFrame:
    """Pointers over 2^k edges become ones over 2^(k+1): a vertex tells both that it points to where it points itself.

    A side that has come to its end has -1 - n there, n its vertices on that side. Who has no answer is next to a vertex
    that is OFF, and is so itself.
    """
    none = F.lit(None).cast("long")
    row = lambda to, ahead, behind: F.struct(F.col(to).alias("id"), ahead.alias("ahead"), behind.alias("behind"))
    settled = lambda c: F.when(~_on(c), F.col(c))
    passed = lambda c: F.when(F.col(c) >= 0, F.col(c)).otherwise(F.col(c) - (1 << k))
    sent = F.array(
        F.when(~_on("ahead") | ~_on("behind"), row("id", settled("ahead"), settled("behind"))),
        F.when(_on("ahead"), row("ahead", none, passed("behind"))),
        F.when(_on("behind"), row("behind", passed("ahead"), none)),
    )
    met = state.select(F.explode(sent).alias("e")).where("e is not null").select("e.*").groupBy("id").agg(F.max("ahead").alias("ahead"), F.max("behind").alias("behind"))
    return _either_off(met.select("id", *(F.coalesce(c, F.lit(OFF)).alias(c) for c in ("ahead", "behind"))))


def path_places(ws: Workspace, edges: DataFrame) -> tuple[DataFrame | None, int, int]:
    """(id, before, after) of every vertex whose component is one path: how many vertices are before and after it there.

    Parallel edges count as one, and loops as none. Also how many vertices these are, and how many others have an edge
    other than a loop. Rounds are as many as the longest path's length has binary digits, or if there are cycles, as the
    number of the vertices left.
    """
    live = F.col("ahead") < OFF
    done = (F.col("ahead") < 0) & (F.col("behind") < 0)
    count = lambda c: F.count(F.when(c, 1))
    state, seen = ws.save_counted(_ends(edges), "p0", tails=count(live & (F.col("ahead") == -1)), heads=count(live & (F.col("behind") == -1)))
    every, found, k, parts = seen["n"], 0, 0, []
    if not (seen["tails"] and seen["heads"]):
        return None, 0, every
    active = every
    while active and 1 << k <= active:
        state = state.where(~done) if k else state
        for _ in range(BLOCK):
            state = _doubled(state, k)
            k += 1
        state, seen = ws.save_counted(state, f"p{k}", done=count(done), active=count(live & ~done))
        if k == BLOCK:
            ws.drop("p0")
        active = seen["active"]
        found += seen["done"]
        if seen["done"]:
            parts.append(state.where(done).select("id", (-1 - F.col("behind")).alias("before"), (-1 - F.col("ahead")).alias("after")))
    whole = None
    for p in parts:
        whole = p if whole is None else whole.unionByName(p)
    return whole, found, every - found
