"""PageRank as one plan: each iteration is a join with links that stay in place and one shuffle of partial sums."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..graph import Graph
from ..workspace import Workspace
from .supersteps import parted

#: Iterations that are planned together before the ranks are written.
TOGETHER = 5


def pagerank(graph: Graph, iterations: int = 10, damping: float = 0.85, tolerance: float | None = None, single: bool = False) -> DataFrame:
    """(id, rank) of every vertex after ``iterations`` steps, or fewer once the ranks' L1 change is at most tolerance.

    rank' = (1-d)/N + d * sum over in-edges of rank/out-degree, with N all ids up to the greatest; parallel edges count
    each, mass of vertices without out-edges is lost, and at least one step is made. ``single`` gives 32-bit ranks. Pull
    and push orders have the same fixed steps, so there is one plan for both. A graph without edges gives no rows.
    """
    spark = graph.edges.sparkSession
    n = graph.max_nodes
    if not n:
        return spark.createDataFrame([], f"id long, rank {'float' if single else 'double'}")
    ws = Workspace(spark, "pagerank")
    # parted by src with a set number, so that the degrees, and every step's sums, shuffled by dst, meet them in place
    laid = parted(ws, graph.view.groupBy("src", "dst").agg(F.count(F.lit(1)).alias("m")), "src", "edges")
    out = laid.table.groupBy(F.col("src").alias("id")).agg(F.sum("m").alias("d"))
    salt = ["_salt"] if laid.hubs else []
    parts = laid.meet(out, "id", how="inner").select("src", "dst", (F.col("m") / F.col("d")).alias("part"), *salt).persist()
    laid.unpersist()  # before it is filled
    links = replace(laid, edges=parts)
    base = (1.0 - damping) / n
    state = None  # ranks of vertices with in-edges; all others have the base rank, at first 1/N
    done = 0
    steps = max(1, iterations)
    while done < steps:
        before = state
        for _ in range(1 if tolerance is not None else min(TOGETHER, steps - done)):
            if state is None:
                flow = links.edges.select("dst", (F.col("part") / n).alias("x"))
            else:
                flow = links.meet(state.select("id", "rank"), "id", how="right").select("dst", (F.col("part") * F.coalesce("rank", F.lit(base))).alias("x"))
            state = flow.groupBy(F.col("dst").alias("id")).agg((F.lit(base) + F.lit(damping) * F.sum("x")).alias("rank"))
            done += 1
        state = ws.save(state, f"ranks{done}")
        if tolerance is not None:
            old = F.lit(1.0 / n) if before is None else F.coalesce("old", F.lit(base))
            paired = state if before is None else state.join(before.withColumnRenamed("rank", "old"), "id", "left")
            moved, held = paired.agg(F.sum(F.abs(F.col("rank") - old)), F.count(F.lit(1))).first()
            if before is None:  # the vertices without in-edges moved once, from 1/N to the base rank
                moved = (moved or 0.0) + (n - held) * abs(1.0 / n - base)
            if (moved or 0.0) <= tolerance:
                break
    links.unpersist()
    ranks = graph.vertices().join(state, "id", "left").select("id", F.coalesce("rank", F.lit(base)).alias("rank"))
    return ranks.withColumn("rank", F.col("rank").cast("float")) if single else ranks


def top_ranks(ranks: DataFrame, k: int = 10) -> DataFrame:
    """The k vertices of greatest rank, the smaller id first among equals."""
    return ranks.orderBy(F.desc("rank"), "id").limit(k)
