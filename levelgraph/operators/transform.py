"""What can be done to edges while they are loaded: direction, duplicates, ids and order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import require_columns
from ..plans.ordering import with_row_number


def _swapped(edges: DataFrame) -> DataFrame:
    return edges.withColumns({"src": F.col("dst"), "dst": F.col("src")})


def undirected_double(edges: DataFrame) -> DataFrame:
    """Every edge in both directions, a self-loop once."""
    require_columns(edges, "src", "dst")
    return edges.unionByName(_swapped(edges.where("src <> dst")))


def undirected_ordered(edges: DataFrame) -> DataFrame:
    """The smaller id first."""
    require_columns(edges, "src", "dst")
    return edges.withColumns({"src": F.least("src", "dst"), "dst": F.greatest("src", "dst")})


def deduplicate(edges: DataFrame) -> DataFrame:
    """One edge for each (created_level, src, dst), the one of least weight and then least edge_id; levels stay apart."""
    require_columns(edges, "src", "dst", "created_level")
    keys = ["created_level", "src", "dst"]
    rest = sorted((c for c in edges.columns if c not in keys), key=lambda c: (c != "weight", c != "edge_id", c))
    if not rest:
        return edges.distinct()
    kept = edges.groupBy(*keys).agg(F.min(F.struct(*rest)).alias("_e"))
    return kept.select(*[F.col(c) if c in keys else F.col(f"_e.{c}").alias(c) for c in edges.columns])


def reverse_edges(edges: DataFrame) -> DataFrame:
    return _swapped(edges)


def renumber(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """Ids replaced by those of ``ids`` (id, new_id); edges of ids that it lacks go."""
    to = ids.select(F.col("id").alias("src"), F.col("new_id").alias("_s"))
    into = ids.select(F.col("id").alias("dst"), F.col("new_id").alias("_d"))
    return edges.join(to, "src").join(into, "dst").withColumns({"src": F.col("_s"), "dst": F.col("_d")}).drop("_s", "_d").select(*edges.columns)


def compact_ids(edges: DataFrame) -> DataFrame:
    """(id, new_id): the ids on edges numbered from 0 in their order, without gaps."""
    ends = edges.select(F.explode(F.array("src", "dst")).alias("id")).distinct()
    return with_row_number(ends, ["id"], "n").select("id", (F.col("n") - 1).alias("new_id"))


def degree_order_ids(edges: DataFrame) -> DataFrame:
    """(id, new_id): the ids on edges numbered from 0 by ascending out-degree, the smaller id first among equals."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("src").alias("id"), F.lit(1).alias("d")), F.struct(F.col("dst").alias("id"), F.lit(0).alias("d")))).alias("e"))
    degree = ends.groupBy(F.col("e.id").alias("id")).agg(F.sum("e.d").alias("d"))
    return with_row_number(degree, ["d", "id"], "n").select("id", (F.col("n") - 1).alias("new_id"))


def shuffle_edges(edges: DataFrame, seed: int, limit: int | None = None) -> DataFrame:
    """Edges in random order, which the seed and their content settle; at most ``limit`` of them."""
    drawn = edges.withColumn("_draw", F.xxhash64(*edges.columns, F.lit(seed)))
    if limit is not None:  # numbered, as a limit would gather them in one task
        drawn = with_row_number(drawn, ["_draw", *edges.columns], "_n").where(F.col("_n") <= limit)
    return drawn.orderBy("_draw", *edges.columns).select(*edges.columns)


def split_edges(edges: DataFrame, shares: list[float], seed: int, keep_pairs: bool = False) -> list[DataFrame]:
    """Random parts of about the given shares. keep_pairs: both directions of a pair fall into the same part."""
    total, low, parts = sum(shares), 0.0, []
    ends: list[str | Column] = [F.least("src", "dst"), F.greatest("src", "dst")] if keep_pairs else list(edges.columns)
    draw = F.pmod(F.xxhash64(*ends, F.lit(seed)), F.lit(1_000_000)) / 1_000_000
    for s in shares:
        high = low + s / total
        parts.append(edges.where((draw >= low) & (draw < (high if len(parts) + 1 < len(shares) else 2.0))))
        low = high
    return parts


def part_of(edges: DataFrame, order: list[str], part: int, parts: int) -> DataFrame:
    """The part-th of so many equal stretches of the edges in an order, counted from 0."""
    if not 0 <= part < parts:
        raise ValueError("part must lie in 0..parts-1")
    numbered = with_row_number(edges, order, "_n", total="_all")
    low, high = F.floor(F.col("_all") * part / parts), F.floor(F.col("_all") * (part + 1) / parts)
    return numbered.where((F.col("_n") > low) & (F.col("_n") <= high)).drop("_n", "_all")
