"""A property graph whose edges carry the level in which they came and, if they went, the level in which they went."""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from functools import cached_property

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .functions.columns import require_columns

#: Bits of an edge id that number the edges of a level.
LEVEL_SHIFT = 38


def visible(level: int | None = None, min_level: int | None = None) -> Column:
    """Condition on an edge's levels: created in min_level..level and not deleted at level. None: no bound."""
    there = F.lit(True)
    if min_level is not None:
        there = there & (F.col("created_level") >= min_level)
    if level is None:
        return there & F.col("deleted_level").isNull()
    return there & (F.col("created_level") <= level) & (F.col("deleted_level").isNull() | (F.col("deleted_level") > level))


def edge_id(level: Column, number: Column) -> Column:
    """A handle that holds the level and the edge's number in it; the same for both directions of an edge."""
    return F.shiftleft(level.cast("long"), LEVEL_SHIFT).bitwiseOR(number)


def level_of(edge: Column) -> Column:
    return F.shiftright(edge, LEVEL_SHIFT).cast("int")


@dataclass
class Graph:
    """edges: src, dst, created_level, deleted_level, edge_id and properties; nodes: id, level and properties, a row for
    each version. Ids are longs from 0; rows are a bag. Every method gives a new lazy plan; a missing column is told by a
    ValueError. ``named`` holds further edge tables; ``declared`` (id, level, deleted_level) nodes that are there without
    edges; ``levels`` is how many levels there are at least, as one may have no edges.
    """

    edges: DataFrame
    nodes: DataFrame | None = None
    named: dict[str, DataFrame] = field(default_factory=dict)
    level: int | None = None
    min_level: int | None = None
    declared: DataFrame | None = None
    levels: int = 0

    def __post_init__(self) -> None:
        require_columns(self.edges, "src", "dst")
        for name, kind in (("created_level", "int"), ("deleted_level", "int")):
            if name not in self.edges.columns:
                value = F.lit(0) if name == "created_level" else F.lit(None)
                self.edges = self.edges.withColumn(name, value.cast(kind))

    # views

    @property
    def view(self) -> DataFrame:
        """The visible edges."""
        return self.edges.where(visible(self.level, self.min_level)) if self.level is not None or self.min_level is not None else self.edges.where(visible())

    def at(self, level: int) -> Graph:
        """The graph as it was at the end of a level."""
        return replace(self, level=level)

    def window(self, min_level: int, level: int) -> Graph:
        """As ``at``, without edges created before min_level. A window only moves forward."""
        if min_level > level or (self.min_level is not None and min_level < self.min_level):
            raise ValueError("a window starts at or before its level, and doesn't move back")
        return replace(self, level=level, min_level=min_level)

    def reverse(self) -> Graph:
        """Every edge turned round; edge ids stay."""
        turned = self.edges.withColumns({"src": F.col("dst"), "dst": F.col("src")})
        return replace(self, edges=turned)

    def within_level(self, level: int) -> DataFrame:
        """Visible edges that were created in one level."""
        return self.view.where(F.col("created_level") == level)

    def modified_nodes(self, level: int) -> DataFrame:
        """Nodes with an out-edge created in a level."""
        return self.within_level(level).select(F.col("src").alias("id")).distinct()

    # sizes

    @cached_property
    def max_nodes(self) -> int:
        """One more than the greatest id on any edge or of a declared node, deleted ones too; never shrinks."""
        ids = self.edges.select(F.greatest("src", "dst").alias("id"))
        if self.declared is not None:
            ids = ids.unionByName(self.declared.select("id"))
        most = ids.agg(F.max("id")).first()[0]
        return 0 if most is None else most + 1

    @cached_property
    def num_levels(self) -> int:
        top = self.edges.agg(F.max("created_level")).first()[0]
        return max(self.levels, 0 if top is None else top + 1)

    def vertices(self) -> DataFrame:
        """All ids from 0 to max_nodes - 1, isolated ones too."""
        return self.edges.sparkSession.range(self.max_nodes)

    def level_sizes(self) -> DataFrame:
        """(level, num_edges, max_nodes): edges created in each level, and the id space up to it."""
        own = self.edges.groupBy(F.col("created_level").alias("level")).agg(
            F.count(F.lit(1)).alias("num_edges"), (F.max(F.greatest("src", "dst")) + 1).alias("_most")
        )
        upto = F.max("_most").over(Window.partitionBy(F.lit(0)).orderBy("level"))  # one row for each level
        return own.select("level", "num_edges", upto.alias("max_nodes"))

    # degrees

    def _degree(self, end: str, name: str) -> DataFrame:
        counted = self.view.groupBy(F.col(end).alias("id")).agg(F.count(F.lit(1)).alias(name))
        return self.vertices().join(counted, "id", "left").fillna(0, [name])

    def out_degree(self) -> DataFrame:
        return self._degree("src", "out_degree")

    def in_degree(self) -> DataFrame:
        return self._degree("dst", "in_degree")

    def existing(self) -> DataFrame:
        """Ids with a visible edge, in or out, and declared nodes."""
        ends = self.view.select(F.explode(F.array("src", "dst")).alias("id"))
        if self.declared is not None:
            gone = F.col("deleted_level")
            there = gone.isNull() if self.level is None else (F.col("level") <= self.level) & (gone.isNull() | (gone > self.level))
            ends = ends.unionByName(self.declared.where(there).select("id"))
        return ends.distinct()

    def top_degree(self, k: int) -> DataFrame:
        """The k nodes of greatest out-degree, the smaller id first among equals: node, degree, rank."""
        top = self.view.groupBy(F.col("src").alias("node")).agg(F.count(F.lit(1)).alias("degree"))
        top = top.orderBy(F.desc("degree"), "node").limit(k)
        return top.withColumn("rank", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc("degree"), "node")))

    # neighbours

    def find(self, pairs: DataFrame) -> DataFrame:
        """For each asked (src, dst): edge_id and created_level of its newest visible edge, null if there is none."""
        newest = self.view.groupBy("src", "dst").agg(F.max(F.struct("created_level", "edge_id")).alias("e"))
        found = pairs.select("src", "dst").distinct().join(newest, ["src", "dst"], "left")
        return found.select("src", "dst", F.col("e.edge_id").alias("edge_id"), F.col("e.created_level").alias("created_level"))

    def edges_exist(self, handles: DataFrame, level: int) -> DataFrame:
        """(edge_id, there): whether each asked edge id is visible at a level."""
        seen = self.edges.where(visible(level)).select("edge_id", F.lit(True).alias("there"))
        return handles.select("edge_id").distinct().join(seen, "edge_id", "left").fillna(False, ["there"])

    def out_neighbours(self, ids: DataFrame) -> DataFrame:
        """(id, neighbour, created_level) of asked ids, one row for each edge."""
        e = self.view.select(F.col("src").alias("id"), F.col("dst").alias("neighbour"), "created_level")
        return e.join(ids.select("id").distinct(), "id", "left_semi")

    def in_neighbours(self, ids: DataFrame) -> DataFrame:
        return self.reverse().out_neighbours(ids)

    def common_neighbours(self, pairs: DataFrame) -> DataFrame:
        """(a, b, neighbour): targets that both ids of an asked pair have an edge to."""
        e = self.view.select("src", F.col("dst").alias("neighbour")).distinct()
        of_a = pairs.select("a", "b").distinct().join(e.withColumnRenamed("src", "a"), "a")
        return of_a.join(e.withColumnRenamed("src", "b"), ["b", "neighbour"]).select("a", "b", "neighbour")

    def random_nodes(self, k: int, seed: int) -> DataFrame:
        """k existing ids, drawn alike for a seed however the rows are laid out."""
        draw = F.xxhash64("id", F.lit(seed))
        return self.existing().orderBy(draw, "id").limit(k)

    def adjacency(self, low: int, high: int) -> DataFrame:
        """(id, out, in): sorted neighbour lists of the ids from low to high; an empty list where there are none."""
        asked = self.edges.sparkSession.range(low, high + 1)
        out = self.view.where(F.col("src").between(low, high)).groupBy(F.col("src").alias("id")).agg(F.sort_array(F.collect_list("dst")).alias("out"))
        into = self.view.where(F.col("dst").between(low, high)).groupBy(F.col("dst").alias("id")).agg(F.sort_array(F.collect_list("src")).alias("in"))
        none = F.array().cast("array<bigint>")
        return asked.join(out, "id", "left").join(into, "id", "left").select("id", F.coalesce("out", none).alias("out"), F.coalesce(F.col("in"), none).alias("in"))

    # properties

    def node_property(self, name: str, default=0) -> DataFrame:
        """(id, name): each vertex's newest value up to the level; without any, or a null one, the default."""
        if self.nodes is None:
            raise ValueError("the graph has no node properties")
        require_columns(self.nodes, "id", "level", name)
        rows = self.nodes if self.level is None else self.nodes.where(F.col("level") <= self.level)
        newest = rows.groupBy("id").agg(F.max(F.struct("level", F.col(name).alias("_v")))["_v"].alias(name))
        return self.vertices().join(newest, "id", "left").select("id", F.coalesce(F.col(name), F.lit(default)).alias(name))

    def properties(self) -> dict[str, list[str]]:
        """Names of the properties of nodes and edges."""
        own = {"src", "dst", "created_level", "deleted_level", "edge_id"}
        return {
            "edges": [c for c in self.edges.columns if c not in own],
            "nodes": [c for c in self.nodes.columns if c not in ("id", "level")] if self.nodes is not None else [],
        }
