"""Changes to a graph: a delta of new edges, deletions and node versions, which a checkpoint turns into a level."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import require_columns
from ..graph import LEVEL_SHIFT, Graph
from ..plans.ordering import with_row_number
from ..store import Store


#: Operations of a log, in the order in which those of one place in it take effect.
OPERATIONS = ("delete_node", "delete_edge", "add_edge", "add_edge_if_absent", "add_weighted", "add_node")
_OWN = ("edge_id", "created_level", "deleted_level")


def _union(a: DataFrame | None, b: DataFrame) -> DataFrame:
    return b if a is None else a.unionByName(b, allowMissingColumns=True)


@dataclass(frozen=True)
class Delta:
    """Pending changes to a graph; each method gives a new delta, so that dropping one is an abort.

    Deleting an edge or node twice is the same as once. ``merged`` is the graph as a reader of the delta sees it, ``base``
    as all others do. New edges belong to level ``base.num_levels``; they get their ids when they are added, which later
    changes don't touch.
    """

    base: Graph
    new_edges: DataFrame | None = None  # src, dst, properties, edge_id: those that are still there
    gone_edges: DataFrame | None = None  # edge_id, of the base
    gone_nodes: DataFrame | None = None  # id
    new_nodes: DataFrame | None = None  # id, properties
    taken: int = 0  # numbers that new edges have had

    @property
    def level(self) -> int:
        return self.base.num_levels

    # changes

    def add_edges(self, edges: DataFrame) -> Delta:
        """Appends edges (src, dst, properties) as they are: rows are a bag. A row without src or dst is no edge."""
        require_columns(edges, "src", "dst")
        props = [c for c in edges.columns if c not in _OWN]
        order = ["src", "dst", *(c for c in props if c not in ("src", "dst") and not isinstance(edges.schema[c].dataType, T.MapType))]
        numbered = with_row_number(edges.where("src is not null and dst is not null").select(*props), order, "_n")
        first = (self.level << LEVEL_SHIFT) + self.taken - 1
        made = numbered.select(*props, (F.lit(first).cast("long") + F.col("_n")).alias("edge_id"))
        return replace(self, new_edges=_union(self.new_edges, made), taken=self.taken + made.count())

    def add_edges_if_absent(self, edges: DataFrame) -> Delta:
        """Appends each different (src, dst) that neither the graph nor the delta has yet."""
        there = self.merged().view.select("src", "dst").distinct()
        return self.add_edges(_one_each(edges).join(there, ["src", "dst"], "left_anti"))

    def add_weighted(self, edges: DataFrame, name: str = "stream_weight") -> Delta:
        """Appends (src, dst) once each; its weight is its occurrences here plus what its visible edges weighed, which go.

        A visible edge without a weight weighs 1. Edges that are themselves pending go like those of the base, so that
        after any number of calls a pair has one edge.
        """
        n = edges.where("src is not null and dst is not null").groupBy("src", "dst").agg(F.count(F.lit(1)).alias("_n"))
        old = self._weights(name)
        new = n.join(old, ["src", "dst"], "left").select("src", "dst", (F.col("_n") + F.coalesce("_old", F.lit(0))).alias(name))
        superseded = self.merged().view.join(n, ["src", "dst"], "left_semi").select("edge_id")
        return self.delete_edges(superseded).add_edges(new)

    def _weights(self, name: str) -> DataFrame:
        """(src, dst, _old): what the visible edges of each pair weigh together."""
        view = self.merged().view
        w = F.coalesce(name, F.lit(1)) if name in view.columns else F.lit(1)
        return view.groupBy("src", "dst").agg(F.sum(w.cast("long")).alias("_old"))

    def add_nodes(self, nodes: DataFrame) -> Delta:
        """Sets properties of nodes (id, properties) at the new level; unnamed properties keep their values.

        The nodes are there from then on, with or without edges.
        """
        require_columns(nodes, "id")
        return replace(self, new_nodes=_union(self.new_nodes, nodes.where("id is not null")))

    def next_node_id(self) -> int:
        """The id that a new node without one takes."""
        most = self.new_edges.agg(F.max(F.greatest("src", "dst"))).first()[0] if self.new_edges is not None else None
        nodes = [df.agg(F.max("id")).first()[0] for df in (self.new_nodes, self.base.nodes) if df is not None]
        return 1 + max([self.base.max_nodes - 1, *(x for x in (most, *nodes) if x is not None)])

    def delete_edges(self, edges: DataFrame) -> Delta:
        """Deletes edges by edge_id, pending ones too; unknown ids do no harm."""
        ids = edges.where("edge_id is not null").select("edge_id")
        kept = None if self.new_edges is None else self.new_edges.join(ids, "edge_id", "left_anti")
        return replace(self, new_edges=kept, gone_edges=_union(self.gone_edges, ids))

    def delete_nodes(self, nodes: DataFrame) -> Delta:
        """Deletes all in- and out-edges of nodes (id), pending ones too; later additions may use the ids again."""
        ids = nodes.where("id is not null").select("id").distinct()
        kept = self.new_edges
        if kept is not None:
            for end in ("src", "dst"):
                kept = kept.join(ids.select(F.col("id").alias(end)), end, "left_anti")
        made = None if self.new_nodes is None else self.new_nodes.join(ids, "id", "left_anti")
        return replace(self, new_edges=kept, new_nodes=made, gone_nodes=_union(self.gone_nodes, ids).distinct())

    def apply(self, log: DataFrame, weight: str = "stream_weight") -> Delta:
        """The delta with a log of operations (op, src, dst, properties, and seq for their order).

        op is delete_node (src), delete_edge (all edges that src and dst have by then), add_edge, add_edge_if_absent,
        add_weighted or add_node (src); ValueError for another op. They take effect by ascending seq (a null one first),
        those of one seq, or of a log without seq, in the order of OPERATIONS. Nothing is walked row by row: of each
        pair only what follows its last deletion counts, and the last add_weighted takes all before it into one edge.
        """
        require_columns(log, "op", "src", "dst")
        known = F.array_position(F.array(*map(F.lit, OPERATIONS)), F.col("op"))
        other = log.where(F.col("op").isNull() | (known == 0)).select("op").take(1)
        if other:
            raise ValueError(f"unknown operation {other[0].op}")
        seq = F.coalesce(F.col("seq").cast("long"), F.lit(-(2**59))) if "seq" in log.columns else F.lit(0).cast("long")
        log = log.withColumn("_at", seq * 8 + known).drop("seq")
        of = lambda *ops: log.where(F.col("op").isin(*ops))
        pair_gone = of("delete_edge").groupBy("src", "dst").agg(F.max("_at").alias("_pair"))
        node_gone = of("delete_node").where("src is not null").groupBy(F.col("src").alias("id")).agg(F.max("_at").alias("_node"))
        d = self.delete_edges(self.merged().view.join(pair_gone, ["src", "dst"], "left_semi")).delete_nodes(node_gone)

        adds = of("add_edge", "add_edge_if_absent", "add_weighted").where("src is not null and dst is not null")
        adds = adds.join(pair_gone, ["src", "dst"], "left")
        for end in ("src", "dst"):
            adds = adds.join(node_gone.select(F.col("id").alias(end), F.col("_node").alias(f"_{end}")), end, "left")
        last = F.greatest("_pair", "_src", "_dst")
        adds = adds.where(last.isNull() | (F.col("_at") > last)).drop("_pair", "_src", "_dst")
        at_weighted = F.max(F.when(F.col("op") == "add_weighted", F.col("_at"))).alias("_last")
        adds = adds.join(adds.groupBy("src", "dst").agg(F.min("_at").alias("_first"), at_weighted), ["src", "dst"])
        helpers = ("op", "_at", "_first", "_last")
        absent = (F.col("op") == "add_edge_if_absent") & (F.col("_at") == F.col("_first"))
        plain = adds.where("op = 'add_edge' and (_last is null or _at > _last)").drop(*helpers)
        there = d.merged().view.select("src", "dst").distinct()
        first = _one_each(adds.where(absent & F.col("_last").isNull()).drop(*helpers)).join(there, ["src", "dst"], "left_anti")
        own = F.coalesce(F.col(weight), F.lit(1)) if weight in log.columns else F.lit(1)
        n = F.when(F.col("op") == "add_weighted", 1).when(F.col("op") == "add_edge", own).otherwise(0).cast("long")
        taken = adds.where("_at <= _last").groupBy("src", "dst").agg(F.sum(n).alias("_n"), F.max(absent.cast("long")).alias("_absent"))
        merged = taken.join(d._weights(weight), ["src", "dst"], "left")
        merged = merged.select("src", "dst", (F.col("_n") + F.coalesce("_old", "_absent")).alias(weight))
        superseded = d.merged().view.join(taken, ["src", "dst"], "left_semi")
        added = plain.unionByName(first)
        if of("add_weighted").take(1):
            d, added = d.delete_edges(superseded), added.unionByName(merged, allowMissingColumns=True)
        if of("add_edge", "add_edge_if_absent", "add_weighted").take(1):
            d = d.add_edges(added)
        nodes = of("add_node").where("src is not null")
        if nodes.take(1):
            props = [c for c in log.columns if c not in ("op", "src", "dst", "_at")]
            newest = nodes.groupBy(F.col("src").alias("id")).agg(F.max_by(F.struct(F.lit(0).alias("_none"), *props), "_at").alias("_p"), F.max("_at").alias("_at"))
            newest = newest.join(node_gone, "id", "left").where("_node is null or _at > _node")
            d = d.add_nodes(newest.select("id", *[F.col(f"_p.{c}").alias(c) for c in props]))
        return d

    # reading

    def _added(self) -> DataFrame | None:
        return None if self.new_edges is None else self.new_edges.withColumn("created_level", F.lit(self.level))

    def _deleted(self) -> DataFrame | None:
        """Ids of the base's edges that the delta deletes."""
        view = self.base.view
        parts = []
        if self.gone_edges is not None:
            parts.append(view.join(self.gone_edges.distinct(), "edge_id", "left_semi").select("edge_id"))
        if self.gone_nodes is not None:
            for end in ("src", "dst"):
                parts.append(view.join(self.gone_nodes.select(F.col("id").alias(end)), end, "left_semi").select("edge_id"))
        if not parts:
            return None
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out.distinct()

    def _declared(self) -> DataFrame | None:
        """(id, level, deleted_level): nodes that were added as such, with those of the delta."""
        out = self.base.declared
        if out is not None and self.gone_nodes is not None:
            gone = self.gone_nodes.select("id", F.lit(self.level).alias("_gone"))
            out = out.join(gone, "id", "left").select("id", "level", F.least("deleted_level", "_gone").alias("deleted_level"))
        if self.new_nodes is not None:
            out = _union(out, self.new_nodes.select("id").distinct().select("id", F.lit(self.level).alias("level"), F.lit(None).cast("int").alias("deleted_level")))
        return out

    def merged(self) -> Graph:
        """The graph with the delta, at the level that a checkpoint would give it."""
        edges = self.base.edges
        gone = self._deleted()
        if gone is not None:
            edges = edges.join(gone.withColumn("_gone", F.lit(self.level)), "edge_id", "left")
            edges = edges.withColumn("deleted_level", F.least("deleted_level", "_gone")).drop("_gone").select(*self.base.edges.columns)
        new = self._added()
        if new is not None:
            edges = edges.unionByName(new, allowMissingColumns=True)
        nodes = self.base.nodes
        if self.new_nodes is not None:
            versions = self.new_nodes.withColumn("level", F.lit(self.level))
            if nodes is not None:
                missing = [c for c in nodes.columns if c not in versions.columns]
                if missing:  # a version is a whole row: what isn't set is taken over
                    old = nodes.groupBy("id").agg(F.max(F.struct("level", *missing)).alias("_o"))
                    versions = versions.join(old, "id", "left").select("*", *[F.col(f"_o.{c}").alias(c) for c in missing]).drop("_o")
                nodes = nodes.unionByName(versions, allowMissingColumns=True)
            else:
                nodes = versions
        return Graph(edges, nodes, self.base.named, declared=self._declared(), levels=self.level + 1)

    def checkpoint(self, store: Store | None = None) -> Graph:
        """The graph with the delta as its newest level; without changes the base itself. A store gets only what is new."""
        if all(x is None for x in (self.new_edges, self.gone_edges, self.gone_nodes, self.new_nodes)):
            return self.base
        if store is None:
            return self.merged()
        new, gone, level = self._added(), self._deleted(), self.level
        if gone is not None:
            store.write_gone(gone, level)
        if self.new_nodes is not None:
            store.write_nodes(self.merged().nodes.where(F.col("level") == level), level)
        declared = self._declared()
        if declared is not None:
            store.write_declared(declared)
        empty = self.base.edges.limit(0).select("src", "dst", "edge_id")
        store.write_level(new if new is not None else empty, level)  # last: a level is there once its edges are
        return store.open()


def _one_each(edges: DataFrame) -> DataFrame:
    """One row of each (src, dst) that has both, of least properties."""
    whole = edges.where("src is not null and dst is not null")
    rest = [c for c in edges.columns if c not in ("src", "dst", *_OWN)]
    if not rest:
        return whole.select("src", "dst").distinct()
    kept = whole.groupBy("src", "dst").agg(F.min(F.struct(*rest)).alias("_e"))
    return kept.select("src", "dst", *[F.col(f"_e.{c}").alias(c) for c in rest])


def delete_by_visible_level(graph: Graph, edge_ids: DataFrame, level: int, lower_only: bool = True) -> Graph:
    """Sets the level from which edges are deleted; lower_only keeps an earlier one."""
    to = edge_ids.select("edge_id").distinct().withColumn("_to", F.lit(level))
    value = F.least("deleted_level", "_to") if lower_only else F.coalesce("_to", "deleted_level")
    edges = graph.edges.join(to, "edge_id", "left").withColumn("deleted_level", value).select(*graph.edges.columns)
    return replace(graph, edges=edges)


def set_edge_property(graph: Graph, values: DataFrame, name: str, add: bool = False) -> Graph:
    """Sets, or adds to, an edge property by edge_id from values (edge_id, name); a missing value counts as 0 in adding.

    Of repeated ids the values add up if added, else the greatest is taken.
    """
    require_columns(values, "edge_id", name)
    new = values.groupBy("edge_id").agg((F.sum(name) if add else F.max(name)).alias("_v"))
    edges = graph.edges if name in graph.edges.columns else graph.edges.withColumn(name, F.lit(None).cast(values.schema[name].dataType))
    value = F.when(F.col("_v").isNotNull(), F.coalesce(name, F.lit(0)) + F.col("_v")).otherwise(F.col(name)) if add else F.coalesce("_v", name)
    joined = edges.join(new, "edge_id", "left").withColumn(name, value.cast(edges.schema[name].dataType)).drop("_v")
    return replace(graph, edges=joined)


def set_node_property(graph: Graph, values: DataFrame, name: str, level: int | None = None, add: bool = False) -> Graph:
    """Sets, or adds to, a node property by id from values (id, name), as a node version of a level (the newest one).

    A version is a whole row, which takes over the node's other properties; a node's row of that very level is replaced.
    In adding, a node without a value has 0. Of repeated ids the values add up if added, else the greatest is taken; rows
    with a null in either column do nothing.
    """
    require_columns(values, "id", name)
    level = max(0, graph.num_levels - 1) if level is None else level
    new = values.where(F.col("id").isNotNull() & F.col(name).isNotNull()).groupBy("id").agg((F.sum(name) if add else F.max(name)).alias("_v"))
    if graph.nodes is None:
        return replace(graph, nodes=new.select("id", F.lit(level).alias("level"), F.col("_v").alias(name)))
    nodes = graph.nodes if name in graph.nodes.columns else graph.nodes.withColumn(name, F.lit(None).cast(values.schema[name].dataType))
    props = [c for c in nodes.columns if c not in ("id", "level")]
    newest = nodes.where(F.col("level") <= level).groupBy("id").agg(F.max(F.struct("level", *props)).alias("_n"))
    value = F.coalesce(F.col(f"_n.{name}"), F.lit(0)) + F.col("_v") if add else F.col("_v")
    kind = nodes.schema[name].dataType
    made = new.join(newest, "id", "left").select("id", F.lit(level).alias("level"), *[(value.cast(kind) if c == name else F.col(f"_n.{c}")).alias(c) for c in props])
    kept = nodes.join(made.select("id", "level"), ["id", "level"], "left_anti")
    return replace(graph, nodes=kept.select("id", "level", *props).unionByName(made))
