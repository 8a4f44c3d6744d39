"""Graphs on disk: append-only Parquet levels, and tombstones beside them, so that deleting never rewrites a level."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .graph import Graph, visible


def flatten(graph: Graph) -> Graph:
    """The graph's view as level 0: edges with all properties, and each node's newest properties."""
    edges = graph.view.withColumns({"created_level": F.lit(0), "deleted_level": F.lit(None).cast("int")})
    nodes = graph.nodes
    if nodes is not None:
        rows = nodes if graph.level is None else nodes.where(F.col("level") <= graph.level)
        props = graph.properties()["nodes"]
        newest = rows.groupBy("id").agg(F.max(F.struct("level", *props)).alias("_n"))
        nodes = newest.select("id", F.lit(0).alias("level"), *[F.col(f"_n.{p}").alias(p) for p in props])
    declared = graph.declared
    if declared is not None:
        at = declared if graph.level is None else declared.where(F.col("level") <= graph.level)
        declared = at.select("id", F.lit(0).alias("level"), F.when(F.col("deleted_level") <= (graph.level if graph.level is not None else 2**31 - 1), 0).alias("deleted_level"))
    return Graph(edges, nodes, declared=declared)


class Store:
    """A folder with edges/created_level=k, gone/deleted_level=k (edge ids), nodes/level=k, declared, and named/<name>.

    Opening reads only the levels asked for; a level that was written is never changed. Writing a level again replaces it.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _fs(self, path: str):
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def _there(self, part: str) -> bool:
        fs, p = self._fs(f"{self.root}/{part}")
        return fs.exists(p)

    def _delete(self, part: str) -> bool:
        fs, p = self._fs(f"{self.root}/{part}")
        return fs.delete(p, True)

    def levels(self, part: str = "edges") -> list[int]:
        """The levels that are stored."""
        if not self._there(part):
            return []
        fs, p = self._fs(f"{self.root}/{part}")
        names = [s.getPath().getName() for s in fs.listStatus(p)]
        return sorted(int(n.split("=")[1]) for n in names if "=" in n)

    def write_level(self, edges: DataFrame, level: int) -> None:
        """Writes edges as one level, clustered by (src, dst), so that files are pruned by their statistics on reading.

        The edges are range-parted: a vertex of very many edges takes as many files as they need.
        """
        out = edges.drop("created_level", "deleted_level").repartitionByRange("src", "dst").sortWithinPartitions("src", "dst")
        out.write.mode("overwrite").parquet(f"{self.root}/edges/created_level={level}")
        self._note("edges", out.schema)

    def write_gone(self, edge_ids: DataFrame, level: int) -> None:
        edge_ids.select("edge_id").write.mode("overwrite").parquet(f"{self.root}/gone/deleted_level={level}")

    def write_nodes(self, nodes: DataFrame, level: int) -> None:
        out = nodes.drop("level")
        out.write.mode("overwrite").parquet(f"{self.root}/nodes/level={level}")
        self._note("nodes", out.schema)

    def write_declared(self, declared: DataFrame) -> None:
        """Nodes that were added as such, all of them: written under a new name, which the newest replaces."""
        old = self._versions("declared")
        declared.write.parquet(f"{self.root}/declared/version={(old[-1] if old else 0) + 1}")
        for k in old:
            self._delete(f"declared/version={k}")

    def _versions(self, part: str) -> list[int]:
        return self.levels(part)

    def _text(self, path: str) -> str | None:
        fs, p = self._fs(path)
        if not fs.exists(p):
            return None
        stream = fs.open(p)
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def _noted(self, part: str) -> T.StructType | None:
        """The columns of all levels of a part, kept beside them, so that opening reads no file's footer."""
        text = self._text(f"{self.root}/{part}.schema.json")
        return None if text is None else T.StructType.fromJson(json.loads(text))

    def _note(self, part: str, schema: T.StructType, replace: bool = False) -> None:
        known = None if replace else self._noted(part)
        fields = {f.name: f for f in (known.fields if known else [])}
        new = [f for f in schema.fields if f.name not in fields]
        if known is not None and not new:
            return
        fields.update({f.name: T.StructField(f.name, f.dataType, True) for f in new})
        fs, p = self._fs(f"{self.root}/{part}.schema.json")
        stream = fs.create(p, True)
        try:
            stream.write(bytearray(json.dumps(T.StructType(list(fields.values())).jsonValue()).encode()))
        finally:
            stream.close()

    def _read(self, part: str, level: str) -> DataFrame:
        noted = self._noted(part)
        if noted is None:  # a folder from elsewhere
            return self.spark.read.option("mergeSchema", "true").parquet(f"{self.root}/{part}")
        fields = [f for f in noted.fields if f.name != level]
        return self.spark.read.schema(T.StructType([*fields, T.StructField(level, T.IntegerType())])).parquet(f"{self.root}/{part}")

    def save(self, graph: Graph) -> None:
        """Writes a whole graph: all its levels in one job, its deletions and node versions beside them."""
        order = ["created_level", "src", "dst"]
        out = graph.edges.drop("deleted_level").repartitionByRange(*order).sortWithinPartitions(*order)
        out.write.mode("overwrite").partitionBy("created_level").parquet(f"{self.root}/edges")
        self._note("edges", out.drop("created_level").schema, replace=True)
        if "edge_id" in graph.edges.columns:
            gone = graph.edges.where("deleted_level is not null").select("edge_id", "deleted_level")
            gone.write.mode("overwrite").partitionBy("deleted_level").parquet(f"{self.root}/gone")
        if graph.nodes is not None:
            graph.nodes.write.mode("overwrite").partitionBy("level").parquet(f"{self.root}/nodes")
            self._note("nodes", graph.nodes.drop("level").schema, replace=True)
        if graph.declared is not None:
            self.write_declared(graph.declared)
        for name, df in graph.named.items():
            df.write.mode("overwrite").parquet(f"{self.root}/named/{name}")

    def open(self, max_level: int | None = None, min_level: int | None = None) -> Graph:
        """The stored graph with all properties; levels outside the bounds aren't read. ValueError if there is none."""
        if not self.levels():
            raise ValueError(f"no graph in {self.root}")
        edges = self._read("edges", "created_level").where(visible_levels(max_level, min_level))
        gone = None
        if self.levels("gone"):
            gone = self.spark.read.parquet(f"{self.root}/gone")
            gone = gone if max_level is None else gone.where(F.col("deleted_level") <= max_level)
            gone = gone.groupBy("edge_id").agg(F.min("deleted_level").alias("deleted_level"))
        if gone is not None:
            edges = edges.join(gone, "edge_id", "left")
        nodes = None
        if self.levels("nodes"):
            nodes = self._read("nodes", "level")
            nodes = nodes if max_level is None else nodes.where(F.col("level") <= max_level)
        named = {}
        if self._there("named"):
            fs, p = self._fs(f"{self.root}/named")
            names = [s.getPath().getName() for s in fs.listStatus(p)]
            named = {n: self.spark.read.parquet(f"{self.root}/named/{n}") for n in names}
        versions = self._versions("declared")
        declared = self.spark.read.parquet(f"{self.root}/declared/version={versions[-1]}") if versions else None
        return Graph(edges, nodes, named, max_level, min_level, declared, 1 + self.levels()[-1])

    def delete_level(self, level: int) -> bool:
        """Drops the edges of a level and everything older levels' deletions said of it; False if it wasn't there."""
        return self._delete(f"edges/created_level={level}")

    def keep_recent(self, n: int) -> list[int]:
        """Drops all node versions that are not the newest up to the n-th level from the end; returns the levels dropped.

        Edges stay: they are one version each. A node's value at the remaining levels stays the same, as the newest
        dropped versions are rewritten at the oldest level that is kept.
        """
        levels = self.levels("nodes")
        drop, keep = levels[:-n] if n else levels, levels[-n:] if n else []
        if not drop or not keep:
            return []
        nodes = self._read("nodes", "level").where(F.col("level") <= keep[0])
        props = [c for c in nodes.columns if c not in ("id", "level")]
        newest = nodes.groupBy("id").agg(F.max(F.struct("level", *props)).alias("_n"))
        # written aside first, as its own input lies under the level that it replaces
        newest.select("id", *[F.col(f"_n.{p}").alias(p) for p in props]).write.mode("overwrite").parquet(f"{self.root}/nodes_next")
        self._delete(f"nodes/level={keep[0]}")
        fs, source = self._fs(f"{self.root}/nodes_next")
        fs.rename(source, self._fs(f"{self.root}/nodes/level={keep[0]}")[1])
        for level in drop:
            self._delete(f"nodes/level={level}")
        return drop


def visible_levels(max_level: int | None, min_level: int | None):
    """Condition on created_level alone, by which folders are pruned."""
    there = F.lit(True)
    if max_level is not None:
        there = there & (F.col("created_level") <= max_level)
    if min_level is not None:
        there = there & (F.col("created_level") >= min_level)
    return there
