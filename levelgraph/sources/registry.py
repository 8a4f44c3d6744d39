"""Which loader takes a file, and how what it loads becomes a graph."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..graph import LEVEL_SHIFT, Graph
from ..operators import transform
from ..operators.mutation import Delta
from ..plans.ordering import with_row_number
from ..store import Store
from . import fgf, generators, snap, xs1

Loader = Callable[[SparkSession, str], "DataFrame | tuple[DataFrame, DataFrame]"]


def _ends(*endings: str) -> Callable[[str], bool]:
    return lambda path: path.lower().rstrip("/").endswith(endings)


#: (name, whether it takes a path, loader); the first that does is used.
LOADERS: list[tuple[str, Callable[[str], bool], Loader]] = [
    ("fgf", _ends(".fgf"), fgf.read_fgf),
    ("snap", _ends(".net", ".txt", ".snap"), snap.read_snap),
    ("xs1", _ends(".xs1", ".dat"), xs1.read_xs1),
    ("generator", generators.is_spec, generators.from_spec),
    ("parquet", _ends(".parquet"), lambda s, p: s.read.parquet(p)),
]


def register_loader(name: str, accepts: Callable[[str], bool], loader: Loader) -> None:
    """Adds a loader before all others."""
    LOADERS.insert(0, (name, accepts, loader))


def loader_for(path: str) -> tuple[str, Loader]:
    for name, accepts, loader in LOADERS:
        if accepts(path):
            return name, loader
    raise ValueError(f"no loader takes {path}")


DIRECTIONS = {"directed": lambda e: e, "double": transform.undirected_double, "ordered": transform.undirected_ordered}


#: Loaders that tell the place of an edge in its file.
PLACED = {"snap", "xs1"}


def read(spark: SparkSession, path: str, properties: bool = True, max_edges: int | None = None) -> tuple[DataFrame, DataFrame | None]:
    """(edges, nodes or None) of one path."""
    name, loader = loader_for(path)
    placed = max_edges is not None and name in PLACED
    got = loader(spark, path, place=True) if placed else loader(spark, path)
    e, n = got if isinstance(got, tuple) else (got, None)
    e = e if properties else e.select("src", "dst", *["_place"] * placed)
    if max_edges is not None:  # numbered, as a limit would gather them in one task
        e = with_row_number(e, ["_place"] if placed else ["src", "dst"], "_n").where(F.col("_n") <= max_edges).drop("_n", "_place")
    return e, n


def append(store: Store, *paths: str, direction: str = "directed", deduplicate: bool = False, properties: bool = True, new_ids: bool | None = None) -> Graph:
    """Adds each path to a stored graph as its next level, and opens it; what is stored isn't read but for its sizes.

    new_ids: the file's ids, which begin at 0, are moved behind all ids of the graph, so that its vertices are new ones; by
    default so for binary property graphs alone. An empty store begins with the first path.
    """
    spark = store.spark
    for path in paths:
        if not store.levels():
            store.save(load(spark, path, direction=direction, deduplicate=deduplicate, properties=properties))
            continue
        name = loader_for(path)[0]
        e, n = read(spark, path, properties)
        delta = Delta(store.open())
        if name == "fgf" if new_ids is None else new_ids:
            first = delta.next_node_id()
            e = e.withColumns({"src": F.col("src") + first, "dst": F.col("dst") + first})
            n = None if n is None else n.withColumn("id", F.col("id") + first)
        e = DIRECTIONS[direction](e.withColumn("created_level", F.lit(delta.level)))
        e = transform.deduplicate(e) if deduplicate else e
        delta = delta.add_edges(e)
        if n is not None and properties:
            delta = delta.add_nodes(n)
        delta.checkpoint(store)
    return store.open()


def load(
    spark: SparkSession,
    *paths: str,
    direction: str = "directed",
    deduplicate: bool = False,
    properties: bool = True,
    min_level: int | None = None,
    max_level: int | None = None,
    max_edges: int | None = None,
    part: tuple[int, int] | None = None,
) -> Graph:
    """A graph with one level for each path, in their order. All paths must be of one loader.

    direction: directed, double (both ways, loops once) or ordered (smaller id first). deduplicate: within levels.
    properties=False reads the structure alone. Levels outside min_level..max_level aren't read. max_edges takes the
    first edges of each path in the order of the file, where its loader tells that (PLACED), else in (src, dst) order;
    part=(k, n) the k-th of n stretches of the (src, dst) order.
    """
    if direction not in DIRECTIONS:
        raise ValueError(f"direction is one of {sorted(DIRECTIONS)}")
    kinds = {loader_for(p)[0] for p in paths}
    if len(kinds) != 1:
        raise ValueError(f"files of several kinds: {sorted(kinds)}" if kinds else "no files")
    levels, nodes = [], []
    for k, path in enumerate(paths):
        if (min_level is not None and k < min_level) or (max_level is not None and k > max_level):
            continue
        e, n = read(spark, path, properties, max_edges)
        e = e if part is None else transform.part_of(e, ["src", "dst"], *part)
        e = DIRECTIONS[direction](e.withColumn("created_level", F.lit(k)))
        e = transform.deduplicate(e) if deduplicate else e
        e = with_row_number(e, ["src", "dst"], "_n")
        levels.append(e.withColumn("edge_id", F.lit(k << LEVEL_SHIFT) + F.col("_n") - 1).drop("_n"))
        if n is not None and properties:
            nodes.append(n.withColumn("level", F.lit(k)))
    if not levels:
        raise ValueError("no level lies within the bounds")
    union = lambda dfs: reduce(lambda x, y: x.unionByName(y, allowMissingColumns=True), dfs)
    return Graph(union(levels), union(nodes) if nodes else None, level=None, min_level=min_level)
