"""Triangle counts, and counts over in-neighbours."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import require_columns
from ..graph import Graph


def _canonical(graph: Graph) -> DataFrame:
    return graph.view.where("src <> dst").select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct()


def _ahead(e: DataFrame) -> DataFrame:
    """(x, y, other columns) of distinct edges (a, b, ...): each oriented from lower to higher (degree, id)."""
    degree = e.select(F.explode(F.array("a", "b")).alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("d"))
    da, db = degree.select(F.col("id").alias("a"), F.col("d").alias("da")), degree.select(F.col("id").alias("b"), F.col("d").alias("db"))
    up = F.struct("da", "a") < F.struct("db", "b")
    both = e.join(da, "a").join(db, "b")
    more = [c for c in e.columns if c not in ("a", "b")]
    return both.select(F.when(up, F.col("a")).otherwise(F.col("b")).alias("x"), F.when(up, F.col("b")).otherwise(F.col("a")).alias("y"), *more)


def triangles(graph: Graph) -> DataFrame:
    """(n_triangles): triangles of the simple undirected graph; loops, parallel and reciprocal edges don't add any.

    Edges are oriented from lower to higher (degree, id), so that no vertex has more than about the square root of twice
    the edges ahead of it, however many neighbours it has; two of those are joined, and the third looked up.
    """
    e = _canonical(graph)
    one = _ahead(e)
    two = one.select(F.col("x"), F.col("y").alias("z"))
    wedges = one.join(two, "x").where("y < z").select(F.col("y").alias("a"), F.col("z").alias("b"))
    return wedges.join(e, ["a", "b"]).agg(F.count(F.lit(1)).alias("n_triangles"))


def triangles_doubled(graph: Graph) -> DataFrame:
    """(n_triangles): on a doubled graph, with parallel edges multiplied: each triple of edges counts.

    Wedges are joined as in triangles, from edges oriented by (degree, id).
    """
    m = graph.view.where("src < dst").groupBy(F.col("src").alias("a"), F.col("dst").alias("b")).agg(F.count(F.lit(1)).alias("m"))
    one = _ahead(m)
    xy = one.select("x", "y", F.col("m").alias("m1"))
    xz = one.select("x", F.col("y").alias("z"), F.col("m").alias("m2"))
    wedges = xy.join(xz, "x").where("y < z").select(F.col("y").alias("a"), F.col("z").alias("b"), "m1", "m2")
    found = wedges.join(m.withColumnRenamed("m", "m3"), ["a", "b"])
    return found.agg(F.coalesce(F.sum(F.col("m1") * F.col("m2") * F.col("m3")), F.lit(0)).alias("n_triangles"))


def teen_followers(graph: Graph, age: DataFrame | None = None, low: int = 10, high: int = 20) -> DataFrame:
    """(id, n_teens): in-edges of each vertex from vertices with low <= age < high; parallel edges count each."""
    ages = graph.node_property("age") if age is None else age
    require_columns(ages, "id", "age")
    teens = ages.where((F.col("age") >= low) & (F.col("age") < high)).select(F.col("id").alias("src"))
    counted = graph.view.join(teens, "src", "left_semi").groupBy(F.col("dst").alias("id")).agg(F.count(F.lit(1)).alias("n_teens"))
    return graph.vertices().join(counted, "id", "left").fillna(0, ["n_teens"])


def avg_teen_followers(graph: Graph, older_than: int = 0, age: DataFrame | None = None) -> DataFrame:
    """(avg_teens): mean of n_teens over vertices of greater age; 0 if there are none."""
    ages = graph.node_property("age") if age is None else age
    old = ages.where(F.col("age") > older_than).select("id")
    return teen_followers(graph, age).join(old, "id", "left_semi").agg(F.coalesce(F.avg("n_teens"), F.lit(0.0)).alias("avg_teens"))
