"""Reports on a graph: degrees, levels, edge properties, adjacency, and equality with another graph."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..functions.columns import require_columns
from ..graph import Graph


def _all() -> WindowSpec:
    """Over histograms, which have a row for each bucket."""
    return Window.partitionBy(F.lit(0))


def degree_distribution(graph: Graph) -> DataFrame:
    """Vertices by bucket of out-degree: (low, high, n_nodes, node_share, nodes_upto, degree_sum, degree_share, degrees_upto).

    Buckets are 0-1, 2-3, 4-7 and so on; isolated vertices count in the first. Shares are of all, upto is cumulative.
    """
    d = F.greatest(F.col("out_degree"), F.lit(1))
    bucket = F.floor(F.log2(d) + F.lit(1e-12)).cast("int")
    rows = graph.out_degree().groupBy(bucket.alias("b")).agg(F.count(F.lit(1)).alias("n_nodes"), F.sum("out_degree").alias("degree_sum"))
    upto = _all().orderBy("b")
    share = lambda c, w: F.col(c) / F.sum(c).over(_all()) if w is None else F.sum(c).over(w) / F.sum(c).over(_all())
    return rows.select(
        F.when(F.col("b") == 0, 0).otherwise(F.pow(F.lit(2), "b")).cast("long").alias("low"),
        (F.pow(F.lit(2), F.col("b") + 1) - 1).cast("long").alias("high"),
        "n_nodes", F.round(share("n_nodes", None), 9).alias("node_share"), F.round(share("n_nodes", upto), 9).alias("nodes_upto"),
        "degree_sum", F.round(share("degree_sum", None), 9).alias("degree_share"), F.round(share("degree_sum", upto), 9).alias("degrees_upto"),
    )


def level_spread(graph: Graph) -> DataFrame:
    """Vertices by the number of levels their out-edges come from: (n_levels, n_nodes, share, share_nonzero, mean_degree)."""
    e = graph.view.groupBy("src").agg(F.count_distinct("created_level").alias("n_levels"), F.count(F.lit(1)).alias("d"))
    per = graph.vertices().join(e, F.col("id") == F.col("src"), "left").fillna(0, ["n_levels", "d"])
    rows = per.groupBy("n_levels").agg(F.count(F.lit(1)).alias("n_nodes"), F.avg("d").alias("mean_degree"))
    some = F.when(F.col("n_levels") > 0, F.col("n_nodes"))
    return rows.select(
        "n_levels", "n_nodes", F.round(F.col("n_nodes") / F.sum("n_nodes").over(_all()), 9).alias("share"),
        F.round(some / F.sum(some).over(_all()), 9).alias("share_nonzero"), F.round("mean_degree", 9).alias("mean_degree"),
    )


def edge_property_stats(graph: Graph, name: str) -> DataFrame:
    """(n, least, most, total, mean) of a numeric edge property over the visible edges; null and NaN are left out."""
    require_columns(graph.edges, name)
    v = F.col(name).cast("double")
    some = graph.view.where(F.col(name).isNotNull() & ~F.isnan(v)).select(v.alias("v"))
    return some.agg(F.count("v").alias("n"), F.min("v").alias("least"), F.max("v").alias("most"), F.sum("v").alias("total"), F.coalesce(F.avg("v"), F.lit(0.0)).alias("mean"))


def dump(graph: Graph) -> DataFrame:
    """(id, line): each existing vertex with its sorted out- and in-neighbours as text, for write.text."""
    out = graph.view.groupBy(F.col("src").alias("id")).agg(F.sort_array(F.collect_list("dst")).alias("o"))
    into = graph.view.groupBy(F.col("dst").alias("id")).agg(F.sort_array(F.collect_list("src")).alias("i"))
    text = lambda c: F.coalesce(F.array_join(c, " "), F.lit("--"))
    both = out.join(into, "id", "full")
    return both.select("id", F.concat_ws("\t", F.col("id").cast("string"), text(F.col("o")), text(F.col("i"))).alias("line"))


def cross_validate(a: Graph, b: Graph) -> DataFrame:
    """(missing_in, src, dst, n): edges that one graph's view has more often than the other's, as bags; none if equal.

    Edge properties that both have are compared as well.
    """
    common = ["src", "dst", *sorted(set(a.properties()["edges"]) & set(b.properties()["edges"]))]
    both = a.view.select(*common, F.lit(1).alias("_n")).unionByName(b.view.select(*common, F.lit(-1).alias("_n")))
    left = both.groupBy(*common).agg(F.sum("_n").alias("n")).where("n <> 0")
    side = F.when(F.col("n") > 0, "second").otherwise("first")
    return left.groupBy(side.alias("missing_in"), "src", "dst").agg(F.sum(F.abs("n")).alias("n"))


def cross_validate_nodes(a: Graph, b: Graph) -> DataFrame:
    """(missing_in, id): vertices whose newest properties one graph has and the other doesn't; none if equal.

    Properties that both have are compared; null equals null and NaN equals NaN. A graph without any has no rows.
    """
    if a.nodes is None or b.nodes is None:
        return a.edges.sparkSession.createDataFrame([], "missing_in string, id long")
    common = sorted(set(a.properties()["nodes"]) & set(b.properties()["nodes"]))
    newest = lambda g: (g.nodes if g.level is None else g.nodes.where(F.col("level") <= g.level)).groupBy("id").agg(F.max(F.struct("level", *common)).alias("_n")).select("id", *[F.col(f"_n.{c}").alias(c) for c in common])
    both = newest(a).withColumn("_k", F.lit(1)).unionByName(newest(b).withColumn("_k", F.lit(-1)))
    left = both.groupBy("id", *common).agg(F.sum("_k").alias("_k")).where("_k <> 0")
    return left.select(F.when(F.col("_k") > 0, "second").otherwise("first").alias("missing_in"), "id")


def summary(values: DataFrame, name: str) -> DataFrame:
    """(n, mean, stdev, c95, least, most, total): population deviation and half the 95 % interval of the mean."""
    v = F.col(name)
    c95 = F.lit(1.96) * F.stddev_pop(v) / F.sqrt(F.count(v))
    return values.agg(F.count(v).alias("n"), F.avg(v).alias("mean"), F.stddev_pop(v).alias("stdev"), c95.alias("c95"), F.min(v).alias("least"), F.max(v).alias("most"), F.sum(v).alias("total"))
