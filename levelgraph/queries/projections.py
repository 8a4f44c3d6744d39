"""Graphs projected from the supplied tables, each with the SQL that gives the same edges."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..graph import Graph
from ..plans.ordering import with_row_number
from . import table

#: Customers and the parts they ordered, weighted by quantity.
CP = """cp as (select o_custkey as src, l_partkey as dst, l_quantity as weight, l_orderkey * 8 + l_linenumber as edge_id
    from orders join lineitem on o_orderkey = l_orderkey)"""
#: Users of consecutive events; a level for every 1000 events.
EV = """ev as (select * from (select user_id as src, lead(user_id) over (order by ts, event_id) as dst, value as weight,
    row_number() over (order by ts, event_id) as edge_id,
    cast(floor((row_number() over (order by ts, event_id) - 1) / 1000) as int) as created_level from events) where dst is not null)"""
#: Consecutive orders of a customer.
CH = """ch as (select * from (select o_orderkey as src, lead(o_orderkey) over (partition by o_custkey order by o_orderdate, o_orderkey) as dst
    from orders) where dst is not null)"""
#: Loaded records with both ends, as levelled edges.
XS = """xs as (select tail as src, head as dst, created_level, weight, rec_no from xs1 where tail is not null and head is not null)"""


def g_cp(spark: SparkSession, sf_dir: str) -> Graph:
    orders, lines = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    e = orders.join(lines, F.col("o_orderkey") == F.col("l_orderkey"))
    return Graph(e.select(F.col("o_custkey").alias("src"), F.col("l_partkey").alias("dst"), F.col("l_quantity").alias("weight"), (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("edge_id")))


def ev_edges(spark: SparkSession, sf_dir: str, batch: int = 1000) -> DataFrame:
    """edge_id is the event's place in time. Each event is joined with the next by its place, so no task sorts them all."""
    n = with_row_number(table(spark, sf_dir, "events").select("user_id", "ts", "event_id", "value"), ["ts", "event_id"], "edge_id")
    after = n.select((F.col("edge_id") - 1).alias("edge_id"), F.col("user_id").alias("dst"))
    e = n.join(after, "edge_id")
    return e.select(F.col("user_id").alias("src"), "dst", F.col("value").alias("weight"), "edge_id", F.floor((F.col("edge_id") - 1) / batch).cast("int").alias("created_level"))


def g_ev(spark: SparkSession, sf_dir: str, batch: int = 1000) -> Graph:
    return Graph(ev_edges(spark, sf_dir, batch))


def g_ch(spark: SparkSession, sf_dir: str) -> Graph:
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    e = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("src"), F.lead("o_orderkey").over(w).alias("dst"))
    return Graph(e.where("dst is not null").withColumn("edge_id", F.col("src")))


def g_xs(spark: SparkSession, sf_dir: str) -> Graph:
    e = table(spark, sf_dir, "xs1").where("tail is not null and head is not null")
    nodes = table(spark, sf_dir, "nodes")
    return Graph(e.select(F.col("tail").alias("src"), F.col("head").alias("dst"), "created_level", "weight", F.col("rec_no").alias("edge_id")), nodes)


def deleted_every(graph: Graph, k: int) -> Graph:
    """Edges whose id k divides are deleted in the level after their own."""
    gone = F.when(F.col("edge_id") % k == 0, F.col("created_level") + 1)
    return Graph(graph.edges.withColumn("deleted_level", gone), graph.nodes)
