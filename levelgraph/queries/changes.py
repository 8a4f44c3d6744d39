"""Queries of changes to graphs: deltas, logs of operations, checkpoints, properties and stored levels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..graph import Graph
from ..operators.mutation import Delta, delete_by_visible_level, set_edge_property, set_node_property
from ..store import Store
from ..workspace import Workspace
from . import Registry, table
from .projections import CP, EV, XS, g_cp, g_ev, g_xs

registry = Registry()
add = registry.add


def _ev(spark, d) -> DataFrame:
    return g_ev(spark, d).edges.select("src", "dst", "edge_id", "created_level")


def _counted(graph: Graph) -> DataFrame:
    return graph.view.groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n"))


def _weighed(graph: Graph) -> DataFrame:
    """Edges by pair and weight, those without one weighing 1."""
    w = F.coalesce("stream_weight", F.lit(1)).cast("long")
    return graph.view.groupBy("src", "dst", w.alias("weight")).agg(F.count(F.lit(1)).alias("n"))


@add("delta_weighted_twice", f"""with {EV}, one as (select src, dst, count(*) as n from ev where created_level between 5 and 8 group by 1, 2),
two as (select src, dst, count(*) as n from ev where created_level >= 7 group by 1, 2),
old as (select src, dst, count(*) as n from ev where created_level <= 6 group by 1, 2),
touched as (select src, dst, sum(n)::bigint as weight, 1::bigint as n from (select * from one union all select * from two union all select old.* from old
    where exists (select 1 from one where one.src = old.src and one.dst = old.dst) or exists (select 1 from two where two.src = old.src and two.dst = old.dst)) group by 1, 2)
select * from touched union all select src, dst, 1, n from old where not exists (select 1 from touched t where t.src = old.src and t.dst = old.dst)""")  # fmt: skip
def delta_weighted_twice(spark, d):
    e = _ev(spark, d)
    first, second = e.where("created_level between 5 and 8"), e.where("created_level >= 7")
    delta = Delta(Graph(e.where("created_level <= 6"))).add_weighted(first.select("src", "dst")).add_weighted(second.select("src", "dst"))
    return _weighed(delta.merged())


@add("delta_delete_pending", f"""with {EV} select src, dst, count(*) as n from (select src, dst from ev where not src > dst
    union all select dst, src from ev where not dst > src) group by 1, 2""")  # fmt: skip
def delta_delete_pending(spark, d):
    """Every edge is added turned round; then those that lead down go, whether stored or pending."""
    e = _ev(spark, d)
    delta = Delta(Graph(e)).add_edges(e.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    down = delta.merged().view.where((F.col("src") > F.col("dst")) & (F.col("created_level") < delta.level))
    delta = delta.delete_edges(down)
    pending = delta.merged().view.where((F.col("src") > F.col("dst")) & (F.col("created_level") == delta.level))
    return _counted(delta.delete_edges(pending).checkpoint())


@add("log_in_order", f"""with {EV}, p as (select src, dst, count(*) as c, bool_or(created_level <= 5) as gone, sum((created_level >= 8)::int) as w from ev group by 1, 2),
r as (select distinct dst as src, src as dst, 1 as k from ev where created_level <= 2),
s as (select src, dst, c is not null as known, case when gone then 0 else coalesce(c, 0) + coalesce(k, 0) end as e, coalesce(w, 0) as w from p full join r using (src, dst)),
t as (select src, dst, case when known and e = 0 then 1 else e end as e, w from s)
select src, dst, (case when w > 0 then e + w else 1 end)::bigint as weight, (case when w > 0 then 1 else e end)::bigint as n from t""")  # fmt: skip
def log_in_order(spark, d):
    """Turned edges, deletions, additions where there is none, and weights, in this order whatever the rows' order is."""
    e = _ev(spark, d)
    op = lambda name, seq, rows, a="src", b="dst": rows.select(F.lit(name).alias("op"), F.col(a).alias("src"), F.col(b).alias("dst"), F.lit(seq).alias("seq"))
    log = op("add_weighted", 4, e.where("created_level >= 8"))
    log = log.unionByName(op("add_edge_if_absent", 3, e))
    log = log.unionByName(op("delete_edge", 2, e.where("created_level <= 5")))
    log = log.unionByName(op("add_edge", 1, e.where("created_level <= 2").select("src", "dst").distinct(), "dst", "src"))
    return _weighed(Delta(Graph(e)).apply(log).merged())


@add("add_isolated_node", f"with {EV}, m as (select max(greatest(src, dst)) as m from ev) select v.id, count(src) as out_degree, bool_or(src is not null or dst is not null or v.id = m + 7) as there from range((select m + 8 from m)) v(id) cross join m left join (select src, dst, src as id from ev union all select null, dst, dst from ev) e on e.id = v.id group by 1")
def add_isolated_node(spark, d):
    g = Graph(_ev(spark, d))
    more = spark.createDataFrame([(g.max_nodes + 6,)], "id long")
    after = Delta(g).add_nodes(more).checkpoint()
    return after.out_degree().join(after.existing().withColumn("there", F.lit(True)), "id", "left").fillna(False, ["there"])


@add("checkpoint_store", f"""with {EV}, top as (select max(created_level) as top from ev)
select src, dst, count(*) as n from ev, top where edge_id % 10 <> 0 and (edge_id % 7 <> 0 or created_level = top) group by 1, 2""")  # fmt: skip
def checkpoint_store(spark, d):
    """All levels but the last are stored; it comes by a checkpoint, and deletions by two more."""
    e = _ev(spark, d)
    g = Graph(e)
    last = g.num_levels - 1
    store = Store(spark, Workspace(spark, "store").path("db"))
    store.save(Graph(e.where(F.col("created_level") < last)))
    new = e.where(F.col("created_level") == last)
    Delta(store.open()).delete_edges(e.where("edge_id % 10 = 0")).add_edges(new.where("edge_id % 10 <> 0").select("src", "dst")).checkpoint(store)
    Delta(store.open()).delete_edges(e.where("edge_id % 7 = 0")).checkpoint(store)
    return _counted(store.open())


@add("store_delete_level", f"with {XS} select src, dst, created_level, count(*) as n from xs where created_level <> 3 group by 1, 2, 3")
def store_delete_level(spark, d):
    store = Store(spark, Workspace(spark, "store").path("db"))
    store.save(g_xs(spark, d))
    store.delete_level(3)
    return store.open().view.groupBy("src", "dst", "created_level").agg(F.count(F.lit(1)).alias("n"))


@add("store_keep_recent", f"""with {XS}, n as (select distinct on (id) id, age from nodes order by id, level desc, age desc nulls last)
select v.id, coalesce(age, 0) as age from range((select max(greatest(src, dst)) + 1 from xs)) v(id) left join n using (id)""")  # fmt: skip
def store_keep_recent(spark, d):
    """Old node versions go from the store, and the newest values stay."""
    store = Store(spark, Workspace(spark, "store").path("db"))
    store.save(g_xs(spark, d))
    store.keep_recent(1)
    return store.open().node_property("age")


@add("edge_property_add", f"with {EV} select src, dst, sum(edge_id + case when created_level >= 4 then 5 else 0 end)::bigint as total from ev group by 1, 2")
def edge_property_add(spark, d):
    g = Graph(_ev(spark, d).withColumn("mark", F.col("edge_id")))
    g = set_edge_property(g, g.view.where("created_level >= 4").select("edge_id", F.lit(5).cast("long").alias("mark")), "mark", add=True)
    return g.view.groupBy("src", "dst").agg(F.sum("mark").alias("total"))


@add("node_property_add", f"""with {XS}, n as (select distinct on (id) id, age from nodes where level <= 7 order by id, level desc, age desc nulls last),
x as (select src as id, count(*)::int as k from xs group by 1)
select v.id, (coalesce(n.age, 0) + coalesce(k, 0))::int as age from range((select max(greatest(src, dst)) + 1 from xs)) v(id) left join n using (id) left join x using (id)""")  # fmt: skip
def node_property_add(spark, d):
    """Each node's out-degree is added to its age."""
    g = g_xs(spark, d)
    more = g.view.groupBy(F.col("src").alias("id")).agg(F.count(F.lit(1)).cast("int").alias("age"))
    return set_node_property(g, more, "age", level=7, add=True).node_property("age")


@add("delete_by_level", f"with {EV} select src, dst, edge_id from ev where created_level <= 6 and not (edge_id % 9 = 0 and created_level <= 3)")
def delete_by_level(spark, d):
    """Old edges stop being visible at level 5, later ones after the level that is looked at."""
    g = Graph(_ev(spark, d))
    g = delete_by_visible_level(g, g.edges.where("edge_id % 9 = 0 and created_level <= 3"), 5)
    g = delete_by_visible_level(g, g.edges.where("edge_id % 9 = 0"), 7)
    return g.at(6).view.select("src", "dst", "edge_id")


_PARTS = 6  # of the stream


@add("stream_levels", f"""with {EV}, t as (select max(created_level) as top from ev),
x as (select src, dst, floor(created_level * {_PARTS} / (top + 1))::int as part from ev, t)
select src, dst, count(*) as weight, (max(part) - {_PARTS - 3})::int as latest from x where part >= {_PARTS - 3} group by 1, 2""")  # fmt: skip
def stream_levels(spark, d):
    """Edges arrive as files, a micro-batch each, become levels of a store, and leave it after three; its window's weights."""
    from ..streaming.windows import stream_into, window_weights

    ws = Workspace(spark, "stream")
    e = _ev(spark, d)
    top = e.agg(F.max("created_level")).first()[0]
    for k in range(_PARTS):
        part = e.where(F.floor(F.col("created_level") * _PARTS / (top + 1)) == k).select("src", "dst")
        part.coalesce(1).write.mode("append").parquet(ws.path("arriving"))  # files are read in the order in which they came
    source = spark.readStream.schema("src long, dst long").option("maxFilesPerTrigger", 1).parquet(ws.path("arriving"))
    store = Store(spark, ws.path("db"))
    query = stream_into(source, store, window=3, checkpoint=ws.path("progress"))
    query.processAllAvailable()
    query.stop()
    last = store.levels()[-1]
    weights = window_weights(store.open().window(last - 2, last))
    return weights.select("src", "dst", "weight", (F.col("latest_level") - (last - 2)).cast("int").alias("latest"))


@add("task_scalars", f"""with recursive {CP}, e as (select src, dst, min(weight)::double as w from cp group by 1, 2),
r(it, id, dist) as (select 0, 0::bigint, 0.0::double
    union all select it, id, min(dist) from (select it + 1 as it, id, dist from r where it < 30
        union all select r.it + 1, e.dst, dist + w from r join e on e.src = r.id where r.it < 30) group by 1, 2)
select 'sssp_weighted' as task, floor(max(dist))::double as scalar from r where it = 30
union all select 'bfs_count', count(*) from r where it = 30
union all select 'edge_prop_stats', round(avg(weight), 9) from cp""")  # fmt: skip
def task_scalars(spark, d):
    """Registered tasks, run by name."""
    from .. import tasks

    g = g_cp(spark, d)
    made = [(n, float(tasks.run(n, g, root=0).scalar)) for n in ("sssp_weighted", "bfs_count", "edge_prop_stats")]
    return spark.createDataFrame(made, "task string, scalar double").withColumn("scalar", F.round("scalar", 9))


@add("load_append", f"""with {CP} select src, dst, 0 as created_level, count(*) as n from cp group by 1, 2
union all select dst, src, 1, 1 from (select distinct src, dst from cp)""")  # fmt: skip
def load_append(spark, d):
    """A file becomes a stored graph, and another one, turned round and without duplicates, its next level."""
    from ..sources.registry import append
    from ..sources.snap import write_snap

    ws = Workspace(spark, "files")
    e = g_cp(spark, d).edges
    write_snap(e, ws.path("first.net"))
    write_snap(e.select(F.col("dst").alias("src"), F.col("src").alias("dst")), ws.path("second.net"))
    store = Store(spark, ws.path("db"))
    append(store, ws.path("first.net"))
    g = append(store, ws.path("second.net"), deduplicate=True)
    return g.view.groupBy("src", "dst", "created_level").agg(F.count(F.lit(1)).alias("n"))


@add("load_first_edges", f"with {EV} select src, dst from ev where edge_id <= 500")
def load_first_edges(spark, d):
    """The first records of a file in its own order."""
    from ..sources.registry import load
    from ..sources.xs1 import write_xs1

    path = Workspace(spark, "files").path("edges.xs1")
    write_xs1(_ev(spark, d).orderBy("edge_id"), path)
    return load(spark, path, max_edges=500).view.select("src", "dst")


@add("load_fgf", """select n_nationkey::bigint as src, (25 + n_regionkey)::bigint as dst, n_name as name, 'in' as edge_kind from nation""")
def load_fgf(spark, d):
    """Nations and their regions as a binary property graph, written and loaded."""
    import pandas as pd

    from ..sources.fgf import write_fgf
    from ..sources.registry import load

    nation, region = table(spark, d, "nation").orderBy("n_nationkey").toPandas(), table(spark, d, "region").orderBy("r_regionkey").toPandas()
    nodes = pd.DataFrame({"node_kind": ["nation"] * len(nation) + ["region"] * len(region), "name": [*nation["n_name"], *region["r_name"]]})
    edges = pd.DataFrame({"src": nation["n_nationkey"].astype(int), "dst": len(nation) + nation["n_regionkey"].astype(int), "edge_kind": "in"})
    ws = Workspace(spark, "files")
    spark.range(1).write.parquet(ws.path("made"))  # makes the folder
    write_fgf(edges, nodes, {"name": "string"}, ws.path("made") + "/world.fgf")
    g = load(spark, ws.path("made") + "/world.fgf")
    names = g.nodes.select(F.col("id").alias("src"), "name")
    return g.view.select("src", "dst", "edge_kind").join(names, "src").select("src", "dst", "name", "edge_kind")
