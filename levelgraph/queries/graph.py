"""Queries of the graph store, its transforms, views, tools and analyses."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..graph import Graph
from ..operators import transform
from ..plans import betweenness as bc
from ..plans import components, pagerank, traversal, triangles
from ..streaming import windows
from ..tools import inspect
from . import Registry, table
from .projections import CH, CP, EV, XS, deleted_every, g_ch, g_cp, g_ev, g_xs

registry = Registry()
add = registry.add

_N_CP = "(select max(greatest(src, dst)) + 1 from cp)"

# adjacency


@add("out_degree", f"with {CP} select v.id, count(src) as out_degree from range({_N_CP}) v(id) left join cp on src = id group by 1")
def out_degree(spark, d):
    return g_cp(spark, d).out_degree()


@add("in_degree", f"with {CP} select v.id, count(dst) as in_degree from range({_N_CP}) v(id) left join cp on dst = id group by 1")
def in_degree(spark, d):
    return g_cp(spark, d).in_degree()


@add("out_degree_at_level", f"with {XS} select v.id, count(src) as out_degree from range((select max(greatest(src, dst)) + 1 from xs)) v(id) left join (select * from xs where created_level <= 3) on src = id group by 1")
def out_degree_at_level(spark, d):
    return g_xs(spark, d).at(3).out_degree()


@add("node_exists", f"with {XS} select src as id from xs union select dst from xs")
def node_exists(spark, d):
    return g_xs(spark, d).existing()


@add("max_nodes", f"with {CP} select {_N_CP} as max_nodes")
def max_nodes(spark, d):
    return spark.range(1).select(F.lit(g_cp(spark, d).max_nodes).cast("long").alias("max_nodes"))


@add("level_sizes", f"with {XS} select created_level as level, count(*) as num_edges, max(max(greatest(src, dst))) over (order by created_level) + 1 as max_nodes from xs group by 1")
def level_sizes(spark, d):
    return g_xs(spark, d).level_sizes()


@add("edges_within_level", f"with {EV} select src, dst, edge_id from ev where created_level = 3")
def edges_within_level(spark, d):
    return g_ev(spark, d).within_level(3).select("src", "dst", "edge_id")


@add("nodes_modified_in_level", f"with {XS} select distinct src as id from xs where created_level = 5")
def nodes_modified_in_level(spark, d):
    return g_xs(spark, d).modified_nodes(5)


@add("edge_exists_at_level", f"with {XS} select rec_no as edge_id, bool_or(created_level <= 2) as there from xs group by 1")
def edge_exists_at_level(spark, d):
    g = g_xs(spark, d)
    one = Graph(g.edges.groupBy("edge_id").agg(F.min("created_level").alias("created_level"), F.min("src").alias("src"), F.min("dst").alias("dst")))
    return one.edges_exist(g.edges, 2)


@add("find_edge", f"""with {XS}, asked as (select distinct tail as src, head as dst from xs1_match where tail is not null and head is not null
        union select distinct src, dst from xs)
select a.src, a.dst, max_by(rec_no, (created_level, rec_no)) as edge_id, max(created_level) as created_level
from asked a left join xs on xs.src = a.src and xs.dst = a.dst group by 1, 2""")  # fmt: skip
def find_edge(spark, d):
    g = g_xs(spark, d)
    m = table(spark, d, "xs1_match").where("tail is not null and head is not null")
    return g.find(m.select(F.col("tail").alias("src"), F.col("head").alias("dst")).unionByName(g.edges.select("src", "dst")))


@add("out_neighbours", f"with {XS} select src as id, dst as neighbour, created_level from xs where src in (select id from nodes)")
def out_neighbours(spark, d):
    return g_xs(spark, d).out_neighbours(table(spark, d, "nodes"))


@add("in_neighbours", f"with {XS} select dst as id, src as neighbour, created_level from xs where dst in (select id from nodes)")
def in_neighbours(spark, d):
    return g_xs(spark, d).in_neighbours(table(spark, d, "nodes"))


@add("common_neighbours", f"""with {XS}, e as (select distinct src, dst from xs),
p as (select distinct tail as a, head as b from xs1_match where tail is not null and head is not null)
select a, b, x.dst as neighbour from p join e x on x.src = a join e y on y.src = b and y.dst = x.dst""")  # fmt: skip
def common_neighbours(spark, d):
    m = table(spark, d, "xs1_match").where("tail is not null and head is not null")
    return g_xs(spark, d).common_neighbours(m.select(F.col("tail").alias("a"), F.col("head").alias("b")))


@add("adjacency_print", f"""with {EV}, o as (select src as id, list_sort(list(dst)) as o from ev group by 1), i as (select dst as id, list_sort(list(src)) as i from ev group by 1)
select v.id, coalesce(array_to_string(o, ' '), '') as out_list, coalesce(array_to_string(i, ' '), '') as in_list
from range((select max(greatest(src, dst)) + 1 from ev)) v(id) left join o using (id) left join i using (id)""")  # fmt: skip
def adjacency_print(spark, d):
    g = g_ev(spark, d)
    return g.adjacency(0, g.max_nodes - 1).select("id", F.array_join("out", " ").alias("out_list"), F.array_join("in", " ").alias("in_list"))


@add("random_nodes")
def random_nodes(spark, d):
    return g_cp(spark, d).random_nodes(20, seed=7)


@add("random_nodes_check", "select 20 as n_nodes, 0 as n_missing")
def random_nodes_check(spark, d):
    g = g_cp(spark, d)
    drawn = g.random_nodes(20, seed=7).join(g.existing().withColumn("_there", F.lit(1)), "id", "left")
    return drawn.agg(F.count_distinct("id").cast("int").alias("n_nodes"), F.sum(F.when(F.col("_there").isNull(), 1).otherwise(0)).cast("int").alias("n_missing"))


@add("node_property", f"""with {XS}, n as (select distinct on (id) id, age from nodes order by id, level desc, age desc nulls last)
select v.id, coalesce(age, 0) as age from range((select max(greatest(src, dst)) + 1 from xs)) v(id) left join n using (id)""")  # fmt: skip
def node_property(spark, d):
    return g_xs(spark, d).node_property("age")


@add("topk_degree", f"with {CP} select src as node, count(*) as degree, row_number() over (order by count(*) desc, src) as rank from cp group by 1 qualify rank <= 10")
def topk_degree(spark, d):
    return g_cp(spark, d).top_degree(10)


# load-time transforms


@add("undirected_double", f"with {EV} select src, dst, edge_id from ev union all select dst, src, edge_id from ev where src <> dst")
def undirected_double(spark, d):
    return transform.undirected_double(g_ev(spark, d).edges).select("src", "dst", "edge_id")


@add("undirected_ordered", f"with {CP} select least(src, dst) as src, greatest(src, dst) as dst, edge_id from cp")
def undirected_ordered(spark, d):
    return transform.undirected_ordered(g_cp(spark, d).edges).select("src", "dst", "edge_id")


@add("dedup_edges", f"with {XS} select distinct created_level, src, dst from xs")
def dedup_edges(spark, d):
    return transform.deduplicate(g_xs(spark, d).edges.select("created_level", "src", "dst"))


@add("dedup_edges_weighted", f"with {CP} select src, dst, min(weight) as weight from cp group by 1, 2")
def dedup_edges_weighted(spark, d):
    return transform.deduplicate(g_cp(spark, d).edges.select("created_level", "src", "dst", "weight")).select("src", "dst", "weight")


@add("reverse_edges", f"with {CP} select dst as src, src as dst, edge_id from cp")
def reverse_edges(spark, d):
    return g_cp(spark, d).reverse().view.select("src", "dst", "edge_id")


_IDS = "ids as (select id, row_number() over (order by id) - 1 as n from (select src as id from xs union select dst from xs))"


@add("compact_ids", f"with {XS}, {_IDS} select a.n as src, b.n as dst, rec_no as edge_id from xs join ids a on a.id = src join ids b on b.id = dst")
def compact_ids(spark, d):
    e = g_xs(spark, d).edges
    return transform.renumber(e, transform.compact_ids(e)).select("src", "dst", "edge_id")


@add("degree_reorder", f"""with {XS}, deg as (select id, sum(o) as d from (select src as id, 1 as o from xs union all select dst, 0 from xs) group by 1)
select id, row_number() over (order by d, id) - 1 as new_id from deg""")  # fmt: skip
def degree_reorder(spark, d):
    return transform.degree_order_ids(g_xs(spark, d).edges)


@add("partial_load", f"with {EV}, n as (select *, row_number() over (order by edge_id) as k, count(*) over () as c from ev) select src, dst, edge_id from n where k > floor(c / 4) and k <= floor(c * 2 / 4)")
def partial_load(spark, d):
    return transform.part_of(g_ev(spark, d).edges, ["edge_id"], 1, 4).select("src", "dst", "edge_id")


@add("split_parts")
def split_parts(spark, d):
    parts = transform.split_edges(g_cp(spark, d).edges, [0.8, 0.1, 0.1], seed=3, keep_pairs=True)
    return parts[0].select(F.lit(0).alias("part"), "src", "dst").unionByName(parts[1].select(F.lit(1).alias("part"), "src", "dst")).unionByName(parts[2].select(F.lit(2).alias("part"), "src", "dst"))


@add("split_check", f"with {CP} select count(*) as n_edges, 0 as n_torn from cp")
def split_check(spark, d):
    """Edges in all parts together, and pairs of ids that lie in more than one."""
    parts = transform.split_edges(g_cp(spark, d).edges, [0.8, 0.1, 0.1], seed=3, keep_pairs=True)
    a, b, c = (p.select("src", "dst", F.lit(k).alias("part")) for k, p in enumerate(parts))
    pairs = a.unionByName(b).unionByName(c).groupBy(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b"))
    seen = pairs.agg(F.count(F.lit(1)).alias("n"), (F.min("part") != F.max("part")).cast("int").alias("torn"))
    return seen.agg(F.sum("n").alias("n_edges"), F.sum("torn").cast("int").alias("n_torn"))


@add("shuffled_edges", f"with {EV} select src, dst, edge_id from ev")
def shuffled_edges(spark, d):
    return transform.shuffle_edges(g_ev(spark, d).edges.select("src", "dst", "edge_id"), seed=5)


# snapshots, windows, deletions

_DEL = "gone as (select *, case when edge_id % 10 = 0 then created_level + 1 end as deleted_level from ev)"


@add("snapshot_view", f"with {XS} select src, dst, rec_no as edge_id from xs where created_level <= 4")
def snapshot_view(spark, d):
    return g_xs(spark, d).at(4).view.select("src", "dst", "edge_id")


@add("window_view", f"with {XS} select src, dst, rec_no as edge_id from xs where created_level between 3 and 5")
def window_view(spark, d):
    return g_xs(spark, d).window(3, 5).view.select("src", "dst", "edge_id")


@add("deleted_edges_view", f"with {EV}, {_DEL} select src, dst, edge_id from gone where created_level <= 5 and (deleted_level is null or deleted_level > 5)")
def deleted_edges_view(spark, d):
    return deleted_every(g_ev(spark, d), 10).at(5).view.select("src", "dst", "edge_id")


@add("deleted_nodes_view", f"with {EV} select src, dst, edge_id from ev where src % 10 <> 0 and dst % 10 <> 0")
def deleted_nodes_view(spark, d):
    from ..operators.mutation import Delta

    g = g_ev(spark, d)
    nodes = g.vertices().where("id % 10 = 0")
    return Delta(g).delete_nodes(nodes).merged().view.select("src", "dst", "edge_id")


@add("flatten_levels", f"with {EV}, {_DEL} select src, dst, 0 as created_level, count(*) as n from gone where created_level <= 7 and (deleted_level is null or deleted_level > 7) group by 1, 2")
def flatten_levels(spark, d):
    from ..store import flatten

    flat = flatten(deleted_every(g_ev(spark, d), 10).at(7))
    return flat.view.groupBy("src", "dst", "created_level").agg(F.count(F.lit(1)).alias("n"))


@add("snapshot_diff", f"""with {EV}, {_DEL}, a as (select src, dst from gone where created_level <= 3 and (deleted_level is null or deleted_level > 3)),
b as (select src, dst from gone where created_level <= 6 and (deleted_level is null or deleted_level > 6)),
x as (select src, dst, sum(k) as n from (select src, dst, 1 as k from a union all select src, dst, -1 from b) group by 1, 2)
select case when n > 0 then 'second' else 'first' end as missing_in, src, dst, abs(n)::bigint as n from x where n <> 0""")  # fmt: skip
def snapshot_diff(spark, d):
    g = deleted_every(g_ev(spark, d), 10)
    plain = Graph(g.edges.drop("weight"))
    return inspect.cross_validate(plain.at(3), plain.at(6))


@add("add_edge_if_absent", f"""with {EV}, wanted as (select distinct dst as src, src as dst from ev)
select src, dst from wanted where not exists (select 1 from ev e where e.src = wanted.src and e.dst = wanted.dst)""")  # fmt: skip
def add_edge_if_absent(spark, d):
    from ..operators.mutation import Delta

    g = g_ev(spark, d)
    return Delta(g).add_edges_if_absent(g.edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).new_edges.select("src", "dst")


@add("operation_log", f"""with {EV}, gone as (select * from ev where not (src % 11 = 3 and dst % 5 = 1) and src % 50 <> 7 and dst % 50 <> 7)
select src, dst, count(*) as n from (select src, dst from gone union all select distinct dst, src from ev where src % 13 = 2) group by 1, 2""")  # fmt: skip
def operation_log(spark, d):
    from ..operators.mutation import Delta

    g = g_ev(spark, d)
    plain = Graph(g.edges.drop("weight"))
    edges = plain.view.select("src", "dst")
    log = edges.where("src % 11 = 3 and dst % 5 = 1").select(F.lit("delete_edge").alias("op"), "src", "dst")
    log = log.unionByName(g.vertices().where("id % 50 = 7").select(F.lit("delete_node").alias("op"), F.col("id").alias("src"), F.lit(None).cast("long").alias("dst")))
    log = log.unionByName(edges.where("src % 13 = 2").distinct().select(F.lit("add_edge").alias("op"), F.col("dst").alias("src"), F.col("src").alias("dst")))
    after = Delta(plain).apply(log).checkpoint()
    return after.view.groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n"))


@add("xs1_sidecars", f"with {CP} select {_N_CP} as vertices, count(*) as edges from cp")
def xs1_sidecars(spark, d):
    from ..sources.xs1 import read_ini, write_xs1
    from ..workspace import Workspace

    path = Workspace(spark, "files").path("edges.xs1")
    write_xs1(g_cp(spark, d).edges, path)
    ini = read_ini(path)
    return spark.range(1).select(*[F.lit(int(ini[k])).cast("long").alias(k) for k in ("vertices", "edges")])


# tools

_LOG = "greatest(d, 1)"


@add("degree_distribution", f"""with {CP}, deg as (select v.id, count(src) as d from range({_N_CP}) v(id) left join cp on src = id group by 1),
b as (select cast(floor(log2({_LOG}) + 1e-12) as int) as b, count(*) as n_nodes, sum(d)::bigint as degree_sum from deg group by 1)
select case when b = 0 then 0 else cast(pow(2, b) as bigint) end as low, cast(pow(2, b + 1) - 1 as bigint) as high, n_nodes,
    round(n_nodes / sum(n_nodes) over (), 9) as node_share, round(sum(n_nodes) over (order by b) / sum(n_nodes) over (), 9) as nodes_upto,
    degree_sum, round(degree_sum / sum(degree_sum) over (), 9) as degree_share,
    round(sum(degree_sum) over (order by b) / sum(degree_sum) over (), 9) as degrees_upto from b""")  # fmt: skip
def degree_distribution(spark, d):
    return inspect.degree_distribution(g_cp(spark, d))


@add("level_spread", f"""with {XS}, e as (select src, count(distinct created_level) as x, count(*) as d from xs group by 1),
p as (select coalesce(x, 0) as n_levels, coalesce(d, 0) as d from range((select max(greatest(src, dst)) + 1 from xs)) v(id) left join e on src = id),
r as (select n_levels, count(*) as n_nodes, avg(d) as mean_degree from p group by 1)
select n_levels, n_nodes, round(n_nodes / sum(n_nodes) over (), 9) as share,
    round(case when n_levels > 0 then n_nodes end / sum(case when n_levels > 0 then n_nodes end) over (), 9) as share_nonzero,
    round(mean_degree, 9) as mean_degree from r""")  # fmt: skip
def level_spread(spark, d):
    return inspect.level_spread(g_xs(spark, d))


@add("edge_property_stats", f"with {CP} select count(weight) as n, min(weight) as least, max(weight) as most, sum(weight) as total, round(avg(weight), 9) as mean from cp")
def edge_property_stats(spark, d):
    return inspect.edge_property_stats(g_cp(spark, d), "weight").withColumn("mean", F.round("mean", 9))


@add("dump_adjacency", f"""with {EV}, o as (select src as id, list_sort(list(dst)) as o from ev group by 1), i as (select dst as id, list_sort(list(src)) as i from ev group by 1)
select id, id || chr(9) || coalesce(array_to_string(o, ' '), '--') || chr(9) || coalesce(array_to_string(i, ' '), '--') as line from o full join i using (id)""")  # fmt: skip
def dump_adjacency(spark, d):
    return inspect.dump(g_ev(spark, d))


@add("cross_validate_equal", f"with {CP} select 'first' as missing_in, src, dst, weight::bigint as n from cp where false")
def cross_validate_equal(spark, d):
    g = g_cp(spark, d)
    there = Graph(transform.shuffle_edges(g.edges, seed=1))
    return inspect.cross_validate(g, there)


@add("load_summary", f"""with {XS}, s as (select created_level, count(*)::double as n_edges from xs group by 1)
select count(*) as n, round(avg(n_edges), 6) as mean, round(stddev_pop(n_edges), 6) as stdev, round(1.96 * stddev_pop(n_edges) / sqrt(count(*)), 6) as c95,
    min(n_edges) as least, max(n_edges) as most, sum(n_edges) as total from s""")  # fmt: skip
def load_summary(spark, d):
    s = g_xs(spark, d).level_sizes().select(F.col("num_edges").cast("double").alias("n_edges"))
    out = inspect.summary(s, "n_edges")
    return out.withColumns({c: F.round(c, 6) for c in ("mean", "stdev", "c95")})


@add("sidecar_check", """with got as (select file_no, count(distinct rec_no) as delivered from xs1 group by 1)
select file_no, edges as declared, coalesce(delivered, 0) as delivered from xs1_ini left join got using (file_no) where edges is distinct from coalesce(delivered, 0)""")  # fmt: skip
def sidecar_check(spark, d):
    got = table(spark, d, "xs1").groupBy("file_no").agg(F.count_distinct("rec_no").alias("delivered"))
    both = table(spark, d, "xs1_ini").join(got, "file_no", "left").select("file_no", F.col("edges").alias("declared"), F.coalesce("delivered", F.lit(0)).alias("delivered"))
    return both.where(~F.col("declared").eqNullSafe(F.col("delivered")))


# ranks and traversals


def _rank_sql(edges: str, name: str, steps: int, digits: int, cast: str = "double") -> str:
    return f"""with recursive {edges}, n as (select max(greatest(src, dst)) + 1 as n from {name}),
deg as (select src, count(*) as d from {name} group by 1),
links as (select e.src, e.dst, count(*) / any_value(d) as part from {name} e join deg using (src) group by 1, 2),
r(it, id, rank) as (select 0, id, 1.0::double / (select n from n) from range((select n from n)) v(id)
    union all select any_value(it) + 1, v.id, 0.15::double / (select n from n) + 0.85::double * coalesce(sum(x), 0)
    from (select it, id from r where it < {steps}) v left join (select dst, part * rank as x from links join r on r.id = links.src) f on f.dst = v.id group by v.id)
select id, round(cast(rank as {cast})::double, {digits}) as rank from r where it = {steps}"""


@add("pagerank", _rank_sql(CP, "cp", 10, 7))
def pagerank_float(spark, d):
    return pagerank.pagerank(g_cp(spark, d), single=True).withColumn("rank", F.round(F.col("rank").cast("double"), 7))


@add("pagerank_push", _rank_sql(XS, "xs", 10, 6))
def pagerank_push(spark, d):
    return pagerank.pagerank(g_xs(spark, d), single=True).withColumn("rank", F.round(F.col("rank").cast("double"), 6))


@add("pagerank_double", _rank_sql(CP, "cp", 10, 12))
def pagerank_double(spark, d):
    return pagerank.pagerank(g_cp(spark, d)).withColumn("rank", F.round("rank", 12))


@add("pagerank_double_push", _rank_sql(EV, "ev", 10, 12))
def pagerank_double_push(spark, d):
    return pagerank.pagerank(g_ev(spark, d)).withColumn("rank", F.round("rank", 12))


@add("pagerank_top10", f"select id, round(rank, 9) as rank from ({_rank_sql(CH, 'ch', 10, 12)}) order by rank desc, id limit 10")
def pagerank_top10(spark, d):
    ranks = pagerank.pagerank(g_ch(spark, d), iterations=10, tolerance=1e-12).withColumn("rank", F.round("rank", 12))
    return pagerank.top_ranks(ranks).withColumn("rank", F.round("rank", 9))


def _levels_sql(edges: str, name: str, root: str, deepest: int) -> str:
    return f"""with recursive {edges}, e as (select distinct src, dst from {name}),
b(id, level) as (select {root}, 0 union select e.dst, level + 1 from b join e on e.src = b.id where level < {deepest})
select id, min(level) as level from b group by 1"""


_DIST = f"""with recursive {CP}, e as (select src, dst, min(weight)::double as w from cp group by 1, 2),
r(it, id, dist) as (select 0, 0::bigint, 0.0::double
    union all select it, id, min(dist) from (select it + 1 as it, id, dist from r where it < 30
        union all select r.it + 1, e.dst, dist + w from r join e on e.src = r.id where r.it < 30) group by 1, 2)
select id, dist from r where it = 30"""


@add("sssp_weighted", _DIST)
def sssp_weighted(spark, d):
    return traversal.shortest_paths(g_cp(spark, d), 0, weight="weight")


@add("sssp_weighted_max", f"select cast(floor(max(dist)) as int) as max_dist from ({_DIST})")
def sssp_weighted_max(spark, d):
    return traversal.farthest(traversal.shortest_paths(g_cp(spark, d), 0, weight="weight"))


def _root_xs(spark, d):
    g = g_xs(spark, d)
    return g, g.view.agg(F.min("src")).first()[0]


_LEV_XS = _levels_sql(XS, "xs", "(select min(src) from xs)", 40)


@add("bfs_levels", _LEV_XS)
def bfs_levels(spark, d):
    return traversal.bfs(*_root_xs(spark, d))


@add("bfs_count", f"select count(*) as n_reached from ({_LEV_XS})")
def bfs_count(spark, d):
    return traversal.bfs_count(*_root_xs(spark, d))


@add("bfs_reverse", _levels_sql(f"{XS}, rev as (select dst as src, src as dst from xs)", "rev", "(select min(dst) from xs)", 40))
def bfs_reverse(spark, d):
    g = g_xs(spark, d)
    return traversal.bfs(g, g.view.agg(F.min("dst")).first()[0], reverse=True)  # the least source may have no in-edges


@add("bfs_down_edges", f"with lev as ({_LEV_XS}), {XS} select src, dst, a.level from xs join lev a on a.id = src join lev b on b.id = dst where b.level = a.level + 1")
def bfs_down_edges(spark, d):
    g, root = _root_xs(spark, d)
    return traversal.down_edges(g, traversal.bfs(g, root))


@add("sssp_unweighted", f"select id, level::double as dist from ({_LEV_XS})")
def sssp_unweighted(spark, d):
    return traversal.bfs(*_root_xs(spark, d)).select("id", F.col("level").cast("double").alias("dist"))


@add("sssp_unweighted_iter", f"select id, level::double as dist from ({_LEV_XS})")
def sssp_unweighted_iter(spark, d):
    return traversal.shortest_paths(*_root_xs(spark, d))


@add("dfs_order")
def dfs_order(spark, d):
    return traversal.dfs(*_root_xs(spark, d))


@add("dfs_check", f"select count(*) as n_reached, 0 as n_wrong from ({_LEV_XS})")
def dfs_check(spark, d):
    """Vertices reached, and those whose parent isn't an edge away, or whose numbers don't lie inside the parent's."""
    g, root = _root_xs(spark, d)
    t = traversal.dfs(g, root).persist()
    up = t.select(F.col("id").alias("parent"), F.col("pre").alias("_pre"), F.col("post").alias("_post"))
    e = g.view.select(F.col("src").alias("parent"), F.col("dst").alias("id")).distinct().withColumn("_edge", F.lit(True))
    both = t.join(up, "parent", "left").join(e, ["parent", "id"], "left")
    right = (F.col("id") == root) | (F.col("_edge") & (F.col("_pre") < F.col("pre")) & (F.col("_post") > F.col("post")))
    return both.agg(F.count(F.lit(1)).alias("n_reached"), F.sum(F.when(right, 0).otherwise(1)).cast("int").alias("n_wrong"))


def _bc_sql(edges: str, name: str, sources: str, deepest: int) -> str:
    return f"""with recursive {edges}, e as (select src, dst, count(*)::double as m from {name} group by 1, 2),
start as ({sources}),
b(s, v, l) as (select distinct id, id, 0 from start union select s, e.dst, l + 1 from b join e on e.src = v where l < {deepest}),
lev as (select s, v, min(l) as l from b group by 1, 2),
down as (select a.s, a.v, z.v as w, a.l, m from lev a join e on e.src = a.v join lev z on z.s = a.s and z.v = e.dst and z.l = a.l + 1),
sig(s, v, l, sigma) as (select distinct id, id, 0, 1.0::double from start
    union all select d.s, d.w, any_value(d.l) + 1, sum(sigma * m) from sig join down d on d.s = sig.s and d.v = sig.v and d.l = sig.l group by d.s, d.w),
del(l, s, v, delta) as (select max(l) + 1, -1::bigint, -1::bigint, 0.0::double from sig
    union all select x.l, x.s, x.v, sum(coalesce(part, 0)) from (
        select g.l, g.s, g.v, g.sigma * d.m / h.sigma * (1 + del.delta) as part from (select distinct l - 1 as l from del where l > 0) k
        join sig g on g.l = k.l left join down d on d.s = g.s and d.v = g.v left join sig h on h.s = d.s and h.v = d.w
        left join del on del.s = d.s and del.v = d.w) x group by 1, 2, 3)
select v.id, round(coalesce(sum(delta * k), 0), 6) as bc from range((select max(greatest(src, dst)) + 1 from {name})) v(id)
left join (select del.v, delta, k from del join (select id, count(*) as k from start group by 1) q on q.id = del.s where del.v <> del.s) z on z.v = v.id group by 1"""


@add("bc_adj", _bc_sql(CH, "ch", "select id from range((select max(greatest(src, dst)) + 1 from ch)) v(id)", 200))
def bc_adj(spark, d):
    """Every vertex of the chains of orders is a source; a chain is short, so that very many sources make one batch."""
    return bc.betweenness(g_ch(spark, d), batch=1 << 20).withColumn("bc", F.round("bc", 6))


@add("bc_adj_events")
def bc_adj_events(spark, d):
    return bc.betweenness(g_ev(spark, d)).withColumn("bc", F.round("bc", 6))


@add("bc_random")
def bc_random(spark, d):
    g = g_ev(spark, d)
    return bc.betweenness(g, bc.drawn_sources(g, 100, seed=1))


@add("tarjan_scc")
def tarjan_scc(spark, d):
    return components.strong_components(g_xs(spark, d))


_HUB = "(select src from xs group by 1 order by count(*) desc, src limit 1)"


@add("scc_of_hub", f"select a.id from ({_levels_sql(XS, 'xs', _HUB, 1000)}) a join ({_levels_sql(f'{XS}, rev as (select dst as src, src as dst from xs)', 'rev', _HUB, 1000)}) b using (id)")
def scc_of_hub(spark, d):
    """The component of the vertex with the most out-edges: what it reaches and is reached from."""
    g = g_xs(spark, d)
    found = components.strong_components(g).persist()
    own = found.join(g.top_degree(1), F.col("id") == F.col("node")).first().component
    return found.where(F.col("component") == own).select("id")


@add("scc_many")
def scc_many(spark, d):
    return components.strong_components(g_cp(spark, d))


_TRI = f"""with {CP}, e as (select distinct least(src, dst) as a, greatest(src, dst) as b from cp where src <> dst)
select count(*) as n_triangles from e x join e y on y.a = x.a and y.b > x.b join e z on z.a = x.b and z.b = y.b"""


@add("triangle_count_i", _TRI)
def triangle_count_i(spark, d):
    return triangles.triangles(g_cp(spark, d))


@add("triangle_count_od", _TRI)
def triangle_count_od(spark, d):
    return triangles.triangles(Graph(transform.deduplicate(transform.undirected_ordered(g_cp(spark, d).edges.select("src", "dst", "created_level")))))


@add("triangle_count_u", f"""with {XS}, u as (select src, dst from xs union all select dst, src from xs where src <> dst),
m as (select src, dst, count(*) as m from u where src < dst group by 1, 2)
select coalesce(sum(x.m * y.m * z.m), 0)::bigint as n_triangles from m x join m y on y.src = x.src and y.dst > x.dst join m z on z.src = x.dst and z.dst = y.dst""")  # fmt: skip
def triangle_count_u(spark, d):
    return triangles.triangles_doubled(Graph(transform.undirected_double(g_xs(spark, d).edges)))


_AGE = "ages as (select id, coalesce(age, 0) as age from range((select max(greatest(src, dst)) + 1 from xs)) v(id) left join (select distinct on (id) id, age from nodes order by id, level desc, age desc nulls last) n using (id))"


@add("teen_followers", f"with {XS}, {_AGE} select v.id, count(t.id) as n_teens from ages v left join xs on dst = v.id left join (select id from ages where age >= 10 and age < 20) t on t.id = src group by 1")
def teen_followers(spark, d):
    return triangles.teen_followers(g_xs(spark, d))


@add("avg_teen_cnt", f"""with {XS}, {_AGE}, t as (select v.id, v.age, count(t.id) as n from ages v left join xs on dst = v.id left join (select id from ages where age >= 10 and age < 20) t on t.id = src group by 1, 2)
select round(coalesce(avg(n), 0), 9) as avg_teens from t where age > 0""")  # fmt: skip
def avg_teen_cnt(spark, d):
    return triangles.avg_teen_followers(g_xs(spark, d)).withColumn("avg_teens", F.round("avg_teens", 9))


# streaming

_WIN = "select src, dst, count(*) as weight, max(created_level) as latest_level from ev where created_level between {} and {} group by 1, 2"


@add("stream_window_weight", f"with {EV} {_WIN.format(5, 7)}")
def stream_window_weight(spark, d):
    return windows.window_weights(g_ev(spark, d).window(5, 7))


@add("stream_window_all_batches", f"""with {EV}, b as (select distinct created_level as batch from ev)
select batch, src, dst, count(*) as weight, max(created_level) as latest_level from b join ev on created_level between batch - 2 and batch group by 1, 2, 3""")  # fmt: skip
def stream_window_all_batches(spark, d):
    return windows.all_window_weights(g_ev(spark, d).edges, window=3)


@add("stream_window_degree", f"""with {EV}, w as (select * from ev where created_level between 7 and 9)
select v.id, count(src) as out_degree from range((select max(greatest(src, dst)) + 1 from ev)) v(id) left join w on src = id group by 1""")  # fmt: skip
def stream_window_degree(spark, d):
    return g_ev(spark, d).window(7, 9).out_degree()


# generators and sources


@add("er_graph")
def er_graph(spark, d):
    from ..sources.generators import erdos_renyi

    return erdos_renyi(spark, 1000, 20_000, seed=1)


@add("er_graph_check", "select 20000 as n_edges, 0 as n_outside")
def er_graph_check(spark, d):
    from ..sources.generators import erdos_renyi

    outside = F.when(F.col("src").between(0, 999) & F.col("dst").between(0, 999), 0).otherwise(1)
    return erdos_renyi(spark, 1000, 20_000, seed=1).agg(F.count(F.lit(1)).cast("int").alias("n_edges"), F.sum(outside).cast("int").alias("n_outside"))


@add("rmat_graph")
def rmat_graph(spark, d):
    from ..sources.generators import rmat

    return rmat(spark, 12, 8, seed=1)


@add("rmat_graph_check", "select 32768 as n_edges, 0 as n_outside, true as skewed")
def rmat_graph_check(spark, d):
    from ..sources.generators import rmat

    e = rmat(spark, 12, 8, seed=1)
    outside = F.when(F.col("src").between(0, 4095) & F.col("dst").between(0, 4095), 0).otherwise(1)
    low = F.sum(((F.col("src") < 2048) & (F.col("dst") < 2048)).cast("int")) / F.count(F.lit(1))
    return e.agg(F.count(F.lit(1)).cast("int").alias("n_edges"), F.sum(outside).cast("int").alias("n_outside"), low.between(0.54, 0.60).alias("skewed"))


def _round_trip(spark, d, ending, write):
    from ..sources.registry import load
    from ..workspace import Workspace

    path = Workspace(spark, "files").path(f"edges.{ending}")
    e = g_cp(spark, d).edges
    write(e, path)
    return load(spark, path).edges


@add("load_snap", f"with {CP} select src, dst, count(*) as n from cp group by 1, 2")
def load_snap(spark, d):
    from ..sources.snap import write_snap

    return _round_trip(spark, d, "net", write_snap).groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n"))


@add("load_xs1", f"with {CP} select src, dst, weight::double as weight, count(*) as n from cp group by 1, 2, 3")
def load_xs1(spark, d):
    from ..sources.xs1 import write_xs1

    got = _round_trip(spark, d, "xs1", write_xs1)
    return got.groupBy("src", "dst", F.col("weight").cast("double").alias("weight")).agg(F.count(F.lit(1)).alias("n"))


@add("load_store", f"with {XS} select src, dst, created_level, count(*) as n from xs where created_level <= 6 group by 1, 2, 3")
def load_store(spark, d):
    from ..store import Store
    from ..workspace import Workspace

    store = Store(spark, Workspace(spark, "store").path("db"))
    store.save(g_xs(spark, d))
    return store.open(max_level=6).view.groupBy("src", "dst", "created_level").agg(F.count(F.lit(1)).alias("n"))
