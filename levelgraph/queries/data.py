"""Queries of the general training-data operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.heavy_keys import node_totals
from ..operators.snapshot_diff import snapshot_changes
from . import Registry, table

registry = Registry()

_SIDES = """
select side, node, other, case when not isnan(weight) then weight::double + 0.0 end as w
from (select 'tail' as side, tail as node, head as other, weight from xs1
      union all select 'head', head, tail, weight from xs1) where node is not null"""


@registry.add(
    "p1_found",
    f"""select side, node from (
    select side, node, count(*) as n, sum(count(*)) over (partition by side) as total from ({_SIDES}) group by side, node)
where n * 1000 >= total * 25""",
)
def p1_found(spark, sf_dir):
    return node_totals(table(spark, sf_dir, "xs1"), share=0.025).where("is_heavy").select("side", "node")


@registry.add(
    "p1_node_totals",
    f"""select side, node, count(*) as n_records, count(w) as n_weights, round(sum(w), 3) as sum_weight, min(w) as min_weight,
    max(w) as max_weight, count(distinct other) as n_others,
    count(*) * 1000 >= sum(count(*)) over (partition by side) * 25 as is_heavy
from ({_SIDES}) group by side, node""",
)
def p1_node_totals(spark, sf_dir):
    return node_totals(table(spark, sf_dir, "xs1"), share=0.025).drop("share").withColumn("sum_weight", F.round("sum_weight", 3))


_CHANGES = """
with newest as (select snapshot_no, max(delivery_no) as delivery_no from xs1_snapshot group by 1),
c as (select snapshot_no, tail, head, weight from xs1_snapshot join newest using (snapshot_no, delivery_no)
    where tail is not null and head is not null
    qualify row_number() over (partition by snapshot_no, tail, head order by rec_no desc) = 1),
steps as (select snapshot_no, lag(snapshot_no) over (order by snapshot_no) as before from newest),
late as (select c.*, before from c join steps using (snapshot_no) where before is not null),
early as (select c.*, s.snapshot_no as later from c join steps s on c.snapshot_no = s.before),
merged as (select coalesce(late.snapshot_no, early.later) as snapshot_no, coalesce(late.tail, early.tail) as tail,
    coalesce(late.head, early.head) as head,
    case when early.tail is null then 'added' when late.tail is null then 'removed'
         when late.weight is distinct from early.weight then 'changed' end as change
    from late full join early on late.snapshot_no = early.later and late.tail = early.tail and late.head = early.head)
select snapshot_no, tail, head, change from merged where change is not null"""


@registry.add("p2_found", _CHANGES)
def p2_found(spark, sf_dir):
    return snapshot_changes(table(spark, sf_dir, "xs1_snapshot"))


@registry.add("p2_change_counts", f"select snapshot_no, change, count(*) as n from ({_CHANGES}) group by 1, 2")
def p2_change_counts(spark, sf_dir):
    return snapshot_changes(table(spark, sf_dir, "xs1_snapshot")).groupBy("snapshot_no", "change").agg(F.count(F.lit(1)).alias("n"))
