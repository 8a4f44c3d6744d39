"""Queries of the operators for language-model data, with SQL where it can express them."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..queries import Registry, table
from .components import connected_groups
from .frequent_items import frequent_items
from .mixing import AVAILABLE, mix
from .packing import fill_report, pack
from .readability import reading_levels
from .top_n import top_n_per_group, top_n_read

registry = Registry()

_FREQUENT = """
select field_name, item, n as n_rows from (
    select field_name, item, count(*) as n, sum(count(*)) over (partition by field_name) as total
    from (select 'tail' as field_name, tail as item from xs1
          union all select 'degree', degree::bigint from node_and_degree)
    where item is not null group by 1, 2)
where n * 100 >= total"""


def _frequent(spark, sf_dir):
    return frequent_items(
        {"tail": (table(spark, sf_dir, "xs1"), "tail"), "degree": (table(spark, sf_dir, "node_and_degree"), "degree")}, share=0.01
    )


@registry.add("p3_found", f"select field_name, item from ({_FREQUENT})")
def p3_found(spark, sf_dir):
    return _frequent(spark, sf_dir).select("field_name", "item")


@registry.add("p3_frequent_counts", _FREQUENT)
def p3_frequent_counts(spark, sf_dir):
    return _frequent(spark, sf_dir).select("field_name", "item", "n_rows")


_GROUPS = """
with recursive e as (select tail as a, head as b from xs1_match where tail is not null and head is not null
    union select head, tail from xs1_match where tail is not null and head is not null),
n as (select tail as id from xs1_match where tail is not null union select head from xs1_match where head is not null),
reach(id, r) as (select id, id from n union select reach.id, b from reach join e on a = r)
select min(r) as group_id, id as node from reach group by id"""


@registry.add("p4_found", _GROUPS)
def p4_found(spark, sf_dir):
    return connected_groups(table(spark, sf_dir, "xs1_match"))


@registry.add(
    "p4_group_sizes",
    f"select n_nodes, count(*) as n_groups from (select group_id, count(*) as n_nodes from ({_GROUPS}) group by 1) group by 1",
)
def p4_group_sizes(spark, sf_dir):
    """How many groups there are of each size."""
    sizes = connected_groups(table(spark, sf_dir, "xs1_match")).groupBy("group_id").agg(F.count(F.lit(1)).alias("n_nodes"))
    return sizes.groupBy("n_nodes").agg(F.count(F.lit(1)).alias("n_groups"))


_TOP = """
select tail, head, score as weight, row_number() over (partition by tail order by score desc, head) as place
from (select tail, head, max(weight::double + 0.0) as score from xs1
      where tail is not null and head is not null and weight is not null and not isnan(weight) group by 1, 2)
qualify place <= 5"""


def _top(spark, sf_dir):
    return top_n_per_group(table(spark, sf_dir, "xs1"), "tail", "head", "weight", 5)


@registry.add("p5_found", f"select tail, head from ({_TOP})")
def p5_found(spark, sf_dir):
    return _top(spark, sf_dir).select("tail", "head")


@registry.add("p5_top_heads", _TOP)
def p5_top_heads(spark, sf_dir):
    return _top(spark, sf_dir)


@registry.add("p5_row_groups")
def p5_row_groups(spark, sf_dir):
    """Row groups that were read, and those there are."""
    return top_n_read(table(spark, sf_dir, "xs1"), "tail", "head", "weight", 5)[1]


@registry.add("p6_pack")
def p6_pack(spark, sf_dir):
    return pack(table(spark, sf_dir, "documents"), table(spark, sf_dir, "pack_capacity"))


@registry.add("p6_fill")
def p6_fill(spark, sf_dir):
    capacities = table(spark, sf_dir, "pack_capacity")
    return fill_report(pack(table(spark, sf_dir, "documents"), capacities), capacities)


@registry.add("p6_check", """select capacity_name, (select count(*) from documents) as n_documents, 0 as n_over, 0 as n_split, true as filled
from pack_capacity""")  # fmt: skip
def p6_check(spark, sf_dir):
    """Documents placed, containers over capacity, documents split that fit into one, and whether 98 % of the space is filled."""
    capacities = table(spark, sf_dir, "pack_capacity")
    packed = pack(table(spark, sf_dir, "documents"), capacities).join(capacities, "capacity_name").persist()
    ok = lambda bad: F.sum(F.when(bad, 1).otherwise(0)).cast("int")
    by_doc = packed.groupBy("capacity_name", "doc_id", "capacity_tokens").agg(F.sum("tokens").alias("t"), F.count(F.lit(1)).alias("k"))
    docs = by_doc.groupBy("capacity_name").agg(F.count(F.lit(1)).alias("n_documents"), ok((F.col("k") > 1) & (F.col("t") <= F.col("capacity_tokens"))).alias("n_split"))
    by_container = packed.where("container_no > 0").groupBy("capacity_name", "container_no", "capacity_tokens").agg(F.sum("tokens").alias("t"))
    filled = F.sum("t") / (F.count(F.lit(1)) * F.max("capacity_tokens")) >= 0.98
    containers = by_container.groupBy("capacity_name").agg(ok(F.col("t") > F.col("capacity_tokens")).alias("n_over"), filled.alias("filled"))
    return docs.join(containers, "capacity_name").select("capacity_name", "n_documents", "n_over", "n_split", "filled")


def _mix(spark, sf_dir, **more):
    """The notebooks' kernel is their domain."""
    return mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_target"), domain="kernel", **more)


@registry.add("p7_mixture")
def p7_mixture(spark, sf_dir):
    return _mix(spark, sf_dir)[0]


@registry.add("p7_shares")
def p7_shares(spark, sf_dir):
    return _mix(spark, sf_dir)[1]


@registry.add("p7_mixture_available")
def p7_mixture_available(spark, sf_dir):
    return _mix(spark, sf_dir, total_tokens=AVAILABLE)[0]


@registry.add("p7_shares_available")
def p7_shares_available(spark, sf_dir):
    return _mix(spark, sf_dir, total_tokens=AVAILABLE)[1]


def _mix_check(spark, sf_dir, slack, **more):
    """For each source whether its share is reached, within ``slack``, and no document used too often."""
    mixture, report = _mix(spark, sf_dir, **more)
    most = mixture.groupBy("source", "doc_id").agg(F.count(F.lit(1)).alias("uses")).groupBy("source").agg(F.max("uses").alias("uses"))
    both = report.join(most, "source", "left")
    used_up = F.col("tokens") >= F.col("available_tokens") * F.col("max_repeat")
    return both.select(
        "source", (F.coalesce("uses", F.lit(0)) <= F.col("max_repeat")).alias("repeats_kept"),
        ((F.col("reached_share") >= F.col("target_share") - slack) | used_up).alias("share_reached"),
    )


_SOURCES = "select source, true as repeats_kept, true as share_reached from mix_target"


@registry.add("p7_check", _SOURCES)
def p7_check(spark, sf_dir):
    return _mix_check(spark, sf_dir, 0.01)


@registry.add("p7_check_available", _SOURCES)
def p7_check_available(spark, sf_dir):
    """A source below its share is used up."""
    return _mix_check(spark, sf_dir, 0.01, total_tokens=AVAILABLE)


def _levels(spark, sf_dir):
    return reading_levels(table(spark, sf_dir, "documents"), table(spark, sf_dir, "reading_labels"))


@registry.add("p8_found")
def p8_found(spark, sf_dir):
    return _levels(spark, sf_dir).where("reading_level = 5").select("doc_id")


@registry.add("p8_reading_levels")
def p8_reading_levels(spark, sf_dir):
    return _levels(spark, sf_dir)


@registry.add("p8_profile")
def p8_profile(spark, sf_dir):
    """Documents and words of each language and level."""
    n = F.count(F.lit(1)).alias("n_documents")
    return _levels(spark, sf_dir).groupBy("lang", "reading_level").agg(n, F.sum("n_words").alias("n_words"))


@registry.add("p8_check", "select count(*) as n_documents, 0 as n_wrong from documents")
def p8_check(spark, sf_dir):
    """Documents, and those whose level is out of range, or null with enough words, or set with too few."""
    enough, level = F.col("n_words") >= 40, F.col("reading_level")
    right = F.when(enough, level.isNotNull() & level.between(1, 5)).otherwise(level.isNull())
    return _levels(spark, sf_dir).agg(F.count(F.lit(1)).alias("n_documents"), F.sum(F.when(right, 0).otherwise(1)).cast("int").alias("n_wrong"))
