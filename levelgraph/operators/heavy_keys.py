"""Per-key results where a few keys hold most rows.

Keys above a share of the rows are found with a frequent-items sketch, built in two levels so that no task merges all
sketches. A broadcast join with those keys, whose number the share bounds, parts the rows: heavy keys are aggregated over
salted sub-groups, all others by one ordinary shuffle, and the union of both is the result.
"""

from __future__ import annotations

import math
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import number, require_columns

#: Sketches are merged in so many groups first.
MERGE_WAYS = 64


def heavy_keys(df: DataFrame, key: str, share: float, by: tuple[str, ...] = ()) -> DataFrame:
    """Candidates (*by, key) that hold at least ``share`` of the rows of ``by`` in which ``key`` isn't null.

    None of those is missed; a key somewhat below the share may be among them. The sketch tracks so many items that its
    error is under a quarter of the share, so there are at most 2/share candidates for each ``by``. Null is no key; an
    empty table gives no rows.
    """
    require_columns(df, key, *by)
    if not 0 < share <= 1:
        raise ValueError("share must lie in (0, 1]")
    tracked = 1 << max(6, math.ceil(math.log2(4 * 3.5 / share)))
    if tracked > 1_000_000:
        raise ValueError("share is too small for a sketch in memory")
    groups = [F.col(b) for b in by]
    some = (
        df.where(F.col(key).isNotNull())
        .groupBy(*groups, F.pmod(F.spark_partition_id(), F.lit(MERGE_WAYS)).alias("_way"))
        .agg(F.expr(f"approx_top_k_accumulate(`{key}`, {tracked})").alias("_sketch"))
    )
    return (
        some.groupBy(*groups)
        .agg(F.expr(f"approx_top_k_estimate(approx_top_k_combine(_sketch), {min(tracked, math.ceil(2 / share))})").alias("_top"))
        .select(*groups, F.explode("_top").alias("_top"))
        .select(*groups, F.col("_top.item").alias(key))
    )


#: Share of a table's rows from which a key is looked up apart from the others, and items that are tracked to find it.
HOT_SHARE, HOT_TRACKED, MOST_TRACKED = 1 / 64, 1024, 1 << 16


def hot_keys_seen(key: str, share: float = HOT_SHARE) -> Column:
    """A metric to take while a table is written: its keys of about ``share`` of the rows, as far as MOST_TRACKED items tell.

    A task's sketch has 16 KB by default and 1 MB at most.
    """
    tracked = min(MOST_TRACKED, 1 << math.ceil(math.log2(max(HOT_TRACKED, 14 / share))))
    return F.expr(f"approx_top_k(`{key}`, {min(tracked, math.ceil(2 / share))}, {tracked})")


def hot_keys_of(metric: list | None, rows: int, share: float = HOT_SHARE) -> dict:
    """The keys of ``hot_keys_seen`` with at least half the share, and about how many rows they have: at most 2/share."""
    return {r.item: r["count"] for r in metric or [] if r.item is not None and r["count"] >= share / 2 * rows}


def look_up(left: DataFrame, right: DataFrame, key: str, hot: Iterable) -> DataFrame:
    """left joined (left outer) with right, which has one row for a key.

    Rows of left with a hot key meet a broadcast of right's rows for these few, all others an ordinary shuffle, so that
    a key that most rows have doesn't gather them in one task.
    """
    hot = list(hot)
    if not hot:
        return left.join(right, key, "left")
    is_hot = F.col(key).isin(hot)
    few = F.broadcast(right.where(is_hot))  # at most a row for each hot key
    return left.where(~is_hot | F.col(key).isNull()).join(right, key, "left").unionByName(left.where(is_hot).join(few, key, "left"))


def node_sides(edges: DataFrame) -> DataFrame:
    """(side, node, other, weight): every edge once for its tail and once for its head. Extra columns are left behind."""
    require_columns(edges, "tail", "head", "weight")
    ends = F.array(
        F.struct(F.lit("tail").alias("side"), F.col("tail").alias("node"), F.col("head").alias("other")),
        F.struct(F.lit("head").alias("side"), F.col("head").alias("node"), F.col("tail").alias("other")),
    )
    return edges.select(F.explode(ends).alias("e"), "weight").select("e.*", "weight").where(F.col("node").isNotNull())


def _measures() -> list[Column]:
    return [
        F.sum("n").alias("n"),
        F.sum("n_weights").alias("n_weights"),
        F.sum("sum_weight").alias("sum_weight"),
        F.min("min_weight").alias("min_weight"),
        F.max("max_weight").alias("max_weight"),
    ]


def node_totals(edges: DataFrame, share: float = 0.025, salts: int = 32) -> DataFrame:
    """Records, weights and opposite ends of every node, for each side of the edge.

    edges: tail, head, weight; other columns are ignored. Result, a row for each (side, node) that occurs: ``n_records``
    (every row, repeated ones too), ``n_weights``, ``sum_weight``, ``min_weight``, ``max_weight`` (over weights neither
    null nor NaN; null if there are none), ``n_others`` (different opposite ends, null being none), ``share`` (of the
    side's rows) and ``is_heavy`` (share reached).

    Both ways start from rows combined by (side, node, other) in the map tasks, so rows repeated in one task cross the
    network once. Heavy nodes are spread over ``salts`` sub-groups of their opposite ends and joined with a broadcast of
    at most 2/share keys a side. Null nodes belong to no group. An empty table gives an empty result.
    """
    rows = node_sides(edges)
    candidates = heavy_keys(rows, "node", share, by=("side",)).withColumn("_hot", F.lit(True))
    w = number(F.col("weight"))
    tagged = rows.join(F.broadcast(candidates), ["side", "node"], "left")
    pairs = (
        tagged.groupBy("side", "node", "other", "_hot")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.count(w).alias("n_weights"),
            F.sum(w).alias("sum_weight"),
            F.min(w).alias("min_weight"),
            F.max(w).alias("max_weight"),
        )
        .withColumn("seen", F.col("other").isNotNull().cast("long"))
    )
    light = pairs.where("_hot is null").groupBy("side", "node").agg(*_measures(), F.sum("seen").alias("n_others"))
    heavy = (
        pairs.where("_hot")
        .groupBy("side", "node", F.pmod(F.xxhash64("other"), F.lit(salts)).alias("_salt"))
        .agg(*_measures(), F.sum("seen").alias("seen"))
        .groupBy("side", "node")
        .agg(*_measures(), F.sum("seen").alias("n_others"))
    )
    both = light.unionByName(heavy)
    counts = edges.agg(F.count("tail").alias("tail"), F.count("head").alias("head"))
    total = counts.select(F.expr("stack(2, 'tail', tail, 'head', head) as (side, _total)"))  # two rows
    return both.join(F.broadcast(total), "side").select(
        "side",
        "node",
        F.col("n").alias("n_records"),
        "n_weights",
        "sum_weight",
        "min_weight",
        "max_weight",
        "n_others",
        (F.col("n") / F.col("_total")).alias("share"),
        # n >= share * total, of a share given as a decimal, without its rounding
        (F.col("n") * F.lit(1_000_000) >= F.col("_total") * F.lit(round(share * 1_000_000))).alias("is_heavy"),
    )
