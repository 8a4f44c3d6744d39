"""Filling containers of fixed capacity: bulk-synchronous best-fit by distributed successor sweeps.

Items are ranked within their size, so that equal items are one run (size, first rank, number), and containers with equal
gaps are another. Runs are range-sorted by (capacity, value) into parts of about PART_RUNS item runs. In a superstep each
part sweeps its items and gaps in descending order: an item takes the smallest gap that holds it, its successor; the rank
of an item in its run settles which of several gets which container; gaps shrink and go to the part of their new size.
Items that no gap of their own part holds get theirs from the nearest parts above: the parts' summaries (a row for each)
tell how many gaps stay over and how many items want one, and the smallest free gaps are handed down for the next
superstep. When no gap holds any item, as many new containers as the rest fills are begun by its largest items. Rounds
repeat until every item is placed. Then documents are ranked within their size and look up their run's container.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import require_columns
from ..workspace import Workspace
from .tokens import VOCABULARY, token_counts

#: Item runs of a part, about.
PART_RUNS = 2048
#: Items of one size are ranked in sub-groups of about so many.
RANKED = 50_000
#: Ranks of a chunk by which items look up their run's container, and of a piece that a long run is first cut into.
CHUNK, PIECE = 64, 1 << 20
#: Capacities, which make up a literal of the plan.
MOST_CAPACITIES = 1000

Run = list[int]  # value, first rank or first container, number
GAP, ITEM, MATCH, SUMMARY = range(4)
_SHIFT = 40
_MASK = (1 << _SHIFT) - 1
#: kind; key: capacity's number and value; first: rank or container; n: items, or containers of a match; home: the part of
#: the key; pre: place of a gap among those that stayed over in its part, from the smallest, or -1. Of a match: each
#: items in each container, from container on. Of a summary, of the part home and the capacity of key: n items left of
#: tokens in all, the least of size least, and gaps that stayed over (pre), that have shrunk (first), matches (each).
_STATE = "kind int, key long, first long, n long, home int, pre long, each long, container long, tokens long, least long, most long, least_gap long"
_COLUMNS = [c.split()[0] for c in _STATE.split(", ")]


def sweep(items: list[Run], gaps: list[Run]) -> tuple[list[tuple], list[Run], list[Run], list[Run]]:
    """One sweep: (matches, items left, gaps that stayed over, gaps that have shrunk). Both inputs descend by value.

    A match (size, rank, each, containers, container) puts ``each`` items, in order of rank, into each of so many
    containers. A gap takes items of one size in a round: as many as fit, as it stays the smallest that holds them.
    """
    out, left, later, stack, at = [], [], [], [], 0
    for size, rank, n in items:
        while at < len(gaps) and gaps[at][0] >= size:
            stack.append(list(gaps[at]))
            at += 1
        while n and stack:
            gap, first, many = top = stack[-1]
            each = gap // size
            full = min(many, n // each)
            if not full:
                each, full = n, 1
            out.append((size, rank, each, full, first))
            if gap > each * size:
                later.append([gap - each * size, first, full])
            rank, n = rank + each * full, n - each * full
            top[1], top[2] = first + full, many - full
            if not top[2]:
                stack.pop()
        if n:
            left.append([size, rank, n])
    return out, left, stack + gaps[at:], later


def begin(items: list[Run], many: int, capacity: int, container: int) -> tuple[list[tuple], list[Run], list[Run]]:
    """New containers, each begun by one of the first ``many`` items: (matches, items left, gaps)."""
    out, gaps, at = [], [], 0
    while many:
        size, rank, n = items[at]
        take = min(many, n)
        out.append((size, rank, 1, take, container))
        if size < capacity:
            gaps.append([capacity - size, container, take])
        many, container = many - take, container + take
        if take < n:
            items = [*items[:at], [size, rank + take, n - take], *items[at + 1 :]]
        else:
            at += 1
    return out, items[at:], gaps


def hand_down(parts: list[dict]) -> list[tuple[int, int, int, int]]:
    """(home, from, to, part): which of the gaps that stayed over in a part, by their place, go to which part below.

    parts: of one capacity, from the highest, with home, items, most (size of the largest item), over (gaps that stayed
    over) and least_gap. The nearest gaps above go first; one that holds several of the items counts for as many.
    """
    grants: list[tuple[int, int, int, int]] = []
    stack: list[list[int]] = []
    for p in parts:
        wanted = p["items"]
        while wanted > 0 and stack:
            home, at, over, least_gap = top = stack[-1]
            each = max(1, least_gap // p["most"])
            take = min(over - at, -(-wanted // each))
            grants.append((home, at, at + take, p["home"]))
            wanted -= take * each
            top[1] += take
            if top[1] == over:
                stack.pop()
        if p["over"]:
            stack.append([p["home"], 0, p["over"], p["least_gap"]])
    return grants


def decide(seen: list, capacities: list[int], following: list[int]) -> tuple[dict, list[tuple], dict, int]:
    """From the summaries of a superstep: (opened, grants, least, items left) for the next one.

    opened: (part, capacity) -> (items that begin containers, first container), if no gap can hold any item of the
    capacity; grants: (capacity, from, lo, hi, to); least: the smallest item left of each capacity. following: the next
    container's number of each capacity, which is moved on.
    """
    opened, grants, least, left = {}, [], {}, 0
    for cap, capacity in enumerate(capacities):
        own = sorted((r for r in seen if r.key >> _SHIFT == cap), key=lambda r: -r.home)
        items = sum(r.n for r in own)
        if not items:
            continue
        left += items
        least[cap] = min(r.least for r in own if r.n)
        parts = [{"home": r.home, "items": r.n, "most": r.most, "over": r.pre, "least_gap": r.least_gap} for r in own]
        given = hand_down(parts)
        if not given and not any(r.each or r.first for r in own):
            new = -(-sum(r.tokens for r in own) // capacity)
            for r in own:
                take = min(new, r.n)
                if take:
                    opened[r.home, cap] = (take, following[cap])
                    following[cap] += take
                    new -= take
        taken = {h: hi for h, _, hi, _ in given}  # a part's gaps are given in order
        grants += [(cap, *g) for g in given]
        grants += [(cap, p["home"], taken[p["home"]], p["over"], p["home"]) for p in parts if 0 < taken.get(p["home"], 0) < p["over"]]
    return opened, grants, least, left


def _sweeper(bounds: np.ndarray, capacities: list[int], opened: dict[tuple[int, int], tuple[int, int]], least: dict[int, int]):
    """The function that sweeps a part; opened: (part, capacity) -> items that begin containers, and the first of these."""

    def home_of(cap: int, value: int) -> int:
        return max(0, int(np.searchsorted(bounds, (cap << _SHIFT) | value, "right")) - 1)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        here = int(pdf["dest"].iat[0])
        rows: list[tuple] = []
        caps = pdf["key"].to_numpy() >> _SHIFT
        for cap in np.unique(caps):
            cap = int(cap)
            own = pdf[caps == cap].sort_values(["key", "first"], ascending=[False, True])
            lists: dict[int, list[Run]] = {GAP: [], ITEM: []}
            for kind, key, first, n in own[["kind", "key", "first", "n"]].itertuples(index=False, name=None):
                lists[kind].append([key & _MASK, first, n])
            items, gaps = lists[ITEM], [g for g in lists[GAP] if g[0] >= least.get(cap, 0)]
            many, container = opened.get((here, cap), (0, 0))
            made, items, new = begin(items, many, capacities[cap], container)
            matches, items, over, later = sweep(items, gaps)
            top = cap << _SHIFT
            for size, rank, each, n, c in made + matches:
                rows.append((MATCH, top | size, rank, n, here, 0, each, c, 0, 0, 0, 0))
            tokens = 0
            for size, rank, n in items:
                rows.append((ITEM, top | size, rank, n, here, 0, 0, 0, 0, 0, 0, 0))
                tokens += size * n
            stayed, moved = 0, 0
            least_gap = 0
            for gap, c, n in sorted(over):
                home = home_of(cap, gap)
                rows.append((GAP, top | gap, c, n, home, stayed if home == here else -1, 0, 0, 0, 0, 0, 0))
                if home == here:
                    least_gap = least_gap or gap
                    stayed += n
                else:
                    moved += n
            for gap, c, n in new + later:
                rows.append((GAP, top | gap, c, n, home_of(cap, gap), -1, 0, 0, 0, 0, 0, 0))
                moved += n
            left = sum(n for *_, n in items)
            rows.append((SUMMARY, top, moved, left, here, stayed, len(made) + len(matches), 0, tokens, items[-1][0] if items else 0, items[0][0] if items else 0, least_gap))
        return pd.DataFrame(rows, columns=_COLUMNS)

    return run


def pack_runs(ws: Workspace, runs: DataFrame, capacities: list[int], part_runs: int = PART_RUNS) -> tuple[DataFrame, int]:
    """((cap, size, first_rank, each, containers, container), rounds) from runs (cap, size, n): cap numbers capacities.

    The driver holds a row for each part and capacity, which are as many as item runs by ``part_runs``. Containers are
    numbered from 1 for each capacity.
    """
    spark = ws.spark
    keyed, shape = ws.save_counted(runs.select((F.shiftleft(F.col("cap").cast("long"), _SHIFT).bitwiseOR(F.col("size"))).alias("key"), "n"), "keyed")
    parts = max(1, -(-shape["n"] // part_runs))
    laid = keyed.repartitionByRange(parts, "key").groupBy(F.spark_partition_id()).agg(F.min("key").alias("low"))
    bounds = np.array(sorted(r.low for r in laid.select("low").collect()), np.int64)  # a row for each part
    parts = max(1, len(bounds))
    listed = F.array(*map(F.lit, bounds.tolist() or [0]))
    home = F.greatest(F.size(F.filter(listed, lambda b: b <= F.col("key"))) - 1, F.lit(0)).cast("int")
    zero = F.lit(0).cast("long")
    size = F.col("key").bitwiseAND(F.lit(_MASK))
    state = keyed.select(F.lit(ITEM).alias("kind"), "key", zero.alias("first"), "n", home.alias("home"), zero.alias("pre"))
    room = F.element_at(F.array(*[F.lit(c).cast("long") for c in capacities]), F.shiftright("key", _SHIFT).cast("int") + 1)
    # no two items above half the capacity share a container: all of these begin one
    large = state.groupBy("home", F.shiftright("key", _SHIFT).alias("cap")).agg(F.sum(F.when(2 * size > room, F.col("n")).otherwise(0)).alias("large"))
    opened: dict[tuple[int, int], tuple[int, int]] = {}
    following = [1] * len(capacities)
    for r in large.where("large > 0").orderBy("cap", F.desc("home")).collect():
        opened[r.home, r.cap] = (r.large, following[r.cap])
        following[r.cap] += r.large
    grants: list[tuple[int, int, int, int, int]] = []
    least: dict[int, int] = {}
    rounds = 0
    while True:
        sent = state.withColumn("dest", F.col("home"))
        if grants:
            given = F.broadcast(spark.createDataFrame(grants, "cap long, home int, lo long, hi long, to int"))  # few for each part
            sent = sent.withColumn("cap", F.shiftright("key", _SHIFT))
            over = sent.where((F.col("kind") == GAP) & (F.col("pre") >= 0)).join(given, ["cap", "home"], "left")
            over = over.where("lo is null or (pre < hi and pre + n > lo)")
            low, high = F.greatest("pre", F.coalesce("lo", "pre")), F.least(F.col("pre") + F.col("n"), F.coalesce("hi", F.col("pre") + F.col("n")))
            over = over.select("kind", "key", (F.col("first") + low - F.col("pre")).alias("first"), (high - low).alias("n"), F.coalesce("to", "home").alias("dest"))
            rest = sent.where((F.col("kind") == ITEM) | (F.col("pre") < 0)).select("kind", "key", "first", "n", "dest")
            sent = rest.unionByName(over)
        swept = sent.select("kind", "key", "first", "n", "dest").groupBy("dest").applyInPandas(_sweeper(bounds, capacities, opened, least), _STATE)
        table = ws.save(swept, f"round{rounds}")
        rounds += 1
        seen = table.where(F.col("kind") == SUMMARY).collect()  # at most a row for each part and capacity
        opened, grants, least, left = decide(seen, capacities, following)
        if not left:
            break
        state = table.where(F.col("kind") <= ITEM).select("kind", "key", "first", "n", "home", "pre")
    paths = [ws.path(f"round{k}") for k in range(rounds)]
    found = spark.read.schema(_STATE).parquet(*paths).where(F.col("kind") == MATCH)
    return found.select(
        F.shiftright("key", _SHIFT).cast("int").alias("cap"), size.alias("size"), F.col("first").alias("first_rank"), "each", F.col("n").alias("containers"), "container",
    ), rounds


def chunked(matches: DataFrame) -> DataFrame:
    """matches with end_rank, a row for each chunk of ranks that a match touches.

    A match is cut into pieces of PIECE ranks, which are spread over all tasks, before these are cut into chunks: one of
    10^10 ranks makes 10^4 pieces in its own row, and no row more than PIECE / CHUNK chunks.
    """
    end = F.col("first_rank") + F.col("each") * F.col("containers")
    pieces = matches.withColumn("end_rank", end).withColumn("_piece", F.explode(F.sequence(F.floor(F.col("first_rank") / PIECE), F.floor((end - 1) / PIECE))))
    low = F.greatest(F.col("first_rank"), F.col("_piece") * PIECE)
    high = F.least(F.col("end_rank"), (F.col("_piece") + 1) * PIECE)
    spread = pieces.withColumns({"_low": low, "_high": high}).repartition("cap", "size", "_piece", "_low")
    return spread.withColumn("chunk", F.explode(F.sequence(F.floor(F.col("_low") / CHUNK), F.floor((F.col("_high") - 1) / CHUNK)))).drop("_piece", "_low", "_high")


def pack(documents: DataFrame, capacities: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """(capacity_name, container_no, doc_id, part_no, tokens): each document's container, for each capacity.

    documents: doc_id, text; capacities: capacity_name, capacity_tokens. Only a document longer than the capacity is
    split: into parts that fill a container, numbered from 0, and a last part that is packed like any other item. A null
    or empty text takes no space and lies in container 0; other containers are numbered from 1. Capacities that are null
    or below 1 or have no name are left out; of repeated names the greatest counts. Repeated documents are packed each
    for itself, a null doc_id like any other. Empty tables give no rows; extra columns are ignored.
    """
    require_columns(documents, "doc_id", "text")
    require_columns(capacities, "capacity_name", "capacity_tokens")
    spark = documents.sparkSession
    ws = Workspace(spark, "pack")
    wanted = capacities.where("capacity_tokens >= 1 and capacity_name is not null").groupBy("capacity_name").agg(F.max("capacity_tokens").cast("long"))
    each = sorted(tuple(r) for r in wanted.limit(MOST_CAPACITIES + 1).collect())
    if len(each) > MOST_CAPACITIES:
        raise ValueError(f"more than {MOST_CAPACITIES} capacities")
    sizes, seen = ws.save_counted(token_counts(documents, "doc_id", vocabulary=vocabulary).withColumn("row", F.monotonically_increasing_id()), "sizes")
    caps = F.array(*[F.struct(F.lit(k).alias("cap"), F.lit(n).alias("capacity_name"), F.lit(c).cast("long").alias("capacity")) for k, (n, c) in enumerate(each)]) if each else None
    if caps is None:
        kind = documents.schema["doc_id"].dataType.simpleString()
        return spark.createDataFrame([], f"capacity_name string, container_no long, doc_id {kind}, part_no int, tokens long")
    over = sizes.select("doc_id", "row", "tokens", F.explode(caps).alias("c")).select("doc_id", "row", "tokens", "c.*")
    last = F.greatest(F.ceil(F.col("tokens") / F.col("capacity")).cast("int"), F.lit(1)) - 1
    items = over.select("cap", "capacity_name", "capacity", "doc_id", "row", "tokens", last.alias("last"), F.explode(F.sequence(F.lit(0), last)).alias("part_no"))
    size = F.when(F.col("part_no") < F.col("last"), F.col("capacity")).otherwise(F.col("tokens") - F.col("last") * F.col("capacity"))
    own = F.xxhash64("doc_id", F.when(F.col("doc_id").isNull(), F.col("row")), "part_no")
    sub = F.pmod(own, F.lit(max(1, -(-seen["n"] // RANKED)))).cast("int")
    items = items.withColumn("size", size).withColumn("sub", sub).drop("tokens", "last")
    counts = items.where("size > 0").groupBy("cap", "size", "sub").agg(F.count(F.lit(1)).alias("n"))
    subs = Window.partitionBy("cap", "size").orderBy("sub")  # a row for each sub-group
    counts = ws.save(counts.withColumn("offset", F.sum("n").over(subs) - F.col("n")), "counts")
    matches, _ = pack_runs(ws, counts.groupBy("cap", "size").agg(F.sum("n").alias("n")), [c for _, c in each])
    within = Window.partitionBy("cap", "size", "sub").orderBy("doc_id", "row", "part_no")
    ranked = items.where("size > 0").withColumn("row", F.row_number().over(within) - 1)
    ranked = ranked.join(counts.select("cap", "size", "sub", "offset"), ["cap", "size", "sub"])
    ranked = ranked.withColumn("rank", F.col("offset") + F.col("row")).withColumn("chunk", F.floor(F.col("rank") / CHUNK))
    placed = ranked.join(chunked(matches), ["cap", "size", "chunk"]).where("rank >= first_rank and rank < end_rank")
    number = F.col("container") + F.floor((F.col("rank") - F.col("first_rank")) / F.col("each"))
    packed = placed.select("capacity_name", number.alias("container_no"), "doc_id", "part_no", F.col("size").alias("tokens"))
    empty = items.where("size = 0").select("capacity_name", F.lit(0).cast("long").alias("container_no"), "doc_id", "part_no", F.col("size").alias("tokens"))
    return packed.unionByName(empty)


def fill_report(packed: DataFrame, capacities: DataFrame) -> DataFrame:
    """For each capacity: items, containers, tokens, and the share of the space that is filled.

    ``least_containers`` is the number that the tokens would fill to the brim: no packing needs fewer.
    """
    per = packed.where("tokens > 0").groupBy("capacity_name", "container_no").agg(F.sum("tokens").alias("t"), F.count(F.lit(1)).alias("k"))
    total = per.groupBy("capacity_name").agg(
        F.sum("k").alias("n_items"), F.count(F.lit(1)).alias("n_containers"), F.sum("t").alias("tokens"), F.max("t").alias("fullest")
    )
    caps = capacities.groupBy("capacity_name").agg(F.max("capacity_tokens").alias("capacity_tokens"))
    return total.join(caps, "capacity_name").select(
        "*",
        F.ceil(F.col("tokens") / F.col("capacity_tokens")).alias("least_containers"),
        F.round(F.col("tokens") / (F.col("n_containers") * F.col("capacity_tokens")), 6).alias("filled"),
    )
