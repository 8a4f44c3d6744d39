"""Mixtures of sources with target weights, by hierarchical budgeting over a tree of domains, languages and sources.

Weights go down the tree from the total to the leaves: a source's share is parted over its domains and languages by the
tokens it has there. A leaf holds its tokens as often as they may be repeated; what it can't hold goes to its siblings,
the other sources of its domain and language, first, and only what no sibling holds to the ancestors' siblings: other
languages of the domain, then other domains. A leaf's budget is read from seeded epochs: each epoch has all documents of
the leaf in a new order, and of the last one a prefix is read, which ends before or after the document in which the
budget ends, so that a source's leaves make up for each other.
"""

from __future__ import annotations

import math
from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import require_columns
from ..workspace import Workspace
from .tokens import VOCABULARY, token_counts

#: Leaves of the tree, a row for each of which the driver plans with.
MOST_LEAVES = 100_000
#: Documents of a leaf whose order is looked at together, about.
SORTED = 4096


def fill(total: float, weights: dict, room: dict) -> dict:
    """Shares of the total by weight, none above its room; what one can't hold goes to the others by weight."""
    given = dict.fromkeys(weights, 0.0)
    able = sorted((k for k, w in weights.items() if w > 0 and room[k] > 0), key=lambda k: room[k] / weights[k])
    rest = list(accumulate(weights[k] for k in reversed(able)))  # what those that are left weigh together
    for k in able:  # those that run short first
        given[k] = min(room[k], total * (weights[k] / rest.pop()))
        total -= given[k]
    return given


def budgets(leaves: dict[tuple[str, ...], tuple[float, float]], total: float) -> dict[tuple[str, ...], float]:
    """Budget of each leaf: leaves has path -> (weight, room); paths are of one length. Siblings come before ancestors."""

    def down(paths: list[tuple[str, ...]], depth: int, amount: float) -> dict[tuple[str, ...], float]:
        if depth == len(paths[0]):
            return {paths[0]: min(amount, leaves[paths[0]][1])}
        children: dict[str, list[tuple[str, ...]]] = {}
        for p in paths:
            children.setdefault(p[depth], []).append(p)
        weight = {c: math.fsum(leaves[p][0] for p in ps) for c, ps in children.items()}
        room = {c: math.fsum(leaves[p][1] for p in ps if leaves[p][0] > 0) for c, ps in children.items()}
        given = fill(amount, weight, room)
        return {k: v for c, ps in children.items() for k, v in down(ps, depth + 1, given[c]).items()}

    return down(sorted(leaves), 0, total) if leaves else {}


#: As total_tokens: as many tokens as the documents of sources with a target have, each used once.
AVAILABLE = "available"


def largest_total(leaves: dict[tuple[str, ...], tuple[float, float]]) -> float:
    """The largest total at which every leaf that has room at all gets its weight and its part of what others lack."""
    endless = {p: (w, math.inf if r > 0 else 0.0) for p, (w, r) in leaves.items()}
    parts = budgets(endless, 1.0)
    return min((leaves[p][1] / b for p, b in parts.items() if b > 0), default=0.0)


def spelled(c: Column) -> Column:
    """One spelling: trimmed, lower case, with hyphens for spaces and underscores; an empty one is null."""
    s = F.regexp_replace(F.lower(F.trim(c)), r"[\s_-]+", "-")
    return F.when(s != "", s)


def tree(stats: list[tuple], goals: dict[str, tuple[float, int]]) -> dict[tuple[str, str, str], tuple[float, float]]:
    """(domain, lang, source) -> (weight, room), from (domain, lang, source, tokens) and source -> (share, max_repeat).

    A source without documents has its share in every domain and language, by the tokens of all sources there, and no
    room, so that its siblings there take its place.
    """
    whole: dict[str, int] = {}
    cells: dict[tuple[str, str], int] = {}
    for domain, lang, source, tokens in stats:
        whole[source] = whole.get(source, 0) + tokens
        cells[domain, lang] = cells.get((domain, lang), 0) + tokens
    every = sum(whole.values())
    leaves = {}
    for domain, lang, source, tokens in stats:
        share, repeat = goals[source]
        leaves[domain, lang, source] = (share * tokens / whole[source], float(tokens * repeat))
    for source, (share, _) in goals.items():
        if source not in whole:
            for (domain, lang), tokens in cells.items():
                leaves[domain, lang, source] = (share * tokens / every, 0.0)
    return leaves


def mix(
    documents: DataFrame,
    targets: DataFrame,
    total_tokens: int | str | None = None,
    domain: str | None = None,
    seed: int = 1,
    vocabulary: str = VOCABULARY,
) -> tuple[DataFrame, DataFrame]:
    """(mixture, report).

    documents: doc_id, text, source, lang, and the column that ``domain`` names, if any; targets: source, target_share,
    max_repeat. Spellings of a source, language or domain that differ in case, outer spaces, hyphens and underscores are
    one. mixture: domain, lang, source, doc_id, epoch, tokens, one row for each use of a document, epoch counting its
    uses from 0. report: a row for each source with a target: target_share, max_repeat, n_documents, available_tokens,
    n_uses, most_uses, tokens, reached_share (of all tokens of the mixture).

    Without total_tokens the mixture is the largest in which every source that has documents reaches its share; with a
    number, or AVAILABLE, sources that run short leave the rest to others, and the report tells the shares reached. As
    documents stay whole, a leaf may miss its budget by one, and a source its share by half a document. Documents without source, of a source without
    target, or of no tokens are not used; a null language or domain is one of its own. A null, NaN or negative share is 0,
    a null max_repeat 1; shares are taken in proportion if they don't add up to 1; of repeated targets shares add up and
    the greatest max_repeat counts. Repeated documents are each used for themselves. Empty tables give no uses.
    """
    require_columns(documents, "doc_id", "text", "source", "lang", *([domain] if domain else []))
    require_columns(targets, "source", "target_share", "max_repeat")
    spark = documents.sparkSession
    ws = Workspace(spark, "mix")
    share = F.greatest(F.coalesce(F.when(~F.isnan("target_share"), F.col("target_share")), F.lit(0.0)), F.lit(0.0))
    goal = targets.select(spelled(F.col("source")).alias("source"), share.alias("share"), F.greatest(F.coalesce("max_repeat", F.lit(1)), F.lit(0)).alias("repeat"))
    goal = goal.where("source is not null").groupBy("source").agg(F.sum("share").alias("share"), F.max("repeat").alias("repeat"))
    own = lambda c: F.coalesce(spelled(F.col(c)), F.lit("?"))
    slim = documents.select("doc_id", "text", spelled(F.col("source")).alias("source"), own("lang").alias("lang"), (own(domain) if domain else F.lit("all")).alias("domain"))
    sized = token_counts(slim, "doc_id", "domain", "lang", "source", vocabulary=vocabulary)
    used = sized.where("tokens > 0 and source is not null").join(goal.select("source"), "source", "left_semi")
    docs = ws.save(used.withColumn("row", F.monotonically_increasing_id()), "docs")
    there = docs.groupBy(*LEAF).agg(F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("n"))
    goals = {r.source: (r.share, r.repeat) for r in goal.limit(MOST_LEAVES + 1).collect()}
    stats = there.limit(MOST_LEAVES + 1).collect()  # of sources with a target
    if max(len(goals), len(stats)) > MOST_LEAVES:
        raise ValueError(f"more than {MOST_LEAVES} leaves")
    leaves = tree([(r.domain, r.lang, r.source, r.tokens) for r in stats], goals)
    if total_tokens == AVAILABLE:
        total_tokens = sum(r.tokens for r in stats)
    given = budgets(leaves, float(total_tokens) if total_tokens is not None else largest_total(leaves))
    mixture = _select(ws, docs, _plan(stats, goals, given), seed)
    return mixture, _report(mixture, docs, goal)


#: The tree's path.
LEAF = ["domain", "lang", "source"]


def _plan(stats: list, goals: dict, given: dict) -> list[tuple]:
    """(domain, lang, source, whole epochs, tokens of the last one, bits of its order by which the leaf is parted)."""
    plan = []
    for r in stats:
        budget, repeat = given[r.domain, r.lang, r.source], goals[r.source][1]
        full = min(int((budget + 1e-6) // r.tokens), repeat)
        rest = max(0.0, budget - full * r.tokens) if full < repeat else 0.0
        plan.append((r.domain, r.lang, r.source, full, rest, max(0, math.ceil(math.log2(max(1, r.n / SORTED))))))
    return plan


def _select(ws: Workspace, docs: DataFrame, plan: list[tuple], seed: int) -> DataFrame:
    leaf = docs.sparkSession.createDataFrame(plan, "domain string, lang string, source string, full int, rest double, bits int")
    drawn = docs.join(F.broadcast(leaf), LEAF)  # at most MOST_LEAVES rows
    use = [*LEAF, "doc_id", "epoch", "tokens"]
    epochs = drawn.where("full > 0").withColumn("epoch", F.explode(F.expr("sequence(0, full - 1)"))).select(*use)
    ordered = drawn.where("rest > 0").withColumn("draw", F.xxhash64(F.lit(seed), F.col("full"), F.col("doc_id"), F.when(F.col("doc_id").isNull(), F.col("row"))))
    # the order's leading bits part a leaf evenly; only the part in which the budget ends is looked at row by row
    ordered = ordered.withColumn("part", F.expr("if(bits = 0, 0L, shiftrightunsigned(draw, 64 - bits))"))
    parts = ordered.groupBy(*LEAF, "part", "rest").agg(F.sum("tokens").alias("t"))
    upto = F.sum("t").over(Window.partitionBy(*LEAF).orderBy("part"))
    parts = parts.withColumn("before", upto - F.col("t")).where("before < rest").select(*LEAF, "part", "before", "t")
    ordered = ordered.join(parts, [*LEAF, "part"])
    inside = ordered.where("before + t <= rest")
    place = Window.partitionBy(*LEAF, "part").orderBy("draw", "doc_id", "row")
    edge = ordered.where("before + t > rest").withColumn("upto", F.col("before") + F.sum("tokens").over(place.rowsBetween(Window.unboundedPreceding, 0)))
    edge = ws.save(edge.select(*LEAF, "doc_id", F.col("full").alias("epoch"), "tokens", "rest", "upto"), "edge")
    ends = edge.where("upto > rest").groupBy(*LEAF).agg(F.min("upto").alias("above"), F.min_by("tokens", "upto").alias("tokens"), F.first("rest").alias("rest"))
    cuts = docs.sparkSession.createDataFrame(nearest_cuts(ends.collect()), "domain string, lang string, source string, cut double")  # a row for each leaf
    edge = edge.join(F.broadcast(cuts), LEAF, "left").where(F.col("upto") <= F.coalesce("cut", "rest"))
    last = inside.withColumn("epoch", F.col("full")).select(*use).unionByName(edge.select(*use))
    return epochs.unionByName(last)


def nearest_cuts(ends: list) -> list[tuple]:
    """(domain, lang, source, cut) from where each leaf's budget ends: rest, inside a document of so many tokens up to above.

    A leaf is cut before or after that document, whichever brings its source nearer to the budgets of all leaves so far.
    The largest documents are settled first, so that what the source misses in the end is half of a small one.
    """
    owed: dict[str, float] = {}
    cuts = []
    for r in sorted(ends, key=lambda r: (-r.tokens, r.domain, r.lang, r.source)):
        wanted = r.rest + owed.get(r.source, 0.0)
        cut = float(r.above if r.above - wanted <= wanted - (r.above - r.tokens) else r.above - r.tokens)
        owed[r.source] = wanted - cut
        cuts.append((r.domain, r.lang, r.source, cut))
    return cuts


def _report(mixture: DataFrame, docs: DataFrame, goal: DataFrame) -> DataFrame:
    used = mixture.groupBy("source").agg(F.count(F.lit(1)).alias("n_uses"), (F.max("epoch") + 1).alias("most_uses"), F.sum("tokens").alias("tokens"))
    held = docs.groupBy("source").agg(F.count(F.lit(1)).alias("n_documents"), F.sum("tokens").alias("available_tokens"))
    zero = {"n_documents": 0, "available_tokens": 0, "n_uses": 0, "most_uses": 0, "tokens": 0}
    rows = goal.join(held, "source", "left").join(used, "source", "left").fillna(zero)
    every = F.sum("tokens").over(Window.partitionBy(F.lit(0)))  # one row for each target
    return rows.select(
        "source", F.col("share").alias("target_share"), F.col("repeat").alias("max_repeat"), "n_documents", "available_tokens",
        "n_uses", "most_uses", "tokens", F.coalesce(F.col("tokens") / F.when(every > 0, every), F.lit(0.0)).alias("reached_share"),
    )
