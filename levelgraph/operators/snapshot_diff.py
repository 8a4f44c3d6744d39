"""What changed between consecutive full snapshots, from invertible Bloom lookup tables.

Every snapshot is summed up, per hash bucket of its keys, in a table of cells that holds XORs of its (key, value hash)
pairs. Subtracting the tables of two snapshots cancels all that both hold; the rest is peeled to the differing pairs. A
bucket that can't be peeled, or whose digest doesn't match, is summed up again with more cells, and in the end compared
exactly, so nothing is missed. A bucket's cells are built inside one task, so no row is shuffled for them threefold.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import require_columns
from ..functions.hashing import np_xxhash64, value_hash
from ..workspace import Workspace

#: Sub-tables of a table: each pair goes into one cell of each.
HASHES = 3
#: Pairs of the largest snapshot that make up a bucket.
BUCKET_PAIRS = 2048
#: Cells of a bucket's table at first, growth when it can't be peeled, and the rounds before buckets are compared exactly.
CELLS, GROWTH, ROUNDS = 768, 4, 3
#: Cells that are peeled together in a task: 40 bytes each.
CELLS_AT_ONCE = 2_000_000

_PURE_SEED, _DIGEST_SEED = 11, 12


def latest_snapshots(records: DataFrame) -> DataFrame:
    """The content of every snapshot: (snapshot_no, tail, head, weight, vh).

    Of a snapshot the greatest delivery alone counts, of its rows those with both ends, of several rows of one
    (tail, head) that with the greatest rec_no (a null rec_no counts as least). ``vh`` is the weight's hash, in which
    null has its own value, NaN equals NaN and 0.0 equals -0.0. Rows without snapshot_no belong nowhere; a null
    delivery_no counts as least. Extra columns are ignored.
    """
    require_columns(records, "snapshot_no", "delivery_no", "rec_no", "tail", "head", "weight")
    r = records.where("snapshot_no is not null").select(
        "snapshot_no", F.coalesce("delivery_no", F.lit(-(2**31))).alias("delivery_no"), "tail", "head", "weight",
        F.coalesce("rec_no", F.lit(-(2**63))).alias("rec_no"),
    )
    newest = r.groupBy("snapshot_no").agg(F.max("delivery_no").alias("delivery_no"))
    rows = r.join(newest, ["snapshot_no", "delivery_no"]).where("tail is not null and head is not null")
    last = F.max(F.struct("rec_no", "weight")).alias("_last")
    return rows.groupBy("snapshot_no", "tail", "head").agg(last).select(
        "snapshot_no", "tail", "head", F.col("_last.weight").alias("weight"), value_hash(F.col("_last.weight")).alias("vh")
    )


def sketch_snapshots(rows: DataFrame, cells: int) -> DataFrame:
    """Tables of ``cells`` cells for each (snapshot_no, bucket); cells that nothing went into are left out.

    rows: snapshot_no, bucket, tail, head, vh. Result: snapshot_no, bucket, cell, n, and the XORs x_tail, x_head, x_vh,
    x_check. Cell -1 holds the bucket's digest in x_check. Tables of snapshots that were summed up before can be kept,
    so that of a new delivery only its own rows are read.
    """
    width = cells // HASHES
    each = [
        (F.lit(i * width) + F.pmod(F.xxhash64("tail", "head", "vh", F.lit(i).cast("long")), F.lit(width))).cast("int")
        for i in range(HASHES)
    ]
    pure = F.xxhash64("tail", "head", "vh", F.lit(_PURE_SEED).cast("long"))
    digest = F.xxhash64("tail", "head", "vh", F.lit(_DIGEST_SEED).cast("long"))
    placed = rows.repartition("bucket").select(
        "snapshot_no", "bucket", "tail", "head", "vh", F.explode(F.array(*each, F.lit(-1))).alias("cell")
    )
    return placed.groupBy("snapshot_no", "bucket", "cell").agg(
        F.count(F.lit(1)).alias("n"),
        F.bit_xor("tail").alias("x_tail"),
        F.bit_xor("head").alias("x_head"),
        F.bit_xor("vh").alias("x_vh"),
        F.bit_xor(F.when(F.col("cell") < 0, digest).otherwise(pure)).alias("x_check"),
    )


def subtract_sketches(sketches: DataFrame, steps: DataFrame) -> DataFrame:
    """Later minus earlier for each step; cells in which nothing is left are dropped. ``snapshot_no`` is the later one."""
    signed = sketches.join(F.broadcast(steps), "snapshot_no").select(
        F.explode(
            F.array(
                F.struct(F.col("snapshot_no").alias("snapshot_no"), F.lit(1).alias("sign")),
                F.struct(F.col("next_no").alias("snapshot_no"), F.lit(-1).alias("sign")),
            )
        ).alias("s"),
        "bucket", "cell", "n", "x_tail", "x_head", "x_vh", "x_check", "has_previous",
    )
    signed = signed.where("s.snapshot_no is not null and (s.sign < 0 or has_previous)")
    xors = [F.bit_xor(c).alias(c) for c in ("x_tail", "x_head", "x_vh", "x_check")]
    return (
        signed.groupBy(F.col("s.snapshot_no").alias("snapshot_no"), "bucket", "cell")
        .agg(F.sum(F.col("n") * F.col("s.sign")).alias("n"), *xors)
        .where("n <> 0 or x_tail <> 0 or x_head <> 0 or x_vh <> 0 or x_check <> 0")
    )


def peel(keys: np.ndarray, cell: np.ndarray, n: np.ndarray, xors: np.ndarray, cells: int):
    """Peels many tables at once.

    keys: the table's number (0, 1, ...) of each row; cell, n, xors (rows x 4: tail, head, vh, check) as subtracted.
    Returns the recovered (table, tail, head, vh, sign) and whether each table peeled completely and met its digest.
    """
    tables, width = int(keys.max(initial=-1)) + 1, cells // HASHES
    count = np.zeros(tables * cells, np.int64)
    table = np.zeros((tables * cells, 4), np.int64)
    digest_n, digest = np.zeros(tables, np.int64), np.zeros(tables, np.int64)
    body = cell >= 0
    at = keys[body] * cells + cell[body]
    count[at], table[at] = n[body], xors[body]
    digest_n[keys[~body]], digest[keys[~body]] = n[~body], xors[~body, 3]
    found: list[tuple[np.ndarray, ...]] = []
    look = np.unique(at)
    seed = [np.full(1, i, np.int64) for i in (*range(HASHES), _PURE_SEED, _DIGEST_SEED)]
    ok = np.ones(tables, bool)
    for _ in range(cells * 2):  # each pass recovers a pair in every table that still moves; a stuck one stays as it is
        some = look[np.abs(count[look]) == 1]
        t = table[some]
        some = some[np_xxhash64(t[:, 0], t[:, 1], t[:, 2], np.broadcast_to(seed[HASHES], len(some))) == t[:, 3]]
        if not len(some):
            break
        # a pair alone in several of its cells is taken once
        who = np.column_stack([some // cells, table[some, :3], count[some]])
        who = np.unique(who, axis=0)
        which, tail, head, vh, sign = who.T
        found.append((which, tail, head, vh, sign))
        check = np_xxhash64(tail, head, vh, np.broadcast_to(seed[HASHES], len(tail)))
        touched = []
        for i in range(HASHES):
            c = which * cells + i * width + np.mod(np_xxhash64(tail, head, vh, np.broadcast_to(seed[i], len(tail))), width)
            np.subtract.at(count, c, sign)
            for j, x in enumerate((tail, head, vh, check)):
                np.bitwise_xor.at(table[:, j], c, x)
            touched.append(c)
        look = np.unique(np.concatenate(touched))
    left = (count != 0) | table.any(axis=1)
    ok[np.flatnonzero(left) // cells] = False
    if found:
        which, tail, head, vh, sign = (np.concatenate(x) for x in zip(*found))
        np.subtract.at(digest_n, which, sign)
        np.bitwise_xor.at(digest, which, np_xxhash64(tail, head, vh, np.broadcast_to(seed[-1], len(tail))))
        ok &= (digest == 0) & (digest_n == 0)
    else:
        which = tail = head = vh = sign = np.zeros(0, np.int64)
        ok &= (digest == 0) & (digest_n == 0)
    return which, tail, head, vh, sign, ok


_PEELED = "snapshot_no int, bucket long, tail long, head long, vh long, sign int"


def _peel_all(diff: DataFrame, cells: int) -> DataFrame:
    """Rows of _PEELED: recovered pairs, and for a bucket that failed one row of sign 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pd.DataFrame] = []

        def solve(pdf: pd.DataFrame) -> Iterator[pa.RecordBatch]:
            step, bucket, cell, n = (pdf[c].to_numpy() for c in ("snapshot_no", "bucket", "cell", "n"))
            xors = pdf[["x_tail", "x_head", "x_vh", "x_check"]].to_numpy(np.int64)
            first = np.flatnonzero(np.r_[True, (step[1:] != step[:-1]) | (bucket[1:] != bucket[:-1])])
            key = np.repeat(np.arange(len(first)), np.diff(np.r_[first, len(pdf)]))
            many = max(1, CELLS_AT_ONCE // cells)
            for lo in range(0, len(first), many):
                a, b = np.searchsorted(key, [lo, lo + many])
                which, tail, head, vh, sign, ok = peel(key[a:b] - lo, cell[a:b].astype(np.int64), n[a:b].astype(np.int64), xors[a:b], cells)
                good, bad = ok[which], np.flatnonzero(~ok)
                none, at = np.zeros(len(bad), np.int64), first[lo + np.concatenate([which[good], bad])]
                yield pa.RecordBatch.from_pydict(
                    {
                        "snapshot_no": pa.array(step[at], pa.int32()),
                        "bucket": pa.array(bucket[at], pa.int64()),
                        **{k: pa.array(np.concatenate([x[good], none]), pa.int64()) for k, x in (("tail", tail), ("head", head), ("vh", vh))},
                        "sign": pa.array(np.concatenate([sign[good], none]), pa.int32()),
                    }
                )

        rows = 0
        for b in batches:
            held.append(b.to_pandas())
            rows += b.num_rows
            if rows < max(200_000, 4 * cells):
                continue
            pdf = pd.concat(held, ignore_index=True)
            last = (pdf["snapshot_no"] == pdf["snapshot_no"].iat[-1]) & (pdf["bucket"] == pdf["bucket"].iat[-1])
            yield from solve(pdf[~last])  # the last table may go on in the next batch
            held, rows = [pdf[last]], int(last.sum())
        if rows:
            yield from solve(pd.concat(held, ignore_index=True))

    whole = diff.repartition("snapshot_no", "bucket").sortWithinPartitions("snapshot_no", "bucket")
    return whole.mapInArrow(run, _PEELED)


def _exact(rows: DataFrame, steps: DataFrame, failed: DataFrame) -> DataFrame:
    """Differing pairs of failed buckets by comparing their rows: the way that always ends."""
    own = failed.withColumnRenamed("snapshot_no", "_step")
    joined = rows.join(F.broadcast(steps), "snapshot_no")
    later = joined.join(own, [joined.snapshot_no == own._step, joined.bucket == own.bucket], "left_semi")
    earlier = joined.join(own, [joined.next_no == own._step, joined.bucket == own.bucket], "left_semi")
    cols = ["bucket", "tail", "head", "vh"]
    both = later.select("snapshot_no", *cols, F.lit(1).alias("sign")).unionByName(
        earlier.select(F.col("next_no").alias("snapshot_no"), *cols, F.lit(-1).alias("sign"))
    )
    return (
        both.groupBy("snapshot_no", *cols).agg(F.sum("sign").cast("int").alias("sign")).where("sign <> 0").select("snapshot_no", *cols, "sign")
    )


def snapshot_changes(
    records: DataFrame, bucket_pairs: int = BUCKET_PAIRS, cells: int = CELLS, growth: int = GROWTH, rounds: int = ROUNDS
) -> DataFrame:
    """(snapshot_no, tail, head, change): what each snapshot added, removed or changed against the one before it.

    records: snapshot_no int, delivery_no int, rec_no long, tail long, head long, weight float. What counts as content
    is told at latest_snapshots. ``snapshot_no`` is the later one; the first snapshot yields nothing, nor does an empty
    table. ``change`` is ``removed``, ``added`` or ``changed`` (in both, with another weight: null equals null, NaN
    equals NaN, null differs from NaN, 0.0 equals -0.0). Weights differ here if their 64-bit hashes do.
    """
    spark = records.sparkSession
    ws = Workspace(spark, "snapshots")
    rows = ws.save(latest_snapshots(records).drop("weight"), "rows")
    every = Window.partitionBy(F.lit(0)).orderBy("snapshot_no")  # one row for each snapshot
    there = records.where("snapshot_no is not null").select("snapshot_no").distinct()  # also those without content
    sizes = there.join(rows.groupBy("snapshot_no").count(), "snapshot_no", "left").fillna(0, ["count"])
    steps = ws.save(
        sizes.select("snapshot_no", "count", F.lead("snapshot_no").over(every).alias("next_no"), (F.row_number().over(every) > 1).alias("has_previous")),
        "steps",
    )
    largest = steps.agg(F.max("count")).first()[0] or 0
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64("tail", "head"), F.lit(max(1, -(-largest // bucket_pairs)))))
    todo, wanted, found = rows, None, []
    for k in range(rounds):
        diff = subtract_sketches(sketch_snapshots(todo, cells), steps)
        if wanted is not None:
            diff = diff.join(wanted, ["snapshot_no", "bucket"], "left_semi")
        peeled, seen = ws.save_counted(_peel_all(diff, cells), f"peeled{k}", failed=F.sum((F.col("sign") == 0).cast("int")))
        found.append(peeled.where("sign <> 0"))
        if not seen["failed"]:
            break
        wanted = peeled.where("sign = 0").select("snapshot_no", "bucket")
        before = steps.select(F.col("snapshot_no").alias("_before"), F.col("next_no").alias("snapshot_no"))
        needed = wanted.unionByName(wanted.join(F.broadcast(before), "snapshot_no").select(F.col("_before").alias("snapshot_no"), "bucket"))
        todo = rows.join(needed, ["snapshot_no", "bucket"], "left_semi")
        cells *= growth
    else:
        found.append(_exact(rows, steps, wanted))
    pairs = found[0]
    for more in found[1:]:
        pairs = pairs.unionByName(more)
    came, went = F.max(F.col("sign") > 0), F.max(F.col("sign") < 0)
    change = F.when(came & went, "changed").when(came, "added").otherwise("removed")
    return pairs.groupBy("snapshot_no", "tail", "head").agg(change.alias("change"))
