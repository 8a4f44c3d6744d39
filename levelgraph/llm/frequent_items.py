"""Most frequent values of a column, by code-based identification.

Values are hashed to groups. Each value is written as a Reed-Solomon codeword of byte symbols; each group tracks, for
every position of the codeword, its heaviest symbols. A frequent value outweighs the rest of its group at most positions,
so its codeword can be read off and decoded, though nothing about the hundreds of millions of rare values is kept. The
decoded candidates are then counted exactly. Each group's rows are counted too: a group whose rows, less its candidates'
rows, could still hide a frequent value is looked at again with other groups, until none could.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import require_columns
from ..functions.hashing import np_xxhash64
from ..workspace import Workspace

#: Symbols of data (the bytes of 64 bits) and of a codeword; four may be missing, or two wrong.
DATA, WORD = 8, 12
#: Symbols kept for a position of a group.
TRACKED = 3
#: Groups for each value that can reach the share.
GROUPS_EACH = 8
#: Rows that a task combines before it adds them to its counters.
COMBINE_ROWS = 500_000


def _field() -> tuple[np.ndarray, np.ndarray]:
    """Powers and logarithms of GF(256) with the polynomial x^8 + x^4 + x^3 + x^2 + 1."""
    power, log, x = np.zeros(512, np.int64), np.zeros(256, np.int64), 1
    for i in range(255):
        power[i], log[x] = x, i
        x = (x << 1) ^ (0x11D if x & 0x80 else 0)
    power[255:510] = power[:255]
    return power, log


_POWER, _LOG = _field()


def _mul(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.where((a == 0) | (b == 0), 0, _POWER[_LOG[a] + _LOG[b]])


@lru_cache(4096)
def _lagrange(known: tuple[int, ...], wanted: tuple[int, ...]) -> np.ndarray:
    """Matrix that takes the symbols at DATA known positions to those at the wanted ones."""
    out = np.zeros((len(wanted), len(known)), np.int64)
    for r, x in enumerate(wanted):
        for c, i in enumerate(known):
            up = down = 0
            for j in known:
                if j != i:
                    if x == j:
                        up = None
                        break
                    up, down = up + _LOG[x ^ j], down + _LOG[i ^ j]
            out[r, c] = 0 if up is None else _POWER[(up - down) % 255]
    return out


_PARITY = _lagrange(tuple(range(DATA)), tuple(range(DATA, WORD)))
_TIMES = [[_mul(np.arange(256), np.full(256, c)).astype(np.uint8) for c in row] for row in _PARITY]


def encode(values: np.ndarray) -> np.ndarray:
    """The WORD symbols of each int64."""
    data = np.ascontiguousarray(values, np.int64).view(np.uint8).reshape(-1, 8)
    word = np.empty((len(values), WORD), np.uint8)
    word[:, :DATA] = data
    for r, row in enumerate(_TIMES):
        word[:, DATA + r] = np.bitwise_xor.reduce([t[data[:, c]] for c, t in enumerate(row)])
    return word


def decode(symbols: np.ndarray, trust: np.ndarray) -> list[int]:
    """Values whose codeword agrees with at least WORD - 2 of the symbols, or with all but four of least trust."""
    order = np.argsort(trust, kind="stable")
    found: list[int] = []

    def attempt(known: tuple[int, ...], need: int) -> bool:
        data = [int(np.bitwise_xor.reduce(_mul(row, symbols[list(known)].astype(np.int64)))) for row in _lagrange(known, tuple(range(DATA)))]
        value = np.array(data, np.uint8).view(np.int64)[0]
        if int((encode(np.array([value]))[0] == symbols).sum()) >= need:
            found.append(int(value))
            return True
        return False

    if attempt(tuple(sorted(order[WORD - DATA :])), DATA + 1) or attempt(tuple(range(DATA)), WORD - 2):
        return found
    for out in combinations(range(WORD), 2):  # any two symbols may be wrong
        if attempt(tuple(i for i in range(WORD) if i not in out)[:DATA], WORD - 2):
            break
    return found


def _key64(df: DataFrame, name: str) -> Column:
    """64 bits for a value: an integer itself, the hash of anything else."""
    if isinstance(df.schema[name].dataType, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return F.col(name).cast("long")
    return F.xxhash64(F.col(name))


_COUNTERS = "field_name string, grp int, pos int, symbol int, n long"


def _group_of(keys: np.ndarray, groups: int, seed: int) -> np.ndarray:
    return np.mod(np_xxhash64(keys, np.broadcast_to(np.int64(seed), len(keys))), groups)


def _count_symbols(groups: int, seed: int):
    """Counters of a task: the TRACKED heaviest symbols of every position of every group, less the next one's count.

    Position -1 has the group's rows. Lower bounds of that kind can be summed over tasks.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        rows: dict[str, np.ndarray] = {}
        held: dict[str, list[np.ndarray]] = {}

        def add(field: str) -> None:
            keys, n = np.unique(np.concatenate(held.pop(field)), return_counts=True)
            if field not in sums:
                sums[field], rows[field] = np.zeros(groups * WORD * 256, np.int32), np.zeros(groups, np.int64)
            g, word = _group_of(keys, groups, seed), encode(keys)
            rows[field] += np.bincount(g, n, groups).astype(np.int64)
            for p in range(WORD):
                at = (g * WORD + p) * 256 + word[:, p]
                np.add.at(sums[field], at, n.astype(np.int32))

        for b in batches:
            names = b.column(0)
            for field in names.unique().to_pylist():
                part = b.filter(pa.compute.equal(names, field)) if len(names.unique()) > 1 else b
                held.setdefault(field, []).append(part.column(1).to_numpy(zero_copy_only=False))
                if sum(map(len, held[field])) >= COMBINE_ROWS:
                    add(field)
        for field in list(held):
            add(field)
        for field, flat in sums.items():
            cube = flat.reshape(groups * WORD, 256)
            top = np.argpartition(cube, 255 - TRACKED, axis=1)[:, 255 - TRACKED :]
            n = np.take_along_axis(cube, top, axis=1).astype(np.int64)
            n -= n.min(axis=1, keepdims=True)
            at, k = np.nonzero(n)
            some = np.flatnonzero(rows[field])
            yield pa.RecordBatch.from_pydict(
                {
                    "field_name": pa.array([field] * (len(at) + len(some)), pa.string()),
                    "grp": pa.array(np.concatenate([at // WORD, some]), pa.int32()),
                    "pos": pa.array(np.concatenate([at % WORD, np.full(len(some), -1)]), pa.int32()),
                    "symbol": pa.array(np.concatenate([top[at, k], np.zeros(len(some), np.int64)]), pa.int32()),
                    "n": pa.array(np.concatenate([n[at, k], rows[field][some]]), pa.int64()),
                }
            )

    return run


def _read_off(groups: int, seed: int):
    """The candidates of a group, from its counters."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        grp = int(pdf["grp"].iat[0])
        body = pdf.sort_values(["pos", "n", "symbol"], ascending=[True, False, True])
        place = body.groupby("pos").cumcount().to_numpy()
        found: dict[int, int] = {}
        for rank in range(2):  # the heaviest symbols, then the next ones: a second frequent value in the group
            pick = body[place == rank]
            if len(pick) < WORD - 4:
                break
            symbols, trust = np.zeros(WORD, np.uint8), np.full(WORD, -1, np.int64)
            symbols[pick["pos"]] = pick["symbol"].to_numpy()
            trust[pick["pos"]] = pick["n"].to_numpy()
            for value in decode(symbols, trust):
                if int(_group_of(np.array([value], np.int64), groups, seed)[0]) == grp:
                    found.setdefault(value, int(np.median(trust)))
        rows = [(pdf["field_name"].iat[0], grp, v, n) for v, n in found.items()]
        return pd.DataFrame(rows, columns=["field_name", "grp", "key", "n_sketch"])

    return run


def frequent_items(columns: dict[str, tuple[DataFrame, str]], share: float = 0.01, max_rounds: int = 6) -> DataFrame:
    """Values that hold at least ``share`` of the rows in which their column isn't null; every row counts.

    columns: a name for each (table, column); all in one pass. Result: field_name, item (long for integer columns, else
    string), n_rows (exact), share, n_sketch (the lower estimate that identified it). Complete, not only likely so: a
    round ends with the rows of each group that its candidates don't explain, and groups where those reach the share go
    into another round; the values of those that still do after ``max_rounds`` are counted one by one, in an ordinary
    aggregation. Null is no value; NaN and 0.0 are values as Spark groups them; an empty table gives no rows. Memory: 12 KB
    for each of the GROUPS_EACH/share groups of a column and task, however many values there are.
    """
    if not 0 < share <= 1 or max_rounds < 1:
        raise ValueError("share must lie in (0, 1], and there is at least one round")
    spark = next(iter(columns.values()))[0].sparkSession
    ws = Workspace(spark, "frequent")
    groups = 1 << math.ceil(math.log2(GROUPS_EACH / share))
    whole = all(isinstance(df.schema[c].dataType, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)) for df, c in columns.values())
    keyed, valued = None, None
    for name, (df, c) in columns.items():
        require_columns(df, c)
        there = df.where(F.col(c).isNotNull())
        k = there.select(F.lit(name).alias("field_name"), _key64(df, c).alias("key"))
        v = there.select(F.lit(name).alias("field_name"), _key64(df, c).alias("key"), F.col(c).cast("long" if whole else "string").alias("item"))
        keyed, valued = (k, v) if keyed is None else (keyed.unionByName(k), valued.unionByName(v))
    of = lambda x: F.coalesce(F.create_map(*[F.lit(v) for pair in x.items() for v in pair])[F.col("field_name")], F.lit(0))
    candidates, rest, need = None, keyed, None
    for k in range(max_rounds):
        counted = rest.mapInArrow(_count_symbols(groups, k), _COUNTERS)
        counters = ws.save(counted.groupBy("field_name", "grp", "pos", "symbol").agg(F.sum("n").alias("n")), f"counters{k}")
        if need is None:  # the first round's groups hold all rows
            seen = counters.where("pos < 0").groupBy("field_name").agg(F.sum("n").alias("n")).collect()  # a row for each column
            totals = dict.fromkeys(columns, 0) | {r.field_name: r.n for r in seen}
            need = of({n: max(1, math.ceil(share * t - 1e-6)) for n, t in totals.items()})
        # only groups with enough rows can hold a frequent value: at most 1/share of them
        able = counters.where((F.col("pos") < 0) & (F.col("n") >= need)).select("field_name", "grp", F.col("n").alias("n_group"))
        body = counters.where("pos >= 0").join(F.broadcast(able), ["field_name", "grp"])
        read = body.groupBy("field_name", "grp").applyInPandas(_read_off(groups, k), "field_name string, grp int, key long, n_sketch long")
        fresh = ws.save(read, f"read{k}")  # at most two rows for each of those groups
        keys = F.broadcast(fresh.select("field_name", "key"))
        exact = rest.join(keys, ["field_name", "key"]).groupBy("field_name", "key").agg(F.count(F.lit(1)).alias("n_rows"))
        exact = ws.save(exact.join(F.broadcast(fresh), ["field_name", "key"]), f"exact{k}")
        candidates = exact if candidates is None else candidates.unionByName(exact)
        explained = exact.groupBy("field_name", "grp").agg(F.sum("n_rows").alias("n_found"))
        hides = F.col("n_group") - F.coalesce("n_found", F.lit(0)) >= need
        doubtful = ws.save(able.join(explained, ["field_name", "grp"], "left").where(hides).select("field_name", "grp"), f"doubtful{k}")
        if not doubtful.take(1):
            break
        group = F.pmod(F.xxhash64("key", F.lit(k).cast("long")), F.lit(groups)).cast("int")
        rest = rest.withColumn("grp", group).join(F.broadcast(doubtful), ["field_name", "grp"], "left_semi").select("field_name", "key")
        rest = rest.join(keys, ["field_name", "key"], "left_anti")
    else:  # the way that always ends: what the last doubtful groups still hold is counted value by value
        left = rest.groupBy("field_name", "key").agg(F.count(F.lit(1)).alias("n_rows")).where(F.col("n_rows") >= need)
        candidates = candidates.unionByName(ws.save(left.withColumn("n_sketch", F.col("n_rows")), "counted"), allowMissingColumns=True)
    total = of(totals)
    kept = candidates.where(F.col("n_rows") >= need)
    if whole:
        return kept.select("field_name", F.col("key").alias("item"), "n_rows", (F.col("n_rows") / total).alias("share"), "n_sketch")
    # behind one hash there may be several values: count the values themselves
    items = valued.join(F.broadcast(kept.select("field_name", "key", "n_sketch")), ["field_name", "key"])
    items = items.groupBy("field_name", "item", "n_sketch").agg(F.count(F.lit(1)).alias("n_rows")).where(F.col("n_rows") >= need)
    return items.select("field_name", "item", "n_rows", (F.col("n_rows") / total).alias("share"), "n_sketch")
