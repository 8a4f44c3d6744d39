"""Top N items of every group by statistics-guided skipping.

Records are clustered into Parquet files by (group, score descending, item), so a group of millions of items lies in many
row groups whose scores fall from one to the next. The row groups' statistics, from the footers of all files, make a
table. First are read the row groups of several groups and, of every group that fills row groups of its own, the one of
greatest maximum: they give each such group's N-th score, which holds across all files. A row group of one group whose
maximum lies strictly below it isn't read, nor one that only ties with it and whose least item comes after the N-th.
What is left is read in descending maximum, while each file's tasks keep their groups' current N-th.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import require_columns
from ..workspace import Workspace

#: Row groups, the unit that is read or skipped, that a table is cut into, and bounds on the rows of one.
ROW_GROUPS, LEAST_ROWS, MOST_ROWS = 2000, 1024, 1_000_000
#: Parts that one row which is repeated very often may be spread over.
SALTS = 1024
#: Rows that are read at once.
SLICE = 500_000


def scored_records(records: DataFrame, group: str, item: str, score: str) -> DataFrame:
    """(grp, item, score) of the rows with none of the three null or NaN; -0.0 becomes 0.0."""
    require_columns(records, group, item, score)
    s = F.col(score).cast("double")
    rows = records.where(F.col(group).isNotNull() & F.col(item).isNotNull() & s.isNotNull() & ~F.isnan(s))
    return rows.select(F.col(group).alias("grp"), F.col(item).alias("item"), (s + F.lit(0.0)).alias("score"))


def row_group_size(n: int) -> int:
    """Rows of a row group for a table of n rows: a group that holds a share of the rows has that share of all row groups."""
    return max(LEAST_ROWS, min(MOST_ROWS, n // ROW_GROUPS))


def cluster(scored: DataFrame, ws: Workspace, tag: str, rows: int) -> list[str]:
    """Writes the files, the only shuffle of all records; returns their names.

    Range parts split a hot group between its scores and items, and a row that is repeated very often by a salt.
    """
    order = [F.col("grp"), F.desc("score"), F.col("item"), F.col("_salt")]
    salted = scored.withColumn("_salt", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(SALTS)).cast("int"))
    laid = salted.repartitionByRange(*order).sortWithinPartitions(*order).drop("_salt")
    ws.save(laid, tag, **{"parquet.block.row.count.limit": str(rows), "parquet.page.row.count.limit": str(rows)})
    return ws.files(tag)


def open_parquet(address: str) -> pq.ParquetFile:
    if address.startswith("file:/") and not address.startswith("file://"):
        address = "file://" + address[5:]
    fs, path = pafs.FileSystem.from_uri(address.replace("s3a://", "s3://", 1))
    return pq.ParquetFile(path, filesystem=fs)


def footer(address: str) -> list[tuple]:
    """(row group, least and greatest group, greatest score, least item, known) of a file; unknown ones have None."""
    f = open_parquet(address)
    names = f.schema_arrow.names
    at = [names.index(c) for c in ("grp", "score", "item")]
    out = []
    for k in range(f.metadata.num_row_groups):
        rg = f.metadata.row_group(k)
        g, s, i = (rg.column(c).statistics for c in at)
        if all(x is not None and x.has_min_max for x in (g, s, i)):
            out.append((k, g.min, g.max, s.max, i.min, True))
        else:
            out.append((k, None, None, None, None, False))
    return out


def _first_items(f: pq.ParquetFile, groups: list[int], n: int) -> pa.Table:
    """The n best different items of every group in some row groups of a file, which are sorted."""
    t = f.read_row_groups(sorted(groups), columns=["grp", "item", "score"])
    pdf = t.select(["grp", "item"]).to_pandas()
    fresh = ~pdf.duplicated()  # an item's first row has its greatest score
    place = fresh.groupby(pdf["grp"], sort=False).cumsum()
    return t.filter(pa.array((fresh & (place <= n)).to_numpy()))


def read_slices(address: str, groups: list[int], n: int) -> Iterator[tuple[pa.Table, int]]:
    """Candidates of the asked row groups of a file, in slices, with the row groups of each."""
    f, held, rows = open_parquet(address), [], 0
    for k in sorted(groups):
        held.append(k)
        rows += f.metadata.row_group(k).num_rows
        if rows >= SLICE:
            yield _first_items(f, held, n), len(held)
            held, rows = [], 0
    if held:
        yield _first_items(f, held, n), len(held)


def beyond(most: float, least_item, nth: tuple | None) -> bool:
    """Whether nothing of a row group can be among a group's best: nth is its (score, item) of place N, if known."""
    return nth is not None and (most < nth[0] or (most == nth[0] and least_item > nth[1]))


def read_descending(address: str, groups: list[tuple], n: int) -> Iterator[tuple[pa.Table, int]]:
    """Candidates of row groups (number, group, greatest score, least item, N-th of the group), by descending score."""
    f = open_parquet(address)
    best: dict[object, dict[object, float]] = {}
    for k, grp, most, least_item, nth in sorted(groups, key=lambda x: (-x[2], x[0])):
        own = best.setdefault(grp, {})
        if len(own) >= n:
            here = max((-s, i) for i, s in own.items())
            nth = min(((-nth[0], nth[1]), here) if nth is not None else (here,))
            nth = (-nth[0], nth[1])
        if beyond(most, least_item, nth):
            continue
        t = _first_items(f, [k], n)
        for i, s in zip(t["item"].to_pylist(), t["score"].to_pylist()):
            own[i] = max(s, own.get(i, s))
        for i, _ in sorted(own.items(), key=lambda x: (-x[1], x[0]))[n:]:
            del own[i]
        yield t, 1


def _read(todo: DataFrame, files: list[str], kinds: dict[str, str], n: int, descending: bool) -> DataFrame:
    """(grp, item, score, row_groups_read): candidates, and a row without item for what has been read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.to_pylist():
                address = files[row["k"]]
                if descending:
                    asked = [(x["rg"], x["lo"], x["smax"], x["imin"], None if x["nth_score"] is None else (x["nth_score"], x["nth_item"])) for x in row["todo"]]
                    slices = read_descending(address, asked, n)
                else:
                    slices = read_slices(address, [x["rg"] for x in row["todo"]], n)
                for t, many in slices:
                    for part in t.combine_chunks().to_batches():
                        cols = [part.column(c) for c in ("grp", "item", "score")]
                        yield pa.RecordBatch.from_arrays([*cols, pa.array([0] * part.num_rows, pa.int32())], names=_NAMES)
                    none = [pa.nulls(1, t.schema.field(c).type) for c in ("grp", "item", "score")]
                    yield pa.RecordBatch.from_arrays([*none, pa.array([many], pa.int32())], names=_NAMES)

    cols = [c for c in todo.columns if c != "k"]
    each = todo.groupBy("k").agg(F.collect_list(F.struct(*cols)).alias("todo"))  # the row groups of one file
    each = each.repartitionByRange(max(1, len(files)), "k")  # a file for each task
    return each.mapInArrow(run, f"grp {kinds['grp']}, item {kinds['item']}, score double, row_groups_read int")


_NAMES = ["grp", "item", "score", "row_groups_read"]


def _ranked(candidates: DataFrame, n: int) -> DataFrame:
    """The n best different items of every group: (grp, item, score, place)."""
    best = candidates.where(F.col("item").isNotNull()).groupBy("grp", "item").agg(F.max("score").alias("score"))
    w = Window.partitionBy("grp").orderBy(F.desc("score"), F.col("item"))
    return best.select("grp", "item", "score", F.row_number().over(w).alias("place")).where(F.col("place") <= n)


def top_n_read(records: DataFrame, group: str, item: str, score: str, n: int) -> tuple[DataFrame, DataFrame]:
    """What ``top_n_per_group`` gives, and (row_groups_read, row_groups)."""
    if n < 1:
        raise ValueError("n must be at least 1")
    spark = records.sparkSession
    ws = Workspace(spark, "topn")
    scored = scored_records(records, group, item, score)
    kinds = {f.name: f.dataType.simpleString() for f in scored.schema}
    files = cluster(scored, ws, "clustered", row_group_size(records.count()))

    def stats(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in b.column(0).to_pylist():
                f = open_parquet(files[k]).schema_arrow
                types = [pa.int32(), f.field("grp").type, f.field("grp").type, pa.float64(), f.field("item").type, pa.bool_()]
                cols = list(zip(*footer(files[k]))) or [()] * 6
                rows = [pa.array(c, t) for c, t in zip(cols, types)]
                yield pa.RecordBatch.from_arrays([pa.array([k] * len(rows[0]), pa.int32()), *rows], names=["k", "rg", "lo", "hi", "smax", "imin", "known"])

    listed = spark.createDataFrame([(k,) for k in range(len(files))], "k int").repartitionByRange(max(1, len(files)), "k")
    table = ws.save(listed.mapInArrow(stats, f"k int, rg int, lo {kinds['grp']}, hi {kinds['grp']}, smax double, imin {kinds['item']}, known boolean"), "stats")
    whole = table.where("known and lo = hi")
    lead = whole.groupBy("lo").agg(F.min(F.struct(-F.col("smax"), "imin", "k", "rg")).alias("_l")).select(F.col("_l.k").alias("k"), F.col("_l.rg").alias("rg"))
    mixed = table.where("not known or lo <> hi").select("k", "rg")
    first = ws.save(_read(mixed.unionByName(lead), files, kinds, n, False), "first")
    # of groups with row groups of their own, which are no more than row groups
    nth = _ranked(first.join(whole.select(F.col("lo").alias("grp")).distinct(), "grp", "left_semi"), n).where(F.col("place") == n)
    nth = nth.select(F.col("grp").alias("lo"), F.col("score").alias("nth_score"), F.col("item").alias("nth_item"))
    rest = whole.join(lead, ["k", "rg"], "left_anti").join(nth, "lo", "left")
    rest = rest.where("nth_score is null or smax > nth_score or (smax = nth_score and imin <= nth_item)")
    more = ws.save(_read(rest.select("k", "rg", "lo", "smax", "imin", "nth_score", "nth_item"), files, kinds, n, True), "more")
    found = first.unionByName(more)
    ranked = _ranked(found, n).select(F.col("grp").alias(group), F.col("item").alias(item), F.col("score").alias(score), "place")
    read = found.agg(F.coalesce(F.sum("row_groups_read"), F.lit(0)).cast("long").alias("row_groups_read"))
    there = table.agg(F.count(F.lit(1)).alias("row_groups"))
    both = read.select("row_groups_read", F.lit(None).cast("long").alias("row_groups")).unionByName(there.select(F.lit(None).cast("long").alias("row_groups_read"), "row_groups"))
    return ranked, both.agg(F.max("row_groups_read").alias("row_groups_read"), F.max("row_groups").alias("row_groups"))


def top_n_per_group(records: DataFrame, group: str, item: str, score: str, n: int) -> DataFrame:
    """The n items of every group with the highest scores: (group, item, score, place).

    An item's score is the greatest of its rows; at equal score the smaller item goes first, so the result is always the
    same. Rows with a null in any of the three, or a NaN score, don't count; 0.0 equals -0.0. Groups of fewer than n items
    come out whole; an empty table gives no rows. Extra columns are ignored.
    """
    return top_n_read(records, group, item, score, n)[0]
