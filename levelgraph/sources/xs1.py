"""Binary edge records of type 1: little-endian uint32 tail, uint32 head, float32 weight; 12 bytes each."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RECORD = np.dtype([("tail", "<u4"), ("head", "<u4"), ("weight", "<f4")])
#: Records that one task reads at a stretch, or more, where there would be more than so many stretches.
STRETCH, MOST_STRETCHES = 4_000_000, 20_000


def _open(address: str) -> tuple[pafs.FileSystem, str]:
    if "://" in address:
        return pafs.FileSystem.from_uri(address.replace("s3a://", "s3://", 1))
    return pafs.LocalFileSystem(), address.removeprefix("file:")


def _files(address: str) -> list[tuple[str, int]]:
    fs, path = _open(address)
    info = fs.get_file_info(path)
    if info.type == pafs.FileType.NotFound:
        raise FileNotFoundError(address)
    if info.type == pafs.FileType.File:
        return [(info.path, info.size)]
    inside = fs.get_file_info(pafs.FileSelector(path))
    return sorted((i.path, i.size) for i in inside if i.extension in ("xs1", "dat"))


def read_ini(address: str) -> dict[str, str]:
    """The key = value lines of a sidecar; empty if there is none."""
    fs, path = _open(address)
    if fs.get_file_info(path + ".ini").type != pafs.FileType.File:
        return {}
    with fs.open_input_stream(path + ".ini") as f:
        lines = f.read().decode().splitlines()
    return {k.strip(): v.strip() for k, _, v in (x.partition("=") for x in lines if "=" in x)}


def read_xs1(spark: SparkSession, address: str, weights: bool = True, place: bool = False) -> DataFrame:
    """(src, dst, weight) of a file, or of the .xs1 and .dat files of a folder, in stretches that tasks share out.

    ValueError for a size that isn't whole records, or a sidecar that names another type. Records are read as they are:
    repeated ones and NaN weights stay. place: also ``_place``, by which the records come in the order of the files.
    """
    rows = []
    files = _files(address)
    stretch = max(STRETCH, -(-sum(size for _, size in files) // (RECORD.itemsize * MOST_STRETCHES)))
    for path, size in files:
        kind = read_ini(address if address.endswith(path) else path).get("type", "1")
        if kind != "1":
            raise ValueError(f"{path}: type {kind} isn't supported")
        if size % RECORD.itemsize:
            raise ValueError(f"{path}: {size} bytes are not whole records")
        n = size // RECORD.itemsize
        rows += [(path, lo, min(stretch, n - lo)) for lo in range(0, n, stretch)]
    columns = "src long, dst long" + ", weight float" * weights + ", _place struct<file: string, record: bigint>" * place

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, lo, n in zip(*(c.to_pylist() for c in b.columns)):
                fs, _ = _open(address)
                with fs.open_input_file(path) as f:
                    f.seek(lo * RECORD.itemsize)
                    r = np.frombuffer(f.read(n * RECORD.itemsize), RECORD)
                cols = [pa.array(r["tail"].astype(np.int64)), pa.array(r["head"].astype(np.int64))]
                cols += [pa.array(r["weight"])] * weights
                if place:
                    cols.append(pa.StructArray.from_arrays([pa.array([path] * len(r)), pa.array(np.arange(lo, lo + len(r)))], names=["file", "record"]))
                yield pa.RecordBatch.from_arrays(cols, names=["src", "dst", *["weight"] * weights, *["_place"] * place])

    plan = spark.createDataFrame(pd.DataFrame(rows, columns=["path", "first", "n"]) if rows else [], "path string, first long, n long")
    return plan.repartition(max(1, len(rows))).mapInArrow(read, columns) if rows else plan.limit(0).mapInArrow(read, columns)


def write_xs1(edges: DataFrame, address: str, name: str = "edges") -> None:
    """Writes a folder of part files, one for each task, and its sidecar. A null weight becomes NaN; without one, 1.

    ValueError for ids that need more than 32 bits, FileExistsError if the folder is there.
    """
    fs, root = _open(address)
    if fs.get_file_info(root).type != pafs.FileType.NotFound:
        raise FileExistsError(address)
    fs.create_dir(root)
    weight = F.col("weight").cast("float") if "weight" in edges.columns else F.lit(1.0).cast("float")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        out, path = _open(address)
        part, n, most = TaskContext.get().partitionId(), 0, -1
        target = f"{path}/part-{part:05d}.xs1"
        with out.open_output_stream(f"{target}.tmp") as f:
            for b in batches:
                src, dst = (np.asarray(c.to_numpy(zero_copy_only=False), np.int64) for c in b.columns[:2])
                if len(src) and (min(src.min(), dst.min()) < 0 or max(src.max(), dst.max()) > 2**32 - 1):
                    raise ValueError("an id needs more than 32 bits")
                r = np.empty(len(src), RECORD)
                r["tail"], r["head"], r["weight"] = src, dst, b.column(2).to_numpy(zero_copy_only=False)
                f.write(r.tobytes())
                n += len(r)
                most = max(most, int(src.max(initial=-1)), int(dst.max(initial=-1)))
        out.move(f"{target}.tmp", target)  # a task that is run again replaces its part
        yield pa.RecordBatch.from_pydict({"n": pa.array([n], pa.int64()), "most": pa.array([most], pa.int64())})

    n, most = edges.select("src", "dst", weight.alias("weight")).mapInArrow(write, "n long, most long").agg(F.sum("n"), F.max("most")).first()
    write_ini(address, name, (most if most is not None else -1) + 1, n or 0)


def write_ini(address: str, name: str, vertices: int, edges: int, replace: bool = True) -> None:
    """Writes the sidecar; FileExistsError unless it may be replaced."""
    fs, path = _open(address)
    if not replace and fs.get_file_info(path + ".ini").type == pafs.FileType.File:
        raise FileExistsError(path + ".ini")
    with fs.open_output_stream(path + ".ini") as f:
        f.write(f"[graph]\ntype=1\nname={name}\nvertices={vertices}\nedges={edges}\n".encode())


def scan_ini(spark: SparkSession, address: str, name: str) -> dict[str, int]:
    """Writes a sidecar that isn't there yet from the records themselves."""
    most, n = read_xs1(spark, address, weights=False).agg(F.max(F.greatest("src", "dst")), F.count(F.lit(1))).first()
    found = {"vertices": 0 if most is None else most + 1, "edges": n}
    write_ini(address, name, replace=False, **found)
    return found


def snap_to_weighted(edges: DataFrame, seed: int, both_ways: bool = False) -> DataFrame:
    """edges with a random weight in [0, 1), settled by seed and ends; both_ways adds the reverse with the same weight."""
    draw = F.pmod(F.xxhash64("src", "dst", F.lit(seed)), F.lit(1 << 24)) / (1 << 24)
    e = edges.select("src", "dst", draw.cast("float").alias("weight"))
    return e.unionByName(e.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight")) if both_ways else e
