"""Tables that outlive one plan: written to the shared folder, so that they cut lineage and survive a lost executor."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

_own_root: dict[str, str] = {}


def shared_root(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or in local mode, where that is unset, a folder of our own."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if root:
        return root.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own_root:
        _own_root[app] = tempfile.mkdtemp(prefix="levelgraph-")
    return _own_root[app]


_open: list[Workspace] = []


@contextmanager
def scope() -> Iterator[None]:
    """Removes the intermediate tables of all that is called inside, once its results aren't needed any more."""
    before = len(_open)
    try:
        yield
    finally:
        while len(_open) > before:
            _open.pop().close()


@atexit.register
def _close_all() -> None:
    while _open:
        _open.pop().close()


class Workspace:
    """A folder of intermediate Parquet tables of one operator call.

    ``save`` writes a table and reads it back, ``drop`` removes one that has been superseded. What is left goes when a
    ``scope`` or the driver ends, as returned DataFrames may still read it.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_root(spark)}/levelgraph-{name}-{uuid.uuid4().hex[:12]}"
        _open.append(self)

    def path(self, tag: str) -> str:
        return f"{self.root}/{tag}"

    def save(self, df: DataFrame, tag: str, **options) -> DataFrame:
        df.write.options(compression="zstd", **options).parquet(self.path(tag))
        return self.spark.read.schema(df.schema).parquet(self.path(tag))

    def save_counted(self, df: DataFrame, tag: str, **more) -> tuple[DataFrame, dict]:
        """As ``save``; also aggregates over the rows, taken while they are written. ``n`` is their number."""
        seen = Observation()
        saved = self.save(df.observe(seen, F.count(F.lit(1)).alias("n"), *(c.alias(k) for k, c in more.items())), tag)
        return saved, seen.get

    def drop(self, *tags: str) -> None:
        for tag in tags:
            self._delete(self.path(tag))

    def qualified(self, tag: str) -> str:
        """The table's address with its scheme."""
        p = self._hadoop_path(self.path(tag))
        return p.getFileSystem(self._conf()).makeQualified(p).toString()

    def files(self, tag: str) -> list[str]:
        p = self._hadoop_path(self.path(tag))
        found = p.getFileSystem(self._conf()).listStatus(p)
        return sorted(s.getPath().toString() for s in found if s.getPath().getName().endswith(".parquet"))

    def close(self) -> None:
        try:
            self._delete(self.root)
        except Exception:  # the JVM has gone before us
            pass

    def _conf(self):
        return self.spark.sparkContext._jsc.hadoopConfiguration()

    def _hadoop_path(self, path: str):
        return self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)

    def _delete(self, path: str) -> None:
        p = self._hadoop_path(path)
        p.getFileSystem(self._conf()).delete(p, True)
