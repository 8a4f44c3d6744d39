"""Edge lists as text: tail, white space, head on each line; comments with # and blank lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: So many lines that can't be read end the load.
BAD_LINES = 100
_EDGE = r"^\s*(\d{1,10})\s+(\d{1,10})\s*$"
_MOST_ID = 2**32 - 1


def read_snap(spark: SparkSession, path: str, bad_lines: int = BAD_LINES, place: bool = False) -> DataFrame:
    """(src, dst) of every readable line. ValueError if ``bad_lines`` or more are neither edge, comment nor blank.

    place: also ``_place``, by which the lines come in the order of the file.
    """
    text = spark.read.text(path)
    at = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line"))
    lines = (text.select("value", at.alias("_place")) if place else text).where("trim(value) <> '' and not startswith(ltrim(value), '#')")
    more = ["_place"] if place else []
    both = lines.select(*more, F.regexp_extract("value", _EDGE, 1).alias("s"), F.regexp_extract("value", _EDGE, 2).alias("d"))
    ids = both.select(*more, F.expr("try_cast(s as bigint)").alias("src"), F.expr("try_cast(d as bigint)").alias("dst"))
    good = F.col("src").isNotNull() & F.col("dst").isNotNull() & (F.col("src") <= _MOST_ID) & (F.col("dst") <= _MOST_ID)
    if len(ids.where(~good).limit(bad_lines).take(bad_lines)) >= bad_lines:
        raise ValueError(f"{path}: {bad_lines} or more lines can't be read")
    return ids.where(good)


def write_snap(edges: DataFrame, path: str) -> None:
    edges.select(F.concat_ws("\t", F.col("src").cast("string"), F.col("dst").cast("string")).alias("value")).write.text(path)
