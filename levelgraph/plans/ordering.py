"""Positions in a total order, without gathering the rows in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..workspace import Workspace


def with_row_number(df: DataFrame, order: list[str], name: str, total: str | None = None) -> DataFrame:
    """df with the row's place from 1 in ascending order, and if asked the number of all rows.

    Rows are range-parted and sorted, numbered within their partition, and shifted by the rows of the partitions before.
    The parted rows are written once, as both counts and rows are read from them. Equal rows may take each other's place.
    """
    ws = Workspace(df.sparkSession, "order")
    cols = [F.col(c) for c in order]
    local = F.monotonically_increasing_id()  # partition number in the upper bits, row number in the lower 33
    laid = df.repartitionByRange(*cols).sortWithinPartitions(*cols).withColumn("_id", local)
    laid = ws.save(laid.withColumns({"_part": F.shiftright("_id", 33), "_row": F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))}).drop("_id"), "laid")
    every = Window.partitionBy(F.lit(0))  # one row for each partition
    counts = laid.groupBy("_part").agg(F.count(F.lit(1)).alias("_c"))
    counts = counts.select("_part", (F.sum("_c").over(every.orderBy("_part")) - F.col("_c")).alias("_before"), F.sum("_c").over(every).alias("_total"))
    out = laid.join(F.broadcast(counts), "_part")
    more = [F.col("_total").alias(total)] if total else []
    return out.select(*df.columns, (F.col("_before") + F.col("_row") + 1).alias(name), *more)
