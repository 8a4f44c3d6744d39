"""Batches of edges, sliding windows of batches, and what is run on them."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..graph import Graph
from ..plans.ordering import with_row_number
from ..store import Store


def window_weights(graph: Graph) -> DataFrame:
    """(src, dst, weight, latest_level): how often each edge occurs in the graph's window, and where last."""
    return graph.view.groupBy("src", "dst").agg(F.count(F.lit(1)).alias("weight"), F.max("created_level").alias("latest_level"))


def all_window_weights(edges: DataFrame, window: int) -> DataFrame:
    """window_weights after every batch: (batch, src, dst, weight, latest_level).

    Each edge is sent, combined by batch, to the ``window`` batches that still see it; nothing is joined.
    """
    if window < 1:
        raise ValueError("a window holds at least one batch")
    own = edges.groupBy("src", "dst", "created_level").agg(F.count(F.lit(1)).alias("n"))
    last = edges.agg(F.max("created_level")).first()[0]
    sees = F.explode(F.sequence(F.col("created_level"), F.least(F.col("created_level") + window - 1, F.lit(last).cast("int")))).alias("batch")
    seen = own.select("src", "dst", "n", "created_level", sees)
    levels = edges.select(F.col("created_level").alias("batch")).distinct()
    return seen.join(levels, "batch", "left_semi").groupBy("batch", "src", "dst").agg(F.sum("n").alias("weight"), F.max("created_level").alias("latest_level"))


def numbered_batches(edges: DataFrame, order: list[str], batch: int) -> DataFrame:
    """edges with created_level: their place in an order, by batches of so many edges. An exact multiple makes no empty batch."""
    n = with_row_number(edges.drop("created_level"), order, "_n")
    return n.withColumn("created_level", F.floor((F.col("_n") - 1) / batch).cast("int")).drop("_n")


def replay(edges: DataFrame, window: int, task: Callable[[Graph], DataFrame], max_batches: int | None = None, compat_window: bool = False) -> Iterator[tuple[int, DataFrame]]:
    """(batch, task's result) after each batch of levelled edges, the task seeing the last ``window`` batches.

    compat_window: one batch fewer. The level is the batch number.
    """
    top = edges.agg(F.max("created_level")).first()[0]
    many = 0 if top is None else top + 1
    seen = window - 1 if compat_window else window
    for k in range(many if max_batches is None else min(many, max_batches)):
        yield k, task(Graph(edges).window(max(0, k - seen + 1), k))


def stream_into(
    source: DataFrame, store: Store, window: int, checkpoint: str, task: Callable[[Graph, int], None] | None = None, keep: bool = False
) -> StreamingQuery:
    """Starts a query that appends each micro-batch of a stream of (src, dst, ...) to the store as a level.

    After each one the task gets the window's graph. Levels that have left the window are deleted unless ``keep``. A
    batch that is delivered again after a failure replaces its own level, so levels are written once. Batches are of the
    source's making, such as one file each by maxFilesPerTrigger.
    """

    def take(batch: DataFrame, number: int) -> None:
        store.write_level(batch, number)
        low = max(0, number - window + 1)
        if task is not None:
            task(store.open(number, low).window(low, number), number)
        if not keep and low > 0:
            store.delete_level(low - 1)

    return source.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).start()


def event_time_weights(stream: DataFrame, time: str, length: str, slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """(window, src, dst, weight): occurrences in windows of event time, with a watermark for late rows."""
    w = F.window(time, length, slide) if slide else F.window(time, length)
    return stream.withWatermark(time, late).groupBy(w, "src", "dst").agg(F.count(F.lit(1)).alias("weight"))
