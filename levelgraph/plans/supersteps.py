"""Vertex-centred supersteps that are planned several at a time.

A superstep joins the state with edges that stay parted by their source, lets every row send itself and what it tells its
neighbours, and combines what arrives by key: one shuffle, and the state is used once, so that several supersteps make one
linear plan. Between blocks the state is written to the shared folder, which cuts lineage. The edges of a source that has
more than half a part's worth of them are spread over several parts, and its state is sent to each of these.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.heavy_keys import hot_keys_of, hot_keys_seen
from ..workspace import Workspace

#: Supersteps of a block.
BLOCK = 6


@dataclass
class Laid:
    """Edges in parts by ``key``; ``table`` is what they were laid from, n their number, hubs the sources that are spread."""

    edges: DataFrame
    key: str
    table: DataFrame
    n: int
    hubs: dict[int, int]

    def meet(self, state: DataFrame, at: str, active: Column | None = None, how: str = "left") -> DataFrame:
        """state joined with the edges whose key is its column ``at``, as far as ``active``; a copy for each part of a hub."""
        on = F.col(at) == F.col(self.key)
        if self.hubs:
            listed = state.sparkSession.createDataFrame(list(self.hubs.items()), "_hub long, _salts int")  # at most 4 for each part
            state = state.join(F.broadcast(listed), F.col(at) == F.col("_hub"), "left")
            state = state.withColumn("_copy", F.explode(F.sequence(F.lit(0), F.coalesce("_salts", F.lit(1)) - 1))).drop("_hub", "_salts")
            on = on & (F.col("_copy") == F.col("_salt"))
        return state.join(self.edges, on if active is None else on & active, how)

    def unpersist(self) -> None:
        self.edges.unpersist()


def parted(ws: Workspace, edges: DataFrame, key: str, tag: str) -> Laid:
    """edges laid out by key, as often as shuffles are parted, so that a state shuffled by its own key meets them in place.

    They are written first, and the keys that very many have are seen in the same pass.
    """
    places = int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    share = 1 / (2 * places)
    table, seen = ws.save_counted(edges, tag, hot=hot_keys_seen(key, share))
    hot = {k: c for k, c in hot_keys_of(seen["hot"], seen["n"], share).items() if c > share * seen["n"]}
    hubs = {k: min(places, -(-c * 2 * places // seen["n"])) for k, c in hot.items()}
    if not hubs:
        return Laid(table.repartition(places, key).persist(), key, table, seen["n"], {})
    salts = F.coalesce(F.element_at(F.create_map(*[F.lit(x).cast(t) for k, v in hubs.items() for x, t in ((k, "long"), (v, "int"))]), F.col(key)), F.lit(1))
    salted = table.withColumn("_salt", F.pmod(F.xxhash64(*table.columns), salts).cast("int"))
    return Laid(salted.repartition(places, key, "_salt").persist(), key, table, seen["n"], hubs)


def superstep(state: DataFrame, edges: Laid, at: str, active: Column, keep: Column, send: Column, keys: list[str], combine: list[Column]) -> DataFrame:
    """keep: a struct, each row as it stays; send: a struct of the same fields, what goes along each edge that leaves ``at``.

    Only rows that are ``active`` send; a row that meets no edge sends nothing. ``combine`` aggregates the fields by
    ``keys``. As a kept row is repeated for each edge it meets, combine takes it by max or min.
    """
    both = edges.meet(state, at, active).select(F.explode(F.array(keep, send)).alias("x")).where(F.col(f"x.{keys[-1]}").isNotNull())
    return both.select("x.*").groupBy(*keys).agg(*combine)


def run(ws: Workspace, state: DataFrame, step: Callable[[DataFrame, int], DataFrame], active: Callable[[int], Column], tag: str = "s", limit: int | None = None) -> tuple[DataFrame, int]:
    """Supersteps 0, 1, ... until no row is active after one; (state, supersteps). ValueError beyond limit."""
    k, before = 0, None
    while True:
        if limit is not None and k > limit:
            raise ValueError("no end after as many rounds as there are vertices, or as were allowed")
        for _ in range(BLOCK):
            state = step(state, k)
            k += 1
        name = f"{tag}{k}"
        state, seen = ws.save_counted(state, name, active=F.sum(active(k).cast("long")))
        if before:
            ws.drop(before)
        before = name
        if not seen["active"]:
            return state, k
