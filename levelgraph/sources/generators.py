"""Random graphs, the same for a seed however Spark parts the work: every draw is a hash of the edge's number."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.hashing import np_xxhash64


def erdos_renyi(spark: SparkSession, nodes: int, edges: int, seed: int = 0) -> DataFrame:
    """(src, dst): edges drawn uniformly with replacement; self-loops may occur."""
    if nodes < 1 or edges < 0:
        raise ValueError("there must be nodes, and no fewer than 0 edges")
    draw = lambda k: F.pmod(F.xxhash64("id", F.lit(seed), F.lit(k)), F.lit(nodes))
    return spark.range(edges).select(draw(1).cast("long").alias("src"), draw(2).cast("long").alias("dst"))


def rmat(spark: SparkSession, scale: int, degree: float, a: float = 0.57, b: float = 0.19, c: float = 0.19, seed: int = 0) -> DataFrame:
    """(src, dst): round(degree * 2^scale) edges, each by ``scale`` choices of a quadrant.

    Noise of 5 % on its chances adds up from one choice to the next; the first has none.
    """
    if not 1 <= scale <= 31:
        raise ValueError("scale must lie in 1..31")
    if min(a, b, c) < 0 or a + b + c > 1:
        raise ValueError("a, b, c are chances and add up to at most 1")
    chances = np.array([a, b, c, 1 - a - b - c])

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy()
            same = lambda x: np.broadcast_to(np.int64(x), len(ids))
            draw = lambda k: (np_xxhash64(ids, same(seed), same(k)).view(np.uint64) >> np.uint64(11)) / float(1 << 53)
            src, dst = np.zeros(len(ids), np.int64), np.zeros(len(ids), np.int64)
            noisy = np.repeat(chances[:, None], len(ids), axis=1)
            for bit in range(scale):
                if bit:
                    noisy = noisy * (0.95 + 0.1 * np.array([draw(8 * bit + q) for q in range(4)]))
                    noisy /= noisy.sum(axis=0)
                upto = np.cumsum(noisy, axis=0)
                quadrant = (draw(8 * bit + 4) >= upto[:3]).sum(axis=0)
                src, dst = (src << 1) | (quadrant >> 1), (dst << 1) | (quadrant & 1)
            yield pa.RecordBatch.from_pydict({"src": pa.array(src), "dst": pa.array(dst)})

    return spark.range(round(degree * 2**scale)).mapInArrow(make, "src long, dst long")


_SPEC = re.compile(r"\s*(ER|ErdosRenyi|Erdos-Renyi|RMAT|R-MAT)\s*\(([^()]*)\)\s*", re.I)


def is_spec(text: str) -> bool:
    return _SPEC.fullmatch(text) is not None


def from_spec(spark: SparkSession, text: str) -> DataFrame:
    """ER(nodes, edges [, seed]) or RMAT(scale, degree [, a, b, c [, seed]]); also ErdosRenyi(...) and R-MAT(...)."""
    m = _SPEC.fullmatch(text)
    if not m:
        raise ValueError(f"not a generator: {text}")
    args = [x.strip() for x in m[2].split(",")]
    if m[1].upper().startswith("E"):
        if len(args) not in (2, 3):
            raise ValueError("ER takes 2 or 3 numbers")
        return erdos_renyi(spark, *map(int, args))
    if len(args) not in (2, 5, 6):
        raise ValueError("RMAT takes 2, 5 or 6 numbers")
    return rmat(spark, int(args[0]), float(args[1]), *map(float, args[2:5]), **({"seed": int(args[5])} if len(args) == 6 else {}))
