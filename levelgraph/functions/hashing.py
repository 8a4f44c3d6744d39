"""Hashes that come out alike in Spark expressions and in numpy."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

# The primes of the public XXH64 algorithm, and the seed of Spark's xxhash64.
P1, P2, P3, P4, P5 = (
    np.uint64(x)
    for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5)
)
SEED = np.uint64(42)

#: Stands for a null in a hash; Spark's xxhash64 alone would skip nulls.
NULL_HASH = -7046029254386353131


def _left(x: np.ndarray, bits: int) -> np.ndarray:
    return (x << np.uint64(bits)) | (x >> np.uint64(64 - bits))


def np_xxhash64(*columns: np.ndarray) -> np.ndarray:
    """xxhash64 of bigint columns as Spark computes it, as int64."""
    h: np.ndarray | np.uint64 = SEED
    with np.errstate(over="ignore"):
        for c in columns:
            x = np.asarray(c, dtype=np.int64).view(np.uint64)
            h = (h + P5 + np.uint64(8)) ^ (_left(x * P2, 31) * P1)
            h = _left(h, 27) * P1 + P4
            h = (h ^ (h >> np.uint64(33))) * P2
            h = (h ^ (h >> np.uint64(29))) * P3
            h = h ^ (h >> np.uint64(32))
    return np.asarray(h, dtype=np.uint64).view(np.int64)


def value_hash(c: Column) -> Column:
    """64 bits of a value in which null has a value of its own, NaN equals NaN and 0.0 equals -0.0."""
    return F.when(c.isNull(), F.lit(NULL_HASH)).otherwise(F.xxhash64(c))
