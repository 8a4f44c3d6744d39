"""Checks and small expressions that several operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def require_columns(df: DataFrame, *names: str) -> None:
    """ValueError that names every column that is missing."""
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"missing column(s) {missing}; there are {df.columns}")


def number(c: Column) -> Column:
    """A floating value as double in which NaN is null and -0.0 is 0.0."""
    d = c.cast("double")
    return F.when(F.isnan(d), F.lit(None)).otherwise(d + F.lit(0.0))


def is_floating(df: DataFrame, name: str) -> bool:
    return isinstance(df.schema[name].dataType, (T.FloatType, T.DoubleType))
