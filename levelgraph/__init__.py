"""Level-versioned property graphs, their analyses and training-data operators, on Spark DataFrames."""

from .graph import Graph, visible

__all__ = ["Graph", "visible"]
