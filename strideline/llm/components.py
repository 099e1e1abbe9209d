"""Connected components of a link table, in saved tables."""

from __future__ import annotations

from pyspark.sql import DataFrame

from strideline.operators import graph
from strideline.operators.graph import salted  # noqa: F401

from .common import dropped, saved


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """v, c: each linked vertex and the smallest vertex of its component; rounds are written to the shared folder."""
    return graph.components(links, a, b, keep=saved, drop=dropped)
