"""Places in one order of all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strideline.operators import graph

#: monotonically_increasing_id counts a partition's rows in the bits below.
_ROWS = (1 << 33) - 1


def numbered(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """df with each row's place from 1 in an order of all rows.

    Rows are dealt by ranges of the order and counted within their range; only the ranges' counts, a row each, meet in one
    task. So no task sees all rows, as one would in a window without a key.
    """
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order)
    held = graph.checkpointed(ranged.withColumn("_n", F.monotonically_increasing_id()).withColumn("_p", F.shiftright("_n", 33)))
    sizes = held.groupBy("_p").agg(F.count("*").alias("_k"))
    before = sizes.select("_p", F.coalesce(F.sum("_k").over(W.orderBy("_p").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_k"))
    return held.join(F.broadcast(before), "_p").withColumn(name, F.col("_n").bitwiseAND(F.lit(_ROWS)) + F.col("_k") + 1).drop("_n", "_p", "_k")  # a row a partition
