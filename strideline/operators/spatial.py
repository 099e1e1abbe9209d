"""Operators over places: distances, grid joins and the shape of closed lines."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

EARTH_M, DEGREE_M = 6371008.8, 111_195.0


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Metres between two places given in degrees."""
    h = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * EARTH_M * F.asin(F.sqrt(h))


def grid_join(a: DataFrame, b: DataFrame, metres: float, max_lat: float = 70.0, left: str = "l", right: str = "r") -> DataFrame:
    """Pairs of structs l, r of rows of a and b (columns lat, lon) at most so many metres apart; rows without a place have none.

    Rows meet in cells a little wider than the distance; the right side is copied into its nine neighbours, so this is
    an equi-join. Cells are wide enough up to max_lat; longitudes aren't wrapped at 180 degrees.
    """
    rows = 1.01 * metres / DEGREE_M
    columns = rows / math.cos(math.radians(max_lat))
    cell = lambda di=0, dj=0: F.struct((F.floor(F.col("lat") / rows) + di).alias("i"), (F.floor(F.col("lon") / columns) + dj).alias("j"))
    x = a.where("lat is not null and lon is not null").select(cell().alias("_cell"), F.struct(*a.columns).alias(left))
    nine = F.array(*(cell(i, j) for i in (-1, 0, 1) for j in (-1, 0, 1)))
    y = b.where("lat is not null and lon is not null").select(F.explode(nine).alias("_cell"), F.struct(*b.columns).alias(right))
    near = haversine(F.col(f"{left}.lat"), F.col(f"{left}.lon"), F.col(f"{right}.lat"), F.col(f"{right}.lon")) <= metres
    return x.join(y, "_cell").where(near).select(left, right)


def roundness(points: DataFrame, key: str, x: str, y: str, order: str) -> DataFrame:
    """key, roundness: 4 pi area over the squared length of the closed line through a key's points; null without length."""
    w = W.partitionBy(key).orderBy(order)
    p = points.select(key, order, F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))
    p = p.withColumn("u", F.coalesce(F.lead("x").over(w), F.first("x").over(w))).withColumn("v", F.coalesce(F.lead("y").over(w), F.first("y").over(w)))
    area = F.abs(F.sum(F.col("x") * F.col("v") - F.col("u") * F.col("y"))) / 2
    length = F.sum(F.sqrt(F.pow(F.col("u") - F.col("x"), 2) + F.pow(F.col("v") - F.col("y"), 2)))
    return p.groupBy(key).agg(area.alias("a"), length.alias("p")).select(key, F.when(F.col("p") > 0, 4 * math.pi * F.col("a") / (F.col("p") * F.col("p"))).alias("roundness"))
