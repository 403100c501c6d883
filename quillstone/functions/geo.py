"""Mercator coordinates and their bounding box."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Radius of the sphere, in metres (fixed value).
RADIUS = 6378137.0


def lon_to_x(lon: Column) -> Column:
    return F.radians(lon) * RADIUS


def x_to_lon(x: Column) -> Column:
    return F.degrees(x / RADIUS)


def lat_to_y(lat: Column) -> Column:
    return F.ln(F.tan(F.radians(lat) / 2 + math.pi / 4)) * RADIUS


def y_to_lat(y: Column) -> Column:
    return F.degrees(F.atan(F.exp(y / RADIUS)) * 2 - math.pi / 2)


def normalised(nodes: DataFrame, scale: float = 1.0) -> DataFrame:
    """``(id, x, y)``: projected, moved so that the box starts at 0, longest side ``scale``, y downwards."""
    p = nodes.select("id", lon_to_x(F.col("lon")).alias("px"), lat_to_y(F.col("lat")).alias("py"))
    box = p.agg(F.min("px").alias("x0"), F.max("px").alias("x1"), F.min("py").alias("y0"), F.max("py").alias("y1"))
    side = F.nullif(F.greatest(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")), F.lit(0.0))
    unit = F.coalesce(F.lit(scale) / side, F.lit(0.0))
    return p.join(F.broadcast(box)).select("id", ((F.col("px") - F.col("x0")) * unit).alias("x"), ((F.col("y1") - F.col("py")) * unit).alias("y"))
