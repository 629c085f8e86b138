"""Points are STRUCT<x, y> (longitude, latitude); distances are Haversine metres on a sphere of 6 371 km."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RADIUS = 6_371_000.0


def point(x: Column, y: Column) -> Column:
    return F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))


def distance(ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    dlat, dlon = F.radians(by - ay) / 2, F.radians(bx - ax) / 2
    h = F.sin(dlat) * F.sin(dlat) + F.cos(F.radians(ay)) * F.cos(F.radians(by)) * F.sin(dlon) * F.sin(dlon)
    return 2 * RADIUS * F.asin(F.sqrt(F.least(h, F.lit(1.0))))


def within(df: DataFrame, lon: float, lat: float, metres: float, x: str = "x", y: str = "y") -> DataFrame:
    """(doc_id, score): score 1 - distance / metres. A bounding box on the plain columns comes first, so scans prune by it."""
    dlat = math.degrees(metres / RADIUS)
    dlon = 360.0 if abs(lat) + dlat >= 89.999 else math.degrees(math.asin(min(1.0, math.sin(metres / RADIUS) / math.cos(math.radians(lat)))))
    box = F.col(y).between(lat - dlat, lat + dlat)
    if dlon < 180 and -180 <= lon - dlon and lon + dlon <= 180:
        box = box & F.col(x).between(lon - dlon, lon + dlon)
    d = distance(F.col(x), F.col(y), F.lit(float(lon)), F.lit(float(lat)))
    return df.where(box).select("doc_id", d.alias("d")).where(F.col("d") <= metres).select("doc_id", (1 - F.col("d") / metres).alias("score"))
