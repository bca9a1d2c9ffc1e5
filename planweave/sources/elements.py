"""Nested plans as one DataFrame per kind of element, keyed by plan and by place.

Each is a narrow explode: only the columns an operator asks for are read from
the nested Parquet, nothing is shuffled.  Null arrays have no elements.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from planweave.functions import geometry as G


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def exploded(plans: DataFrame, column: str) -> DataFrame:
    """(plan_id, ord, e) of each non-null member of an array column."""
    return plans.select("plan_id", F.posexplode(column).alias("ord", "e")).where("e is not null")


def walls(plans: DataFrame) -> DataFrame:
    """(plan_id, ord, wall_id, x1, y1, x2, y2, thickness, is_exterior); walls without both ends are left out."""
    e = exploded(plans, "walls")
    ends = [F.get(f"e.{p}", i).alias(n) for p, i, n in (("start_point", 0, "x1"), ("start_point", 1, "y1"), ("end_point", 0, "x2"), ("end_point", 1, "y2"))]
    return e.select("plan_id", "ord", F.col("e.id").alias("wall_id"), *ends, F.col("e.thickness").alias("thickness"), F.col("e.is_exterior").alias("is_exterior")).where("x1 is not null and y1 is not null and x2 is not null and y2 is not null")


def rooms(plans: DataFrame) -> DataFrame:
    """(plan_id, ord, room_id, category, name, area_m2, width_mm, length_mm, ring)."""
    e = exploded(plans, "rooms")
    return e.select("plan_id", "ord", F.col("e.id").alias("room_id"), "e.category", "e.name", "e.area_m2", "e.dimensions.width_mm", "e.dimensions.length_mm", F.coalesce(G.ring(F.col("e.polygon")), F.array().cast("array<struct<x:double,y:double>>")).alias("ring"))


def openings(plans: DataFrame, column: str) -> DataFrame:
    """(plan_id, ord, id, host_wall_id, x, y, width, height) of doors or windows; x and y may be null."""
    e = exploded(plans, column)
    return e.select("plan_id", "ord", F.col("e.id").alias("id"), F.col("e.host_wall_id").alias("host_wall_id"), F.get("e.insertion_point", 0).alias("x"), F.get("e.insertion_point", 1).alias("y"), "e.width", "e.height")
