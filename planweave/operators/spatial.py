"""Spatial joins within a plan: nearest segment, nearest polygon, overlapping boxes, points within a tolerance.

A plan is the equi key of every join.  Where a plan may hold very many
elements, a grid cell of the cut-off's size is added to the key: each segment
or box is listed in the cells it may reach, a point in its own, so the join
stays an equi join and a dense plan is spread over many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from planweave.functions import geometry as G
from planweave.functions.shared import by_shuffle


def _cells(low: Column, high: Column, size: float) -> Column:
    return F.sequence(F.floor(low / size), F.floor(high / size))


def in_cells(df: DataFrame, x1, y1, x2, y2, size: float) -> DataFrame:
    """df with (cx, cy), one row per grid cell the box touches."""
    out = df.withColumn("cx", F.explode(_cells(x1, x2, size)))
    return out.withColumn("cy", F.explode(_cells(y1, y2, size)))


def near_segment_cells(df: DataFrame, reach: float, size: float) -> DataFrame:
    """df of segments (x1, y1, x2, y2) with (cx, cy), one row per grid cell that may hold a point within reach: as many as the segment is long, not as its box is large."""
    c = F.col
    out = df.withColumn("cx", F.explode(_cells(F.least("x1", "x2") - reach, F.greatest("x1", "x2") + reach, size)))
    # The part of the segment that lies above the column of cells, widened by the reach.
    a = F.greatest(F.least("x1", "x2"), c("cx") * size - reach)
    b = F.least(F.greatest("x1", "x2"), (c("cx") + 1) * size + reach)
    slope = (c("y2") - c("y1")) / F.when(c("x2") != c("x1"), c("x2") - c("x1"))
    ends = [F.coalesce(c("y1") + (x - c("x1")) * slope, y) for x, y in ((a, c("y1")), (b, c("y2")))]
    # A step of rounding more, as the ends are computed.
    more = reach + F.abs(F.greatest(*ends)) * 1e-9 + 1e-6
    return out.withColumn("cy", F.explode(_cells(F.least(*ends) - more, F.greatest(*ends) + more, size)))


def at_cell(df: DataFrame, x, y, size: float) -> DataFrame:
    return df.withColumn("cx", F.floor(x / size)).withColumn("cy", F.floor(y / size))


def nearest_segment(points: DataFrame, segments: DataFrame, cutoff: float, cell: float | None = None) -> DataFrame:
    """Each point with its nearest segment of the same plan within the cut-off; the first in input order of equal ones.

    points: (plan_id, id, ord, x, y); segments: (plan_id, wall_id, ord, x1, y1, x2, y2).
    Points without coordinates or without a segment in reach have nulls.
    """
    cell = cell or max(4 * cutoff, 1.0)
    placed = at_cell(points.where("x is not null and y is not null"), F.col("x"), F.col("y"), cell)
    s = near_segment_cells(segments.select("plan_id", "wall_id", F.col("ord").alias("seg_ord"), "x1", "y1", "x2", "y2"), cutoff, cell)
    pairs = placed.join(s, ["plan_id", "cx", "cy"]).withColumn("d", G.segment_distance(*(F.col(c) for c in ("x", "y", "x1", "y1", "x2", "y2")))).where(F.col("d") <= cutoff)
    best = pairs.groupBy("plan_id", "id", "ord").agg(F.min(F.struct("d", "seg_ord", "wall_id")).alias("b"))
    return points.select("plan_id", "id", "ord").join(best, ["plan_id", "id", "ord"], "left").select("plan_id", "id", "ord", F.col("b.wall_id").alias("wall_id"), F.col("b.d").alias("distance"))


def _in_reach(points: DataFrame, polygons: DataFrame, cutoff: float, cell: float | None) -> DataFrame:
    """(plan_id, id, ord, d, room_ord, room_id) of each point and each polygon of its plan within the cut-off."""
    cell = cell or max(4 * cutoff, 1.0)
    placed = at_cell(points.where("x is not null and y is not null"), F.col("x"), F.col("y"), cell)
    b = polygons.where(F.size("ring") >= 3).select("plan_id", "room_id", F.col("ord").alias("room_ord"), G.edges(F.col("ring")).alias("edges"), G.bounds(F.col("ring")).alias("b"))
    b = in_cells(b, F.col("b.x1") - cutoff, F.col("b.y1") - cutoff, F.col("b.x2") + cutoff, F.col("b.y2") + cutoff, cell)
    return placed.join(by_shuffle(b), ["plan_id", "cx", "cy"]).withColumn("d", G.ring_distance(F.col("x"), F.col("y"), F.col("edges"))).where(F.col("d") <= cutoff).select("plan_id", "id", "ord", "d", "room_ord", "room_id")


def nearest_polygon(points: DataFrame, polygons: DataFrame, cutoff: float, cell: float | None = None) -> DataFrame:
    """Each point with the nearest polygon of its plan within the cut-off (0 inside); points without one are dropped.

    points: (plan_id, id, ord, x, y); polygons: (plan_id, room_id, ord, ring).
    """
    best = _in_reach(points, polygons, cutoff, cell).groupBy("plan_id", "id", "ord").agg(F.min(F.struct("d", "room_ord", "room_id")).alias("n"))
    return best.select("plan_id", "id", "ord", F.col("n.room_id").alias("room_id"), F.col("n.d").alias("distance"))


def two_polygons(points: DataFrame, polygons: DataFrame, cutoff: float, cell: float | None = None) -> DataFrame:
    """(plan_id, id, ord, a, b): the polygon nearest to a point's first place, and of the others the one nearest to its second.

    points: (plan_id, id, ord, side, x, y), the places of a point being its sides 0 and 1; polygons as above.
    Points with neither are dropped; where no polygon is near the first place, none is left out at the second.
    """
    keys = ["plan_id", "id", "ord"]
    sides = points.where("x is not null and y is not null").withColumn("ord", F.struct("ord", "side"))
    each = _in_reach(sides, polygons, cutoff, cell).groupBy(*keys, "room_id").agg(F.min(F.struct("d", "room_ord")).alias("n"))
    # Of the two nearest to the second place one at least is not the first's.
    ranked = each.withColumn("r", F.row_number().over(Window.partitionBy(*keys).orderBy("n", "room_id"))).where(F.col("r") <= 2)
    ranked = ranked.select("plan_id", "id", "ord.ord", "ord.side", "r", "room_id")
    pick = lambda side, r: F.max(F.when((F.col("side") == side) & (F.col("r") == r), F.col("room_id")))
    got = ranked.groupBy(*keys).agg(pick(0, 1).alias("a"), pick(1, 1).alias("b"), pick(1, 2).alias("c"))
    return got.select(*keys, "a", F.when(F.col("a") == F.col("b"), F.col("c")).otherwise(F.col("b")).alias("b"))


def overlapping_boxes(boxes: DataFrame, least: float, cell: float) -> DataFrame:
    """(plan_id, id_a, id_b, iou), ord_a < ord_b: boxes of one plan whose IoU is above the least.

    boxes: (plan_id, id, ord, b).  A pair that shares several cells is judged in the first of them only.
    """
    placed = in_cells(boxes, F.col("b.x1"), F.col("b.y1"), F.col("b.x2"), F.col("b.y2"), cell)
    a = placed.select("plan_id", "cx", "cy", F.col("id").alias("id_a"), F.col("ord").alias("ord_a"), F.col("b").alias("a"))
    c = placed.select("plan_id", "cx", "cy", F.col("id").alias("id_b"), F.col("ord").alias("ord_b"), F.col("b").alias("c"))
    pairs = a.join(c, ["plan_id", "cx", "cy"]).where("ord_a < ord_b")
    first = (F.floor(F.greatest("a.x1", "c.x1") / cell) == F.col("cx")) & (F.floor(F.greatest("a.y1", "c.y1") / cell) == F.col("cy"))
    return pairs.where(first).withColumn("iou", G.iou(F.col("a"), F.col("c"))).where(F.col("iou") > least).select("plan_id", "id_a", "id_b", "iou")


def first_within(points: DataFrame, targets: DataFrame, tolerance: float) -> DataFrame:
    """Each point with the first target (by order, not by distance) of its plan within the tolerance; left join.

    points: (plan_id, id, x, y); targets: (plan_id, target_id, target_ord, tx, ty).
    """
    cell = max(tolerance, 1e-9)
    p = at_cell(points, F.col("x"), F.col("y"), cell)
    t = in_cells(targets, F.col("tx") - tolerance, F.col("ty") - tolerance, F.col("tx") + tolerance, F.col("ty") + tolerance, cell)
    near = p.join(t, ["plan_id", "cx", "cy"]).where(G.length(F.col("x"), F.col("y"), F.col("tx"), F.col("ty")) <= tolerance)
    best = near.groupBy("plan_id", "id").agg(F.min(F.struct("target_ord", "target_id")).alias("b"))
    return points.select("plan_id", "id").join(best, ["plan_id", "id"], "left").select("plan_id", "id", F.col("b.target_id").alias("target_id"))


def near_pairs(points: DataFrame, distance: float) -> DataFrame:
    """(plan_id, id_a, id_b), ord_a < ord_b: points of one plan closer than the distance, by cells of that size and their neighbours."""
    a = in_cells(points, F.col("x") - distance, F.col("y") - distance, F.col("x") + distance, F.col("y") + distance, distance).select("plan_id", "cx", "cy", F.col("id").alias("id_a"), F.col("ord").alias("ord_a"), F.col("x").alias("xa"), F.col("y").alias("ya"))
    b = at_cell(points, F.col("x"), F.col("y"), distance).select("plan_id", "cx", "cy", F.col("id").alias("id_b"), F.col("ord").alias("ord_b"), "x", "y")
    pairs = a.join(b, ["plan_id", "cx", "cy"]).where("ord_a < ord_b")
    return pairs.where(G.length(F.col("xa"), F.col("ya"), F.col("x"), F.col("y")) < distance).select("plan_id", "id_a", "id_b")


def not_covered(boxes: DataFrame, covers: DataFrame, share: float, cell: float) -> DataFrame:
    """Boxes of whose area no single cover of their plan takes more than the share (overlap anti-join).

    boxes, covers: (plan_id, id, ord, b).  Covers are looked for in the cells a box touches; ids of covered boxes alone are set aside.
    """
    b = boxes.select("plan_id", "ord", "b").withColumn("a", F.col("b"))
    placed = in_cells(b, F.col("b.x1"), F.col("b.y1"), F.col("b.x2"), F.col("b.y2"), cell).select("plan_id", "cx", "cy", "ord", "a")
    c = in_cells(covers.select("plan_id", F.col("b").alias("c")), F.col("c.x1"), F.col("c.y1"), F.col("c.x2"), F.col("c.y2"), cell)
    hit = placed.join(c, ["plan_id", "cx", "cy"]).where(G.overlap(F.col("a"), F.col("c")) > share * G.box_area(F.col("a"))).select("plan_id", "ord").distinct()
    return boxes.join(hit, ["plan_id", "ord"], "left_anti")


def meeting_boxes(boxes: DataFrame, cell: float) -> DataFrame:
    """(plan_id, id_a, id_b, x, y), ord_a < ord_b: boxes of one plan that overlap or touch, and the middle of what they share.

    boxes: (plan_id, id, ord, b).  A pair that shares several cells is judged in the first of them only.
    """
    placed = in_cells(boxes, F.col("b.x1"), F.col("b.y1"), F.col("b.x2"), F.col("b.y2"), cell)
    side = lambda s: placed.select("plan_id", "cx", "cy", F.col("id").alias(f"id_{s}"), F.col("ord").alias(f"ord_{s}"), F.col("b").alias(s))
    x1, y1 = F.greatest("a.x1", "c.x1"), F.greatest("a.y1", "c.y1")
    x2, y2 = F.least("a.x2", "c.x2"), F.least("a.y2", "c.y2")
    first = (F.floor(x1 / cell) == F.col("cx")) & (F.floor(y1 / cell) == F.col("cy"))
    pairs = side("a").join(side("c"), ["plan_id", "cx", "cy"]).where("ord_a < ord_c").where((x1 <= x2) & (y1 <= y2) & first)
    return pairs.select("plan_id", "id_a", F.col("id_c").alias("id_b"), ((x1 + x2) / 2).alias("x"), ((y1 + y2) / 2).alias("y"))


def snapped(points: DataFrame, targets: DataFrame, within: float) -> DataFrame:
    """Points moved to the target whose id they name, where it is within reach; other points stay, with ``snapped`` false.

    points: (plan_id, ..., target_id, x, y); targets: (plan_id, target_id, tx, ty), ids once per plan.
    """
    both = points.join(targets.select("plan_id", "target_id", "tx", "ty"), ["plan_id", "target_id"], "left")
    near = F.coalesce(G.length(F.col("x"), F.col("y"), F.col("tx"), F.col("ty")) <= within, F.lit(False))
    moved = {"x": F.when(near, F.col("tx")).otherwise(F.col("x")), "y": F.when(near, F.col("ty")).otherwise(F.col("y")), "snapped": near}
    return both.withColumns(moved).drop("tx", "ty")


def tagged_regions(regions: DataFrame, tags: DataFrame, reach: float) -> DataFrame:
    """(plan_id, room_id, ord, tag): the first tag inside each region, else the nearest to the mean of its corners within reach, else null.

    regions: (plan_id, room_id, ord, ring); tags: (plan_id, ord, x, y), the tag being its order.
    """
    held = _in_reach(tags.select("plan_id", F.col("ord").alias("id"), "ord", "x", "y"), regions, 0.0, 4 * reach).groupBy("plan_id", "room_ord").agg(F.min("ord").alias("held"))
    mid = regions.select("plan_id", "room_id", F.col("ord").alias("room_ord"), G.vertex_mean(F.col("ring")).alias("m"))
    t = at_cell(tags.select("plan_id", F.col("ord").alias("tag"), "x", "y"), F.col("x"), F.col("y"), reach)
    m = in_cells(mid, F.col("m.x") - reach, F.col("m.y") - reach, F.col("m.x") + reach, F.col("m.y") + reach, reach)
    far = G.length(F.col("m.x"), F.col("m.y"), F.col("x"), F.col("y"))
    near = m.join(t, ["plan_id", "cx", "cy"]).withColumn("far", far).where(F.col("far") <= reach).groupBy("plan_id", "room_ord").agg(F.min(F.struct("far", "tag")).alias("n"))
    out = mid.join(held, ["plan_id", "room_ord"], "left").join(near, ["plan_id", "room_ord"], "left")
    return out.select("plan_id", "room_id", F.col("room_ord").alias("ord"), F.coalesce("held", "n.tag").alias("tag"))
