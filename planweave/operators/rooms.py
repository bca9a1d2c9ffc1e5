"""Rooms, doors and walls of plans as graphs: door links, widest edges, outer rooms and walls, ways out.

All plans advance together; the plan is the equi key of every join.  What one
plan holds (its outer ring, the edges of its rooms) is compared inside a row or
between the rows of a plan, in the JVM.

Defined results: doors without a place are left out, doors near no room have
nulls; rooms without a ring have no outer side; a plan whose rooms fall apart
into several parts has no outer ring.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from planweave.functions import geometry as G
from planweave.functions.shared import by_shuffle
from planweave.operators import graph, spatial

# Fixed values, in mm: how far the probes of a door stand off its wall, how far a room may be from a probe, and how near the outer ring counts as on it.
PROBE, REACH, ON_RING = 150.0, 300.0, 30.0


def door_links(doors: DataFrame, walls: DataFrame, rooms: DataFrame) -> DataFrame:
    """(plan_id, id, ord, width, room_a, room_b), room_a < room_b: the rooms on either side of each door.

    Two probes along the normal of the host wall take the nearest room each, the second one another than the first's;
    a door without host has both probes at its place.
    """
    o = doors.where("x is not null and y is not null")
    w = walls.groupBy("plan_id", F.col("wall_id").alias("host_wall_id")).agg(F.min_by(F.struct("x1", "y1", "x2", "y2"), "ord").alias("w")).select("plan_id", "host_wall_id", "w.*")
    o = o.join(by_shuffle(w), ["plan_id", "host_wall_id"], "left").withColumn("n", G.length(*(F.col(c) for c in ("x1", "y1", "x2", "y2"))))
    s, n = F.col("s"), F.col("n")
    probes = o.withColumn("s", F.explode(F.array(F.lit(1.0), F.lit(-1.0)))).select(
        "plan_id", "id", "ord", F.when(s > 0, 0).otherwise(1).alias("side"),
        F.when(n > 0, F.col("x") - s * PROBE * (F.col("y2") - F.col("y1")) / n).otherwise(F.col("x")).alias("x"),
        F.when(n > 0, F.col("y") + s * PROBE * (F.col("x2") - F.col("x1")) / n).otherwise(F.col("y")).alias("y"),
    )
    met = spatial.two_polygons(probes, rooms, REACH).withColumn("r", F.sort_array(F.array_compact(F.array("a", "b")))).select("plan_id", "id", "ord", "r")
    return o.select("plan_id", "id", "ord", "width").join(by_shuffle(met), ["plan_id", "id", "ord"], "left").select("plan_id", "id", "ord", "width", F.get("r", 0).alias("room_a"), F.get("r", 1).alias("room_b"))


def door_edges(links: DataFrame) -> DataFrame:
    """(plan_id, room_a, room_b, door_id, width, doors): each pair of rooms once, with its widest door, the first of equally wide ones."""
    wide = F.struct(F.coalesce(-F.col("width"), F.lit(float("inf"))), "ord")
    e = links.where("room_b is not null").groupBy("plan_id", "room_a", "room_b").agg(F.min_by(F.struct("id", "width"), wide).alias("d"), F.count("*").alias("doors"))
    return e.select("plan_id", "room_a", "room_b", F.col("d.id").alias("door_id"), "d.width", "doors")


def exits(links: DataFrame) -> DataFrame:
    """(plan_id, room_id, outer_doors): rooms with a door that has a room on one side only."""
    one = links.where("room_a is not null and room_b is null")
    return one.groupBy("plan_id", F.col("room_a").alias("room_id")).agg(F.count("*").alias("outer_doors"))


def _graph(rooms: DataFrame, edges: DataFrame, ends: DataFrame):
    nodes = rooms.select(F.col("plan_id").alias("g"), F.col("room_id").alias("node"))
    return nodes, edges.select(F.col("plan_id").alias("g"), F.col("room_a").alias("a"), F.col("room_b").alias("b")), ends.select(F.col("plan_id").alias("g"), F.col("room_id").alias("node"))


def ways_out(rooms: DataFrame, edges: DataFrame, ends: DataFrame) -> DataFrame:
    """(plan_id, room_id, steps, path): fewest doors from each room to an exit and the rooms on the way; rooms without a way have nulls."""
    p = graph.paths_to(*_graph(rooms, edges, ends)).select(F.col("g").alias("plan_id"), F.col("node").alias("room_id"), "steps", "path")
    return rooms.select("plan_id", "room_id").distinct().join(by_shuffle(p), ["plan_id", "room_id"], "left")


def neighbours(edges: DataFrame) -> DataFrame:
    """(plan_id, room_id, n, rooms): the rooms next to each room, in order."""
    both = edges.select("plan_id", F.explode(F.array(F.struct(F.col("room_a").alias("room_id"), F.col("room_b").alias("other")), F.struct(F.col("room_b").alias("room_id"), F.col("room_a").alias("other")))).alias("p"))
    return both.groupBy("plan_id", "p.room_id").agg(F.count("*").alias("n"), F.sort_array(F.collect_set("p.other")).alias("rooms"))


def first_pairs(rooms: DataFrame, edges: DataFrame, kinds: list[tuple[str, str]]) -> DataFrame:
    """(plan_id, kind_a, kind_b, pairs, room_a, room_b) of each pair of kinds that has adjoining rooms: their number and the first by order of the rooms.

    rooms: plan_id, room_id, category, ord.  Plans without such a pair have no row.
    """
    spark = rooms.sparkSession
    k = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(kinds)], "k int, kind_a string, kind_b string")
    e = edges.select("plan_id", F.explode(F.array(F.struct(F.col("room_a").alias("a"), F.col("room_b").alias("b")), F.struct(F.col("room_b").alias("a"), F.col("room_a").alias("b")))).alias("p")).select("plan_id", "p.*")
    r = lambda s: rooms.select("plan_id", F.col("room_id").alias(s), F.col("category").alias(f"kind_{s}"), F.col("ord").alias(f"ord_{s}"))
    pairs = e.join(by_shuffle(r("a")), ["plan_id", "a"]).join(by_shuffle(r("b")), ["plan_id", "b"]).join(F.broadcast(k), ["kind_a", "kind_b"])
    first = pairs.groupBy("plan_id", "kind_a", "kind_b").agg(F.count("*").alias("pairs"), F.min(F.struct("ord_a", "ord_b", "a", "b")).alias("f"))
    return first.select("plan_id", "kind_a", "kind_b", "pairs", F.col("f.a").alias("room_a"), F.col("f.b").alias("room_b"))


def _segments(edges: Column) -> Column:
    """Arrays of four numbers as structs."""
    return F.transform(edges, lambda e: F.struct(*[F.get(e, k).alias(n) for k, n in enumerate(("x1", "y1", "x2", "y2"))]))


def outer_rooms(rooms: DataFrame, footprints: DataFrame) -> DataFrame:
    """(plan_id, room_id, ord, outer): whether a room's ring comes nearer than 30 mm to the outer ring of its plan."""
    f = footprints.select("plan_id", _segments(F.col("exterior")).alias("outer"))
    near = F.exists(G.edges(F.col("ring")), lambda e: F.exists("outer", lambda o: G.segments_distance(e, o) < ON_RING))
    return rooms.join(f, "plan_id", "left").select("plan_id", "room_id", "ord", F.coalesce(near, F.lit(False)).alias("outer"))


def outer_walls(walls: DataFrame, footprints: DataFrame) -> DataFrame:
    """(plan_id, wall_id, ord, outer): whether a wall's midpoint lies nearer than 30 mm to the outer ring; without a ring as the wall is flagged, else not."""
    f = footprints.select("plan_id", _segments(F.col("exterior")).alias("ring"))
    x, y = (F.col("x1") + F.col("x2")) / 2, (F.col("y1") + F.col("y2")) / 2
    near = F.exists("ring", lambda o: G.segment_distance(x, y, o["x1"], o["y1"], o["x2"], o["y2"]) < ON_RING)
    return walls.join(f, "plan_id", "left").select("plan_id", "wall_id", "ord", F.coalesce(near, "is_exterior", F.lit(False)).alias("outer"))


def glazing(windows: DataFrame, rooms: DataFrame, reach: float = 500.0) -> DataFrame:
    """(plan_id, room_id, glazed_m2, ratio) of each room: the area of the windows nearest to it, and its part of the room's; 0 where the room has none."""
    near = spatial.nearest_polygon(windows, rooms, reach).join(windows.select("plan_id", "id", "ord", "width", "height"), ["plan_id", "id", "ord"])
    per = near.groupBy("plan_id", "room_id").agg((F.sum(F.col("width") * F.col("height")) / 1e6).alias("g"))
    area = G.area(F.col("ring")) / 1e6
    r = rooms.select("plan_id", "room_id", area.alias("area")).join(per, ["plan_id", "room_id"], "left").withColumn("g", F.coalesce("g", F.lit(0.0)))
    return r.select("plan_id", "room_id", F.col("g").alias("glazed_m2"), F.when(F.col("area") > 0, F.col("g") / F.when(F.col("area") > 0, F.col("area"))).otherwise(F.lit(0.0)).alias("ratio"))


def all_reach(values: DataFrame, key: str, name: str, value: str, least: float) -> DataFrame:
    """(key, n, ok, worst, worst_value): whether all rows of a key reach a value, and the one that falls shortest (least name of equal ones)."""
    short = F.when(F.col(value) < least, F.struct(F.col(value).alias("v"), F.col(name).alias("n")))
    g = values.groupBy(key).agg(F.count("*").alias("n"), F.every(F.coalesce(F.col(value) >= least, F.lit(False))).alias("ok"), F.min(short).alias("w"))
    return g.select(key, "n", "ok", F.col("w.n").alias("worst"), F.col("w.v").alias("worst_value"))
