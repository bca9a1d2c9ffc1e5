"""Registered queries on the room graph of plans, and greedy operators, with the SQL that must give the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from planweave.functions import geometry as G
from planweave.functions.shared import by_shuffle
from planweave.operators import greedy, rooms, spatial
from planweave.plans.catalogue import _ROOM_POINTS, _WALL, _opening_sql, _read, registry
from planweave.sources import elements as E

QUERIES, SQL, query = registry()


def _dist(px: str, py: str, s: str = "") -> str:
    """SQL of the distance of a point from a segment with columns x1, y1, x2, y2 of a table."""
    x1, y1, x2, y2 = (f"{s}{c}" for c in ("x1", "y1", "x2", "y2"))
    l2 = f"(({x2} - {x1}) * ({x2} - {x1}) + ({y2} - {y1}) * ({y2} - {y1}))"
    t = f"greatest(0.0, least(1.0, CASE WHEN {l2} > 0 THEN (({px} - {x1}) * ({x2} - {x1}) + ({py} - {y1}) * ({y2} - {y1})) / {l2} ELSE 0.0 END))"
    dx, dy = f"({px} - ({x1} + {t} * ({x2} - {x1})))", f"({py} - ({y1} + {t} * ({y2} - {y1})))"
    return f"sqrt({dx} * {dx} + {dy} * {dy})"


def _near_rooms(points: str, reach: int) -> str:
    """SQL of (points' columns, room_id, ro, dd) of rooms within reach of points (plan_id, k, x, y)."""
    return f"""SELECT plan_id, k, room_id, ro, dd FROM (SELECT p.plan_id, p.k, e.room_id, e.ord AS ro,
      CASE WHEN count(*) FILTER (WHERE (e.y1 > p.y) <> (e.y2 > p.y) AND p.x < e.x1 + (p.y - e.y1) * (e.x2 - e.x1) / (e.y2 - e.y1)) % 2 = 1 THEN 0.0 ELSE min({_dist("p.x", "p.y", "e.")}) END AS dd
      FROM ({points}) p JOIN edge e ON p.plan_id = e.plan_id WHERE e.m >= 3 GROUP BY p.plan_id, p.k, e.room_id, e.ord) WHERE dd <= {reach}"""


_LINKS = f"""{_ROOM_POINTS}, o AS (SELECT * FROM ({_opening_sql('doors')}) WHERE x IS NOT NULL AND y IS NOT NULL),
  w1 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY plan_id, wall_id ORDER BY ord) AS rn FROM ({_WALL})) WHERE rn = 1),
  ow AS (SELECT o.*, w1.x1, w1.y1, w1.x2, w1.y2, sqrt((w1.x2 - w1.x1) * (w1.x2 - w1.x1) + (w1.y2 - w1.y1) * (w1.y2 - w1.y1)) AS n FROM o LEFT JOIN w1 ON o.plan_id = w1.plan_id AND o.host_wall_id = w1.wall_id),
  pr AS (SELECT plan_id, ord, id, side, {{'o': ord, 'i': id}} AS k, CASE WHEN n > 0 THEN x - s * 150 * (y2 - y1) / n ELSE x END AS x, CASE WHEN n > 0 THEN y + s * 150 * (x2 - x1) / n ELSE y END AS y
    FROM ow, (VALUES (0, CAST(1.0 AS DOUBLE)), (1, CAST(-1.0 AS DOUBLE))) v(side, s)),
  first AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY plan_id, k ORDER BY dd, ro) AS rn FROM ({_near_rooms("SELECT * FROM pr WHERE side = 0", 300)})) WHERE rn = 1),
  second AS (SELECT * FROM (SELECT s.*, row_number() OVER (PARTITION BY s.plan_id, s.k ORDER BY s.dd, s.ro) AS rn FROM ({_near_rooms("SELECT * FROM pr WHERE side = 1", 300)}) s
    LEFT JOIN first f ON s.plan_id = f.plan_id AND s.k = f.k WHERE s.room_id IS DISTINCT FROM f.room_id) WHERE rn = 1),
  links AS (SELECT o.plan_id, o.id, o.ord, o.width, CASE WHEN a.room_id IS NULL THEN b.room_id WHEN b.room_id IS NULL THEN a.room_id ELSE least(a.room_id, b.room_id) END AS room_a,
    CASE WHEN a.room_id IS NOT NULL AND b.room_id IS NOT NULL THEN greatest(a.room_id, b.room_id) END AS room_b
    FROM o LEFT JOIN first a ON o.plan_id = a.plan_id AND a.k = {{'o': o.ord, 'i': o.id}} LEFT JOIN second b ON o.plan_id = b.plan_id AND b.k = {{'o': o.ord, 'i': o.id}}),
  edges AS (SELECT plan_id, room_a, room_b, id AS door_id, width, doors FROM (SELECT *, count(*) OVER (PARTITION BY plan_id, room_a, room_b) AS doors,
    row_number() OVER (PARTITION BY plan_id, room_a, room_b ORDER BY width DESC NULLS LAST, ord) AS rn FROM links WHERE room_b IS NOT NULL) WHERE rn = 1),
  ends AS (SELECT plan_id, room_a AS room_id, count(*) AS outer_doors FROM links WHERE room_a IS NOT NULL AND room_b IS NULL GROUP BY plan_id, room_a),
  both_ways AS (SELECT plan_id, room_a AS a, room_b AS b FROM edges UNION ALL SELECT plan_id, room_b, room_a FROM edges)"""

_FOOT = f"""{_ROOM_POINTS},
  xs AS (SELECT plan_id, v, row_number() OVER (PARTITION BY plan_id ORDER BY v) AS i FROM (SELECT DISTINCT plan_id, x AS v FROM ring WHERE m >= 3)),
  ys AS (SELECT plan_id, v, row_number() OVER (PARTITION BY plan_id ORDER BY v) AS i FROM (SELECT DISTINCT plan_id, y AS v FROM ring WHERE m >= 3)),
  cell AS (SELECT a.plan_id, a.i, c.i AS j, a.v AS l, b.v AS r, c.v AS lo, d.v AS hi FROM xs a JOIN xs b ON a.plan_id = b.plan_id AND b.i = a.i + 1 JOIN ys c ON a.plan_id = c.plan_id JOIN ys d ON c.plan_id = d.plan_id AND d.i = c.i + 1),
  filled AS (SELECT plan_id, i, j, l, r, lo, hi FROM (SELECT c.plan_id, c.i, c.j, c.l, c.r, c.lo, c.hi, e.ord,
      count(*) FILTER (WHERE (e.y1 > (c.lo + c.hi) / 2) <> (e.y2 > (c.lo + c.hi) / 2) AND (c.l + c.r) / 2 < e.x1 + ((c.lo + c.hi) / 2 - e.y1) * (e.x2 - e.x1) / (e.y2 - e.y1)) % 2 = 1 AS f
    FROM cell c JOIN edge e ON c.plan_id = e.plan_id WHERE e.m >= 3 GROUP BY ALL) GROUP BY plan_id, i, j, l, r, lo, hi HAVING bool_or(f)),
  size AS (SELECT x.plan_id, x.n AS nx, y.n AS ny FROM (SELECT plan_id, count(*) AS n FROM xs GROUP BY plan_id) x JOIN (SELECT plan_id, count(*) AS n FROM ys GROUP BY plan_id) y ON x.plan_id = y.plan_id),
  free AS (SELECT s.plan_id, s.i, s.j FROM (SELECT plan_id, i, unnest(range(0, ny + 1)) AS j FROM (SELECT plan_id, ny, unnest(range(0, nx + 1)) AS i FROM size)) s LEFT JOIN filled f ON s.plan_id = f.plan_id AND s.i = f.i AND s.j = f.j WHERE f.i IS NULL),
  outside(plan_id, i, j) AS (SELECT plan_id, CAST(0 AS BIGINT), CAST(0 AS BIGINT) FROM size UNION SELECT f.plan_id, f.i, f.j FROM outside o JOIN free f ON o.plan_id = f.plan_id AND abs(o.i - f.i) + abs(o.j - f.j) = 1),
  part(plan_id, i, j) AS (SELECT plan_id, c.i, c.j FROM (SELECT plan_id, min({{'i': i, 'j': j}}) AS c FROM filled GROUP BY plan_id) UNION SELECT f.plan_id, f.i, f.j FROM part p JOIN filled f ON p.plan_id = f.plan_id AND abs(p.i - f.i) + abs(p.j - f.j) = 1),
  straight AS (SELECT plan_id, bool_and(x1 = x2 OR y1 = y2) AS s FROM edge WHERE m >= 3 GROUP BY plan_id),
  total AS (SELECT f.plan_id, sum((r - l) * (hi - lo)) AS area, count(*) = any_value(p.n) AS single FROM filled f JOIN (SELECT plan_id, count(*) AS n FROM part GROUP BY plan_id) p ON f.plan_id = p.plan_id GROUP BY f.plan_id),
  rim AS (SELECT f.plan_id, CASE WHEN d.di = 1 THEN f.r ELSE f.l END AS x1, CASE WHEN d.dj = 1 THEN f.hi ELSE f.lo END AS y1, CASE WHEN d.di = -1 THEN f.l ELSE f.r END AS x2, CASE WHEN d.dj = -1 THEN f.lo ELSE f.hi END AS y2
    FROM filled f, (VALUES (-1, 0), (1, 0), (0, -1), (0, 1)) d(di, dj), outside o, total t, straight s
    WHERE o.plan_id = f.plan_id AND o.i = f.i + d.di AND o.j = f.j + d.dj AND t.plan_id = f.plan_id AND t.single AND s.plan_id = f.plan_id AND s.s)"""


def _links(plans):
    return rooms.door_links(E.openings(plans, "doors"), E.walls(plans), E.rooms(plans))


def _rings(plans):
    return E.rooms(plans).where(F.size("ring") >= 3)


@query(f"WITH {_LINKS} SELECT plan_id, id, room_a, room_b FROM links")
def room_links(spark, d):
    """Doors to the rooms on either side of their wall: two probes along the normal, the second without the first's room; doors near no room stay."""
    return _links(_read(spark, d, "plans")).select("plan_id", "id", "room_a", "room_b")


@query(f"WITH {_LINKS} SELECT plan_id, room_a, room_b, door_id, width, doors FROM edges")
def graph_edges(spark, d):
    """Pairs of rooms joined by a door, each with its widest door."""
    return rooms.door_edges(_links(_read(spark, d, "plans")))


@query(f"WITH {_LINKS} SELECT plan_id, room_id, outer_doors FROM ends")
def exit_rooms(spark, d):
    """Rooms with a door to the outside."""
    return rooms.exits(_links(_read(spark, d, "plans")))


@query(f"""WITH RECURSIVE {_LINKS}, r(plan_id, node, steps) AS (SELECT plan_id, room_id, 0 FROM ends UNION SELECT e.plan_id, e.b, r.steps + 1 FROM r JOIN both_ways e ON r.plan_id = e.plan_id AND e.a = r.node WHERE r.steps < 60),
  dist AS (SELECT plan_id, node, min(steps) AS steps FROM r GROUP BY plan_id, node),
  via AS (SELECT a.plan_id, a.node, a.steps, min(b.node) AS via FROM dist a JOIN both_ways e ON a.plan_id = e.plan_id AND e.a = a.node JOIN dist b ON b.plan_id = a.plan_id AND b.node = e.b AND b.steps = a.steps - 1 GROUP BY a.plan_id, a.node, a.steps),
  p(plan_id, node, steps, path) AS (SELECT plan_id, node, 0, node FROM dist WHERE steps = 0 UNION ALL SELECT v.plan_id, v.node, v.steps, v.node || '>' || p.path FROM p JOIN via v ON v.plan_id = p.plan_id AND v.via = p.node AND v.steps = p.steps + 1)
  SELECT a.plan_id, a.room_id, CAST(p.steps AS INTEGER) AS steps, p.path FROM (SELECT DISTINCT plan_id, e.id AS room_id FROM (SELECT plan_id, unnest(rooms) AS e FROM plans) WHERE e IS NOT NULL) a LEFT JOIN p ON a.plan_id = p.plan_id AND a.room_id = p.node""")
def egress_paths(spark, d):
    """The shortest way from each room to one with an outer door; rooms without a way have none."""
    plans = _read(spark, d, "plans")
    links = _links(plans)
    return rooms.ways_out(E.rooms(plans), rooms.door_edges(links), rooms.exits(links)).withColumn("path", F.when(F.col("path").isNotNull(), F.concat_ws(">", "path")))


@query(f"WITH {_LINKS} SELECT plan_id, a AS room_id, count(*) AS n, string_agg(b, ',' ORDER BY b) AS rooms FROM both_ways GROUP BY plan_id, a")
def room_neighbours(spark, d):
    """The rooms next to each room."""
    return rooms.neighbours(rooms.door_edges(_links(_read(spark, d, "plans")))).withColumn("rooms", F.concat_ws(",", "rooms"))


_KINDS = [("room_kitchen", "room_bathroom"), ("room_bedroom", "room_corridor"), ("room_storage", "room_living")]


@query(f"""WITH {_LINKS}, k(kind_a, kind_b) AS (VALUES {', '.join(f"('{a}', '{b}')" for a, b in _KINDS)}), r AS (SELECT plan_id, ord, e.id AS id, e.category AS category FROM (SELECT plan_id, unnest(rooms) AS e, generate_subscripts(rooms, 1) AS ord FROM plans) WHERE e IS NOT NULL)
  SELECT plan_id, kind_a, kind_b, pairs, a AS room_a, b AS room_b FROM (SELECT e.plan_id, k.kind_a, k.kind_b, e.a, e.b, count(*) OVER (PARTITION BY e.plan_id, k.kind_a, k.kind_b) AS pairs, row_number() OVER (PARTITION BY e.plan_id, k.kind_a, k.kind_b ORDER BY x.ord, y.ord) AS rn
    FROM both_ways e JOIN r x ON e.plan_id = x.plan_id AND e.a = x.id JOIN r y ON e.plan_id = y.plan_id AND e.b = y.id JOIN k ON k.kind_a = x.category AND k.kind_b = y.category) WHERE rn = 1""")
def adjoining_kinds(spark, d):
    """Plans in which rooms of two kinds adjoin, with the first such pair."""
    plans = _read(spark, d, "plans")
    return rooms.first_pairs(E.rooms(plans), rooms.door_edges(_links(plans)), _KINDS)


@query(f"WITH RECURSIVE {_FOOT} SELECT t.plan_id, t.area, t.single, (SELECT count(*) FROM rim WHERE rim.plan_id = t.plan_id) AS n, CAST(CASE WHEN t.single AND s.s THEN n END AS INTEGER) AS outer_edges FROM total t JOIN straight s ON t.plan_id = s.plan_id".replace(", (SELECT count(*) FROM rim WHERE rim.plan_id = t.plan_id) AS n, CAST(CASE WHEN t.single AND s.s THEN n END", ", CAST(CASE WHEN t.single AND s.s THEN (SELECT count(*) FROM rim WHERE rim.plan_id = t.plan_id) END"))
def footprints(spark, d):
    """Union area of each plan's rooms, whether it is in one part, and the edges of its outer ring, cut where cells end."""
    f = greedy.footprint(_rings(_read(spark, d, "plans")))
    return f.select("plan_id", "area", (F.col("parts") == 1).alias("single"), F.when(F.col("exterior").isNotNull(), F.size("exterior")).alias("outer_edges"))


_SEG = f"least({_dist('e.x1', 'e.y1', 'q.')}, {_dist('e.x2', 'e.y2', 'q.')}, {_dist('q.x1', 'q.y1', 'e.')}, {_dist('q.x2', 'q.y2', 'e.')})"
_SIDE = "((%s.x2 - %s.x1) * (%s - %s.y1) - (%s.y2 - %s.y1) * (%s - %s.x1))"


def _side(s: str, x: str, y: str) -> str:
    return _SIDE % (s, s, y, s, s, s, x, s)


_MEET = f"({_side('e', 'q.x1', 'q.y1')} * {_side('e', 'q.x2', 'q.y2')} < 0 AND {_side('q', 'e.x1', 'e.y1')} * {_side('q', 'e.x2', 'e.y2')} < 0)"


@query(f"""WITH RECURSIVE {_FOOT}, hit AS (SELECT DISTINCT e.plan_id, e.ord FROM edge e JOIN rim q ON e.plan_id = q.plan_id WHERE e.m >= 3 AND ({_MEET} OR {_SEG} < 30))
  SELECT r.plan_id, r.e.id AS room_id, CAST(r.ord AS INTEGER) AS ord, h.ord IS NOT NULL AS "outer" FROM (SELECT plan_id, unnest(rooms) AS e, generate_subscripts(rooms, 1) - 1 AS ord FROM plans) r LEFT JOIN hit h ON r.plan_id = h.plan_id AND r.ord = h.ord WHERE r.e IS NOT NULL""")
def outer_rooms(spark, d):
    """Rooms that lie on the outer ring of their plan."""
    r = E.rooms(_read(spark, d, "plans"))
    return rooms.outer_rooms(r, greedy.footprint(r.where(F.size("ring") >= 3)))


_OUTER_WALLS = f"""w AS ({_WALL}), near AS (SELECT DISTINCT w.plan_id, w.ord FROM w JOIN rim q ON w.plan_id = q.plan_id WHERE {_dist('((w.x1 + w.x2) / 2)', '((w.y1 + w.y2) / 2)', 'q.')} < 30),
  ow AS (SELECT w.plan_id, w.wall_id, w.ord, CASE WHEN w.plan_id IN (SELECT plan_id FROM rim) THEN n.ord IS NOT NULL ELSE coalesce(w.is_exterior, false) END AS "outer" FROM w LEFT JOIN near n ON w.plan_id = n.plan_id AND w.ord = n.ord)"""


@query(f'WITH RECURSIVE {_FOOT}, {_OUTER_WALLS} SELECT plan_id, wall_id, ord, "outer" FROM ow')
def outer_walls(spark, d):
    """Walls that lie on the outer ring of their plan, by their midpoint; as flagged where there is no ring."""
    plans = _read(spark, d, "plans")
    return rooms.outer_walls(E.walls(plans), greedy.footprint(_rings(plans)))


@query(f"""WITH RECURSIVE {_FOOT}, {_OUTER_WALLS}, o AS ({_opening_sql('windows')}), n AS ({_near_rooms("SELECT plan_id, {'o': ord, 'i': id} AS k, x, y FROM o WHERE x IS NOT NULL AND y IS NOT NULL", 500)}),
  r AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY plan_id, k ORDER BY dd, ro) AS rn FROM n) WHERE rn = 1)
  SELECT o.plan_id, o.id, o.ord, r.room_id, coalesce(ow."outer", false) AS "outer" FROM o JOIN r ON o.plan_id = r.plan_id AND r.k = {{'o': o.ord, 'i': o.id}} LEFT JOIN ow ON o.plan_id = ow.plan_id AND o.host_wall_id = ow.wall_id""")
def window_sides(spark, d):
    """Windows with the room nearest to them and whether their wall is an outer one."""
    plans = _read(spark, d, "plans")
    o = E.openings(plans, "windows")
    outer = rooms.outer_walls(E.walls(plans), greedy.footprint(_rings(plans))).select("plan_id", F.col("wall_id").alias("host_wall_id"), "outer")
    near = spatial.nearest_polygon(o, E.rooms(plans), 500.0).select("plan_id", "id", "ord", "room_id")
    return o.select("plan_id", "id", "ord", "host_wall_id").join(near, ["plan_id", "id", "ord"]).join(outer, ["plan_id", "host_wall_id"], "left").select("plan_id", "id", "ord", "room_id", F.coalesce("outer", F.lit(False)).alias("outer"))


_GLAZED = f"""{_ROOM_POINTS}, o AS ({_opening_sql('windows')}), n AS ({_near_rooms("SELECT plan_id, {'o': ord, 'i': id} AS k, x, y FROM o WHERE x IS NOT NULL AND y IS NOT NULL", 500)}),
  near AS (SELECT plan_id, k, room_id FROM (SELECT *, row_number() OVER (PARTITION BY plan_id, k ORDER BY dd, ro) AS rn FROM n) WHERE rn = 1),
  per AS (SELECT o.plan_id, near.room_id, sum(o.width * o.height) / 1e6 AS g FROM o JOIN near ON o.plan_id = near.plan_id AND near.k = {{'o': o.ord, 'i': o.id}} GROUP BY o.plan_id, near.room_id),
  area AS (SELECT plan_id, ord, any_value(room_id) AS room_id, abs(sum(x1 * y2 - x2 * y1)) / 2 / 1e6 AS a FROM edge WHERE m >= 3 GROUP BY plan_id, ord),
  ratio AS (SELECT a.plan_id, a.room_id, coalesce(per.g, 0.0) AS glazed_m2, CASE WHEN a.a > 0 THEN coalesce(per.g, 0.0) / a.a ELSE 0.0 END AS ratio FROM area a LEFT JOIN per ON a.plan_id = per.plan_id AND a.room_id = per.room_id)"""


@query(f"WITH {_GLAZED} SELECT plan_id, room_id, glazed_m2, ratio FROM ratio")
def glazing_ratio(spark, d):
    """Glazed area of each room and its part of the room's area."""
    plans = _read(spark, d, "plans")
    return rooms.glazing(E.openings(plans, "windows"), _rings(plans))


@query(f"""WITH {_GLAZED}, b AS (SELECT *, row_number() OVER (PARTITION BY plan_id ORDER BY CASE WHEN ratio < 0.05 THEN 0 ELSE 1 END, ratio, room_id) AS rn FROM ratio)
  SELECT plan_id, count(*) AS n, bool_and(ratio >= 0.05) AS ok, max(CASE WHEN rn = 1 AND ratio < 0.05 THEN room_id END) AS worst, max(CASE WHEN rn = 1 AND ratio < 0.05 THEN ratio END) AS worst_value FROM b GROUP BY plan_id""")
def least_glazed(spark, d):
    """Whether all rooms of a plan have a given part of glazing, and the room that falls shortest of it."""
    plans = _read(spark, d, "plans")
    return rooms.all_reach(rooms.glazing(E.openings(plans, "windows"), _rings(plans)), "plan_id", "room_id", "ratio", 0.05)


@query(f"""WITH RECURSIVE {_LINKS}, n AS ({_near_rooms("SELECT plan_id, {'o': ord, 'i': id} AS k, x, y FROM (" + _opening_sql('windows') + ") WHERE x IS NOT NULL AND y IS NOT NULL", 500)}), lit AS (SELECT plan_id, count(DISTINCT room_id) AS n FROM (SELECT *, row_number() OVER (PARTITION BY plan_id, k ORDER BY dd, ro) AS rn FROM n) WHERE rn = 1 GROUP BY plan_id)
  SELECT p.plan_id, CAST(len(p.rooms) AS BIGINT) AS rooms, coalesce(e.n, 0) AS door_edges, coalesce(x.n, 0) AS exit_rooms, coalesce(lit.n, 0) AS rooms_with_windows FROM plans p LEFT JOIN (SELECT plan_id, count(*) AS n FROM edges GROUP BY plan_id) e ON p.plan_id = e.plan_id
  LEFT JOIN (SELECT plan_id, count(*) AS n FROM ends GROUP BY plan_id) x ON p.plan_id = x.plan_id LEFT JOIN lit ON p.plan_id = lit.plan_id WHERE p.rooms IS NOT NULL""")
def graph_summary(spark, d):
    """Per plan: rooms, pairs joined by doors, rooms with an outer door, rooms with a window."""
    plans = _read(spark, d, "plans")
    links = _links(plans)
    lit = spatial.nearest_polygon(E.openings(plans, "windows"), E.rooms(plans), 500.0)
    parts = {"door_edges": rooms.door_edges(links), "exit_rooms": rooms.exits(links), "rooms_with_windows": lit.select("plan_id", "room_id").distinct()}
    out = plans.where("rooms is not null").select("plan_id", F.size("rooms").cast("long").alias("rooms"))
    for name, df in parts.items():
        out = out.join(by_shuffle(df.groupBy("plan_id").agg(F.count("*").alias(name))), "plan_id", "left")
    return out.select("plan_id", "rooms", *[F.coalesce(c, F.lit(0)).alias(c) for c in parts])


# ------------------------------------------------------------------ greedy operators, one plan at a time

_DOOR_POINTS = f"d AS (SELECT plan_id, ord, x, y, row_number() OVER (PARTITION BY plan_id ORDER BY ord) AS k FROM ({_opening_sql('doors')}) WHERE x IS NOT NULL AND y IS NOT NULL)"


@query(f"""WITH RECURSIVE {_DOOR_POINTS}, s(plan_id, k, kept) AS (SELECT plan_id, k, [{{'ord': ord, 'x': x, 'y': y}}] FROM d WHERE k = 1 UNION ALL
  SELECT d.plan_id, d.k, CASE WHEN len(list_filter(s.kept, lambda p: sqrt((p.x - d.x) * (p.x - d.x) + (p.y - d.y) * (p.y - d.y)) < 1500)) = 0 THEN list_append(s.kept, {{'ord': d.ord, 'x': d.x, 'y': d.y}}) ELSE s.kept END FROM s JOIN d ON s.plan_id = d.plan_id AND d.k = s.k + 1)
  SELECT plan_id, p.ord AS ord, p.x AS x, p.y AS y FROM (SELECT plan_id, unnest(kept) AS p FROM (SELECT plan_id, max_by(kept, k) AS kept FROM s GROUP BY plan_id))""")
def thinned_doors(spark, d):
    """Doors of a plan, in order, unless a kept one is nearer than 1500 mm."""
    return greedy.radius_dedup(E.openings(_read(spark, d, "plans"), "doors"), "plan_id", 1500.0)


@query(f"""WITH RECURSIVE {_DOOR_POINTS}, s(plan_id, place, here, rest) AS (SELECT plan_id, 0, min({{'k': k, 'ord': ord, 'x': x, 'y': y}}), list({{'k': k, 'ord': ord, 'x': x, 'y': y}}) FILTER (WHERE k > 1) FROM d GROUP BY plan_id UNION ALL
  SELECT plan_id, place + 1, b.p, list_filter(rest, lambda p: p.k <> b.p.k) FROM (SELECT plan_id, place, rest, list_min(list_transform(rest, lambda p: {{'d': sqrt((p.x - here.x) * (p.x - here.x) + (p.y - here.y) * (p.y - here.y)), 'p': p}})) AS b FROM s WHERE len(rest) > 0))
  SELECT plan_id, here.ord AS ord, here.x AS x, here.y AS y, CAST(place AS BIGINT) AS place FROM s""")
def door_chain(spark, d):
    """Doors of each plan in greedy nearest-neighbour order."""
    return greedy.chain(E.openings(_read(spark, d, "plans"), "doors"), "plan_id")


def _iou_sql(a: str, b: str) -> str:
    w = f"greatest(least({a}.x2, {b}.x2) - greatest({a}.x1, {b}.x1), 0.0)"
    h = f"greatest(least({a}.y2, {b}.y2) - greatest({a}.y1, {b}.y1), 0.0)"
    u = f"(({a}.x2 - {a}.x1) * ({a}.y2 - {a}.y1) + ({b}.x2 - {b}.x1) * ({b}.y2 - {b}.y1) - {w} * {h})"
    return f"(CASE WHEN {u} > 0 THEN {w} * {h} / {u} ELSE 0.0 END)"


@query(f"""WITH RECURSIVE {_ROOM_POINTS}, b AS (SELECT plan_id, CAST(ord AS INTEGER) AS id, abs(sum(x1 * y2 - x2 * y1)) / 2 AS score, min(x1) AS x1, min(y1) AS y1, max(x1) AS x2, max(y1) AS y2 FROM edge WHERE m >= 3 GROUP BY plan_id, ord),
  d AS (SELECT plan_id, {{'id': id, 'score': score, 'x1': x1 * 1.0, 'y1': y1, 'x2': x2, 'y2': y2}} AS p, row_number() OVER (PARTITION BY plan_id ORDER BY score DESC, id) AS k FROM b),
  s(plan_id, k, kept) AS (SELECT plan_id, k, [p] FROM d WHERE k = 1 UNION ALL SELECT d.plan_id, d.k, CASE WHEN len(list_filter(s.kept, lambda q: {_iou_sql('q', 'd.p')} > 0.01)) = 0 THEN list_append(s.kept, d.p) ELSE s.kept END FROM s JOIN d ON s.plan_id = d.plan_id AND d.k = s.k + 1)
  SELECT plan_id, p.id AS id, p.score AS score, p.x1 AS x1, p.y1 AS y1, p.x2 AS x2, p.y2 AS y2 FROM (SELECT plan_id, unnest(kept) AS p FROM (SELECT plan_id, max_by(kept, k) AS kept FROM s GROUP BY plan_id))""")
def suppressed_rooms(spark, d):
    """Greedy suppression of rooms whose boxes overlap, by area."""
    r = _rings(_read(spark, d, "plans")).withColumn("b", G.bounds(F.col("ring")))
    return greedy.suppress(r.select("plan_id", F.col("ord").alias("id"), G.area(F.col("ring")).alias("score"), "b.x1", "b.y1", "b.x2", "b.y2"), ["plan_id"], 0.01)


def _box_sql(column: str) -> str:
    return f"SELECT plan_id, ord AS id, width AS score, x - width AS x1, y - width AS y1, x + width AS x2, y + width AS y2 FROM ({_opening_sql(column)}) WHERE x IS NOT NULL AND y IS NOT NULL AND width IS NOT NULL"


MATCHED = f"""t AS (SELECT plan_id, list({{'id': id, 'x1': x1, 'y1': y1, 'x2': x2, 'y2': y2}} ORDER BY id) AS free FROM ({_box_sql('doors')}) GROUP BY plan_id),
  p AS (SELECT w.plan_id, w.id, w.score, {{'x1': w.x1, 'y1': w.y1, 'x2': w.x2, 'y2': w.y2}} AS b, row_number() OVER (PARTITION BY w.plan_id ORDER BY w.score DESC, w.id) AS k FROM ({_box_sql('windows')}) w),
  s(plan_id, k, id, free, hit) AS (SELECT DISTINCT p.plan_id, CAST(0 AS BIGINT), CAST(NULL AS INTEGER), coalesce(t.free, []), CAST(NULL AS STRUCT(v DOUBLE, n INTEGER)) FROM p LEFT JOIN t ON p.plan_id = t.plan_id UNION ALL
    SELECT plan_id, k, id, CASE WHEN best.v >= 0.1 THEN list_filter(free, lambda q: q.id <> -best.n) ELSE free END, CASE WHEN best.v >= 0.1 THEN best END FROM
      (SELECT p.plan_id, p.k, p.id, s.free, list_max(list_transform(s.free, lambda q: {{'v': {_iou_sql('q', 'p.b')}, 'n': -q.id}})) AS best FROM s JOIN p ON s.plan_id = p.plan_id AND p.k = s.k + 1)),
  m AS (SELECT plan_id, id, CAST(-hit.n AS INTEGER) AS truth_id, coalesce(hit.v, 0.0) AS iou FROM s WHERE k > 0)"""


def matched(spark, d):
    plans = _read(spark, d, "plans")
    box = lambda o: o.where("x is not null and y is not null and width is not null").select("plan_id", F.col("ord").alias("id"), F.lit(1).alias("label"), F.col("width").alias("score"), (F.col("x") - F.col("width")).alias("x1"), (F.col("y") - F.col("width")).alias("y1"), (F.col("x") + F.col("width")).alias("x2"), (F.col("y") + F.col("width")).alias("y2"))
    predicted, truth = box(E.openings(plans, "windows")), box(E.openings(plans, "doors"))
    # Plans with truth alone have no predictions to match.
    return predicted, truth, greedy.match(predicted, truth, "plan_id", 0.1)


@query(f"WITH RECURSIVE {MATCHED} SELECT plan_id, id, truth_id, iou FROM m")
def matched_boxes(spark, d):
    """Windows as predictions matched to doors as truth of their plan, greedily by score."""
    return matched(spark, d)[2]
