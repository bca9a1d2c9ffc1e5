"""Registered queries of the core, each with the SQL that must give the same rows where SQL can say it on whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from planweave.functions import geometry as G
from planweave.operators import graph, keyed, measures, spatial
from planweave.operators.entities import MEMBERS
from planweave.sources import elements as E
from planweave.sources.files import report_rows

def registry() -> tuple:
    """Queries, their SQL, and the decorator that registers a query with its SQL."""
    queries_, sql_ = {}, {}

    def query(sql: str | None = None):
        def register(f):
            queries_[f.__name__] = f
            if sql:
                sql_[f.__name__] = sql
            return f

        return register

    return queries_, sql_, query


QUERIES, SQL, query = registry()


def _read(spark: SparkSession, d: str, name: str) -> DataFrame:
    return E.table(spark, d, name)


# ------------------------------------------------------------------ nested records and quantities


def _unwrapped(col: str) -> str:
    return f"CASE WHEN json_valid({col}) AND json_type({col}) = 'VARCHAR' THEN trim(json_extract_string({col}, '$'), ' ') ELSE {col} END"


ENTITIES_SQL = f"""e0 AS (SELECT clause_id, trim(entities, ' ') AS t FROM clauses WHERE entities IS NOT NULL), e1 AS (SELECT clause_id, {_unwrapped('t')} AS t FROM e0), e2 AS (SELECT clause_id, {_unwrapped('t')} AS t FROM e1),
  e3 AS (SELECT clause_id, CAST(t AS JSON) AS j FROM e2 WHERE json_valid(t) AND json_type(t) IN ('OBJECT', 'ARRAY')),
  e4 AS (SELECT clause_id, CASE WHEN json_type(j) = 'OBJECT' AND len(json_keys(j)) = 1 AND NOT list_contains({MEMBERS!r}, json_keys(j)[1]) AND json_type(json_extract(j, '$.*')[1]) IN ('OBJECT', 'ARRAY') THEN json_extract(j, '$.*')[1] ELSE j END AS j FROM e3),
  e5 AS (SELECT clause_id, CASE WHEN json_type(j) = 'ARRAY' THEN json_extract(j, '$[*]') ELSE [j] END AS l FROM e4),
  ent AS (SELECT clause_id, pos - 1 AS pos, e FROM (SELECT clause_id, unnest(l) AS e, generate_subscripts(l, 1) AS pos FROM e5) WHERE json_type(e) = 'OBJECT')"""
_CONDITIONS = """con AS (SELECT clause_id, pos, CASE WHEN json_type(c) = 'ARRAY' THEN json_extract(c, '$[*]') WHEN json_type(c) = 'OBJECT' THEN [c] END AS l FROM (SELECT clause_id, pos, CASE WHEN json_type(e, '$.condition') IN ('OBJECT', 'ARRAY') THEN json_extract(e, '$.condition') ELSE json_extract(e, '$.conditions') END AS c FROM ent)),
  cond AS (SELECT clause_id, pos, k - 1 AS k FROM (SELECT clause_id, pos, unnest(l) AS c, generate_subscripts(l, 1) AS k FROM con) WHERE json_type(c) = 'OBJECT')"""
_DOCUMENTS = f"""d0 AS (SELECT export_id, trim(payload, ' ') AS t FROM plan_exports WHERE payload IS NOT NULL), d1 AS (SELECT export_id, {_unwrapped('t')} AS t FROM d0),
  tree AS (SELECT d1.export_id, j.id AS node, j.parent, j.key, j.type, j.value FROM d1, json_tree(CASE WHEN json_valid(d1.t) THEN d1.t ELSE 'null' END) j),
  own AS (SELECT o.export_id, o.node, CASE WHEN p.key = 'nodes' THEN o.key ELSE json_extract_string(o.value, '$.id') END AS k, o.value AS v FROM tree o LEFT JOIN tree p ON o.export_id = p.export_id AND o.parent = p.node WHERE o.type = 'OBJECT'),
  lists AS (SELECT export_id, k, CASE WHEN json_type(v, '$.windows') = 'OBJECT' THEN [json_extract(v, '$.windows')] WHEN json_type(v, '$.windows') = 'ARRAY' THEN json_extract(v, '$.windows[*]') END AS w,
    coalesce(CASE WHEN json_type(v, '$.footprint_polygon') <> 'NULL' THEN json_extract(v, '$.footprint_polygon') END, CASE WHEN json_type(v, '$.footprint') <> 'NULL' THEN json_extract(v, '$.footprint') END, json_extract(v, '$.polygon')) AS p FROM own WHERE k IS NOT NULL),
  rings AS (SELECT export_id, k, json_extract(CASE WHEN json_type(p) = 'OBJECT' THEN json_extract(p, '$.points') ELSE p END, '$[*]') AS l FROM lists WHERE json_type(p) IN ('OBJECT', 'ARRAY')),
  corners AS (SELECT export_id, k, list_transform(l, lambda q: CASE WHEN json_type(q) = 'OBJECT' THEN {{'x': CAST(json_extract(q, '$.x') AS DOUBLE), 'y': CAST(json_extract(q, '$.y') AS DOUBLE)}} ELSE {{'x': CAST(json_extract(q, '$[0]') AS DOUBLE), 'y': CAST(json_extract(q, '$[1]') AS DOUBLE)}} END) AS l FROM rings)"""
_NESTED = f"""WITH {ENTITIES_SQL}, {_CONDITIONS}, {_DOCUMENTS}
SELECT DISTINCT kind, rec_id, parent_key, child_key FROM (
SELECT 'entity' AS kind, clause_id AS rec_id, '' AS parent_key, CAST(pos AS VARCHAR) AS child_key FROM ent
UNION ALL SELECT 'condition', clause_id, CAST(pos AS VARCHAR), CAST(k AS VARCHAR) FROM cond
UNION ALL SELECT 'window', export_id, k, json_extract_string(w, '$.id') FROM (SELECT export_id, k, unnest(w) AS w FROM lists)
UNION ALL SELECT 'vertex', export_id, k, CAST(i AS VARCHAR) FROM (SELECT export_id, k, unnest(range(0, CASE WHEN len(l) > 1 AND l[1] = l[-1] THEN len(l) - 1 ELSE len(l) END)) AS i FROM corners)) WHERE child_key IS NOT NULL"""


@query(_NESTED)
def p3_found(spark, d):
    """Flat rows of nested entities, conditions, windows and corners, linked to their record and parent."""
    from planweave.operators.nested import entity_tables, plan_tables

    return entity_tables(_read(spark, d, "clauses")).unionByName(plan_tables(_read(spark, d, "plan_exports")))


@query(f"""WITH {ENTITIES_SQL} SELECT clause_id, CAST(pos AS BIGINT) AS pos, json_extract_string(e, '$.property') AS property, json_extract_string(e, '$.comparator') AS comparator, json_extract_string(e, '$.unit') AS unit,
  CASE WHEN json_type(e, '$.value') NOT IN ('ARRAY', 'OBJECT', 'NULL') THEN json_extract_string(e, '$.value') END AS value FROM ent""")
def p3_entities(spark, d):
    """Entities of clauses with their single values, keyed by clause and place."""
    from planweave.operators.nested import entity_rows

    e = entity_rows(_read(spark, d, "clauses"))
    plain = F.when(~F.col("value").rlike(r"^[\[{]"), F.col("value"))
    return e.select(F.col("rec_id").alias("clause_id"), F.col("place").alias("pos"), "property", "comparator", "unit", plain.alias("value"))


@query(f"""WITH {_DOCUMENTS} SELECT DISTINCT export_id, k AS room_id, CAST(i - 1 AS BIGINT) AS place, json_extract_string(w, '$.id') AS window_id, CAST(json_extract(w, '$.width') AS DOUBLE) AS width, CAST(json_extract(w, '$.height') AS DOUBLE) AS height
  FROM (SELECT export_id, k, unnest(w) AS w, generate_subscripts(w, 1) AS i FROM lists) WHERE json_extract_string(w, '$.id') IS NOT NULL""")
def p3_windows(spark, d):
    """Windows of exported rooms with their size, keyed by export, room and place."""
    from planweave.operators.nested import window_rows

    w = window_rows(_read(spark, d, "plan_exports"))
    return w.select(F.col("rec_id").alias("export_id"), F.col("parent_key").alias("room_id"), "place", F.col("child_key").alias("window_id"), "width", "height")


@query(f"""WITH {_DOCUMENTS} SELECT DISTINCT export_id, k AS element_id, CAST(i - 1 AS BIGINT) AS place, p.x AS x, p.y AS y FROM (SELECT export_id, k, unnest(l) AS p, generate_subscripts(l, 1) AS i, l[1] AS f, len(l) AS n FROM corners) WHERE NOT (i = n AND n > 1 AND p = f)""")
def p3_vertices(spark, d):
    """Corners of exported rooms, slabs and stairs with their coordinates, keyed by export, element and place."""
    from planweave.operators.nested import vertex_rows

    v = vertex_rows(_read(spark, d, "plan_exports"))
    return v.select(F.col("rec_id").alias("export_id"), F.col("parent_key").alias("element_id"), "place", "x", "y")


@query()
def p5_found(spark, d):
    """Lengths and areas of clauses and findings in whole mm and mm²."""
    from planweave.operators.quantities import clause_quantities, finding_quantities

    return clause_quantities(_read(spark, d, "clauses")).unionByName(finding_quantities(_read(spark, d, "findings")))


# ------------------------------------------------------------------ geometry

_ROOM_POINTS = """
  pts AS (SELECT plan_id, r.ord - 1 AS ord, r.e.id AS room_id, p.k AS k, p.pt[1] AS x, p.pt[2] AS y, len(r.e.polygon) AS n, r.e.polygon[1] AS f, r.e.polygon[-1] AS l
    FROM (SELECT plan_id, unnest(rooms) AS e, generate_subscripts(rooms, 1) AS ord FROM plans) r,
      LATERAL (SELECT unnest(r.e.polygon) AS pt, generate_subscripts(r.e.polygon, 1) AS k) p),
  ring AS (SELECT plan_id, ord, room_id, k, x, y, CASE WHEN n > 1 AND f[1] = l[1] AND f[2] = l[2] THEN n - 1 ELSE n END AS m FROM pts
    WHERE NOT (k = n AND n > 1 AND f[1] = l[1] AND f[2] = l[2])),
  edge AS (SELECT a.plan_id, a.ord, a.room_id, a.m, a.x AS x1, a.y AS y1, b.x AS x2, b.y AS y2 FROM ring a
    JOIN ring b ON a.plan_id = b.plan_id AND a.ord = b.ord AND b.k = a.k % a.m + 1)"""


@query(f"""WITH {_ROOM_POINTS}
SELECT plan_id, room_id, CAST(ord AS INTEGER) AS ord, abs(sum(x1 * y2 - x2 * y1)) / 2 AS area, min(x1) AS left_x, max(x1) AS right_x, min(y1) AS low_y, max(y1) AS high_y, CAST(any_value(m) AS INTEGER) AS corners
FROM edge WHERE m >= 3 GROUP BY plan_id, ord, room_id""")
def room_areas(spark, d):
    """Shoelace area and bounds of each room."""
    r = E.rooms(_read(spark, d, "plans")).where(F.size("ring") >= 3).withColumn("b", G.bounds(F.col("ring")))
    return r.select("plan_id", "room_id", "ord", G.area(F.col("ring")).alias("area"), F.col("b.x1").alias("left_x"), F.col("b.x2").alias("right_x"), F.col("b.y1").alias("low_y"), F.col("b.y2").alias("high_y"), F.size("ring").alias("corners"))


_WALL = """SELECT plan_id, CAST(ord - 1 AS INTEGER) AS ord, w.id AS wall_id, w.start_point[1] AS x1, w.start_point[2] AS y1, w.end_point[1] AS x2, w.end_point[2] AS y2, w.thickness AS thickness, w.is_exterior AS is_exterior
  FROM (SELECT plan_id, unnest(walls) AS w, generate_subscripts(walls, 1) AS ord FROM plans) WHERE w IS NOT NULL AND w.start_point[2] IS NOT NULL AND w.end_point[2] IS NOT NULL"""


@query(f"SELECT plan_id, wall_id, ord, sqrt((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1)) AS length, abs(x2 - x1) >= abs(y2 - y1) AS horizontal FROM ({_WALL}) WHERE sqrt((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1)) >= 1")
def wall_lengths(spark, d):
    """Length and main direction of walls of at least 1 mm."""
    w = E.walls(_read(spark, d, "plans"))
    n = G.length(*(F.col(c) for c in ("x1", "y1", "x2", "y2")))
    return w.select("plan_id", "wall_id", "ord", n.alias("length"), (F.abs(F.col("x2") - F.col("x1")) >= F.abs(F.col("y2") - F.col("y1"))).alias("horizontal")).where("length >= 1")


@query(f"""WITH w AS ({_WALL}), s AS (SELECT plan_id, sqrt((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1)) AS len, is_exterior FROM w)
SELECT plan_id, count(*) AS walls, count(*) FILTER (WHERE is_exterior) AS exterior, max(len) AS longest, count(*) FILTER (WHERE len > 3000) AS long_walls FROM s GROUP BY plan_id""")
def wall_summary(spark, d):
    """Per plan: walls, exterior ones, the longest and the long ones."""
    w = E.walls(_read(spark, d, "plans")).withColumn("len", G.length(*(F.col(c) for c in ("x1", "y1", "x2", "y2"))))
    return w.groupBy("plan_id").agg(F.count("*").alias("walls"), F.count_if("is_exterior").alias("exterior"), F.max("len").alias("longest"), F.count_if(F.col("len") > 3000).alias("long_walls"))


@query(f"""WITH w AS ({_WALL}), e AS (SELECT plan_id, wall_id, x1 AS x, y1 AS y FROM w UNION ALL SELECT plan_id, wall_id, x2, y2 FROM w)
SELECT plan_id, x, y, count(DISTINCT wall_id) AS walls, CASE count(DISTINCT wall_id) WHEN 1 THEN 'end' WHEN 2 THEN 'corner' WHEN 3 THEN 'T' WHEN 4 THEN 'cross' ELSE 'complex' END AS kind
FROM e WHERE wall_id IS NOT NULL GROUP BY plan_id, x, y""")
def junction_kinds(spark, d):
    """Junctions of walls by shared end point, with their kind by number of walls."""
    w = E.walls(_read(spark, d, "plans"))
    ends = w.select("plan_id", "wall_id", F.explode(F.array(F.struct(F.col("x1").alias("x"), F.col("y1").alias("y")), F.struct(F.col("x2").alias("x"), F.col("y2").alias("y")))).alias("p"))
    n = F.col("walls")
    kind = F.when(n == 1, "end").when(n == 2, "corner").when(n == 3, "T").when(n == 4, "cross").otherwise("complex")
    return ends.where("wall_id is not null").groupBy("plan_id", F.col("p.x").alias("x"), F.col("p.y").alias("y")).agg(F.count_distinct("wall_id").alias("walls")).withColumn("kind", kind)


@query(f"""WITH w AS ({_WALL}), b AS (SELECT plan_id, min(least(x1, x2)) AS l, max(greatest(x1, x2)) AS r, min(least(y1, y2)) AS b, max(greatest(y1, y2)) AS t FROM w GROUP BY plan_id)
SELECT w.plan_id, w.wall_id, w.ord, concat_ws(',', CASE WHEN x1 = l AND x2 = l THEN 'left' END, CASE WHEN x1 = r AND x2 = r THEN 'right' END, CASE WHEN y1 = b.b AND y2 = b.b THEN 'bottom' END, CASE WHEN y1 = t AND y2 = t THEN 'top' END,
  CASE WHEN abs(x2 - x1) > 0.3 * (r - l) AND r > l THEN 'span' END) AS reasons
FROM w JOIN b ON w.plan_id = b.plan_id""")
def exterior_reasons(spark, d):
    """Why a wall counts as an outer one: sides of the plan's bounds it lies on, and its span."""
    w = E.walls(_read(spark, d, "plans"))
    b = w.groupBy("plan_id").agg(F.min(F.least("x1", "x2")).alias("l"), F.max(F.greatest("x1", "x2")).alias("r"), F.min(F.least("y1", "y2")).alias("b"), F.max(F.greatest("y1", "y2")).alias("t"))
    c = F.col
    tags = measures.notes(
        ((c("x1") == c("l")) & (c("x2") == c("l")), "left"), ((c("x1") == c("r")) & (c("x2") == c("r")), "right"),
        ((c("y1") == c("b")) & (c("y2") == c("b")), "bottom"), ((c("y1") == c("t")) & (c("y2") == c("t")), "top"),
        ((F.abs(c("x2") - c("x1")) > 0.3 * (c("r") - c("l"))) & (c("r") > c("l")), "span"),
    )
    return w.join(b, "plan_id").select("plan_id", "wall_id", "ord", F.concat_ws(",", tags).alias("reasons"))


def _opening_sql(column: str) -> str:
    return f"""SELECT plan_id, CAST(ord - 1 AS INTEGER) AS ord, e.id AS id, e.host_wall_id AS host_wall_id, e.insertion_point[1] AS x, e.insertion_point[2] AS y, e.width AS width, e.height AS height
  FROM (SELECT plan_id, unnest({column}) AS e, generate_subscripts({column}, 1) AS ord FROM plans) WHERE e IS NOT NULL"""


@query(f"""WITH o AS ({_opening_sql('doors')}), w AS ({_WALL}),
t AS (SELECT o.plan_id, o.id, o.ord, w.wall_id, w.ord AS wo, x, y, x1, y1, x2, y2, greatest(0.0, least(1.0, CASE WHEN (x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1) > 0 THEN ((x - x1) * (x2 - x1) + (y - y1) * (y2 - y1)) / ((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1)) ELSE 0.0 END)) AS t
  FROM o JOIN w ON o.plan_id = w.plan_id WHERE x IS NOT NULL AND y IS NOT NULL),
g AS (SELECT *, sqrt((x - (x1 + t * (x2 - x1))) * (x - (x1 + t * (x2 - x1))) + (y - (y1 + t * (y2 - y1))) * (y - (y1 + t * (y2 - y1)))) AS dist FROM t),
b AS (SELECT *, row_number() OVER (PARTITION BY plan_id, id, ord ORDER BY dist, wo) AS rn FROM g WHERE dist <= 1000)
SELECT o.plan_id, o.id, o.ord, b.wall_id, b.dist AS distance FROM o LEFT JOIN b ON o.plan_id = b.plan_id AND o.id = b.id AND o.ord = b.ord AND rn = 1""")
def nearest_host(spark, d):
    """The nearest wall of each door within 1000 mm, the first of equally near ones."""
    plans = _read(spark, d, "plans")
    return spatial.nearest_segment(E.openings(plans, "doors"), E.walls(plans), 1000.0)


@query(f"""WITH {_ROOM_POINTS}, o AS ({_opening_sql('windows')}),
c AS (SELECT o.plan_id, o.id, o.ord, e.room_id, e.ord AS ro, e.m, x, y, x1, y1, x2, y2, greatest(0.0, least(1.0, CASE WHEN (x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1) > 0 THEN ((x - x1) * (x2 - x1) + (y - y1) * (y2 - y1)) / ((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1)) ELSE 0.0 END)) AS t
  FROM o JOIN edge e ON o.plan_id = e.plan_id WHERE x IS NOT NULL AND y IS NOT NULL AND m >= 3),
g AS (SELECT plan_id, id, ord, room_id, ro, min(sqrt((x - (x1 + t * (x2 - x1))) * (x - (x1 + t * (x2 - x1))) + (y - (y1 + t * (y2 - y1))) * (y - (y1 + t * (y2 - y1))))) AS dist,
  count(*) FILTER (WHERE (y1 > y) <> (y2 > y) AND x < x1 + (y - y1) * (x2 - x1) / (y2 - y1)) % 2 = 1 AS ins FROM c GROUP BY plan_id, id, ord, room_id, ro),
b AS (SELECT *, CASE WHEN ins THEN 0.0 ELSE dist END AS dd FROM g),
r AS (SELECT *, row_number() OVER (PARTITION BY plan_id, id, ord ORDER BY dd, ro) AS rn FROM b WHERE dd <= 500)
SELECT plan_id, id, ord, room_id, dd AS distance FROM r WHERE rn = 1""")
def window_rooms(spark, d):
    """The nearest room of each window within 500 mm."""
    plans = _read(spark, d, "plans")
    return spatial.nearest_polygon(E.openings(plans, "windows"), E.rooms(plans), 500.0)


@query(f"""WITH o AS ({_opening_sql('doors')}), w AS ({_WALL})
SELECT o.plan_id, o.id, o.ord, w.is_exterior AS exterior, w.wall_id IS NOT NULL AS hosted FROM o LEFT JOIN w ON o.plan_id = w.plan_id AND o.host_wall_id = w.wall_id""")
def door_hosts(spark, d):
    """Doors with their host wall, by id; a door without one stays."""
    plans = _read(spark, d, "plans")
    w = E.walls(plans).select("plan_id", F.col("wall_id").alias("host_wall_id"), "is_exterior", F.lit(True).alias("h"))
    return E.openings(plans, "doors").join(w, ["plan_id", "host_wall_id"], "left").select("plan_id", "id", "ord", F.col("is_exterior").alias("exterior"), F.coalesce("h", F.lit(False)).alias("hosted"))


@query(f"""WITH o AS ({_opening_sql('windows')}), b AS (SELECT plan_id, ord, id, x - width AS x1, x + width AS x2, y - width AS y1, y + width AS y2 FROM o WHERE x IS NOT NULL AND y IS NOT NULL AND width IS NOT NULL),
p AS (SELECT a.plan_id, a.id AS id_a, c.id AS id_b, greatest(least(a.x2, c.x2) - greatest(a.x1, c.x1), 0.0) * greatest(least(a.y2, c.y2) - greatest(a.y1, c.y1), 0.0) AS i,
  (a.x2 - a.x1) * (a.y2 - a.y1) + (c.x2 - c.x1) * (c.y2 - c.y1) AS s FROM b a JOIN b c ON a.plan_id = c.plan_id AND a.ord < c.ord)
SELECT plan_id, id_a, id_b, i / (s - i) AS iou FROM p WHERE s - i > 0 AND i / (s - i) > 0.05""")
def overlapping_boxes(spark, d):
    """Pairs of windows of a plan whose boxes overlap."""
    o = E.openings(_read(spark, d, "plans"), "windows").where("x is not null and y is not null and width is not null")
    c = F.col
    box = F.struct((c("x") - c("width")).alias("x1"), (c("y") - c("width")).alias("y1"), (c("x") + c("width")).alias("x2"), (c("y") + c("width")).alias("y2"))
    return spatial.overlapping_boxes(o.select("plan_id", "id", "ord", box.alias("b")), 0.05, 4000.0)


@query(f"""WITH o AS ({_opening_sql('doors')})
SELECT a.plan_id, a.id AS id_a, b.id AS id_b FROM o a JOIN o b ON a.plan_id = b.plan_id AND a.ord < b.ord WHERE sqrt((b.x - a.x) * (b.x - a.x) + (b.y - a.y) * (b.y - a.y)) < 1500""")
def near_doors(spark, d):
    """Pairs of doors of a plan closer than 1500 mm."""
    o = E.openings(_read(spark, d, "plans"), "doors").where("x is not null and y is not null")
    return spatial.near_pairs(o.select("plan_id", "id", "ord", "x", "y"), 1500.0)


@query(f"""WITH o AS ({_opening_sql('doors')}), w AS ({_WALL}),
n AS (SELECT o.plan_id, o.ord, w.wall_id, row_number() OVER (PARTITION BY o.plan_id, o.ord ORDER BY w.ord) AS rn FROM o JOIN w ON o.plan_id = w.plan_id WHERE sqrt((w.x1 - o.x) * (w.x1 - o.x) + (w.y1 - o.y) * (w.y1 - o.y)) <= 2000)
SELECT o.plan_id, o.ord, n.wall_id FROM o LEFT JOIN n ON o.plan_id = n.plan_id AND o.ord = n.ord AND rn = 1 WHERE o.x IS NOT NULL AND o.y IS NOT NULL""")
def first_within_tolerance(spark, d):
    """The first wall, by order, that starts within 2000 mm of a door."""
    plans = _read(spark, d, "plans")
    o = E.openings(plans, "doors").where("x is not null and y is not null").select("plan_id", F.col("ord").alias("id"), "x", "y")
    w = E.walls(plans).select("plan_id", F.col("wall_id").alias("target_id"), F.col("ord").alias("target_ord"), F.col("x1").alias("tx"), F.col("y1").alias("ty"))
    return spatial.first_within(o, w, 2000.0).select("plan_id", F.col("id").alias("ord"), F.col("target_id").alias("wall_id"))


@query(f"""WITH o AS ({_opening_sql('doors')}), r AS (SELECT *, row_number() OVER (PARTITION BY plan_id, host_wall_id ORDER BY width DESC, ord) AS rn FROM o WHERE host_wall_id IS NOT NULL AND width IS NOT NULL)
SELECT plan_id, host_wall_id, id, width FROM r WHERE rn = 1""")
def widest_door(spark, d):
    """The widest door of each wall, the first of equally wide ones."""
    o = E.openings(_read(spark, d, "plans"), "doors").where("host_wall_id is not null and width is not null")
    best = o.groupBy("plan_id", "host_wall_id").agg(F.min_by(F.struct("id", "width"), F.struct(-F.col("width"), "ord")).alias("b"))
    return best.select("plan_id", "host_wall_id", "b.id", "b.width")


@query(f"""WITH {_ROOM_POINTS}, a AS (SELECT plan_id, ord, any_value(room_id) AS room_id, abs(sum(x1 * y2 - x2 * y1)) / 2 AS area FROM edge WHERE m >= 3 GROUP BY plan_id, ord),
m AS (SELECT plan_id, median(area) AS med FROM a GROUP BY plan_id)
SELECT a.plan_id, a.ord, a.room_id, area FROM a JOIN m ON a.plan_id = m.plan_id WHERE area > 2 * med OR area < 0.5 * med""")
def odd_rooms(spark, d):
    """Rooms more than twice or less than half the median area of their plan."""
    r = E.rooms(_read(spark, d, "plans")).where(F.size("ring") >= 3).select("plan_id", F.col("ord").cast("long").alias("ord"), "room_id", G.area(F.col("ring")).alias("area"))
    return measures.anomalies(r, ["plan_id"], "area", 2.0, 0.5).select("plan_id", "ord", "room_id", "area")


@query(f"""WITH o AS ({_opening_sql('windows')})
SELECT plan_id, id, ord, width * height / 1e6 AS glazed_m2, CASE WHEN width * height < 1000000 THEN 'small' WHEN width * height < 2000000 THEN 'medium' ELSE 'large' END AS size FROM o WHERE width IS NOT NULL AND height IS NOT NULL""")
def window_sizes(spark, d):
    """Glazed area and size class of windows."""
    o = E.openings(_read(spark, d, "plans"), "windows").where("width is not null and height is not null")
    a = F.col("width") * F.col("height")
    return o.select("plan_id", "id", "ord", (a / 1e6).alias("glazed_m2"), F.when(a < 1000000, "small").when(a < 2000000, "medium").otherwise("large").alias("size"))


@query("""SELECT plan_id, len(rooms) AS rooms, coalesce(len(doors), 0) AS doors, coalesce(len(stairs), 0) > 0 AS has_stairs, coalesce(len(railings), 0) > 0 AS has_railing,
 len(list_filter(rooms, lambda r: r.polygon IS NULL)) AS without_polygon FROM plans WHERE rooms IS NOT NULL""")
def plan_counts(spark, d):
    """Elements per plan straight from the nested columns, without an explode."""
    size = lambda c: F.coalesce(F.size(c), F.lit(0))
    p = _read(spark, d, "plans").where("rooms is not null")
    return p.select("plan_id", size("rooms").cast("long").alias("rooms"), size("doors").cast("long").alias("doors"), (size("stairs") > 0).alias("has_stairs"), (size("railings") > 0).alias("has_railing"), F.size(F.filter("rooms", lambda r: r["polygon"].isNull())).cast("long").alias("without_polygon"))


@query("""SELECT p.plan_id, e.category AS category, count(*) AS rooms FROM (SELECT plan_id, unnest(rooms) AS e FROM plans) p GROUP BY p.plan_id, e.category""")
def room_histogram(spark, d):
    """Rooms per plan and category."""
    return E.exploded(_read(spark, d, "plans"), "rooms").groupBy("plan_id", F.col("e.category").alias("category")).agg(F.count("*").alias("rooms"))


@query("""SELECT plan_id FROM plans p WHERE EXISTS (SELECT 1 FROM plan_exports x WHERE x.plan_id = p.plan_id AND x.payload <> '')""")
def exported_plans(spark, d):
    """Plans with at least one export that is not empty (semi-join)."""
    return _read(spark, d, "plans").select("plan_id").join(_read(spark, d, "plan_exports").where("payload <> ''").select("plan_id"), "plan_id", "left_semi")


@query("""SELECT plan_id FROM plans p WHERE NOT EXISTS (SELECT 1 FROM plan_exports x WHERE x.plan_id = p.plan_id AND x.exporter = 'web_ui')""")
def unexported_plans(spark, d):
    """Plans without an export of one exporter (anti-join)."""
    return _read(spark, d, "plans").select("plan_id").join(_read(spark, d, "plan_exports").where("exporter = 'web_ui'").select("plan_id"), "plan_id", "left_anti")


# ------------------------------------------------------------------ keyed tables and quality


@query("""SELECT plan_id, agent, count(*) FILTER (WHERE v = 'PASS') AS pass, count(*) FILTER (WHERE v = 'FAIL') AS fail, count(*) FILTER (WHERE v = 'NEEDS_REVIEW') AS needs_review, count(*) AS total
FROM (SELECT plan_id, agent, coalesce(upper(trim(verdict)), 'NEEDS_REVIEW') AS v FROM findings) GROUP BY plan_id, agent""")
def verdict_summary(spark, d):
    """Verdicts per plan and agent, zeros included."""
    return measures.verdict_counts(_read(spark, d, "findings"), ["plan_id", "agent"])


@query("""WITH r AS (SELECT *, row_number() OVER (PARTITION BY plan_id, agent, article_id, element_id, checked_at, message ORDER BY ingested_at DESC, finding_id DESC) AS rn FROM findings)
SELECT finding_id, plan_id, article_id, element_id, verdict FROM r WHERE rn = 1""")
def latest_findings(spark, d):
    """Findings once each: of repeated deliveries the last ingested."""
    keys = ["plan_id", "agent", "article_id", "element_id", "checked_at", "message"]
    f = _read(spark, d, "findings").select(*keys, "finding_id", "ingested_at", "verdict")
    return keyed.latest(f, keys, ["ingested_at", "finding_id"]).select("finding_id", "plan_id", "article_id", "element_id", "verdict")


@query("""WITH n AS (SELECT mabhas_part, article_id, clause_id, rule_type FROM (SELECT *, row_number() OVER (PARTITION BY mabhas_part, article_id ORDER BY ingested_at DESC, clause_id DESC) AS rn FROM clauses WHERE origin IN ('gazette', 'council_site')) WHERE rn = 1),
o AS (SELECT mabhas_part, article_id, clause_id, rule_type FROM (SELECT *, row_number() OVER (PARTITION BY mabhas_part, article_id ORDER BY ingested_at DESC, clause_id DESC) AS rn FROM clauses WHERE origin NOT IN ('gazette', 'council_site')) WHERE rn = 1)
SELECT coalesce(n.mabhas_part, o.mabhas_part) AS mabhas_part, coalesce(n.article_id, o.article_id) AS article_id, coalesce(o.clause_id, n.clause_id) AS clause_id, CASE WHEN n.article_id IS NOT NULL THEN n.rule_type ELSE o.rule_type END AS rule_type
FROM n FULL JOIN o ON n.mabhas_part = o.mabhas_part AND n.article_id = o.article_id""")
def clause_upsert(spark, d):
    """Clauses of official origins upserted into those of the others by part and article; the first id is kept."""
    c = _read(spark, d, "clauses").select("mabhas_part", "article_id", "clause_id", "rule_type", "ingested_at", "origin")
    keys, official = ["mabhas_part", "article_id"], F.col("origin").isin("gazette", "council_site")
    sides = [keyed.latest(c.where(w).drop("origin"), keys, ["ingested_at", "clause_id"]).drop("ingested_at") for w in (~official, official)]
    return keyed.upserted(sides[0], sides[1], keys, kept=["clause_id"])


@query("""SELECT min(clause_id) AS clause_id, text_fa FROM clauses WHERE text_fa IS NOT NULL GROUP BY text_fa""")
def first_seen_clauses(spark, d):
    """The first clause of each text."""
    return keyed.first_seen(_read(spark, d, "clauses").where("text_fa is not null").select("clause_id", "text_fa"), ["text_fa"], ["clause_id"])


@query("""SELECT mabhas_part, article_id, count(*) AS n FROM clauses GROUP BY mabhas_part, article_id HAVING count(*) > 1""")
def duplicate_keys(spark, d):
    """Clause keys delivered more than once."""
    return keyed.repeated_keys(_read(spark, d, "clauses"), ["mabhas_part", "article_id"])


@query("""SELECT clause_id, concat_ws(',', CASE WHEN coalesce(trim(heading_fa), '') = '' THEN 'heading_fa' END, CASE WHEN coalesce(trim(text_en), '') = '' THEN 'text_en' END, CASE WHEN coalesce(trim(rule_type), '') = '' THEN 'rule_type' END) AS missing
FROM clauses WHERE coalesce(trim(heading_fa), '') = '' OR coalesce(trim(text_en), '') = '' OR coalesce(trim(rule_type), '') = ''""")
def required_fields(spark, d):
    """Clauses that lack required fields, with their names."""
    return keyed.lacking_fields(_read(spark, d, "clauses"), "clause_id", ["heading_fa", "text_en", "rule_type"]).withColumn("missing", F.concat_ws(",", "missing"))


@query("""SELECT rule_type, count(*) AS n FROM clauses WHERE rule_type IS NOT NULL AND rule_type NOT IN ('numeric', 'spatial') GROUP BY rule_type""")
def vocabulary(spark, d):
    """Rule types outside a vocabulary."""
    return keyed.outside_vocabulary(_read(spark, d, "clauses"), "rule_type", ["numeric", "spatial"])


@query("""SELECT finding_id, concat_ws(',', CASE WHEN measured < 0 OR measured > 10000 THEN 'measured' END, CASE WHEN required.lo < 0 OR required.lo > 10000 THEN 'lo' END) AS failed
FROM findings WHERE measured < 0 OR measured > 10000 OR required.lo < 0 OR required.lo > 10000""")
def range_check(spark, d):
    """Findings with numbers outside their ranges."""
    f = _read(spark, d, "findings").select("finding_id", "measured", F.col("required.lo").alias("lo"))
    return keyed.out_of_range(f, "finding_id", {"measured": (0, 10000), "lo": (0, 10000)}).withColumn("failed", F.concat_ws(",", "failed"))


@query("""SELECT clause_id, CASE WHEN coalesce(skip_category, '') <> '' THEN false WHEN applicable_occupancies IS NOT NULL THEN len(list_intersect(applicable_occupancies, ['M-4', 'all_residential'])) > 0 ELSE true END AS in_scope FROM clauses""")
def scope_filter(spark, d):
    """Whether each clause is in scope."""
    return _read(spark, d, "clauses").select("clause_id", keyed.in_scope(F.col("skip_category"), F.col("applicable_occupancies"), ["M-4", "all_residential"]).alias("in_scope"))


@query("""SELECT clause_id, concat_ws(chr(10), nullif(trim(heading_fa, ' '), ''), nullif(trim(text_fa, ' '), ''), nullif(trim(text_en, ' '), '')) AS passage FROM clauses""")
def passage_text(spark, d):
    """Heading and texts of a clause as one passage."""
    return _read(spark, d, "clauses").select("clause_id", keyed.passage(F.col("heading_fa"), F.col("text_fa"), F.col("text_en")).alias("passage"))


@query("""SELECT rule_type, count(*) AS total, count(*) FILTER (WHERE list_contains(applicable_occupancies, 'M-4')) AS m4, count(*) FILTER (WHERE list_contains(applicable_height_groups, 'any')) AS any_height, count(*) FILTER (WHERE coalesce(skip_category, '') <> '') AS skipped FROM clauses GROUP BY rule_type""")
def conditional_counts(spark, d):
    """Per rule type: clauses, those for an occupancy, for any height, and skipped ones."""
    has = lambda c, v: F.coalesce(F.array_contains(c, v), F.lit(False))
    return _read(spark, d, "clauses").groupBy("rule_type").agg(F.count("*").alias("total"), F.count_if(has("applicable_occupancies", "M-4")).alias("m4"), F.count_if(has("applicable_height_groups", "any")).alias("any_height"), F.count_if(F.coalesce("skip_category", F.lit("")) != "").alias("skipped"))


@query("""SELECT t.term_id, t.term, count(f.finding_id) AS n, min(f.measured) AS low, max(f.measured) AS high FROM canon_terms t LEFT JOIN findings f ON f.object = t.term AND f.measured IS NOT NULL GROUP BY t.term_id, t.term""")
def registry_stats(spark, d):
    """Findings per registered term, terms without any included."""
    f = _read(spark, d, "findings").where("measured is not null").select(F.col("object").alias("term"), "measured")
    return measures.registry_stats(_read(spark, d, "canon_terms").select("term_id", "term"), f, "term", "measured").select("term_id", "term", "n", "low", "high")


@query("""WITH v AS (SELECT article_id, object, upper(trim(verdict)) AS v FROM findings WHERE object IS NOT NULL AND verdict IS NOT NULL)
SELECT article_id, object, count(*) AS n, any_value(v) AS verdict FROM v GROUP BY article_id, object HAVING count(*) >= 3 AND count(DISTINCT v) = 1""")
def unanimous(spark, d):
    """Articles and objects with at least three findings, all of one verdict."""
    v = _read(spark, d, "findings").where("object is not null and verdict is not null").select("article_id", "object", F.upper(F.trim("verdict")).alias("v"))
    g = v.groupBy("article_id", "object").agg(F.count("*").alias("n"), F.min("v").alias("verdict"), F.max("v").alias("other"))
    return g.where("n >= 3 and verdict = other").drop("other")


@query("""WITH c AS (SELECT article_id, clause_id, rule_type, row_number() OVER (PARTITION BY article_id ORDER BY clause_id DESC) AS rn FROM clauses)
SELECT f.finding_id, c.clause_id, c.rule_type FROM findings f LEFT JOIN c ON f.article_id = c.article_id AND c.rn = 1""")
def clause_lookup(spark, d):
    """Each finding with the last clause of its article; both sides may be large, hot articles are split by AQE."""
    c = keyed.latest(_read(spark, d, "clauses").select("article_id", "clause_id", "rule_type"), ["article_id"], ["clause_id"])
    return _read(spark, d, "findings").select("finding_id", "article_id").join(c, "article_id", "left").select("finding_id", "clause_id", "rule_type")


# ------------------------------------------------------------------ ordered operators


@query("""SELECT finding_id, avg(measured) OVER (PARTITION BY plan_id, element_id ORDER BY checked_at, finding_id ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS smooth FROM findings WHERE measured IS NOT NULL AND element_id IS NOT NULL""")
def moving_average_3(spark, d):
    """Centred moving average of three over the measurements of an element."""
    f = _read(spark, d, "findings").where("measured is not null and element_id is not null").select("finding_id", "plan_id", "element_id", "checked_at", "measured")
    return measures.moving_average(f, ["plan_id", "element_id"], ["checked_at", "finding_id"], "measured").select("finding_id", "smooth")


@query("""SELECT vec_id, clause_id, CAST(floor((row_number() OVER (PARTITION BY clause_id ORDER BY chunk_no, vec_id) - 1) / 2) AS BIGINT) AS chunk FROM clause_vectors WHERE clause_id IS NOT NULL""")
def chunk_numbers(spark, d):
    """Vectors of a clause in chunks of two."""
    v = _read(spark, d, "clause_vectors").where("clause_id is not null").select("vec_id", "clause_id", "chunk_no")
    return keyed.chunked(v, "clause_id", ["chunk_no", "vec_id"], 2).select("vec_id", "clause_id", "chunk")


@query("""SELECT plan_id, CAST(floor(doc_id / 500) AS BIGINT) AS part, string_agg(CAST(doc_id AS VARCHAR) || ':' || coalesce(doc_kind, '?'), '|' ORDER BY doc_id) AS listing FROM documents WHERE plan_id IS NOT NULL GROUP BY plan_id, CAST(floor(doc_id / 500) AS BIGINT)""")
def ordered_listing(spark, d):
    """Documents of each plan in order, as texts of bounded length: a hot plan has many parts."""
    docs = _read(spark, d, "documents").where("plan_id is not null")
    item = F.concat(F.col("doc_id").cast("string"), F.lit(":"), F.coalesce("doc_kind", F.lit("?")))
    return docs.groupBy("plan_id", F.floor(F.col("doc_id") / 500).alias("part")).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("doc_id", item.alias("t")))), lambda x: x["t"]), "|").alias("listing"))


@query("""WITH r AS (SELECT plan_id, article_id, finding_id, row_number() OVER w AS rank, sum(CASE WHEN upper(verdict) = 'FAIL' THEN 1 ELSE 0 END) OVER (PARTITION BY plan_id, article_id ORDER BY measured DESC, finding_id ROWS UNBOUNDED PRECEDING) AS hits FROM findings WHERE measured IS NOT NULL WINDOW w AS (PARTITION BY plan_id, article_id ORDER BY measured DESC, finding_id)),
p AS (SELECT *, CAST(hits AS DOUBLE) / rank AS precision FROM r)
SELECT plan_id, article_id, finding_id, CAST(rank AS INTEGER) AS rank, CAST(hits AS BIGINT) AS hits, precision, max(precision) OVER (PARTITION BY plan_id, article_id ORDER BY rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS envelope FROM p""")
def precision_envelope(spark, d):
    """Precision by rank and its monotone envelope per plan and article."""
    f = _read(spark, d, "findings").where("measured is not null").select("plan_id", "article_id", "finding_id", "measured", (F.upper("verdict") == "FAIL").cast("int").alias("hit"), F.lit(1.0).alias("n"))
    return measures.precision_envelope(f, ["plan_id", "article_id"], "measured", "hit", "n", ["finding_id"]).select("plan_id", "article_id", "finding_id", "rank", "hits", "precision", "envelope")


@query("""SELECT t.threshold, count(l.l_orderkey) AS kept, coalesce(sum(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) FILTER (WHERE l.l_orderkey IS NOT NULL), 0)::BIGINT AS hits FROM (VALUES (0.0::DOUBLE), (10.0), (20.0), (30.0), (40.0), (50.0), (60.0)) t(threshold) LEFT JOIN lineitem l ON l.l_quantity >= t.threshold GROUP BY t.threshold""")
def threshold_sweep(spark, d):
    """Kept rows and hits at each of a list of thresholds, in one pass."""
    rows = _read(spark, d, "lineitem").select("l_quantity", (F.col("l_returnflag") == "R").alias("hit"))
    return measures.threshold_sweep(rows, "l_quantity", "hit", [0.0, 10.0, 20.0, 30.0, 40.0, 50.0, 60.0])


@query("""SELECT finding_id, CASE verdict WHEN 'FAIL' THEN 0 WHEN 'NEEDS_REVIEW' THEN 1 WHEN 'PASS' THEN 2 ELSE 3 END AS verdict_rank, CASE WHEN length(message) > 70 THEN left(message, 70) || '…' ELSE message END AS title FROM findings""")
def report_order(spark, d):
    """Report lines: rank of the verdict and short title."""
    return report_rows(_read(spark, d, "findings")).select("finding_id", "verdict_rank", "title")


_TOP = """SELECT e.vec_id, e.label, round(list_dot_product(e.embedding::DOUBLE[], q.embedding::DOUBLE[]) / (sqrt(list_dot_product(e.embedding::DOUBLE[], e.embedding::DOUBLE[])) * sqrt(list_dot_product(q.embedding::DOUBLE[], q.embedding::DOUBLE[]))), 9) AS score
FROM embeddings e, (SELECT embedding FROM embeddings ORDER BY vec_id LIMIT 1) q {where} ORDER BY score DESC, e.vec_id LIMIT 10"""


def _query_vector(spark, d) -> list[float]:
    return [float(x) for x in _read(spark, d, "embeddings").orderBy("vec_id").select("embedding").first()[0]]


@query(_TOP.format(where=""))
def cosine_topk(spark, d):
    """The ten vectors most similar to one, exact."""
    out = measures.top_k(_read(spark, d, "embeddings"), "embedding", _query_vector(spark, d), 10, ["vec_id"])
    return out.select("vec_id", "label", F.round("score", 9).alias("score"))


@query(_TOP.format(where="WHERE e.label = 3"))
def cosine_topk_filtered(spark, d):
    """The same among the vectors of one label."""
    out = measures.top_k(_read(spark, d, "embeddings"), "embedding", _query_vector(spark, d), 10, ["vec_id"], F.col("label") == 3)
    return out.select("vec_id", "label", F.round("score", 9).alias("score"))


_TOP_BATCH = """SELECT query_id, vec_id, label, score FROM (
SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS r FROM (
SELECT q.vec_id AS query_id, e.vec_id, e.label, round(list_dot_product(e.embedding::DOUBLE[], q.embedding::DOUBLE[]) / (sqrt(list_dot_product(e.embedding::DOUBLE[], e.embedding::DOUBLE[])) * sqrt(list_dot_product(q.embedding::DOUBLE[], q.embedding::DOUBLE[]))), 9) AS score
FROM embeddings e, embeddings q WHERE q.vec_id % 100 = 0)) WHERE r <= 10"""


@query(_TOP_BATCH)
def cosine_topk_batch(spark, d):
    """The ten vectors most similar to each whose id is divisible by 100, among all rows, exact."""
    e = _read(spark, d, "embeddings")
    found = measures.top_k_batch(e, "vec_id", "embedding", len(_query_vector(spark, d)), F.col("vec_id") % 100 == 0, 10)
    return found.join(e.select(F.col("vec_id").alias("id"), "label"), "id").select("query_id", F.col("id").alias("vec_id"), "label", "score")


@query("""SELECT event_id, CAST(regexp_extract(props, '"k":\\s*(-?[0-9]+)', 1) AS BIGINT) AS k FROM events WHERE regexp_matches(props, '"k":\\s*-?[0-9]+')""")
def json_member(spark, d):
    """A member of the JSON texts of events, read by its path."""
    return _read(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k")).where("k is not null")


@query("""SELECT o.o_custkey, o.o_orderpriority, count(*) AS n, sum(CAST(round(l.l_quantity) AS BIGINT)) AS quantity FROM orders o JOIN lineitem l ON o.o_orderkey = l.l_orderkey GROUP BY o.o_custkey, o.o_orderpriority""")
def order_lines(spark, d):
    """A large equi-join pre-aggregated on its key before the shuffle."""
    lines = _read(spark, d, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n"), F.sum(F.round("l_quantity").cast("long")).alias("q"))
    o = _read(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderpriority")
    return o.join(lines, o["o_orderkey"] == lines["l_orderkey"]).groupBy("o_custkey", "o_orderpriority").agg(F.sum("n").alias("n"), F.sum("q").alias("quantity"))


# ------------------------------------------------------------------ sets, graphs, greedy operators


@query("""(SELECT plan_id FROM plan_exports WHERE exporter = 'web_ui' EXCEPT SELECT plan_id FROM plan_exports WHERE exporter = 'ifc_exporter') UNION (SELECT plan_id FROM plan_exports WHERE exporter = 'ifc_exporter' EXCEPT SELECT plan_id FROM plan_exports WHERE exporter = 'web_ui')""")
def set_difference(spark, d):
    """Plans exported by one of two exporters only."""
    x = _read(spark, d, "plan_exports")
    a, b = (x.where(F.col("exporter") == e).select("plan_id") for e in ("web_ui", "ifc_exporter"))
    return a.subtract(b).union(b.subtract(a)).distinct()


_SUPPLY = """WITH RECURSIVE e AS (SELECT DISTINCT a.l_suppkey AS a, b.l_suppkey AS b FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_suppkey <> b.l_suppkey WHERE a.l_quantity >= 50 AND b.l_quantity >= 50),
r(node, label) AS (SELECT s_suppkey, s_suppkey FROM supplier UNION SELECT e.b, r.label FROM r JOIN e ON r.node = e.a)"""


def _supply_graph(spark, d):
    big = _read(spark, d, "lineitem").where("l_quantity >= 50").select(F.lit(0).alias("g"), "l_orderkey", F.col("l_suppkey").alias("a"))
    edges = big.join(big.select("l_orderkey", F.col("a").alias("b")), "l_orderkey").where("a < b").select("g", "a", "b").distinct()
    return _read(spark, d, "supplier").select(F.lit(0).alias("g"), F.col("s_suppkey").alias("node"), "s_nationkey"), edges


@query(_SUPPLY + " SELECT node, min(label) AS label FROM r GROUP BY node")
def graph_components(spark, d):
    """Components of the supplier graph, by least member."""
    nodes, edges = _supply_graph(spark, d)
    return graph.components(nodes.select("g", "node"), edges).select("node", "label")


@query(_SUPPLY + " SELECT s.s_suppkey AS node, EXISTS (SELECT 1 FROM r JOIN supplier t ON r.label = t.s_suppkey WHERE r.node = s.s_suppkey AND t.s_nationkey IN (0, 5)) AS reaches FROM supplier s")
def graph_reachable(spark, d):
    """Suppliers that reach one of given nations."""
    nodes, edges = _supply_graph(spark, d)
    return graph.reachable(nodes.select("g", "node"), edges, nodes.where("s_nationkey in (0, 5)")).select("node", "reaches")


@query(_SUPPLY.replace("r(node, label)", "goal AS (SELECT s_suppkey AS node FROM supplier WHERE s_nationkey IN (0, 5)), r(node, steps)").replace("SELECT s_suppkey, s_suppkey FROM supplier UNION SELECT e.b, r.label FROM r JOIN e ON r.node = e.a", "SELECT node, 0 FROM goal UNION SELECT e.b, r.steps + 1 FROM r JOIN e ON r.node = e.a WHERE r.steps < 40") + """, m AS (SELECT node, min(steps) AS steps FROM r GROUP BY node)
SELECT m.node, CAST(m.steps AS INTEGER) AS steps, min(v.node) AS via FROM m LEFT JOIN e ON e.a = m.node AND m.steps > 0 LEFT JOIN m v ON v.node = e.b AND v.steps = m.steps - 1 GROUP BY m.node, m.steps""")
def graph_steps(spark, d):
    """Fewest steps from each supplier to one of given nations."""
    nodes, edges = _supply_graph(spark, d)
    return graph.steps_to(nodes.select("g", "node"), edges, nodes.where("s_nationkey in (0, 5)")).select("node", "steps", "via")


def flagship(spark: SparkSession, d: str) -> DataFrame:
    """Rooms with their area and the windows that lie nearest to them."""
    plans = _read(spark, d, "plans")
    r = E.rooms(plans).where(F.size("ring") >= 3).select("plan_id", "room_id", "category", G.area(F.col("ring")).alias("area"))
    w = spatial.nearest_polygon(E.openings(plans, "windows"), E.rooms(plans), 500.0).groupBy("plan_id", "room_id").agg(F.count("*").alias("windows"))
    return r.join(w, ["plan_id", "room_id"], "left").select("plan_id", "room_id", "category", "area", F.coalesce("windows", F.lit(0)).alias("windows"))


def _all() -> list:
    from planweave.plans import rooms, shapes, tables

    return [(QUERIES, SQL), *((m.QUERIES, m.SQL) for m in (rooms, tables, shapes))]


def queries() -> dict:
    """All queries of the core."""
    return {k: v for q, _ in _all() for k, v in q.items()}


def oracle_sql() -> dict[str, str]:
    return {k: v for _, s in _all() for k, v in s.items()}
