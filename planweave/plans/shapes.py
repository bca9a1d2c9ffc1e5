"""Registered queries on shapes, names, decisions and chunks of tables, with the SQL that must give the same rows."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from planweave.functions import geometry as G
from planweave.operators import keyed, measures
from planweave.plans.catalogue import _ROOM_POINTS, _WALL, _opening_sql, _read, registry
from planweave.plans.tables import _DOOR_BOX, _len
from planweave.sources import elements as E
from planweave.sources.files import report_rows

QUERIES, SQL, query = registry()
c = F.col

# How a door of a name opens, and the angle it opens by.
OPERATIONS = {"narrow": "SINGLE_SWING_LEFT", "normal": "SINGLE_SWING_RIGHT", "wide": "DOUBLE_DOOR_SINGLE_SWING"}
ANGLES = {"narrow": 90, "normal": 90, "wide": 180}


def _map(values: dict):
    return F.create_map(*[F.lit(x) for kv in values.items() for x in kv])


_KIND = "CASE WHEN width < 800 THEN 'narrow' WHEN width < 1000 THEN 'normal' ELSE 'wide' END"


def _map_sql(values: dict) -> str:
    return "CASE k " + " ".join(f"WHEN '{a}' THEN {b!r}" for a, b in values.items()) + " END"


@query(f"SELECT plan_id, 'Door_' || (ord + 1) AS name, k AS kind, {_map_sql(OPERATIONS)} AS operation, CAST({_map_sql(ANGLES)} AS INTEGER) AS angle, coalesce(height, 2100.0) AS height FROM (SELECT *, {_KIND} AS k FROM ({_opening_sql('doors')}) WHERE width IS NOT NULL)")
def shaped_doors(spark, d):
    """Doors as an exporter takes them: a name by place, kind, operation and angle by table, a height by default."""
    o = E.openings(_read(spark, d, "plans"), "doors").where("width is not null")
    o = o.withColumn("kind", F.when(c("width") < 800, "narrow").when(c("width") < 1000, "normal").otherwise("wide"))
    return o.select("plan_id", F.concat(F.lit("Door_"), c("ord") + 1).alias("name"), "kind", _map(OPERATIONS)[c("kind")].alias("operation"), _map(ANGLES)[c("kind")].alias("angle"), F.coalesce("height", F.lit(2100.0)).alias("height"))


@query("""SELECT plan_id, e.id AS room_id FROM (SELECT plan_id, unnest(rooms) AS e FROM plans) WHERE e.area_m2 / 25 >= CASE e.category WHEN 'room_living' THEN 0.6 WHEN 'room_storage' THEN 0.15 ELSE 0.3 END""")
def confident_rooms(spark, d):
    """Rooms whose confidence reaches that of their category, or the default one."""
    r = E.rooms(_read(spark, d, "plans"))
    least = F.coalesce(F.try_element_at(_map({"room_living": 0.6, "room_storage": 0.15}), c("category")), F.lit(0.3))
    return r.where(c("area_m2") / 25 >= least).select("plan_id", "room_id")


@query("""SELECT agent, CASE agent WHEN 'safety' THEN 'safeties' WHEN 'topology' THEN 'topologies' ELSE agent || 's' END AS plural, count(*) AS n FROM findings GROUP BY agent""")
def plural_names(spark, d):
    """Agents under their plural names, irregular ones by table."""
    g = _read(spark, d, "findings").groupBy("agent").agg(F.count("*").alias("n"))
    return g.select("agent", F.coalesce(F.try_element_at(_map({"safety": "safeties", "topology": "topologies"}), c("agent")), F.concat("agent", F.lit("s"))).alias("plural"), "n")


_DECIDED = """f AS (SELECT finding_id, plan_id, upper(trim(verdict)) AS v, plan_id || '|' || article_id || '|' || coalesce(element_id, '') AS k FROM findings WHERE agent <> 'safety'),
  s AS (SELECT k, v FROM (SELECT plan_id || '|' || article_id || '|' || coalesce(element_id, '') AS k, upper(trim(verdict)) AS v, row_number() OVER (PARTITION BY plan_id || '|' || article_id || '|' || coalesce(element_id, '') ORDER BY checked_at DESC, finding_id DESC) AS rn FROM findings WHERE agent = 'safety') WHERE rn = 1)"""


def _merged(spark, d):
    f = _read(spark, d, "findings").select("finding_id", "plan_id", "agent", F.upper(F.trim("verdict")).alias("verdict"), F.concat_ws("|", "plan_id", "article_id", F.coalesce("element_id", F.lit(""))).alias("k"), F.struct("checked_at", "finding_id").alias("decided_at"))
    decisions = f.where("agent = 'safety'").select("k", c("verdict").alias("reviewer_verdict"), "decided_at")
    return keyed.decided(f.where("agent <> 'safety'").drop("decided_at"), decisions, "k")


@query(f"""WITH {_DECIDED} SELECT f.plan_id, count(*) FILTER (WHERE z = 'PASS') AS pass, count(*) FILTER (WHERE z = 'FAIL') AS fail, count(*) FILTER (WHERE coalesce(z, 'NEEDS_REVIEW') = 'NEEDS_REVIEW') AS needs_review, count(*) AS total
  FROM (SELECT f.plan_id, CASE WHEN f.v = 'NEEDS_REVIEW' THEN coalesce(s.v, f.v) ELSE f.v END AS z FROM f LEFT JOIN s ON f.k = s.k) f GROUP BY f.plan_id""")
def resolved_summary(spark, d):
    """Verdicts per plan after the latest decision of each open finding's key."""
    return measures.verdict_counts(_merged(spark, d), ["plan_id"], "final")


@query(f"""WITH {_DECIDED} SELECT f.finding_id, CASE WHEN s.k IS NULL THEN 'pending' WHEN s.v = 'NEEDS_REVIEW' THEN 'deferred' ELSE 'decided' END AS state FROM f LEFT JOIN s ON f.k = s.k WHERE f.v = 'NEEDS_REVIEW'""")
def decision_states(spark, d):
    """Open findings by what the log of decisions last says of their key."""
    m = _merged(spark, d).where("verdict = 'NEEDS_REVIEW'")
    return m.select("finding_id", F.when(c("reviewer_verdict").isNull(), "pending").when(c("reviewer_verdict") == "NEEDS_REVIEW", "deferred").otherwise("decided").alias("state"))


# ------------------------------------------------------------------ shapes


@query(f"""WITH {_ROOM_POINTS}, s AS (SELECT plan_id, ord, k, x, y, lag(x) OVER w AS px, lag(y) OVER w AS py FROM ring WINDOW w AS (PARTITION BY plan_id, ord ORDER BY k)), l AS (SELECT plan_id, ord, k, sqrt((x - px) * (x - px) + (y - py) * (y - py)) AS n FROM s WHERE px IS NOT NULL)
  SELECT plan_id, CAST(ord AS INTEGER) AS ord, count(*) AS parts, sum(n) AS length FROM l WHERE n >= 10 GROUP BY plan_id, ord""")
def open_lengths(spark, d):
    """Each ring as an open line: its parts between consecutive corners that are not degenerate, and their length."""
    p = E.rooms(_read(spark, d, "plans")).select("plan_id", "ord", F.posexplode("ring").alias("k", "p"))
    w = Window.partitionBy("plan_id", "ord").orderBy("k")
    far = G.length(F.lag("p.x").over(w), F.lag("p.y").over(w), c("p.x"), c("p.y"))
    return p.withColumn("n", far).where("n >= 10").groupBy("plan_id", "ord").agg(F.count("*").alias("parts"), F.sum("n").alias("length"))


@query(f"""WITH {_ROOM_POINTS} SELECT plan_id, CAST(ord AS INTEGER) AS ord, round(sum(x) / count(*), 6) AS x, round(sum(y) / count(*), 6) AS y, round(min(x) - sum(x) / count(*), 6) AS left_x, round(max(y) - sum(y) / count(*), 6) AS high_y FROM ring GROUP BY plan_id, ord""")
def room_centres(spark, d):
    """The mean of the corners of each room, and its bounds from there."""
    r = E.rooms(_read(spark, d, "plans")).where(F.size("ring") > 0).withColumn("m", G.vertex_mean(c("ring")))
    b = r.withColumn("b", G.bounds(G.local(c("ring"), c("m"))))
    return b.select("plan_id", "ord", F.round("m.x", 6).alias("x"), F.round("m.y", 6).alias("y"), F.round("b.x1", 6).alias("left_x"), F.round("b.y2", 6).alias("high_y"))


@query(f"""SELECT plan_id, ord, round(CASE WHEN a < 0 THEN a + 180 WHEN a >= 180 THEN a - 180 ELSE a END, 6) AS degrees FROM (SELECT plan_id, ord, degrees(atan2(y2 - y1, x2 - x1)) AS a FROM ({_WALL}))""")
def wall_directions(spark, d):
    """Undirected direction of each wall in degrees."""
    return E.walls(_read(spark, d, "plans")).select("plan_id", "ord", F.round(G.orientation(c("x1"), c("y1"), c("x2"), c("y2")), 6).alias("degrees"))


@query(f"""WITH {_ROOM_POINTS}, q AS (SELECT plan_id, ord, list({{'x': least(greatest(x / 50 + 10, 0.0), 400.0), 'y': least(greatest(y / 50 + 10, 0.0), 120.0)}} ORDER BY k) AS l FROM ring GROUP BY plan_id, ord),
  u AS (SELECT plan_id, ord, list_filter(l, lambda p, i: i = 1 OR p <> l[i - 1]) AS l FROM q) SELECT plan_id, CAST(ord AS INTEGER) AS ord, CAST(len(l) AS INTEGER) AS corners, list_max(list_transform(l, lambda p: p.x)) AS right_x, list_max(list_transform(l, lambda p: p.y)) AS high_y FROM u""")
def drawn_rooms(spark, d):
    """Rooms scaled to a drawing of 400 by 120 pixels and clipped to it, without corners that repeat the one before."""
    r = E.rooms(_read(spark, d, "plans")).where(F.size("ring") > 0).withColumn("s", G.scaled(c("ring"), 1 / 50, 1 / 50, 10.0, 10.0, 400, 120))
    b = r.withColumn("b", G.bounds(c("s")))
    return b.select("plan_id", "ord", F.size("s").alias("corners"), c("b.x2").alias("right_x"), c("b.y2").alias("high_y"))


@query(f"""WITH {_ROOM_POINTS}, e AS (SELECT *, row_number() OVER (PARTITION BY plan_id, ord ORDER BY x1, y1, x2, y2) AS k FROM edge WHERE m >= 3),
  x AS (SELECT DISTINCT a.plan_id, a.ord FROM e a JOIN e b ON a.plan_id = b.plan_id AND a.ord = b.ord AND a.k < b.k WHERE ((a.x2 - a.x1) * (b.y1 - a.y1) - (a.y2 - a.y1) * (b.x1 - a.x1)) * ((a.x2 - a.x1) * (b.y2 - a.y1) - (a.y2 - a.y1) * (b.x2 - a.x1)) < 0
    AND ((b.x2 - b.x1) * (a.y1 - b.y1) - (b.y2 - b.y1) * (a.x1 - b.x1)) * ((b.x2 - b.x1) * (a.y2 - b.y1) - (b.y2 - b.y1) * (a.x2 - b.x1)) < 0)
  SELECT r.plan_id, CAST(r.ord AS INTEGER) AS ord, r.m >= 3 AS closed, coalesce(r.m >= 3 AND x.ord IS NULL, false) AS simple, round(CASE WHEN r.m >= 3 THEN p.per ELSE 0.0 END, 6) AS perimeter FROM (SELECT plan_id, ord, any_value(m) AS m FROM ring GROUP BY plan_id, ord) r
  LEFT JOIN x ON r.plan_id = x.plan_id AND r.ord = x.ord LEFT JOIN (SELECT plan_id, ord, sum({_len()}) AS per FROM e GROUP BY plan_id, ord) p ON r.plan_id = p.plan_id AND r.ord = p.ord""")
def ring_flags(spark, d):
    """Whether each room's ring has three corners and does not cross itself, and its perimeter."""
    r = E.rooms(_read(spark, d, "plans")).where(F.size("ring") > 0)
    closed = F.size("ring") >= 3
    return r.select("plan_id", "ord", closed.alias("closed"), (closed & G.simple(G.edges(c("ring")))).alias("simple"), F.round(G.perimeter(c("ring")), 6).alias("perimeter"))


_CLIP = "greatest(0.0, CASE WHEN w.x2 <> w.x1 THEN least((d.x1 - w.x1) / (w.x2 - w.x1), (d.x2 - w.x1) / (w.x2 - w.x1)) WHEN w.x1 < d.x1 OR w.x1 > d.x2 THEN 2.0 ELSE 0.0 END, CASE WHEN w.y2 <> w.y1 THEN least((d.y1 - w.y1) / (w.y2 - w.y1), (d.y2 - w.y1) / (w.y2 - w.y1)) WHEN w.y1 < d.y1 OR w.y1 > d.y2 THEN 2.0 ELSE 0.0 END)"
_CLIP_END = "least(1.0, CASE WHEN w.x2 <> w.x1 THEN greatest((d.x1 - w.x1) / (w.x2 - w.x1), (d.x2 - w.x1) / (w.x2 - w.x1)) ELSE 1.0 END, CASE WHEN w.y2 <> w.y1 THEN greatest((d.y1 - w.y1) / (w.y2 - w.y1), (d.y2 - w.y1) / (w.y2 - w.y1)) ELSE 1.0 END)"


@query(f"""WITH w AS ({_WALL}), {_DOOR_BOX}, h AS (SELECT plan_id, ord, id, host FROM (SELECT plan_id, ord - 1 AS ord, e.id AS id, e.host_wall_id AS host FROM (SELECT plan_id, unnest(doors) AS e, generate_subscripts(doors, 1) AS ord FROM plans)) WHERE host IS NOT NULL),
  t AS (SELECT w.plan_id, h.id, h.ord, {_len('w.')} AS len, {_CLIP} AS a, {_CLIP_END} AS b FROM h JOIN db d ON h.plan_id = d.plan_id AND h.ord = d.ord JOIN w ON h.plan_id = w.plan_id AND h.host = w.wall_id)
  SELECT plan_id, id, CAST(ord AS INTEGER) AS ord, a <= b AS meets, CAST(CASE WHEN a > b THEN 1 ELSE CASE WHEN a > 0 THEN 1 ELSE 0 END + CASE WHEN b < 1 THEN 1 ELSE 0 END END AS INTEGER) AS parts, round(CASE WHEN a > b THEN len ELSE len * (1 - (b - a)) END, 4) AS rest FROM t""")
def split_walls(spark, d):
    """The wall of each door, split at the door's box: whether they meet, the parts that are left and their length."""
    plans = _read(spark, d, "plans")
    o = E.openings(plans, "doors").where("x is not null and y is not null and width is not null and host_wall_id is not null")
    box = F.struct((c("x") - c("width")).alias("x1"), (c("y") - c("width")).alias("y1"), (c("x") + c("width")).alias("x2"), (c("y") + c("width")).alias("y2"))
    w = E.walls(plans).select("plan_id", c("wall_id").alias("host_wall_id"), F.struct("x1", "y1", "x2", "y2").alias("s"))
    both = o.select("plan_id", "id", "ord", "host_wall_id", box.alias("b")).join(w, ["plan_id", "host_wall_id"])
    both = both.withColumn("p", G.outside_parts(c("s"), c("b")))
    rest = F.aggregate("p", F.lit(0.0), lambda a, e: a + G.length(e["x1"], e["y1"], e["x2"], e["y2"]))
    return both.select("plan_id", "id", "ord", G.segment_meets_box(c("s"), c("b")).alias("meets"), F.size("p").alias("parts"), F.round(rest, 4).alias("rest"))


def _esc(x: str) -> str:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        x = f"replace({x}, '{a}', '{b}')"
    return x


@query(f"""SELECT finding_id, '<tr><td>' || {_esc("coalesce(article_id, '')")} || '</td><td>' || {_esc("coalesce(verdict, '')")} || '</td><td>' || {_esc("coalesce(CASE WHEN length(message) > 70 THEN left(message, 70) || '…' ELSE message END, '')")} || '</td></tr>' AS markup FROM findings""")
def report_markup(spark, d):
    """Report lines as rows of a table in markup, special characters escaped."""
    return report_rows(_read(spark, d, "findings")).select("finding_id", "markup")


@query(f"""WITH w AS (SELECT *, {_len()} AS len FROM ({_WALL})), e AS (SELECT plan_id, ord, x1 AS x, y1 AS y FROM w UNION ALL SELECT plan_id, ord, x2, y2 FROM w), met AS (SELECT DISTINCT a.plan_id, a.ord FROM e a JOIN e b ON a.plan_id = b.plan_id AND a.x = b.x AND a.y = b.y AND a.ord <> b.ord)
  SELECT w.plan_id, w.wall_id, w.ord, concat_ws(',', CASE WHEN met.ord IS NULL THEN 'unconnected' END, CASE WHEN len > 15000 THEN 'long' END) AS reasons FROM w LEFT JOIN met ON w.plan_id = met.plan_id AND w.ord = met.ord WHERE met.ord IS NULL OR len > 15000""")
def standing_walls(spark, d):
    """Walls that no other wall meets at an end, and long ones, with the reason."""
    w = E.walls(_read(spark, d, "plans")).withColumn("len", G.length(c("x1"), c("y1"), c("x2"), c("y2")))
    ends = w.select("plan_id", "ord", F.explode(F.array(F.struct(c("x1").alias("x"), c("y1").alias("y")), F.struct(c("x2").alias("x"), c("y2").alias("y")))).alias("p"))
    shared = ends.groupBy("plan_id", "p").agg(F.min("ord").alias("a"), F.max("ord").alias("b")).where("a <> b").select("plan_id", "p")
    met = ends.join(shared, ["plan_id", "p"], "left_semi").select("plan_id", "ord").distinct().withColumn("met", F.lit(True))
    tags = measures.notes((c("met").isNull(), "unconnected"), (c("len") > 15000, "long"))
    return w.join(met, ["plan_id", "ord"], "left").select("plan_id", "wall_id", "ord", F.concat_ws(",", tags).alias("reasons")).where("reasons <> ''")


@query("""SELECT export_id, CAST(coalesce(json_extract(p, '$.x'), json_extract(p, '$[0]')) AS DOUBLE) AS x, CAST(coalesce(json_extract(p, '$.y'), json_extract(p, '$[1]')) AS DOUBLE) AS y FROM (SELECT export_id, coalesce(json_extract(payload, '$.bim_data.rooms[0].polygon[0]'), json_extract(payload, '$.plan.storeys[0].spaces[0].polygon[0]'), json_extract(payload, '$.rooms[0].polygon[0]')) AS p FROM plan_exports WHERE json_valid(payload)) WHERE p IS NOT NULL""")
def first_corners(spark, d):
    """The first corner of the first room of each export, whether written as a list or with names."""
    x = _read(spark, d, "plan_exports").where(F.try_parse_json("payload").isNotNull())
    p = F.coalesce(*[F.get_json_object("payload", f"$.{a}[0].polygon[0]") for a in ("bim_data.rooms", "plan.storeys[0].spaces", "rooms")])
    return x.select("export_id", G.json_point(p).alias("p")).where("p is not null").select("export_id", "p.x", "p.y")
