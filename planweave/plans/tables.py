"""Registered queries on measures, detections, texts and checks of tables, with the SQL that must give the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from planweave.functions import geometry as G
from planweave.operators import detections as D
from planweave.operators import keyed, limits, measures, spatial, texts
from planweave.plans.catalogue import _ROOM_POINTS, _WALL, _opening_sql, _read, registry
from planweave.plans.rooms import MATCHED, _iou_sql, _near_rooms, matched
from planweave.sources import elements as E
from planweave.sources.files import issue_topics

QUERIES, SQL, query = registry()
c = F.col


def _len(s: str = "") -> str:
    return f"sqrt(({s}x2 - {s}x1) * ({s}x2 - {s}x1) + ({s}y2 - {s}y1) * ({s}y2 - {s}y1))"


def _wall_length():
    return G.length(c("x1"), c("y1"), c("x2"), c("y2"))


# ------------------------------------------------------------------ limits: entities against measures

_LIMITS = [("room_bedroom", "area", ">=", 9.0, None), ("room_kitchen", "area", "range", 5.5, 20.0), ("room_bathroom", "min_side", ">", 1.4, None), ("room_storage", "max_side", "<=", 6.0, None), ("room_terrace", "area", ">=", 1.0, None)]
_LIMIT_ROWS = ", ".join(f"('{a}', '{b}', '{o}', CAST({lo} AS DOUBLE), CAST({'NULL' if hi is None else hi} AS DOUBLE))" for a, b, o, lo, hi in _LIMITS)
_COMPARE = "CASE l.comparator WHEN '>=' THEN m.value >= l.lo WHEN '<=' THEN m.value <= l.lo WHEN '>' THEN m.value > l.lo WHEN '<' THEN m.value < l.lo WHEN 'range' THEN m.value BETWEEN l.lo AND l.hi ELSE false END"
_MEASURES = """m0 AS (SELECT plan_id, e.id AS element_id, e.category AS category, e.area_m2 AS area, e.dimensions.width_mm / 1000 AS min_side, e.dimensions.length_mm / 1000 AS max_side FROM (SELECT plan_id, unnest(rooms) AS e FROM plans) WHERE e IS NOT NULL),
  m AS (SELECT plan_id, element_id, category, 'area' AS property, area AS value FROM m0 UNION ALL SELECT plan_id, element_id, category, 'min_side', min_side FROM m0 UNION ALL SELECT plan_id, element_id, category, 'max_side', max_side FROM m0)"""


@query(f"""WITH {_MEASURES}, l(category, property, comparator, lo, hi) AS (VALUES {_LIMIT_ROWS})
  SELECT m.plan_id, m.element_id, l.category, l.property, m.value, {_COMPARE} AS ok FROM l JOIN m ON l.category = m.category AND l.property = m.property WHERE m.value IS NOT NULL""")
def limit_pairs(spark, d):
    """Each limit against each room of its category: the measure it names and whether it holds."""
    lim = spark.createDataFrame(_LIMITS, "category string, property string, comparator string, lo double, hi double")
    return limits.checked(lim, limits.room_measures(E.rooms(_read(spark, d, "plans")))).where("value is not null").select("plan_id", "element_id", "category", "property", "value", "ok")


@query(f"""WITH {_MEASURES}, l(category, property, comparator, lo, hi) AS (VALUES {_LIMIT_ROWS}), p AS (SELECT plan_id FROM plans WHERE len(rooms) > 0)
  SELECT p.plan_id, l.category, l.property, count(m.value) AS measured, count(*) FILTER (WHERE {_COMPARE}) AS held, CASE WHEN count(m.element_id) = 0 THEN 'absent' WHEN count(m.value) = 0 THEN 'unmeasured' WHEN count(*) FILTER (WHERE NOT ({_COMPARE})) > 0 THEN 'broken' ELSE 'held' END AS state
  FROM p CROSS JOIN l LEFT JOIN m ON p.plan_id = m.plan_id AND l.category = m.category AND l.property = m.property GROUP BY p.plan_id, l.category, l.property""")
def limit_states(spark, d):
    """Each limit in each plan with rooms: held, broken, unmeasured, or absent where the plan has no room of the category."""
    lim = spark.createDataFrame(_LIMITS, "category string, property string, comparator string, lo double, hi double")
    plans = _read(spark, d, "plans")
    return limits.states(plans.where(F.size("rooms") > 0).select("plan_id"), lim, limits.room_measures(E.rooms(plans)))


@query("""WITH e AS (SELECT finding_id, lower(trim(object)) AS phrase FROM findings), t AS (SELECT lower(term) AS phrase, min(term_id) AS term_id FROM canon_terms WHERE kind = 'element' GROUP BY lower(term))
  SELECT e.finding_id, t.term_id, t.term_id IS NOT NULL AS mapped FROM e LEFT JOIN t ON e.phrase = t.phrase""")
def phrase_lookup(spark, d):
    """Objects of findings looked up in the list of elements by exact phrase; those that miss stay."""
    t = _read(spark, d, "canon_terms").where("kind = 'element'").groupBy(F.lower("term").alias("phrase")).agg(F.min("term_id").alias("term_id"))
    f = _read(spark, d, "findings").select("finding_id", F.lower(F.trim("object")).alias("phrase"))
    return f.join(t, "phrase", "left").select("finding_id", "term_id", c("term_id").isNotNull().alias("mapped"))


@query("""SELECT finding_id, CASE WHEN required.hi IS NOT NULL THEN measured BETWEEN required.lo AND required.hi ELSE measured >= required.lo END AS ok FROM findings WHERE measured IS NOT NULL AND required.lo IS NOT NULL""")
def required_bounds(spark, d):
    """Measured values against what is required: within a range, or at least the one bound."""
    f = _read(spark, d, "findings").where("measured is not null and required.lo is not null")
    kind = F.when(c("required.hi").isNotNull(), "range").otherwise(">=")
    return f.select("finding_id", limits.holds(c("measured"), kind, c("required.lo"), c("required.hi")).alias("ok"))


# ------------------------------------------------------------------ joins in the plane

_WALL_BOX = f"wb AS (SELECT plan_id, wall_id, ord, least(x1, x2) - thickness / 2 AS x1, greatest(x1, x2) + thickness / 2 AS x2, least(y1, y2) - thickness / 2 AS y1, greatest(y1, y2) + thickness / 2 AS y2 FROM ({_WALL}) WHERE thickness IS NOT NULL)"


def _wall_boxes(plans):
    t = c("thickness") / 2
    box = F.struct((F.least("x1", "x2") - t).alias("x1"), (F.least("y1", "y2") - t).alias("y1"), (F.greatest("x1", "x2") + t).alias("x2"), (F.greatest("y1", "y2") + t).alias("y2"))
    return E.walls(plans).where("thickness is not null").select("plan_id", c("wall_id").alias("id"), "ord", box.alias("b"))


def _door_boxes(plans):
    o = E.openings(plans, "doors").where("x is not null and y is not null and width is not null")
    box = F.struct((c("x") - c("width")).alias("x1"), (c("y") - c("width")).alias("y1"), (c("x") + c("width")).alias("x2"), (c("y") + c("width")).alias("y2"))
    return o.select("plan_id", "id", "ord", box.alias("b"))


_DOOR_BOX = f"db AS (SELECT plan_id, id, ord, x - width AS x1, x + width AS x2, y - width AS y1, y + width AS y2 FROM ({_opening_sql('doors')}) WHERE x IS NOT NULL AND y IS NOT NULL AND width IS NOT NULL)"


@query(f"""WITH {_WALL_BOX}, {_DOOR_BOX} SELECT w.plan_id, w.wall_id AS id, w.ord FROM wb w WHERE NOT EXISTS (SELECT 1 FROM db d WHERE d.plan_id = w.plan_id AND
  greatest(least(w.x2, d.x2) - greatest(w.x1, d.x1), 0.0) * greatest(least(w.y2, d.y2) - greatest(w.y1, d.y1), 0.0) > 0.35 * ((w.x2 - w.x1) * (w.y2 - w.y1)))""")
def uncovered_walls(spark, d):
    """Walls of whose box no door's box covers more than 35 per cent (overlap anti-join)."""
    plans = _read(spark, d, "plans")
    return spatial.not_covered(_wall_boxes(plans), _door_boxes(plans), 0.35, 4000.0).select("plan_id", "id", "ord")


@query(f"""WITH {_WALL_BOX} SELECT a.plan_id, a.wall_id AS id_a, b.wall_id AS id_b, (greatest(a.x1, b.x1) + least(a.x2, b.x2)) / 2 AS x, (greatest(a.y1, b.y1) + least(a.y2, b.y2)) / 2 AS y
  FROM wb a JOIN wb b ON a.plan_id = b.plan_id AND a.ord < b.ord AND a.x1 <= b.x2 AND b.x1 <= a.x2 AND a.y1 <= b.y2 AND b.y1 <= a.y2""")
def wall_crossings(spark, d):
    """Pairs of walls whose boxes meet or touch, with the middle of what they share (intersect self-join)."""
    return spatial.meeting_boxes(_wall_boxes(_read(spark, d, "plans")), 4000.0)


@query(f"""WITH o AS ({_opening_sql('doors')}), w AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY plan_id, wall_id ORDER BY ord) AS rn FROM ({_WALL})) WHERE rn = 1),
  p AS (SELECT o.plan_id, o.id, o.ord, x, y, w.x1 AS tx, w.y1 AS ty, sqrt((w.x1 - x) * (w.x1 - x) + (w.y1 - y) * (w.y1 - y)) AS far FROM o LEFT JOIN w ON o.plan_id = w.plan_id AND o.host_wall_id = w.wall_id WHERE x IS NOT NULL AND y IS NOT NULL)
  SELECT plan_id, id, ord, CASE WHEN far <= 1800 THEN tx ELSE x END AS x, CASE WHEN far <= 1800 THEN ty ELSE y END AS y, coalesce(far <= 1800, false) AS snapped FROM p""")
def snapped_doors(spark, d):
    """Doors moved to the start of their host wall where it is within 1800 mm (snap join)."""
    plans = _read(spark, d, "plans")
    o = E.openings(plans, "doors").where("x is not null and y is not null").select("plan_id", "id", "ord", "x", "y", c("host_wall_id").alias("target_id"))
    w = E.walls(plans).groupBy("plan_id", c("wall_id").alias("target_id")).agg(F.min_by(F.struct(c("x1").alias("tx"), c("y1").alias("ty")), "ord").alias("t")).select("plan_id", "target_id", "t.*")
    return spatial.snapped(o, w, 1800.0).select("plan_id", "id", "ord", "x", "y", "snapped")


@query(f"""WITH {_ROOM_POINTS}, o AS (SELECT * FROM ({_opening_sql('windows')}) WHERE x IS NOT NULL AND y IS NOT NULL),
  held AS (SELECT plan_id, ro, min(k) AS tag FROM ({_near_rooms("SELECT plan_id, ord AS k, x, y FROM o", 0)}) GROUP BY plan_id, ro),
  mid AS (SELECT plan_id, ord, any_value(room_id) AS room_id, sum(x) / count(*) AS x, sum(y) / count(*) AS y FROM ring WHERE m >= 3 GROUP BY plan_id, ord),
  near AS (SELECT m.plan_id, m.ord, min({{'d': sqrt((o.x - m.x) * (o.x - m.x) + (o.y - m.y) * (o.y - m.y)), 'k': o.ord}}) AS n FROM mid m JOIN o ON m.plan_id = o.plan_id WHERE sqrt((o.x - m.x) * (o.x - m.x) + (o.y - m.y) * (o.y - m.y)) <= 2500 GROUP BY m.plan_id, m.ord)
  SELECT m.plan_id, CAST(m.ord AS INTEGER) AS ord, m.room_id, coalesce(h.tag, n.n.k) AS tag FROM mid m LEFT JOIN held h ON m.plan_id = h.plan_id AND m.ord = h.ro LEFT JOIN near n ON m.plan_id = n.plan_id AND m.ord = n.ord""")
def room_tags(spark, d):
    """Each room with the first window inside it, else the nearest one within 2500 mm of its middle (two passes)."""
    plans = _read(spark, d, "plans")
    o = E.openings(plans, "windows").where("x is not null and y is not null").select("plan_id", "ord", "x", "y")
    return spatial.tagged_regions(E.rooms(plans).where(F.size("ring") >= 3), o, 2500.0).select("plan_id", "ord", "room_id", "tag")


# ------------------------------------------------------------------ detections


@query(f"""WITH w AS ({_opening_sql('windows')}), p AS (SELECT plan_id, list_sum(list_transform(rooms, lambda r: r.area_m2)) * 1e6 AS whole FROM plans)
  SELECT w.plan_id, count(*) AS n, round(coalesce(avg(least(width / 2000, 1.0)), 0.0), 9) AS mean, coalesce(min(least(width / 2000, 1.0)), 0.0) AS least, coalesce(max(least(width / 2000, 1.0)), 0.0) AS most,
  round(coalesce(sum(coalesce(width * height, 0.0)) / CASE WHEN max(p.whole) <> 0 THEN max(p.whole) END * 100, 0.0), 6) AS coverage FROM w JOIN p ON w.plan_id = p.plan_id GROUP BY w.plan_id""")
def window_metrics(spark, d):
    """Windows of each plan as detections: number, confidences, per cent of the rooms' area."""
    plans = _read(spark, d, "plans")
    whole = plans.select("plan_id", (F.aggregate(F.transform("rooms", lambda r: r["area_m2"]), F.lit(0.0), lambda a, v: a + F.coalesce(v, F.lit(0.0))) * 1e6).alias("whole"))
    o = E.openings(plans, "windows").join(whole, "plan_id").withColumn("confidence", F.least(c("width") / 2000, F.lit(1.0)))
    m = D.metrics(o, ["plan_id"], "confidence", c("width") * c("height"), c("whole"))
    return m.withColumns({"mean": F.round("mean", 9), "coverage": F.round("coverage", 6)})


_HITS = f"""{MATCHED}, tr AS (SELECT plan_id, count(*) AS truths FROM ({_opening_sql('doors')}) WHERE x IS NOT NULL AND y IS NOT NULL AND width IS NOT NULL GROUP BY plan_id),
  r0 AS (SELECT m.plan_id, m.id, p.score, CASE WHEN m.truth_id IS NOT NULL THEN 1 ELSE 0 END AS hit, tr.truths FROM m JOIN p ON m.plan_id = p.plan_id AND m.id = p.id JOIN tr ON m.plan_id = tr.plan_id),
  r1 AS (SELECT *, row_number() OVER w AS rank, sum(hit) OVER (PARTITION BY plan_id ORDER BY score DESC, id ROWS UNBOUNDED PRECEDING) AS hits FROM r0 WINDOW w AS (PARTITION BY plan_id ORDER BY score DESC, id)),
  r2 AS (SELECT *, max(CAST(hits AS DOUBLE) / rank) OVER (PARTITION BY plan_id ORDER BY rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS envelope, CAST(hits AS DOUBLE) / truths AS recall FROM r1),
  r3 AS (SELECT *, (recall - coalesce(lag(recall) OVER (PARTITION BY plan_id ORDER BY rank), 0.0)) * envelope AS gain FROM r2),
  ap AS (SELECT plan_id, count(*) AS n, CAST(max(hits) AS BIGINT) AS hits, max(recall) AS recall, round(sum(gain), 9) AS ap FROM r3 GROUP BY plan_id)"""


def _average_precision(spark, d):
    predicted, truth, found = matched(spark, d)
    n = truth.groupBy("plan_id").agg(F.count("*").cast("double").alias("truths"))
    rows = found.join(predicted.select("plan_id", "id", "score"), ["plan_id", "id"]).join(n, "plan_id").withColumn("hit", c("truth_id").isNotNull().cast("int"))
    return D.average_precision(rows, ["plan_id"], "score", "hit", "truths", ["id"]).withColumn("ap", F.round("ap", 9))


@query(f"WITH RECURSIVE {_HITS} SELECT plan_id, n, hits, recall, ap FROM ap")
def average_precision(spark, d):
    """Average precision and recall of the matched windows of each plan."""
    return _average_precision(spark, d)


@query(f"WITH RECURSIVE {_HITS} SELECT count(*) AS plans, round(avg(ap), 6) AS mean_ap, round(avg(recall), 6) AS mean_recall FROM ap")
def mean_average_precision(spark, d):
    """Means of average precision and recall over plans."""
    return _average_precision(spark, d).agg(F.count("*").alias("plans"), F.round(F.avg("ap"), 6).alias("mean_ap"), F.round(F.avg("recall"), 6).alias("mean_recall"))


@query("""WITH t(threshold) AS (VALUES (CAST(0.0 AS DOUBLE)), (10.0), (20.0), (30.0), (40.0), (50.0)), s AS (SELECT l_linestatus, t.threshold, count(*) FILTER (WHERE l_quantity >= t.threshold) AS kept, count(*) FILTER (WHERE l_quantity >= t.threshold AND l_returnflag = 'R') AS hits FROM lineitem, t GROUP BY l_linestatus, t.threshold),
  v AS (SELECT *, CASE WHEN kept > 0 THEN round(CAST(hits AS DOUBLE) / kept, 3) END AS value FROM s)
  SELECT l_linestatus, threshold, value FROM (SELECT *, row_number() OVER (PARTITION BY l_linestatus ORDER BY value DESC, threshold) AS rn FROM v WHERE value IS NOT NULL) WHERE rn = 1""")
def best_threshold(spark, d):
    """The threshold with the greatest part of hits per line status, the lowest of equally good ones; one pass over the rows."""
    rows = _read(spark, d, "lineitem").select("l_linestatus", "l_quantity", (c("l_returnflag") == "R").alias("hit"))
    at = [0.0, 10.0, 20.0, 30.0, 40.0, 50.0]
    per = rows.groupBy("l_linestatus").agg(*[F.struct(F.count_if(c("l_quantity") >= t).alias("kept"), F.count_if((c("l_quantity") >= t) & c("hit")).alias("hits")).alias(f"t{k}") for k, t in enumerate(at)])
    sweep = per.select("l_linestatus", F.explode(F.array(*[F.struct(F.lit(t).alias("threshold"), f"t{k}.kept", f"t{k}.hits") for k, t in enumerate(at)])).alias("s")).select("l_linestatus", "s.*")
    return D.best_threshold(sweep.withColumn("value", F.round(F.try_divide(c("hits").cast("double"), c("kept")), 3)), ["l_linestatus"], "threshold", "value")


@query("""WITH r AS (SELECT e.category AS category, least(e.area_m2, e.dimensions.width_mm * e.dimensions.length_mm / 1e6) AS common, greatest(e.area_m2, e.dimensions.width_mm * e.dimensions.length_mm / 1e6) AS either FROM (SELECT unnest(rooms) AS e FROM plans) WHERE e.area_m2 IS NOT NULL AND e.dimensions.width_mm IS NOT NULL AND e.dimensions.length_mm IS NOT NULL)
  SELECT category, round(sum(common) / CASE WHEN sum(either) <> 0 THEN sum(either) END, 9) AS iou FROM r GROUP BY category""")
def class_overlap(spark, d):
    """Overlap of stated area and bounding box per category of room, summed over all plans."""
    r = E.rooms(_read(spark, d, "plans")).withColumn("box", c("width_mm") * c("length_mm") / 1e6).where("area_m2 is not null and box is not null")
    got = D.class_overlap(r.select("category", F.least("area_m2", "box").alias("common"), F.greatest("area_m2", "box").alias("either")), "category", "common", "either")
    return got.withColumn("iou", F.round("iou", 9))


@query("""SELECT plan_id, CAST(coalesce(len(rooms), 0) AS INTEGER) AS found, CAST(coalesce(len(list_filter(rooms, lambda r: r.polygon IS NOT NULL AND len(r.polygon) > 0)), 0) AS INTEGER) AS kept,
  CASE WHEN coalesce(len(rooms), 0) = 0 THEN 'skipped' WHEN coalesce(len(list_filter(rooms, lambda r: r.polygon IS NOT NULL AND len(r.polygon) > 0)), 0) >= len(rooms) THEN 'ok' WHEN len(list_filter(rooms, lambda r: r.polygon IS NOT NULL AND len(r.polygon) > 0)) = 0 THEN 'failed' ELSE 'degraded' END AS status FROM plans""")
def room_status(spark, d):
    """How the rooms of each plan came through: all, some or none with a polygon."""
    size = lambda x: F.coalesce(F.size(x), F.lit(0))
    p = _read(spark, d, "plans").select("plan_id", size("rooms").alias("found"), size(F.filter("rooms", lambda r: r["polygon"].isNotNull() & (F.size(r["polygon"]) > 0))).alias("kept"))
    return p.withColumn("status", D.status(c("found"), c("kept")))


@query("""SELECT exporter, count(*) AS documents, count(*) FILTER (WHERE payload <> '' AND json_valid(payload)) AS converted, count(*) FILTER (WHERE coalesce(payload, '') = '') AS empty, count(*) FILTER (WHERE payload <> '' AND NOT json_valid(payload)) AS cut_off FROM plan_exports GROUP BY exporter""")
def conversion_stats(spark, d):
    """Exports converted and skipped, by reason."""
    x = _read(spark, d, "plan_exports").select("exporter", "payload")
    full = F.coalesce("payload", F.lit("")) != ""
    good = F.try_parse_json("payload").isNotNull()
    return x.groupBy("exporter").agg(F.count("*").alias("documents"), F.count_if(full & good).alias("converted"), F.count_if(~full).alias("empty"), F.count_if(full & ~good).alias("cut_off"))


@query("""SELECT plan_id, 'Room_' || row_number() OVER (PARTITION BY plan_id ORDER BY ord) AS new_id, e.id AS room_id FROM (SELECT plan_id, unnest(rooms) AS e, generate_subscripts(rooms, 1) AS ord FROM plans) WHERE e.area_m2 >= 5 AND len(e.polygon) >= 4""")
def accepted_rooms(spark, d):
    """Rooms that are large enough and have a ring, numbered anew without gaps."""
    e = E.exploded(_read(spark, d, "plans"), "rooms").where("e.area_m2 >= 5 and size(e.polygon) >= 4").select("plan_id", "ord", c("e.id").alias("room_id"))
    return D.dense_ids(e, "plan_id", ["ord"], "Room_").select("plan_id", "new_id", "room_id")


@query("""WITH r AS (SELECT plan_id, e.id AS room_id, e.area_m2 AS a, ord, count(*) OVER (PARTITION BY plan_id) AS n, row_number() OVER (PARTITION BY plan_id ORDER BY e.area_m2 DESC NULLS LAST, ord) AS rn FROM (SELECT plan_id, unnest(rooms) AS e, generate_subscripts(rooms, 1) - 1 AS ord FROM plans) WHERE e IS NOT NULL)
  SELECT plan_id, room_id, CAST(ord AS INTEGER) AS ord FROM r WHERE n <= 8 OR rn <= 4""")
def strongest_rooms(spark, d):
    """Plans of more than eight rooms cut to the four largest, other plans whole."""
    r = E.rooms(_read(spark, d, "plans")).select("plan_id", "room_id", "ord", "area_m2")
    return D.strongest(r, "plan_id", [F.desc_nulls_last("area_m2"), F.asc("ord")], 8, 4).select("plan_id", "room_id", "ord")


@query("""WITH m(old, new) AS (VALUES ('room_living', 1), ('room_kitchen', 2), ('room_bedroom', 3)) SELECT plan_id, e.id AS room_id, m.new AS class_id FROM (SELECT plan_id, unnest(rooms) AS e FROM plans) JOIN m ON e.category = m.old""")
def remapped_classes(spark, d):
    """Rooms by class id instead of category; those of unknown categories are dropped."""
    r = E.rooms(_read(spark, d, "plans")).select("plan_id", "room_id", c("category").alias("class_id"))
    return D.remapped(r, "class_id", {"room_living": 1, "room_kitchen": 2, "room_bedroom": 3})


_SIZE_SQL = "CASE WHEN v IS NULL THEN NULL WHEN v < 2000 THEN 'small' WHEN v < 6000 THEN 'medium' WHEN v < 10000 THEN 'large' ELSE 'very large' END"


@query(f"SELECT plan_id, id, ord, {_SIZE_SQL} AS size FROM (SELECT *, width * height / 200 AS v FROM ({_opening_sql('doors')}))")
def door_sizes(spark, d):
    """Size class of doors by area in pixels of a drawing at 200 mm² each."""
    o = E.openings(_read(spark, d, "plans"), "doors")
    return o.select("plan_id", "id", "ord", D.bucket(c("width") * c("height") / 200, [2000, 6000, 10000], ["small", "medium", "large", "very large"]).alias("size"))


# ------------------------------------------------------------------ summaries of plans


@query(f"""WITH w AS (SELECT *, {_len()} AS len FROM ({_WALL})), s AS (SELECT plan_id, avg(len) AS mean FROM w GROUP BY plan_id), e AS (SELECT plan_id, ord, x1 AS x, y1 AS y FROM w UNION ALL SELECT plan_id, ord, x2, y2 FROM w),
  met AS (SELECT DISTINCT a.plan_id, a.ord FROM e a JOIN e b ON a.plan_id = b.plan_id AND a.x = b.x AND a.y = b.y AND a.ord <> b.ord)
  SELECT w.plan_id, round(stddev_pop(w.thickness), 6) AS deviation, coalesce(stddev_pop(w.thickness) < 2, false) AS uniform, count(*) FILTER (WHERE len > 1.5 * s.mean) AS long_walls, count(*) FILTER (WHERE met.ord IS NULL) AS isolated,
    CASE WHEN count(*) FILTER (WHERE abs(x2 - x1) >= abs(y2 - y1)) >= count(*) FILTER (WHERE abs(x2 - x1) < abs(y2 - y1)) THEN 'horizontal' ELSE 'vertical' END AS main_direction
  FROM w JOIN s ON w.plan_id = s.plan_id LEFT JOIN met ON w.plan_id = met.plan_id AND w.ord = met.ord GROUP BY w.plan_id""")
def wall_insights(spark, d):
    """Per plan: spread of wall thickness, long and isolated walls, the direction most walls have."""
    w = E.walls(_read(spark, d, "plans")).withColumn("len", _wall_length())
    ends = w.select("plan_id", "ord", F.explode(F.array(F.struct(c("x1").alias("x"), c("y1").alias("y")), F.struct(c("x2").alias("x"), c("y2").alias("y")))).alias("p"))
    # A point of several walls by the least and the greatest of their numbers: no pairs of walls are made.
    shared = ends.groupBy("plan_id", "p").agg(F.min("ord").alias("a"), F.max("ord").alias("b")).where("a <> b").select("plan_id", "p")
    met = ends.join(shared, ["plan_id", "p"], "left_semi").select("plan_id", "ord").distinct().withColumn("met", F.lit(True))
    mean = w.groupBy("plan_id").agg(F.avg("len").alias("mean_len"))
    flat = F.abs(c("x2") - c("x1")) >= F.abs(c("y2") - c("y1"))
    g = w.join(mean, "plan_id").join(met, ["plan_id", "ord"], "left").groupBy("plan_id")
    dev = F.stddev_pop("thickness")
    return g.agg(F.round(dev, 6).alias("deviation"), F.coalesce(dev < 2, F.lit(False)).alias("uniform"), F.count_if(c("len") > 1.5 * c("mean_len")).alias("long_walls"), F.count_if(c("met").isNull()).alias("isolated"), F.when(F.count_if(flat) >= F.count_if(~flat), "horizontal").otherwise("vertical").alias("main_direction"))


@query(f"""WITH w AS (SELECT *, {_len()} AS len, row_number() OVER (PARTITION BY plan_id ORDER BY {_len()} DESC, ord) AS rn FROM ({_WALL}) WHERE is_exterior)
  SELECT plan_id, count(*) AS walls, sum(len) AS perimeter, round(avg(len), 6) AS mean, CASE WHEN count(*) >= 4 THEN max(CASE WHEN rn = 1 THEN len END) * max(CASE WHEN rn = 2 THEN len END) END AS extent FROM w GROUP BY plan_id""")
def perimeter(spark, d):
    """Per plan its outer walls: their number, length and mean, and from four walls on the product of the two longest."""
    w = E.walls(_read(spark, d, "plans")).where("is_exterior").withColumn("len", _wall_length())
    return measures.perimeter(w, "plan_id", "len").withColumn("mean", F.round("mean", 6))


@query(f"""WITH w AS ({_WALL}), b AS (SELECT plan_id, min(least(x1, x2)) AS l, max(greatest(x1, x2)) AS r, min(least(y1, y2)) AS b, max(greatest(y1, y2)) AS t FROM w GROUP BY plan_id),
  e AS (SELECT w.plan_id, unnest([CASE WHEN x1 = l AND x2 = l THEN 'left' END, CASE WHEN x1 = r AND x2 = r THEN 'right' END, CASE WHEN y1 = b.b AND y2 = b.b THEN 'bottom' END, CASE WHEN y1 = t AND y2 = t THEN 'top' END]) AS side FROM w JOIN b ON w.plan_id = b.plan_id)
  SELECT plan_id, side, count(*) AS walls FROM e WHERE side IS NOT NULL GROUP BY plan_id, side""")
def side_counts(spark, d):
    """Walls on each side of a plan's bounds."""
    from planweave.plans.catalogue import exterior_reasons

    r = exterior_reasons(spark, d).select("plan_id", F.explode(F.split("reasons", ",")).alias("side"))
    return r.where("side in ('left', 'right', 'bottom', 'top')").groupBy("plan_id", "side").agg(F.count("*").alias("walls"))


@query(f"""WITH w AS (SELECT plan_id, count(*) AS walls, round(avg(thickness), 6) AS thickness, count(*) FILTER (WHERE abs(x2 - x1) >= abs(y2 - y1)) AS horizontal, count(*) FILTER (WHERE abs(x2 - x1) < abs(y2 - y1)) AS vertical FROM ({_WALL}) GROUP BY plan_id)
  SELECT p.plan_id, coalesce(w.walls, 0) AS walls, coalesce(w.thickness, 0.0) AS thickness, coalesce(w.horizontal, 0) AS horizontal, coalesce(w.vertical, 0) AS vertical, CAST(coalesce(len(p.doors), 0) AS BIGINT) AS doors, CAST(coalesce(len(p.windows), 0) AS BIGINT) AS windows,
  round(coalesce(list_sum(list_transform(p.rooms, lambda r: coalesce(r.area_m2, 0.0))), 0.0), 6) AS area_m2 FROM plans p LEFT JOIN w ON p.plan_id = w.plan_id""")
def plan_totals(spark, d):
    """Per plan: walls with their mean thickness and directions, openings, area of the rooms; zeros where there is none."""
    plans = _read(spark, d, "plans")
    flat = F.abs(c("x2") - c("x1")) >= F.abs(c("y2") - c("y1"))
    w = E.walls(plans).groupBy("plan_id").agg(F.count("*").alias("walls"), F.round(F.avg("thickness"), 6).alias("thickness"), F.count_if(flat).alias("horizontal"), F.count_if(~flat).alias("vertical"))
    size = lambda x: F.coalesce(F.size(x), F.lit(0)).cast("long")
    area = F.coalesce(F.aggregate(F.transform("rooms", lambda r: F.coalesce(r["area_m2"], F.lit(0.0))), F.lit(0.0), lambda a, v: a + v), F.lit(0.0))
    p = plans.select("plan_id", size("doors").alias("doors"), size("windows").alias("windows"), F.round(area, 6).alias("area_m2"))
    zero = [F.coalesce(x, F.lit(0)).alias(x) for x in ("walls", "horizontal", "vertical")]
    return p.join(w, "plan_id", "left").select("plan_id", *zero, F.coalesce("thickness", F.lit(0.0)).alias("thickness"), "doors", "windows", "area_m2")


@query(f"""SELECT plan_id, avg(greatest(width, height)) AS mean_side, count(*) FILTER (WHERE x < 1000 OR y < 1000) AS at_border, CASE WHEN count(*) FILTER (WHERE width >= height) >= count(*) FILTER (WHERE width < height) THEN 'wide' ELSE 'tall' END AS shape FROM ({_opening_sql('windows')}) WHERE width IS NOT NULL AND height IS NOT NULL GROUP BY plan_id""")
def window_layout(spark, d):
    """Per plan: mean of the longer sides of windows, those near the plan's lower bounds, the shape most have."""
    o = E.openings(_read(spark, d, "plans"), "windows").where("width is not null and height is not null")
    wide = c("width") >= c("height")
    return o.groupBy("plan_id").agg(F.avg(F.greatest("width", "height")).alias("mean_side"), F.count_if((c("x") < 1000) | (c("y") < 1000)).alias("at_border"), F.when(F.count_if(wide) >= F.count_if(~wide), "wide").otherwise("tall").alias("shape"))


@query(f"""WITH {_ROOM_POINTS} SELECT plan_id, CAST(ord AS INTEGER) AS ord, round(avg({_len()}), 6) AS mean, min({_len()}) AS least, max({_len()}) AS most, count(*) FILTER (WHERE {_len()} >= 500) AS sides FROM edge WHERE m >= 3 GROUP BY plan_id, ord""")
def edge_profile(spark, d):
    """Lengths of the sides of each room: mean, least, greatest, and those that are not degenerate; in the row, without an explode."""
    r = E.rooms(_read(spark, d, "plans")).where(F.size("ring") >= 3)
    sides = F.transform(G.edges(c("ring")), lambda e: G.length(e["x1"], e["y1"], e["x2"], e["y2"]))
    p = r.select("plan_id", "ord", sides.alias("s"))
    return p.select("plan_id", "ord", F.round(measures.array_mean(c("s")), 6).alias("mean"), F.array_min("s").alias("least"), F.array_max("s").alias("most"), F.size(F.filter("s", lambda x: x >= 500)).cast("long").alias("sides"))


@query("""WITH v AS (SELECT plan_id, upper(trim(verdict)) AS v FROM findings) SELECT plan_id, CASE WHEN count(*) FILTER (WHERE v = 'FAIL') > 0 THEN 'broken' WHEN count(*) FILTER (WHERE v = 'NEEDS_REVIEW' OR v IS NULL) > 0 THEN 'open' ELSE 'clean' END AS state,
  round(count(*) FILTER (WHERE v = 'PASS') * 100.0 / count(*), 1) AS passed FROM v GROUP BY plan_id""")
def plan_states(spark, d):
    """The worst verdict class of each plan and the per cent of its findings that pass."""
    v = measures.verdict_counts(_read(spark, d, "findings"), ["plan_id"])
    state = F.when(c("fail") > 0, "broken").when(c("needs_review") > 0, "open").otherwise("clean")
    return v.select("plan_id", state.alias("state"), F.round(c("pass") * 100.0 / c("total"), 1).alias("passed"))


@query(f"""WITH {_ROOM_POINTS}, s AS (SELECT plan_id, e.id AS id, 'room without polygon' AS reason FROM (SELECT plan_id, unnest(rooms) AS e FROM plans) WHERE e IS NOT NULL AND (e.polygon IS NULL OR len(e.polygon) = 0)
  UNION ALL SELECT plan_id, id, 'door without place' FROM ({_opening_sql('doors')}) WHERE x IS NULL OR y IS NULL UNION ALL SELECT plan_id, id, 'window without place' FROM ({_opening_sql('windows')}) WHERE x IS NULL OR y IS NULL)
  SELECT plan_id, id, reason, CAST(CASE reason WHEN 'room without polygon' THEN 0 WHEN 'door without place' THEN 1 ELSE 2 END AS INTEGER) AS part_ord FROM s""")
def skipped_elements(spark, d):
    """Elements that geometry has to skip, with the reason: a union of tagged results in fixed order."""
    plans = _read(spark, d, "plans")
    parts = {"room without polygon": E.exploded(plans, "rooms").where("e.polygon is null or size(e.polygon) = 0").select("plan_id", c("e.id").alias("id"))}
    for kind in ("door", "window"):
        parts[f"{kind} without place"] = E.openings(plans, kind + "s").where("x is null or y is null").select("plan_id", "id")
    return D.tagged(parts).select("plan_id", "id", c("part").alias("reason"), "part_ord")


@query("""SELECT plan_id, CAST(len(rooms) AS BIGINT) AS rooms, array_to_string(list_transform(list_filter(rooms, lambda r: r.id IS NOT NULL)[1:3], lambda r: r.id), ', ') || CASE WHEN len(list_filter(rooms, lambda r: r.id IS NOT NULL)) > 3 THEN '…' ELSE '' END AS preview FROM plans WHERE len(rooms) > 0""")
def room_preview(spark, d):
    """The first three rooms of each plan, and a mark where there are more."""
    ids = F.filter(F.transform("rooms", lambda r: r["id"]), lambda i: i.isNotNull())
    p = _read(spark, d, "plans").where(F.size("rooms") > 0).select("plan_id", F.size("rooms").cast("long").alias("rooms"), ids.alias("ids"))
    return p.select("plan_id", "rooms", F.concat(F.array_join(F.slice("ids", 1, 3), ", "), F.when(F.size("ids") > 3, "…").otherwise("")).alias("preview"))


@query("""SELECT 'skip_category' AS kind, coalesce(nullif(skip_category, ''), '(none)') AS name, count(*) AS n FROM clauses GROUP BY 2 UNION ALL SELECT 'rule_type', coalesce(rule_type, '(none)'), count(*) FROM clauses GROUP BY 2""")
def scope_preview(spark, d):
    """Clauses per category they are skipped for and per type of rule, by one pass over both."""
    none = lambda x: F.coalesce(x, F.lit("(none)"))
    pairs = F.array(F.struct(F.lit("skip_category").alias("kind"), none(F.nullif("skip_category", F.lit(""))).alias("name")), F.struct(F.lit("rule_type").alias("kind"), none(c("rule_type")).alias("name")))
    return _read(spark, d, "clauses").select(F.explode(pairs).alias("p")).groupBy("p.kind", "p.name").agg(F.count("*").alias("n"))


@query(f"""WITH p AS (SELECT plan_id, coalesce(len(doors), 0) AS nd, coalesce(len(windows), 0) AS nw, coalesce(len(rooms), 0) AS nr, coalesce(len(stairs), 0) AS ns FROM plans)
  SELECT plan_id, concat_ws('; ', CASE WHEN nd = 0 THEN 'no doors' END, CASE WHEN nw = 0 THEN 'no windows' END, CASE WHEN nd < nr THEN 'fewer doors than rooms' END, CASE WHEN ns > 1 THEN 'several stairs' END) AS notes FROM p""")
def plan_notes(spark, d):
    """What stands out in each plan, in fixed order."""
    size = lambda x: F.coalesce(F.size(x), F.lit(0))
    p = _read(spark, d, "plans").select("plan_id", size("doors").alias("nd"), size("windows").alias("nw"), size("rooms").alias("nr"), size("stairs").alias("ns"))
    return p.select("plan_id", F.concat_ws("; ", measures.notes((c("nd") == 0, "no doors"), (c("nw") == 0, "no windows"), (c("nd") < c("nr"), "fewer doors than rooms"), (c("ns") > 1, "several stairs"))).alias("notes"))


# ------------------------------------------------------------------ texts


_TOPICS = [("egress", ["exit", "escape", "egress"]), ("stair", ["stair", "step"]), ("light", ["window", "daylight", "glaz", "light"]), ("wet", ["kitchen", "bath", "toilet", "wash"])]
_PHRASE = "regexp_replace(lower(text_en), '[^a-z\\s]', ' ', 'g')"
_TOPIC_SQL = "CASE " + " ".join("WHEN " + " OR ".join(f"contains({_PHRASE}, '{w}')" for w in ws) + f" THEN '{n}'" for n, ws in _TOPICS) + " END"


@query(f"SELECT clause_id, {_TOPIC_SQL} AS topic, coalesce(contains(lower(text_en), 'area') OR contains(lower(text_en), 'height'), false) AS measurable FROM clauses")
def clause_topics(spark, d):
    """The first topic whose words stand in a clause's text, and whether any word of a measure does."""
    return _read(spark, d, "clauses").select("clause_id", texts.category_of(c("text_en"), _TOPICS).alias("topic"), texts.mentions(c("text_en"), ["area", "height"]).alias("measurable"))


@query("""WITH x AS (SELECT clause_id, CASE WHEN regexp_extract(entities, '\\[.*\\]', 0, 's') <> '' THEN regexp_extract(entities, '\\[.*\\]', 0, 's') ELSE '[' || coalesce(regexp_extract(entities, '\\{.*\\}', 0, 's'), '') || ']' END AS a FROM clauses WHERE entities NOT LIKE '"%')
  SELECT clause_id, CAST(CASE WHEN json_valid(a) THEN json_array_length(a) ELSE 0 END AS INTEGER) AS n_members FROM x""")
def embedded_arrays(spark, d):
    """Members of the JSON array that stands within a text, from its first bracket to its last; an object is an array of one. Texts that are JSON strings are left out."""
    return texts.json_members(_read(spark, d, "clauses").where("entities not like '\"%'"), "entities").select("clause_id", "n_members")


@query("""WITH r AS (SELECT mabhas_part, clause_id, heading_fa IS NOT NULL AS h, text_fa, floor((row_number() OVER (PARTITION BY mabhas_part ORDER BY clause_id) - 1) / 6) AS chunk FROM clauses WHERE trim(text_fa, ' ') <> '')
  SELECT mabhas_part, CAST(chunk AS BIGINT) AS chunk, count(*) AS n, md5(string_agg(CASE WHEN h THEN '[H] ' ELSE '' END || text_fa, chr(10) ORDER BY clause_id)) AS body FROM r GROUP BY mabhas_part, chunk""")
def headed_chunks(spark, d):
    """Texts of each part in order, six a chunk, headings marked; the digest of each chunk's text."""
    k = _read(spark, d, "clauses").select("mabhas_part", "clause_id", "heading_fa", "text_fa")
    return texts.headed_chunks(k, "mabhas_part", "clause_id", "text_fa", c("heading_fa").isNotNull(), 6).withColumn("body", F.md5("body"))


@query("""WITH v AS (SELECT DISTINCT upper(trim(object, ' ')) AS value FROM findings WHERE length(trim(object, ' ')) >= 2), t AS (SELECT upper(trim(term, ' ')) AS term, term_id FROM canon_terms),
  s AS (SELECT v.value, t.term_id, (1 - levenshtein(v.value, t.term) / CAST(greatest(length(v.value), length(t.term)) AS DOUBLE)) * 100 AS score FROM v, t),
  b AS (SELECT *, row_number() OVER (PARTITION BY value ORDER BY score DESC, term_id) AS rn FROM s WHERE score >= 80 AND (length(value) >= 4 OR score = 100))
  SELECT v.value, b.term_id, coalesce(b.score, 0.0) AS score FROM v LEFT JOIN b ON v.value = b.value AND rn = 1""")
def nearest_terms(spark, d):
    """Distinct objects of findings with the term most like each, from a likeness of 80 on."""
    t = _read(spark, d, "canon_terms")
    return texts.nearest_terms(_read(spark, d, "findings"), "object", t, "term", "term_id")


@query("""SELECT upper(trim(v, ' ')) AS variant, min(term_id) AS id FROM (SELECT term_id, unnest(list_concat([term, term_fa], coalesce(aliases, []))) AS v FROM canon_terms) WHERE trim(v, ' ') <> '' GROUP BY 1""")
def first_variants(spark, d):
    """Each spelling of the reference list once, with the first entry that has it."""
    t = _read(spark, d, "canon_terms")
    return texts.first_variants(t, "term_id", F.concat(F.array("term", "term_fa"), F.coalesce("aliases", F.array().cast("array<string>"))))


@query("""SELECT 'id' AS side, CAST(term_id AS VARCHAR) AS key, count(DISTINCT t) AS n FROM (SELECT term_id, unnest(aliases) AS t FROM canon_terms) GROUP BY term_id HAVING count(DISTINCT t) > 1 UNION ALL SELECT 'alias', t, count(DISTINCT term_id) FROM (SELECT term_id, unnest(aliases) AS t FROM canon_terms) GROUP BY t HAVING count(DISTINCT term_id) > 1""")
def bijection_faults(spark, d):
    """Ids and aliases of the reference list that are not one to one."""
    t = _read(spark, d, "canon_terms").select(c("term_id").alias("id"), F.explode("aliases").alias("alias"))
    return D.bijection_faults(t, "id", "alias")


@query("""SELECT finding_id, CASE WHEN length(message) > 200 THEN left(message, 199) || '…' ELSE message END AS title, upper(trim(verdict)) AS priority FROM findings WHERE upper(trim(verdict)) IN ('FAIL', 'NEEDS_REVIEW')""")
def report_topics(spark, d):
    """One topic for each finding that fails or is open, with a title of 200 characters at most."""
    return issue_topics(_read(spark, d, "findings")).select("finding_id", "title", "priority")


@query("""SELECT f.plan_id, f.article_id, f.element_id, min(f.finding_id) AS finding_id FROM findings f WHERE upper(trim(f.verdict)) = 'NEEDS_REVIEW' AND f.element_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM findings k WHERE k.agent = 'safety' AND k.plan_id = f.plan_id AND k.article_id = f.article_id AND k.element_id = f.element_id)
  GROUP BY f.plan_id, f.article_id, f.element_id""")
def enqueued(spark, d):
    """Open findings once per plan, article and element, without those whose key is known already (idempotent insert)."""
    keys = ["plan_id", "article_id", "element_id"]
    f = _read(spark, d, "findings")
    new = f.where((F.upper(F.trim("verdict")) == "NEEDS_REVIEW") & c("element_id").isNotNull()).select(*keys, "finding_id")
    return keyed.unseen(keyed.first_seen(new, keys, ["finding_id"]), f.where("agent = 'safety'"), keys)


@query(f"WITH {_DOOR_BOX} SELECT a.plan_id, a.id AS id_a, b.id AS id_b, {_iou_sql('a', 'b')} AS iou FROM db a JOIN db b ON a.plan_id = b.plan_id AND a.ord < b.ord WHERE {_iou_sql('a', 'b')} > 0")
def door_ious(spark, d):
    """Overlaps of the doors' boxes of a plan: the entries of its matrix that are not 0."""
    return spatial.overlapping_boxes(_door_boxes(_read(spark, d, "plans")), 0.0, 4000.0)

