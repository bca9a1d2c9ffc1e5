"""Core operators against small models, fixtures and the SQL of the catalogue."""

import glob
import json
import math
import os
import random
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from planweave.functions import geometry as G
from planweave.functions.units import AREA, LENGTH, OTHER, parse_unit, unit_at
from planweave.operators import graph, greedy, keyed, measures, nested, quantities, spatial
from planweave.plans import catalogue


@pytest.fixture(scope="module")
def con(data):
    import duckdb

    c = duckdb.connect()
    for p in glob.glob(data + "/*.parquet"):
        c.sql(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return c


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_catalogue_against_sql(spark, data, con, name):
    df = catalogue.queries()[name](spark, data)
    cols = sorted(df.columns)
    got = sorted(repr(tuple(r[c] for c in cols)) for r in df.collect())
    rel = con.sql(catalogue.oracle_sql()[name])
    assert sorted(rel.columns) == cols
    at = [rel.columns.index(c) for c in cols]
    assert got == sorted(repr(tuple(r[i] for i in at)) for r in rel.fetchall())


def test_queries_without_sql():
    # These are tested by fixtures below and by their planted cases.
    assert set(catalogue.queries()) - set(catalogue.oracle_sql()) <= {"p5_found"}


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0


# ------------------------------------------------------------------ units and quantities


@pytest.mark.parametrize(
    "text,expected",
    [("mm", (LENGTH, 1)), ("㎜", (LENGTH, 1)), ("میلی‌متر مربع", (AREA, 1)), ("M2", (AREA, 1e6)), ("m^2", (AREA, 1e6)), ("sq ft", (AREA, 92903.04)), ("in.", (LENGTH, 25.4)), ("سانتیمتر", (LENGTH, 10)), ("درصد", (OTHER, 1)), ("dB", (OTHER, 1)), ("unknown", None), ("", None), ("?", None), ("x" * 500, None)],
)
def test_units(text, expected):
    assert parse_unit(text) == expected


@pytest.mark.parametrize(
    "text,expected",
    [("hectares", (AREA, 1e10)), ("µm", (LENGTH, 1e-3)), ("yards", (LENGTH, 914.4)), ("sq yd", (AREA, 836127.36)), ("square miles", (AREA, 2589988110336.0)), ("هکتار", (AREA, 1e10)), ("میکرومتر", (LENGTH, 1e-3)), ("m3", (OTHER, 1)), ("acre", (AREA, 4046856422.4)), ("km", (LENGTH, 1e6))],
)
def test_more_units(text, expected):
    dimension, factor = parse_unit(text)
    assert dimension == expected[0] and factor == pytest.approx(expected[1], rel=1e-9)


@pytest.mark.parametrize(
    "text,expected",
    [
        ("1,200 mm", [("value", 1200, "mm")]), ("12,000", [("value", 12000, "")]), ("1 200 mm", [("value", 1200, "mm")]), ("1.200,5 m", [("value", 1200.5, "m")]), ("192,5cm", [("value", 192.5, "cm")]),
        ("0,350 m", [("value", 0.35, "m")]), (">= 90 cm", [("value", 90, "cm")]), ("at least 3 m", [("value", 3, "m")]), ("3 to 5 m", [("lo", 3, "m"), ("hi", 5, "m")]), ("between 3 and 5 m", [("lo", 3, "m"), ("hi", 5, "m")]),
        ("۳٫۵ متر", [("value", 3.5, "متر")]), ("1,234,567.5 mm", [("value", 1234567.5, "mm")]), ("1,2345", [("value", 1.2345, "")]), ("1'200 mm", [("value", 1200, "mm")]), ("two", []), ("-4", [("value", -4, "")]), ("1e3 mm", [("value", 1000, "mm")]),
    ],
)
def test_numbers_as_typed(text, expected):
    assert quantities.valued(text) == [(what, pytest.approx(v), unit) for what, v, unit in expected]


def test_sides_by_the_words_beside_numbers():
    units = lambda m: {r: u for v, u, r in quantities.mentions(m, None)}
    mm, m = (LENGTH, 1), (LENGTH, 1000)
    assert units("Room_1: 3 mm demanded, 3 m found") == {"asked": mm, "found": m}
    assert units("measured 3 m, required 3 mm") == {"found": m, "asked": mm}
    assert units("3 m is the actual width; 3 mm is the limit") == {"found": m, "asked": mm}
    # A number of a code is no end of a range.
    assert [v for v, _, _ in quantities.mentions("item 8-11-31-13 was reworded 36 times", None)] == [36.0]
    assert [v for v, _, _ in quantities.mentions("from 3 to 5 m", None)] == [3.0, 5.0]
    far = "x" * 50
    assert quantities.mentions(f"{far} 3{' ' * 60}m wide", None) == [(3.0, m, "")]
    assert quantities.text_unit(3.0, quantities.mentions("limit 3 mm but 3 m found here, 2 in each room", None), "found") in (m, mm)
    assert quantities.mentions("2 in each room and 2 in. of water", None) == [(2.0, (LENGTH, 25.4), "")]


def test_unit_within_text():
    assert unit_at(" متر مربع باشد") == (AREA, 1e6)
    assert unit_at("mm but required") == (LENGTH, 1)
    assert unit_at(" metres high") == (LENGTH, 1000)
    assert unit_at("inside") is None


@given(st.integers(0, 10**6), st.sampled_from(["mm", "cm", "m", "ft", "in"]))
@settings(max_examples=50, deadline=None)
def test_amounts_round_halves_up(v, unit):
    from decimal import ROUND_FLOOR, Decimal

    exact = Decimal(v) / 4 * Decimal(str(parse_unit(unit)[1]))
    assert quantities.whole(v / 4, parse_unit(unit)[1]) == int((exact + Decimal("0.5")).to_integral_value(ROUND_FLOOR))


def test_quantities(spark):
    rows = [
        (1, json.dumps({"value": "192,5cm", "unit": "m"}), None, None),
        (2, json.dumps([{"value": [1, 2.5], "unit": "m"}, "note", None, {"value": {"lo": "۳", "hi": "4 ft"}, "unit": ""}]), None, None),
        (3, json.dumps({"value": 0.35, "unit": "unknown"}), "needs at least 0.35 metres", None),
        (4, json.dumps([{"value": 5, "unit": None}, {"value": 5}]), "5 metres", None),
        (5, json.dumps({"value": 9, "unit": "%"}), "9 metres", None),
        (6, '{"value": 3, "un', "3 metres", None),
        (7, None, None, None),
        (8, json.dumps(json.dumps({"items": [{"value": 2, "unit": "mm"}]})), None, None),
        (9, json.dumps({"value": None, "unit": "mm"}), None, None),
        (11, json.dumps({"value": "1,200 mm", "unit": "m"}), None, None),
        (12, json.dumps({"value": {"lo": "12,000", "hi": None}, "unit": "mm"}), None, None),
        (13, json.dumps({"value": 3, "unit": None}), "a door of 3" + " " * 60 + "metres", None),
        (14, json.dumps({"value": "at least 3 m wide", "unit": None}), None, None),
        (10, json.dumps(json.dumps(json.dumps(json.dumps({"value": 7, "unit": "mm"})))), None, None),
    ]
    df = spark.createDataFrame(rows, "clause_id long, entities string, text_en string, text_fa string").withColumn("pos", F.lit("clash"))
    got = {(r["rec_id"], r["pos"], r["what"], r["amount"]) for r in quantities.clause_quantities(df).collect()}
    assert got == {(1, 0, "value", 1925), (2, 0, "lo", 1000), (2, 0, "hi", 2500), (2, 3, "lo", 914), (2, 3, "hi", 1219), (3, 0, "value", 350), (8, 0, "value", 2), (10, 0, "value", 7), (11, 0, "value", 1200), (12, 0, "lo", 12000), (13, 0, "value", 3000), (14, 0, "value", 3000)}
    assert quantities.clause_quantities(df.limit(0)).count() == 0
    f = spark.createDataFrame(
        [(1, 68.44, (3069916.0, None), None, "measured ۶۸.۴۴ m^2, required ۳۰۶۹۹۱۶ mm²"), (2, 5.0, None, "dB", "5 m"), (3, None, (1.0, 2.0), "ft", None), (4, 2.0, None, "?", "Room_2: found 2M2"), (5, 3.0, (3.0, None), "", "Room_1: 3 mm demanded, 3 m found"), (6, 7.0, None, None, None)],
        "finding_id long, measured double, required struct<lo:double,hi:double>, unit string, message string",
    )
    got = {(r["rec_id"], r["what"], r["amount"]) for r in quantities.finding_quantities(f).collect()}
    assert got == {(1, "measured", 68440000), (1, "lo", 3069916), (3, "lo", 305), (3, "hi", 610), (4, "measured", 2000000), (5, "measured", 3000), (5, "lo", 3)}


# ------------------------------------------------------------------ nested records


def test_nested_entities(spark):
    rows = [(1, '{"a": 1, "conditions": [{"t": 1}, "x", {"t": 2}]}'), (2, '["x", null, {"object": 1, "condition": {"t": 1}}]'), (3, "null"), (4, '{"items": [{"object": 1}]}'), (5, '{"object": 1'), (6, json.dumps('[{"object": 1}]')), (7, ""), (8, None), (9, "[]")]
    df = spark.createDataFrame(rows, "clause_id long, entities string").withColumn("texts", F.lit(1))
    got = {tuple(r)[0:4] for r in nested.entity_tables(df).collect()}
    assert got == {
        ("entity", 1, "", "0"), ("condition", 1, "0", "0"), ("condition", 1, "0", "2"), ("entity", 2, "", "2"), ("condition", 2, "2", "0"),
        ("entity", 4, "", "0"), ("entity", 6, "", "0"),
    }
    assert nested.entity_tables(df.limit(0)).count() == 0


def test_nested_plans(spark):
    ring = [[0, 0], [1, 0], [1, 1], [0, 0]]
    docs = [
        {"bim_data": {"rooms": [{"id": "R", "polygon": ring, "windows": [{"id": "W"}, {"id": "W"}]}, {"id": 7, "polygon": None}], "slabs": None}},
        {"graph": {"nodes": {"R": {"polygon": {"points": [{"x": 0, "y": 0}, {"x": 1, "y": 1}]}, "windows": {"id": "V"}}}}, "ifc": {"stairs": [{"id": "S", "footprint_polygon": ring}]}},
        {"plan": {"storeys": [{"spaces": [], "slabs": [{"id": "B", "polygon": []}]}, None, {"spaces": [{"id": "Q", "polygon": [[5, 5]]}]}]}},
    ]
    rows = [(i, json.dumps(x)) for i, x in enumerate(docs)] + [(8, json.dumps(docs[0])[:-3]), (9, ""), (10, None), (11, json.dumps(json.dumps(docs[2])))]
    got = sorted((r["kind"], r["rec_id"], r["parent_key"], r["child_key"]) for r in nested.plan_tables(spark.createDataFrame(rows, "export_id long, payload string")).collect())
    vertices = [("R", 0, n) for n in "012"] + [("R", 1, n) for n in "01"] + [("S", 1, n) for n in "012"] + [("Q", 2, "0"), ("Q", 11, "0")]
    assert got == sorted([("window", 0, "R", "W"), ("window", 1, "R", "V")] + [("vertex", rec, key, n) for key, rec, n in vertices])


# ------------------------------------------------------------------ geometry and spatial joins


@given(st.lists(st.tuples(st.integers(-50, 50), st.integers(-50, 50)), min_size=1, max_size=7))
@settings(max_examples=15, deadline=None)
def test_area_and_perimeter(spark, pts):
    n = len(pts)
    open_ = pts[:-1] if n > 1 and pts[0] == pts[-1] else pts
    m = len(open_)
    area = abs(sum(open_[i][0] * open_[(i + 1) % m][1] - open_[(i + 1) % m][0] * open_[i][1] for i in range(m))) / 2 if m >= 3 else 0
    df = spark.createDataFrame([([[float(a), float(b)] for a, b in pts],)], "p array<array<double>>")
    r = df.select(G.area(G.ring(F.col("p"))).alias("a"), F.size(G.ring(F.col("p"))).alias("n")).first()
    assert (r["a"], r["n"]) == (area, m)


def test_geometry_pieces(spark):
    df = spark.sql("select named_struct('x1', 0D, 'y1', 0D, 'x2', 2D, 'y2', 2D) a, named_struct('x1', 1D, 'y1', 1D, 'x2', 3D, 'y2', 3D) b, named_struct('x1', 0D, 'y1', 2D, 'x2', 2D, 'y2', 0D) c, array(array(0D, 0D), array(3D, 4D), null, array(3D)) p")
    c = F.col
    r = df.select(G.iou(c("a"), c("b")).alias("iou"), G.segments_meet(c("a"), c("c")).alias("meet"), G.crossing(c("a"), c("c")).alias("x"), G.crossing(c("a"), c("b")).alias("par"), G.polyline_length(G.ring(c("p"))).alias("len"), G.bounds(G.ring(c("p"))).alias("bb"), G.scaled(G.ring(c("p")), 2.0, 2.0, 0.0, 0.0, 1.0, 1.0).alias("s")).first()
    assert r["iou"] == pytest.approx(1 / 7) and r["meet"] and tuple(r["x"]) == (1, 1) and r["par"] is None and r["len"] == 5
    assert tuple(r["bb"]) == (0, 0, 3, 4) and [tuple(p) for p in r["s"]] == [(0, 0), (1, 1)]


def test_nearest_ties_and_reach(spark):
    pts = spark.createDataFrame([("P", "a", 0, 5.0, 0.0), ("P", "b", 1, 9e6, 0.0), ("P", "c", 2, None, 0.0), ("Q", "d", 0, 5.0, 0.0)], "plan_id string, id string, ord int, x double, y double")
    segs = spark.createDataFrame([("P", "w2", 1, 0.0, 3.0, 10.0, 3.0), ("P", "w1", 0, 0.0, -3.0, 10.0, -3.0)], "plan_id string, wall_id string, ord int, x1 double, y1 double, x2 double, y2 double")
    got = {r["id"]: (r["wall_id"], r["distance"]) for r in spatial.nearest_segment(pts, segs, 10.0).collect()}
    assert got == {"a": ("w1", 3.0), "b": (None, None), "c": (None, None), "d": (None, None)}


def test_long_slanting_segments_take_few_cells(spark):
    rng = random.Random(4)
    segs = [("P", f"w{i}", i, *[rng.uniform(0, 1e5) for _ in range(4)]) for i in range(6)] + [("P", "up", 6, 500.0, 0.0, 500.0, 9e4), ("P", "dot", 7, 700.0, 700.0, 700.0, 700.0)]
    pts = [("P", f"p{i}", i, rng.uniform(-100, 1e5), rng.uniform(-100, 1e5)) for i in range(200)]
    pts += [("P", f"q{i}", 1000 + i, s[3] + t * (s[5] - s[3]) + rng.uniform(-40, 40), s[4] + t * (s[6] - s[4]) + rng.uniform(-40, 40)) for i, s in enumerate(segs * 20) for t in [rng.random()]]
    p = spark.createDataFrame(pts, "plan_id string, id string, ord int, x double, y double")
    s = spark.createDataFrame(segs, "plan_id string, wall_id string, ord int, x1 double, y1 double, x2 double, y2 double")
    assert spatial.near_segment_cells(s, 60.0, 100.0).count() < 8 * 5000

    def far(x, y, x1, y1, x2, y2):
        n = (x2 - x1) ** 2 + (y2 - y1) ** 2
        t = max(0.0, min(1.0, ((x - x1) * (x2 - x1) + (y - y1) * (y2 - y1)) / n)) if n else 0.0
        return math.hypot(x - x1 - t * (x2 - x1), y - y1 - t * (y2 - y1))

    want = {a[1]: min((far(*a[3:], *b[3:]), b[2], b[1]) for b in segs) for a in pts}
    got = {r["id"]: r["wall_id"] for r in spatial.nearest_segment(p, s, 60.0, 100.0).collect()}
    assert got == {k: v[2] if v[0] <= 60 else None for k, v in want.items()}


def _apart(x, y, ring):
    """Distance of a point from a rectangle given by its corners."""
    xs, ys = [p[0] for p in ring], [p[1] for p in ring]
    return max(min(xs) - x, x - max(xs), 0.0), max(min(ys) - y, y - max(ys), 0.0)


def _room_links(plan):
    """Plain model: nearest room to the first probe, then to the second among the other rooms."""
    walls = {w[0]: w for w in plan["walls"]}
    out = set()
    for door, host, x, y in plan["doors"]:
        probes = [(x, y)] * 2
        if host in walls and (n := math.dist(walls[host][1], walls[host][2])):
            (x1, y1), (x2, y2) = walls[host][1:]
            probes = [(x - s * 150 * (y2 - y1) / n, y + s * 150 * (x2 - x1) / n) for s in (1, -1)]
        met = []
        for p in probes:
            near = [(math.hypot(*_apart(*p, ring)), k, room) for k, (room, ring) in enumerate(plan["rooms"]) if room not in met]
            met += [b[2] for b in [min(near, default=(1e9,))] if b[0] <= 300]
        out.add((plan["plan_id"], door, *(sorted(met) + [None, None])[:2]))
    return out


def test_room_links_exclude_the_first_room(spark, tmp_path):
    rng = random.Random(5)
    box = lambda x, y, w, h: [[x, y], [x + w, y], [x + w, y + h], [x, y + h]]
    plans = [{"plan_id": "edge", "rooms": [("r1", box(0, 0, 1000, 1000)), ("r2", box(1100, 0, 1000, 1000))], "walls": [("w", (1050.0, 0.0), (1050.0, 1000.0))],
              "doors": [("hostless", None, 1050.0, 500.0), ("shifted", "w", 800.0, 500.0), ("on", "w", 1050.0, 500.0), ("outer", None, 0.0, 500.0), ("far", None, 9000.0, 0.0)]}]
    for k in range(20):
        rooms = [(f"r{i}", box(rng.uniform(0, 3000), rng.uniform(0, 3000), rng.uniform(100, 1500), rng.uniform(100, 1500))) for i in range(6)]
        walls = [(f"w{i}", (rng.uniform(0, 4000), rng.uniform(0, 4000)), (rng.uniform(0, 4000), rng.uniform(0, 4000))) for i in range(3)]
        plans.append({"plan_id": f"p{k}", "rooms": rooms, "walls": walls, "doors": [(f"d{i}", rng.choice(["w0", "w1", "w2", "gone", None]), rng.uniform(-300, 4500), rng.uniform(-300, 4500)) for i in range(15)]})
    schema = spark.read.parquet("/root/testdata/sf0.001/plans.parquet").select("plan_id", "rooms", "walls", "doors").schema
    rows = []
    for p in plans:
        rows.append(json.dumps({"plan_id": p["plan_id"], "rooms": [{"id": i, "polygon": r} for i, r in p["rooms"]], "walls": [{"id": i, "start_point": a, "end_point": b} for i, a, b in p["walls"]], "doors": [{"id": i, "host_wall_id": h, "insertion_point": [x, y]} for i, h, x, y in p["doors"]]}))
    spark.read.schema(schema).json(spark.sparkContext.parallelize(rows)).write.parquet(str(tmp_path / "plans.parquet"))
    got = [tuple(r) for r in catalogue.queries()["room_links"](spark, str(tmp_path)).collect()]
    want = set().union(*map(_room_links, plans))
    assert {("edge", "hostless", "r1", "r2"), ("edge", "shifted", "r1", "r2"), ("edge", "outer", "r1", None), ("edge", "far", None, None)} <= want
    assert len(got) == len(set(got)) and set(got) == want


def test_graph(spark):
    nodes = spark.createDataFrame([(g, n) for g in (1, 2) for n in range(40)], "g int, node int")
    edges = spark.createDataFrame([(1, i, i + 1) for i in range(29)] + [(1, 5, 5), (1, 33, 34), (1, 3, 99), (2, 1, 0), (2, 1, 0)], "g int, a int, b int")
    c = {(r["g"], r["node"]): r["label"] for r in graph.components(nodes, edges).collect()}
    assert all(c[1, n] == 0 for n in range(30)) and c[1, 34] == 33 and c[1, 39] == 39 and c[2, 1] == 0 and c[2, 2] == 2
    s = {(r["g"], r["node"]): r["steps"] for r in graph.steps_to(nodes, edges, nodes.where("node = 4 and g = 1")).collect()}
    assert s[1, 4] == 0 and s[1, 0] == 4 and s[1, 29] == 25 and (1, 31) not in s and (2, 4) not in s
    p = {(r["g"], r["node"]): r["path"] for r in graph.paths_to(nodes, edges, nodes.where("node = 4 and g = 1")).collect()}
    assert p[1, 4] == [4] and p[1, 1] == [1, 2, 3, 4] and p[1, 29] == list(range(29, 3, -1)) and p.keys() == s.keys()


def test_greedy(spark):
    b = spark.createDataFrame([("p", 1, 0.9, 0.0, 0.0, 10.0, 10.0), ("p", 2, 0.8, 1.0, 0.0, 11.0, 10.0), ("p", 3, 0.7, 50.0, 0.0, 60.0, 10.0), ("p", 4, None, 50.0, 0.0, 60.0, 10.0), ("q", 2, 0.8, 1.0, 0.0, 11.0, 10.0)], "plan_id string, id int, score double, x1 double, y1 double, x2 double, y2 double")
    assert sorted((r["plan_id"], r["id"]) for r in greedy.suppress(b, ["plan_id"], 0.3).collect()) == [("p", 1), ("p", 3), ("q", 2)]
    truth = b.where("score is not null").withColumn("label", F.lit(1))
    got = {(r["plan_id"], r["id"]): r["truth_id"] for r in greedy.match(truth, truth, "plan_id", 0.5).collect()}
    assert got == {("p", 1): 1, ("p", 2): 2, ("p", 3): 3, ("q", 2): 2}
    line = spark.createDataFrame([("a", i, float(i), 0.01 if i == 2 else 0.0) for i in range(5)], "k string, ord int, x double, y double")
    assert [r["ord"] for r in greedy.simplified(line, "k", 0.1).orderBy("ord").collect()] == [0, 4]
    pt = lambda *v: [(float(x), float(y)) for x, y in v]
    rooms = spark.createDataFrame([("one", pt((0, 0), (3, 0), (3, 3), (0, 3))), ("one", pt((3, 0), (6, 0), (6, 3), (3, 3))), ("two", pt((0, 0), (1, 0), (1, 1), (0, 1))), ("two", pt((5, 5), (6, 5), (6, 6), (5, 6)))], "plan_id string, ring array<struct<x:double,y:double>>")
    f = {r["plan_id"]: r for r in greedy.footprint(rooms).collect()}
    assert (f["one"]["area"], f["one"]["parts"], len(f["one"]["exterior"])) == (18, 1, 6)
    assert (f["two"]["area"], f["two"]["parts"], f["two"]["exterior"]) == (2, 2, None)


# ------------------------------------------------------------------ keyed tables, measures, files, streams


def test_limits_and_comparators(spark):
    from planweave.operators import limits

    rows = [(1.0, ">=", 1.0, None), (1.0, ">", 1.0, None), (2.0, "range", 1.0, 2.0), (2.1, "range", 1.0, 2.0), (1.0, "=", 1.0, None), (None, "<", 1.0, None), (0.5, "<", 1.0, None), (1.0, "<=", 0.9, None)]
    df = spark.createDataFrame(rows, "v double, c string, lo double, hi double")
    assert [r[0] for r in df.select(limits.holds(*(F.col(x) for x in ("v", "c", "lo", "hi")))).collect()] == [True, False, True, False, False, None, True, False]


def test_texts(spark):
    from planweave.operators import texts as T

    one = lambda col, *v: [r[0] for r in spark.createDataFrame([(x,) for x in v], "t string").select(col(F.col("t"))).collect()]
    assert one(T.as_text, None, "null", "plain", '["a", ["b", {"k": "c"}]]', '{"k": "v: w"}', "[1") == ["", "", "plain", "a b c", "v: w", "[1"]
    words = [("wet", ["bath", "kitchen"]), ("any", ["room"])]
    assert one(lambda c: T.category_of(c, words), "The BATH-room", "room 5", "hall", None) == ["wet", "any", None, None]
    assert one(lambda c: T.mentions(c, ["exit"]), "No EXIT", "no", None) == [True, False, False]
    df = spark.createDataFrame([(1, 'Here: [{"a": 1}, 2] end'), (2, "nothing"), (3, 'x {"a": [1'), (4, 'only {"a": 1} one'), (5, "[1] and [2]"), (6, None)], "id int, t string")
    assert [(r["id"], r["n_members"]) for r in T.json_members(df, "t").orderBy("id").collect()] == [(1, 2), (2, 0), (3, 0), (4, 1), (5, 0), (6, 0)]


def test_nearest_terms_against_all_pairs(spark):
    from planweave.operators import texts as T

    rng = random.Random(3)
    word = lambda n: "".join(rng.choice("ABC") for _ in range(n))
    terms = [(k, word(rng.randint(1, 12))) for k in range(60)]
    values = [word(rng.randint(0, 14)) for _ in range(200)] + [" abc ", None, terms[3][1]]

    def lev(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row, last = [i], row
            for j, y in enumerate(b, 1):
                row.append(min(row[-1] + 1, last[j] + 1, last[j - 1] + (x != y)))
        return row[-1]

    want = {}
    for v in {x.strip().upper() for x in values if x}:
        if len(v) >= 2:
            s = sorted((-(1 - lev(v, t) / max(len(v), len(t))) * 100, k) for k, t in terms)
            good = [(a, k) for a, k in s if -a >= 80 and (len(v) >= 4 or a == -100)]
            want[v] = (good[0][1], round(-good[0][0], 6)) if good else (None, 0.0)
    v = spark.createDataFrame([(x,) for x in values], "o string")
    got = {r["value"]: (r["term_id"], round(r["score"], 6)) for r in T.nearest_terms(v, "o", spark.createDataFrame(terms, "term_id int, term string"), "term", "term_id").collect()}
    assert got == want


def test_detections(spark):
    from planweave.operators import detections as D

    st_ = spark.createDataFrame([(0, 0), (3, 3), (3, 0), (3, 1)], "f int, k int")
    assert [tuple(r) for r in st_.select(D.status(F.col("f"), F.col("k")), D.status(F.col("f"), F.col("k"), False)).collect()] == [("skipped", "skipped"), ("ok", "ok"), ("failed", "degraded"), ("degraded", "degraded")]
    df = spark.createDataFrame([("g", 1, 0.9, 1, 2.0), ("g", 2, 0.8, 0, 2.0), ("g", 3, 0.7, 1, 2.0), ("h", 1, 0.5, 0, 0.0)], "g string, id int, s double, hit int, n double")
    ap = {r["g"]: r for r in D.average_precision(df, ["g"], "s", "hit", "n", ["id"]).collect()}
    assert ap["g"]["ap"] == pytest.approx(0.5 + 0.5 * 2 / 3) and ap["g"]["recall"] == 1 and ap["h"]["ap"] == 0
    sweep = spark.createDataFrame([("a", 0.1, 0.5), ("a", 0.2, 0.5), ("a", 0.3, None), ("b", 0.1, None)], "k string, t double, v double")
    assert [tuple(r) for r in D.best_threshold(sweep, ["k"], "t", "v").collect()] == [("a", 0.1, 0.5)]
    m = D.metrics(spark.createDataFrame([("a", None, None, 10.0)], "k string, c double, s double, w double"), ["k"], "c", F.col("s"), F.col("w")).first()
    assert (m["n"], m["mean"], m["coverage"]) == (1, 0.0, 0.0)
    assert D.class_overlap(spark.createDataFrame([("a", 0.0, 0.0)], "l string, c double, e double"), "l", "c", "e").first()["iou"] is None


def test_drawing_helpers(spark):
    import struct

    from planweave.sources import files

    png = b"\x89PNG\r\n\x1a\n" + struct.pack(">I4sII", 13, b"IHDR", 640, 480) + b"rest"
    r = spark.createDataFrame([(bytearray(png),), (bytearray(b"GIF89a"),)], "c binary").select(files.png_size(F.col("c")).alias("s")).collect()
    assert tuple(r[0]["s"]) == (640, 480) and r[1]["s"] is None
    v = spark.createDataFrame([("10 20 100 50",), ("0,0,0,5",), (None,), ("a b c d",)], "v string").select(files.view_box(F.col("v"), F.lit(200), F.lit(100)).alias("s")).collect()
    assert [tuple(x["s"]) for x in v] == [(2.0, 2.0, -20.0, -40.0), (1.0, 1.0, 0.0, 0.0), (1.0, 1.0, 0.0, 0.0), (1.0, 1.0, 0.0, 0.0)]
    k = spark.createDataFrame([("x Wall", "id", None), ("x", "Door-12", None), (None, "q9", "Window"), (None, None, None)], "c string, i string, t string")
    assert [x[0] for x in k.select(files.class_of(F.col("c"), F.col("i"), F.col("t"), {"wall": 1, "door": 2, "window": 3})).collect()] == [1, 2, 3, None]
    d = files.with_defaults(spark.createDataFrame([("x", None), ("2.5", "n")], "height string, name string"), {"height": 3.0, "name": "plan", "floors": 1}).collect()
    assert [(x["height"], x["name"], x["floors"]) for x in d] == [(3.0, "plan", 1), (2.5, "n", 1)]
    p = files.paragraphs(spark.createDataFrame([(1, "# Head\n\n text \n## Sub"), (2, None)], "doc int, text string")).orderBy("pos").collect()
    assert [(x["pos"], x["style"], x["text"]) for x in p] == [(0, "Heading 1", "Head"), (2, "Normal", "text"), (3, "Heading 2", "Sub")]
    j = spark.createDataFrame([("[1, 2, 3]",), ('{"x": 4, "y": 5.5}',), ("[1]",), ("q",), (None,)], "t string").select(G.json_point(F.col("t")).alias("p")).collect()
    assert [x["p"] and tuple(x["p"]) for x in j] == [(1.0, 2.0), (4.0, 5.5), None, None, None]


def test_logs_and_reports(spark, tmp_path):
    from planweave.sources import files

    f = spark.createDataFrame([(1, "P", "a<b", "FAIL", "m" * 300), (2, "P", "c", "PASS", "x"), (3, "P", None, "needs_review", None)], "finding_id int, plan_id string, article_id string, verdict string, message string")
    t = {r["finding_id"]: r for r in files.issue_topics(f).collect()}
    assert t.keys() == {1, 3} and len(t[1]["title"]) == 200 and t[1]["title"].endswith("…") and "<Title>m" in t[1]["markup"]
    files.write_report(f, str(tmp_path / "r"))
    rows = [r["value"] for r in spark.read.text(str(tmp_path / "r" / "rows")).collect()]
    assert "a&lt;b" in rows[0] and len(rows) == 3
    files.write_topics(f, str(tmp_path / "t"))
    assert spark.read.json(str(tmp_path / "t")).count() == 2
    for v in (1, 2):
        files.append_log(spark.createDataFrame([("j", v)], "job string, at int"), str(tmp_path / "log"))
        files.append_csv(spark.createDataFrame([("j", None if v == 1 else 0.5)], "k string, iou double"), str(tmp_path / "csv"))
    assert [tuple(r) for r in keyed.latest(spark.read.parquet(str(tmp_path / "log")), ["job"], ["at"]).collect()] == [("j", 2)]
    assert sorted(str(r["iou"]) for r in spark.read.option("header", True).csv(str(tmp_path / "csv")).collect()) == ["0.5", "None"]
    (tmp_path / "coco.json").write_text(json.dumps({"images": [{"id": 1, "file_name": "a", "width": 5, "height": 5}, {"id": 2, "file_name": "b", "width": 5, "height": 5}], "annotations": [{"id": 1, "image_id": 1, "category_id": 3, "segmentation": [[0, 0, 4, 0, 4, 4]], "bbox": [0, 0, 4, 4], "area": 8, "iscrowd": 0}, {"id": 2, "image_id": 2, "category_id": 3, "segmentation": [], "bbox": [0, 0, 1, 1], "area": 1, "iscrowd": 0}], "categories": [{"id": 3, "name": "door"}, {"id": 4, "name": "window"}]}))
    images, annotations, categories = files.coco(spark, str(tmp_path / "coco.json"))
    assert [(r["id"], len(r["annotations"])) for r in files.annotated_images(images, annotations).collect()] == [(1, 1)]
    assert {tuple(r) for r in files.conversion_report(images, annotations.where("area >= 4"), categories).collect()} == {("converted", 1), ("skipped", 1), ("door", 1), ("window", 0)}
    files.write_coco(images, annotations, [(3, "door"), (4, "window")], str(tmp_path / "out"))
    back = [json.loads(r["value"]) for r in spark.read.text(str(tmp_path / "out")).collect()]
    assert sorted(b["images"][0]["id"] for b in back) == [1, 2] and all(len(b["categories"]) == 2 for b in back)


def test_keyed_checks(spark):
    from planweave.operators import detections as D

    a = spark.createDataFrame([(1, "x"), (1, "y"), (2, "z"), (3, "z")], "id int, name string")
    assert {tuple(r) for r in D.bijection_faults(a, "id", "name").collect()} == {("id", "1", 2), ("name", "z", 2)}
    with pytest.raises(ValueError):
        keyed.once_each(a, ["id"])
    assert keyed.once_each(a.where("id = 2"), ["id"]).count() == 1
    assert sorted(r["id"] for r in keyed.unseen(a, spark.createDataFrame([(1,)], "id int"), ["id"]).collect()) == [2, 3]
    n = spark.createDataFrame([(1, "k1"), (2, "k2"), (3, "k2")], "v int, key string")
    known = spark.createDataFrame([(9, "k1")], "v int, key string")
    once = keyed.added(known, n, ["key"], ["v"])
    assert sorted(map(tuple, once.collect())) == [(2, "k2"), (9, "k1")] and sorted(map(tuple, keyed.added(once, n, ["key"], ["v"]).collect())) == sorted(map(tuple, once.collect()))


SEGMENTS = [((0, 0, 10, 0), (2, -1, 4, 1)), ((0, 0, 1, 0), (2, -1, 4, 1)), ((3, 0, 3.5, 0), (2, -1, 4, 1)), ((0, 5, 10, 5), (2, -1, 4, 1)), ((2, -5, 2, 5), (2, -1, 4, 1)), ((0, 0, 4, 4), (4, 4, 6, 6)), ((3, 0, 9, 0), (2, -1, 4, 1)), ((1, 1, 1, 1), (0, 0, 2, 2))]


def test_segments_and_boxes(spark):
    df = spark.createDataFrame([({k: float(v) for k, v in zip(("x1", "y1", "x2", "y2"), s)}, {k: float(v) for k, v in zip(("x1", "y1", "x2", "y2"), b)}) for s, b in SEGMENTS], "s struct<x1:double,y1:double,x2:double,y2:double>, b struct<x1:double,y1:double,x2:double,y2:double>")
    got = df.select(G.segment_meets_box(F.col("s"), F.col("b")).alias("m"), G.outside_parts(F.col("s"), F.col("b")).alias("p")).collect()
    assert [r["m"] for r in got] == [True, False, True, False, True, True, True, True]
    parts = [[tuple(x) for x in r["p"]] for r in got]
    assert parts[0] == [(0, 0, 2, 0), (4, 0, 10, 0)] and parts[1] == [(0, 0, 1, 0)] and parts[2] == [] and parts[3] == [(0, 5, 10, 5)]
    assert parts[4] == [(2, -5, 2, -1), (2, 1, 2, 5)] and parts[5] == [(0, 0, 4, 4)] and parts[6] == [(4, 0, 9, 0)] and parts[7] == []
    d = df.select(G.segments_distance(F.col("s"), F.col("b")).alias("d"), G.simple(G.edges(F.array(*[F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in ((0.0, 0.0), (2.0, 2.0), (2.0, 0.0), (0.0, 2.0))]))).alias("s")).collect()
    assert d[0]["d"] == 0 and d[1]["d"] == pytest.approx(math.sqrt(2)) and not d[0]["s"]


def plan_fixture(spark, tmp_path, name, rooms, walls, doors, windows=()):
    """One plan as a table: rooms (id, category, x1, y1, x2, y2), walls (id, x1, y1, x2, y2, exterior), doors and windows (id, host, x, y, width, height)."""
    box = lambda x1, y1, x2, y2: [[x1, y1], [x2, y1], [x2, y2], [x1, y2], [x1, y1]]
    opening = lambda o: {"id": o[0], "host_wall_id": o[1], "insertion_point": [float(o[2]), float(o[3])], "width": float(o[4]), "height": float(o[5])}
    doc = {"plan_id": "P", "rooms": [{"id": r[0], "category": r[1], "polygon": box(*map(float, r[2:]))} for r in rooms], "walls": [{"id": w[0], "start_point": [float(w[1]), float(w[2])], "end_point": [float(w[3]), float(w[4])], "is_exterior": w[5]} for w in walls], "doors": [opening(o) for o in doors], "windows": [opening(o) for o in windows]}
    schema = spark.read.parquet("/root/testdata/sf0.001/plans.parquet").schema
    spark.read.schema(schema).json(spark.sparkContext.parallelize([json.dumps(doc)])).write.parquet(str(tmp_path / name / "plans.parquet"))
    return str(tmp_path / name)


def test_room_graph_of_a_small_plan(spark, tmp_path):
    walls = [("W1", 0, 0, 9000, 0, True), ("W2", 0, 3000, 9000, 3000, True), ("W3", 0, 0, 0, 3000, True), ("W4", 9000, 0, 9000, 3000, True), ("W5", 3000, 0, 3000, 3000, False), ("W6", 7000, 0, 7000, 3000, False)]
    rooms = [("Room_1", "room_bedroom", 0, 0, 3000, 3000), ("Room_2", "room_living", 3000, 0, 7000, 3000), ("Room_3", "room_bathroom", 7000, 0, 9000, 3000)]
    doors = [("Door_1", "W5", 3000, 1500, 900, 2000), ("Door_2", "W6", 7000, 1500, 800, 2000), ("Door_3", "W2", 5000, 3000, 1000, 2000), ("Door_4", "W5", 3000, 2500, 900, 2000), ("Door_5", None, 50000, 0, 900, 2000)]
    windows = [("Window_1", "W3", 0, 1500, 1200, 1000), ("Window_2", "W1", 5000, 0, 1500, 1000), ("Window_3", "W6", 7000, 500, 600, 400)]
    d = plan_fixture(spark, tmp_path, "one", rooms, walls, doors, windows)
    q = lambda n: catalogue.queries()[n](spark, d).collect()
    assert {(r["room_a"], r["room_b"], r["door_id"], r["doors"]) for r in q("graph_edges")} == {("Room_1", "Room_2", "Door_1", 2), ("Room_2", "Room_3", "Door_2", 1)}
    assert [r["room_id"] for r in q("exit_rooms")] == ["Room_2"]
    assert ("Door_5", None, None) in {(r["id"], r["room_a"], r["room_b"]) for r in q("room_links")}
    assert {r["room_id"]: r["path"] for r in q("egress_paths")} == {"Room_1": "Room_1>Room_2", "Room_2": "Room_2", "Room_3": "Room_3>Room_2"}
    assert all(r["outer"] for r in q("outer_rooms")) and {r["wall_id"]: r["outer"] for r in q("outer_walls")} == {"W1": True, "W2": True, "W3": True, "W4": True, "W5": False, "W6": False}
    sides = {r["id"]: (r["room_id"], r["outer"]) for r in q("window_sides")}
    assert sides["Window_1"] == ("Room_1", True) and sides["Window_3"][1] is False
    assert {r["room_id"]: r["ratio"] for r in q("glazing_ratio")}["Room_1"] == pytest.approx(1.2 / 9)
    s = q("graph_summary")[0]
    assert (s["rooms"], s["door_edges"], s["exit_rooms"]) == (3, 2, 1)
    # A room apart from the others leaves the plan without an outer ring: walls are as flagged, rooms not outer.
    d = plan_fixture(spark, tmp_path, "two", [*rooms, ("Dark", "room_living", 0, 3500, 4000, 6500)], walls, doors)
    assert not any(r["outer"] for r in q("outer_rooms")) and {r["wall_id"] for r in q("outer_walls") if r["outer"]} == {"W1", "W2", "W3", "W4"}


def test_footprint_with_courtyard(spark):
    sq = lambda x1, y1, x2, y2: [(float(a), float(b)) for a, b in ((x1, y1), (x2, y1), (x2, y2), (x1, y2))]
    ring = [("c", sq(0, 0, 3, 1)), ("c", sq(0, 2, 3, 3)), ("c", sq(0, 1, 1, 2)), ("c", sq(2, 1, 3, 2)), ("d", sq(0, 0, 1, 1)), ("d", sq(1, 1, 2, 2))]
    f = {r["plan_id"]: r for r in greedy.footprint(spark.createDataFrame(ring, "plan_id string, ring array<struct<x:double,y:double>>")).collect()}
    assert (f["c"]["area"], f["c"]["parts"], len(f["c"]["exterior"])) == (8, 1, 12)
    assert all(0 in (e[0] % 3, e[1] % 3) for e in f["c"]["exterior"]) and (f["d"]["parts"], f["d"]["exterior"]) == (2, None)


def test_upsert_and_latest(spark):
    old = spark.createDataFrame([(1, "a", "t0"), (2, "b", "t0")], "k int, v string, made string")
    new = spark.createDataFrame([(2, "B", "t1"), (3, None, "t1"), (None, "n", "t1")], "k int, v string, made string")
    got = {tuple(r) for r in keyed.upserted(old, new, ["k"], kept=["made"]).collect()}
    assert got == {(1, "a", "t0"), (2, "B", "t0"), (3, None, "t1"), (None, "n", "t1")}
    assert {tuple(r) for r in keyed.latest(old.unionByName(new), ["k"], ["made"]).where("k is not null").collect()} == {(1, "a", "t0"), (2, "B", "t1"), (3, None, "t1")}
    d = spark.createDataFrame([(2, "PASS", 1), (2, "FAIL", 2)], "k int, reviewer_verdict string, decided_at int")
    f = spark.createDataFrame([(2, "NEEDS_REVIEW"), (2, "PASS"), (3, "NEEDS_REVIEW")], "k int, verdict string")
    assert sorted((r["k"], r["verdict"], r["final"]) for r in keyed.decided(f, d, "k").collect()) == [(2, "NEEDS_REVIEW", "FAIL"), (2, "PASS", "PASS"), (3, "NEEDS_REVIEW", "NEEDS_REVIEW")]


def test_scope(spark):
    df = spark.createDataFrame([(None, None), ("x", ["M-4"]), (None, []), ("", ["M-4", None]), (None, [None])], "s string, o array<string>")
    assert [r[0] for r in df.select(keyed.in_scope(F.col("s"), F.col("o"), ["M-4"])).collect()] == [True, False, False, True, False]


def test_measures(spark):
    v = spark.createDataFrame([("a", "pass"), ("a", None), ("b", "FAIL")], "k string, verdict string")
    assert {tuple(r) for r in measures.verdict_counts(v, ["k"]).collect()} == {("a", 1, 0, 1, 2), ("b", 0, 1, 0, 1)}
    r = spark.range(1).select(measures.reliability(F.lit(0.9), F.lit(3), F.lit(4), F.lit(1)).alias("s"), measures.share_text(F.lit(1), F.lit(0)).alias("t")).first()
    assert r["s"] == pytest.approx(36 + 22.5 + 15 + 10) and r["t"] == "100.0%"
    e = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, None), (4, [1.0, 1.0]), (5, [2.0, 0.0])], "id int, v array<double>")
    assert [x["id"] for x in measures.top_k(e, "v", [1.0, 0.0], 3, ["id"]).collect()] == [1, 5, 4]
    with pytest.raises(ValueError):
        measures.top_k(e, "v", [1.0, 0.0], 0, ["id"])


def test_files(spark, tmp_path):
    from planweave.sources import files

    (tmp_path / "c.json").write_text(json.dumps([{"article_id": "1", "skip_category": None, "entities": {"a": 1}}, {"article_id": "2", "skip_category": "x"}]))
    assert [(r["article_id"], r["entities"]) for r in files.clauses(spark, str(tmp_path / "c.json")).collect()] == [("1", '{"a": 1}')]
    (tmp_path / "s.txt").write_text("# no\n\n /a/b/ \nc\n")
    assert sorted(r["item"] for r in files.split_list(spark, str(tmp_path / "s.txt")).collect()) == ["a/b", "c"]
    svg = '<svg><g class="Wall"><polygon points="0,0 4,0 4,4"/><path d="M0 0 h2 v2 z"/></g><path id="X" d="M0 0 C 1 1 2 2 3 3"/></svg>'
    df = spark.createDataFrame([(1, svg), (2, "<svg"), (3, None)], "drawing_id int, svg string")
    got = [(r["drawing_id"], r["label"], len(r["points"])) for r in files.svg_polygons(df).orderBy("place").collect()]
    assert got == [(1, "Wall", 3), (1, "Wall", 3)]
    folder = str(tmp_path / "v")
    assert files.clauses(spark, str(tmp_path / "missing.json")).count() == 0
    (tmp_path / "bad.json").write_text('[{"article_id": "1"}, {"article_id": ')
    assert files.clauses(spark, str(tmp_path / "bad.json")).count() == 0
    (tmp_path / "more.json").write_text('[{"article_id": "1", "flag": true}]')
    assert files.clauses(spark, str(tmp_path / "more.json"), schema=files.CLAUSE + ", flag boolean").first()["flag"] is True
    assert files.read_version(spark, folder, "k int").count() == 0
    files.write_version(spark.range(3), folder)
    assert files.write_version(spark.range(5), folder, "second") == 2
    assert files.read_version(spark, folder, "id long").count() == 5
    with pytest.raises(files.VersionConflict):
        files.write_version(spark.range(7), folder, after=1)
    assert files.read_version(spark, folder, "id long").count() == 5 and [v[2] for v in files.versions(spark, folder)] == ["", "second"]


def test_state_survives_a_failing_read(spark, tmp_path):
    import shutil

    from planweave.sources import files
    from planweave.streaming import findings as S

    schema, folder, src = "k int, at int, v string", str(tmp_path / "state"), str(tmp_path / "in")
    run = lambda: S.keep_latest(S.read_stream(spark, src, schema, 1), folder, str(tmp_path / "cp"), ["k"], ["at"]).awaitTermination()
    spark.createDataFrame([(1, 1, "a"), (2, 1, "a")], schema).coalesce(1).write.parquet(src)
    run()
    data = f"{folder}/{files.versions(spark, folder)[-1][1]}"
    shutil.move(data, data + "-gone")
    spark.createDataFrame([(2, 2, "b"), (3, 1, "b"), (2, 0, "old")], schema).coalesce(1).write.mode("append").parquet(src)
    with pytest.raises(Exception):
        run()
    assert len(files.versions(spark, folder)) == 1
    shutil.move(data + "-gone", data)
    run()
    assert sorted(map(tuple, files.read_version(spark, folder, schema).collect())) == [(1, 1, "a"), (2, 2, "b"), (3, 1, "b")]
    # A batch whose commit was lost comes again and changes nothing.
    for name in ("1", ".1.crc"):
        (tmp_path / "cp" / "commits" / name).unlink()
    run()
    assert len(files.versions(spark, folder)) == 2


def test_streams(spark, data, tmp_path):
    from planweave.streaming import findings as S

    src = spark.read.parquet(f"{data}/findings.parquet")
    src.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = S.read_stream(spark, str(tmp_path / "in"), src.schema, 1)
    folder = str(tmp_path / "state")
    S.keep_latest(stream.select("plan_id", "verdict", "ingested_at", "finding_id"), folder, str(tmp_path / "cp"), ["plan_id"], ["ingested_at", "finding_id"]).awaitTermination()
    from planweave.sources.files import read_version

    got = {tuple(r) for r in read_version(spark, folder, "").select("plan_id", "finding_id").collect()}
    want = keyed.latest(src.select("plan_id", "verdict", "ingested_at", "finding_id"), ["plan_id"], ["ingested_at", "finding_id"])
    assert got == {tuple(r) for r in want.select("plan_id", "finding_id").collect()}
    q = S.windowed_verdicts(stream).writeStream.format("memory").queryName("verdicts").outputMode("complete").option("checkpointLocation", str(tmp_path / "cp2")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.sql("select sum(total) from verdicts").first()[0] == src.count()


@pytest.mark.parametrize("name", ["room_links", "adjoining_kinds", "exit_rooms", "graph_summary", "room_neighbours", "egress_paths", "graph_edges"])
def test_exploded_elements_are_not_broadcast(spark, data, name):
    # Estimates alone decide here: those of exploded columns are far too low, and the broadcast went through the driver.
    import __spark_entry__ as entry

    conf = {"spark.sql.autoBroadcastJoinThreshold": "10485760", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1"}
    before = {k: spark.conf.get(k, None) for k in conf}
    store = spark._jsparkSession.sharedState().statusStore()
    ran = store.executionsCount()
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        entry.queries()[name](spark, data).collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)
    plans = store.executionsList()
    assert plans.size() > ran
    text = "".join(plans.apply(i).physicalPlanDescription() for i in range(ran, plans.size()))
    # Only the list of kinds, given as a parameter, is.
    assert "SortMergeJoin" in text and all("kind_a" in keys for keys in re.findall(r"BroadcastHashJoin[^\n]*\nLeft keys[^\n]*", text))
