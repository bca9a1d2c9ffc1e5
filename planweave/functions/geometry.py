"""Plane geometry as Column expressions: points are structs (x, y), lengths in the unit of the input.

All of it stays inside the JVM; rings may be open or closed, null or too short
rings have area 0 and no other measure.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def point(p: Column) -> Column:
    """[x, y, ...] as a struct (x, y); null unless both are there."""
    x, y = F.get(p, 0), F.get(p, 1)
    return F.when(x.isNotNull() & y.isNotNull(), F.struct(x.alias("x"), y.alias("y")))


def json_point(text: Column) -> Column:
    """A JSON text [x, y, ...] or {"x": x, "y": y} as a struct (x, y); null unless both are numbers."""
    listed = F.from_json(F.when(F.trim(text).startswith("["), text), "array<double>")
    named = F.from_json(F.when(F.trim(text).startswith("{"), text), "x double, y double")
    x, y = F.coalesce(F.get(listed, 0), named["x"]), F.coalesce(F.get(listed, 1), named["y"])
    return F.when(x.isNotNull() & y.isNotNull(), F.struct(x.alias("x"), y.alias("y")))


def pixels(value: Column, mm_per_pixel: Column) -> Column:
    """A length in mm in pixels of a drawing; null for a scale that is not above 0."""
    return F.when(mm_per_pixel > 0, value / F.when(mm_per_pixel > 0, mm_per_pixel))


def square_mm(pixel_area: Column, mm_per_pixel: Column) -> Column:
    return pixel_area * mm_per_pixel * mm_per_pixel


def facing(b: Column, width: Column, height: Column) -> Column:
    """Direction an opening's box faces in a drawing where nothing else tells it: along its shorter side, away from the drawing's middle."""
    x, y = (b["x1"] + b["x2"]) / 2, (b["y1"] + b["y2"]) / 2
    flat = (b["x2"] - b["x1"]) >= (b["y2"] - b["y1"])
    return F.when(flat, F.when(y < height / 2, "up").otherwise("down")).otherwise(F.when(x < width / 2, "left").otherwise("right"))


def ring(polygon: Column) -> Column:
    """[[x, y], ...] as an open ring of points: without points that lack a coordinate and without a closing repeat."""
    pts = F.filter(F.transform(polygon, point), lambda p: p.isNotNull())
    closed = (F.size(pts) > 1) & (F.element_at(pts, 1) == F.element_at(pts, -1))
    return F.when(closed, F.slice(pts, F.lit(1), F.size(pts) - 1)).otherwise(pts)


def edges(r: Column) -> Column:
    """The edges of an open ring: array of (x1, y1, x2, y2), the last one back to the start."""
    shifted = F.concat(F.slice(r, F.lit(2), F.greatest(F.size(r) - 1, F.lit(0))), F.slice(r, 1, 1))
    e = F.zip_with(r, shifted, lambda a, b: F.struct(a["x"].alias("x1"), a["y"].alias("y1"), b["x"].alias("x2"), b["y"].alias("y2")))
    return F.when(F.size(r) >= 2, e).otherwise(F.array().cast("array<struct<x1:double,y1:double,x2:double,y2:double>>"))


def _total(items: Column, value) -> Column:
    return F.aggregate(items, F.lit(0.0), lambda acc, e: acc + value(e))


def area(r: Column) -> Column:
    """Shoelace area of a ring; 0 below three corners."""
    twice = _total(edges(r), lambda e: e["x1"] * e["y2"] - e["x2"] * e["y1"])
    return F.when(F.size(r) >= 3, F.abs(twice) / 2).otherwise(F.lit(0.0))


def length(x1, y1, x2, y2) -> Column:
    dx, dy = x2 - x1, y2 - y1
    return F.sqrt(dx * dx + dy * dy)


def perimeter(r: Column) -> Column:
    return F.when(F.size(r) >= 3, _total(edges(r), lambda e: length(e["x1"], e["y1"], e["x2"], e["y2"]))).otherwise(F.lit(0.0))


def polyline_length(pts: Column) -> Column:
    """Length of an open line through points."""
    n = F.size(pts)
    e = F.zip_with(F.slice(pts, F.lit(1), F.greatest(n - 1, F.lit(0))), F.slice(pts, F.lit(2), F.greatest(n - 1, F.lit(0))), lambda a, b: length(a["x"], a["y"], b["x"], b["y"]))
    return F.when(n >= 2, _total(e, lambda v: v)).otherwise(F.lit(0.0))


def bounds(r: Column) -> Column:
    """(x1, y1, x2, y2) of the points; null without points."""
    xs, ys = F.transform(r, lambda p: p["x"]), F.transform(r, lambda p: p["y"])
    return F.when(F.size(r) > 0, F.struct(F.array_min(xs).alias("x1"), F.array_min(ys).alias("y1"), F.array_max(xs).alias("x2"), F.array_max(ys).alias("y2")))


def vertex_mean(r: Column) -> Column:
    n = F.size(r)
    return F.when(n > 0, F.struct((_total(r, lambda p: p["x"]) / n).alias("x"), (_total(r, lambda p: p["y"]) / n).alias("y")))


def local(r: Column, origin: Column) -> Column:
    """Points relative to an origin."""
    return F.transform(r, lambda p: F.struct((p["x"] - origin["x"]).alias("x"), (p["y"] - origin["y"]).alias("y")))


def orientation(x1, y1, x2, y2) -> Column:
    """Undirected direction in degrees, from 0 up to 180."""
    d = F.degrees(F.atan2(y2 - y1, x2 - x1))
    return F.when(d < 0, d + 180).otherwise(F.when(d >= 180, d - 180).otherwise(d))


def scaled(pts: Column, sx: float, sy: float, dx: float, dy: float, width: float, height: float) -> Column:
    """Points scaled, moved and clipped to a frame, without repeats of the point before."""
    moved = F.transform(pts, lambda p: F.struct(F.least(F.greatest(p["x"] * sx + dx, F.lit(0.0)), F.lit(float(width))).alias("x"), F.least(F.greatest(p["y"] * sy + dy, F.lit(0.0)), F.lit(float(height))).alias("y")))
    return F.filter(moved, lambda p, i: (i == 0) | (p != F.get(moved, i - 1)))


def segment_distance(px, py, x1, y1, x2, y2) -> Column:
    """Distance of a point from a segment; a degenerate segment is a point."""
    dx, dy = x2 - x1, y2 - y1
    l2 = dx * dx + dy * dy
    t = F.when(l2 > 0, ((px - x1) * dx + (py - y1) * dy) / F.when(l2 > 0, l2)).otherwise(F.lit(0.0))
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), t))
    ex, ey = px - (x1 + t * dx), py - (y1 + t * dy)
    return F.sqrt(ex * ex + ey * ey)


def crosses_ray(px, py, x1, y1, x2, y2) -> Column:
    """Whether a ray to the right of the point crosses an edge."""
    up = (y1 > py) != (y2 > py)
    return up & (px < x1 + (py - y1) * (x2 - x1) / F.when(y2 != y1, y2 - y1))


def inside(px, py, es: Column) -> Column:
    """Ray casting: odd number of crossings."""
    return F.size(F.filter(es, lambda e: F.coalesce(crosses_ray(px, py, e["x1"], e["y1"], e["x2"], e["y2"]), F.lit(False)))) % 2 == 1


def ring_distance(px, py, es: Column) -> Column:
    """Distance of a point from a polygon: 0 inside, null without edges."""
    d = F.array_min(F.transform(es, lambda e: segment_distance(px, py, e["x1"], e["y1"], e["x2"], e["y2"])))
    return F.when(inside(px, py, es), F.lit(0.0)).otherwise(d)


def overlap(a: Column, b: Column) -> Column:
    """Common area of two boxes; 0 if apart or touching."""
    w = F.least(a["x2"], b["x2"]) - F.greatest(a["x1"], b["x1"])
    h = F.least(a["y2"], b["y2"]) - F.greatest(a["y1"], b["y1"])
    return F.greatest(w, F.lit(0.0)) * F.greatest(h, F.lit(0.0))


def box_area(b: Column) -> Column:
    return (b["x2"] - b["x1"]) * (b["y2"] - b["y1"])


def iou(a: Column, b: Column) -> Column:
    """Intersection over union of two boxes; 0 where the union is empty."""
    i = overlap(a, b)
    u = box_area(a) + box_area(b) - i
    return F.when(u > 0, i / F.when(u > 0, u)).otherwise(F.lit(0.0))


def segments_meet(a: Column, b: Column) -> Column:
    """Whether two segments (x1, y1, x2, y2) cross properly."""

    def side(s, x, y):
        return (s["x2"] - s["x1"]) * (y - s["y1"]) - (s["y2"] - s["y1"]) * (x - s["x1"])

    return (side(a, b["x1"], b["y1"]) * side(a, b["x2"], b["y2"]) < 0) & (side(b, a["x1"], a["y1"]) * side(b, a["x2"], a["y2"]) < 0)


def segments_distance(a: Column, b: Column) -> Column:
    """Distance of two segments (x1, y1, x2, y2): 0 if they cross, else the least distance of an end from the other."""
    ends = [segment_distance(p[f"x{k}"], p[f"y{k}"], q["x1"], q["y1"], q["x2"], q["y2"]) for p, q in ((a, b), (b, a)) for k in (1, 2)]
    return F.when(segments_meet(a, b), F.lit(0.0)).otherwise(F.least(*ends))


def simple(es: Column) -> Column:
    """Whether no two edges of a ring cross properly."""
    crossed = F.exists(es, lambda e: F.exists(es, lambda o: segments_meet(e, o)))
    return ~F.coalesce(crossed, F.lit(False))


def segment_meets_box(s: Column, b: Column) -> Column:
    """Whether a segment (x1, y1, x2, y2) has a point in a box (x1, y1, x2, y2), its border included."""
    first, last = clipped(s, b)
    return first <= last


def clipped(s: Column, b: Column) -> tuple[Column, Column]:
    """First and last place, from 0 to 1, of a segment in a box; the first is beyond the last if it has none."""
    dx, dy = s["x2"] - s["x1"], s["y2"] - s["y1"]
    low, high = [F.lit(0.0)], [F.lit(1.0)]
    for d, p, a, z in ((dx, s["x1"], b["x1"], b["x2"]), (dy, s["y1"], b["y1"], b["y2"])):
        d_ = F.when(d != 0, d)
        t1, t2 = (a - p) / d_, (z - p) / d_
        outside = (p < a) | (p > z)
        low.append(F.coalesce(F.least(t1, t2), F.when(outside, F.lit(2.0)).otherwise(F.lit(0.0))))
        high.append(F.coalesce(F.greatest(t1, t2), F.lit(1.0)))
    return F.greatest(*low), F.least(*high)


def outside_parts(s: Column, b: Column) -> Column:
    """The parts of a segment outside a box, as segments: the whole, none, one or two of them; points are no part."""
    first, last = clipped(s, b)
    at = lambda t: ((s["x1"] + t * (s["x2"] - s["x1"])), (s["y1"] + t * (s["y2"] - s["y1"])))

    def part(t1, t2):
        (x1, y1), (x2, y2) = at(t1), at(t2)
        return F.struct(x1.alias("x1"), y1.alias("y1"), x2.alias("x2"), y2.alias("y2"))

    zero, one = F.lit(0.0), F.lit(1.0)
    return F.array_compact(F.array(F.when(first > last, part(zero, one)), F.when((first <= last) & (first > 0), part(zero, first)), F.when((first <= last) & (last < 1), part(last, one))))


def crossing(a: Column, b: Column) -> Column:
    """Point where the lines of two segments cross; null if parallel."""
    d = (a["x2"] - a["x1"]) * (b["y2"] - b["y1"]) - (a["y2"] - a["y1"]) * (b["x2"] - b["x1"])
    t = ((b["x1"] - a["x1"]) * (b["y2"] - b["y1"]) - (b["y1"] - a["y1"]) * (b["x2"] - b["x1"])) / F.when(d != 0, d)
    return F.when(d != 0, F.struct((a["x1"] + t * (a["x2"] - a["x1"])).alias("x"), (a["y1"] + t * (a["y2"] - a["y1"])).alias("y")))
