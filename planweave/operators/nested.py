"""Deeply nested records as related flat tables.

The JVM parses the JSON once into typed nested columns that hold every layout
(missing members are null).  Python then flattens whole Arrow batches: list
offsets and parent indices give each child's parent and place, and keys are
carried down by ``take``.  No value is touched row by row.

Defined results: records that are null, empty or cut off have no rows; null or
empty arrays have no children; repeated children of one parent are one row;
children without a key are left out.  Record ids are unique.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from planweave.operators.entities import json_list, with_entity_texts, with_json_text

SCHEMA = "kind string, rec_id long, parent_key string, child_key string"


def children(lists: pa.Array) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """Of a list array: parent index and place of each child, and the children."""
    if isinstance(lists, pa.ChunkedArray):
        lists = lists.combine_chunks()
    parent = pc.list_parent_indices(lists).to_numpy()
    start = np.searchsorted(parent, parent, "left")
    return parent, pc.list_flatten(lists), np.arange(len(parent)) - start


def _distinct(kind: str, rec: pa.Array, parent: pa.Array, child: pa.Array) -> pa.RecordBatch:
    """Rows once each, without those that lack a key."""
    table = pa.table({"rec_id": rec, "parent_key": parent.cast(pa.string()), "child_key": child.cast(pa.string())})
    table = table.filter(pc.and_(pc.is_valid(table["parent_key"]), pc.is_valid(table["child_key"])))
    table = table.group_by(["rec_id", "parent_key", "child_key"]).aggregate([]).combine_chunks()
    return pa.record_batch([pa.array([kind] * table.num_rows, pa.string()), *(table[c].combine_chunks() for c in ("rec_id", "parent_key", "child_key"))], names=["kind", "rec_id", "parent_key", "child_key"])


def _text(places: np.ndarray) -> pa.Array:
    return pa.array(places).cast(pa.string())


def entity_tables(clauses: DataFrame, id_col: str = "clause_id", column: str = "entities") -> DataFrame:
    """Rows of kind entity and condition: each JSON object among the entities, each object among their conditions."""
    base = clauses.select(F.col(id_col).cast("long").alias("rec_id"), F.col(column).alias("_e")).where("rec_id is not null and _e is not null")
    base = with_entity_texts(base, "_e", "texts").where("texts is not null")
    member = F.transform(
        F.col("texts"),
        lambda e: F.struct(
            F.coalesce(e.startswith("{"), F.lit(False)).alias("object"),
            F.when(e.startswith("{"), F.from_json(e, "condition string, conditions string")).alias("c"),
        ),
    )
    base = base.select("rec_id", member.alias("parsed"))
    flags = F.transform(
        F.col("parsed"),
        lambda m: F.struct(
            m["object"].alias("object"),
            F.transform(F.coalesce(json_list(m["c"]["condition"]), json_list(m["c"]["conditions"])), lambda x: F.coalesce(x.startswith("{"), F.lit(False))).alias("conditions"),
        ),
    )

    def over(batches):
        for batch in batches:
            rec = batch.column(0)
            parent, members, place = children(batch.column(1))
            is_object = members.field("object") if len(members) else pa.array([], pa.bool_())
            at = np.flatnonzero(is_object.to_numpy(zero_copy_only=False))
            empty = pa.array([""] * len(at), pa.string())
            yield _distinct("entity", rec.take(pa.array(parent[at])), empty, _text(place[at]))
            if not len(members):
                continue
            owner, conditions, cplace = children(pc.struct_field(members, "conditions"))
            at = np.flatnonzero(conditions.to_numpy(zero_copy_only=False).astype(bool)) if len(conditions) else np.zeros(0, np.int64)
            own = owner[at]
            yield _distinct("condition", rec.take(pa.array(parent[own])), _text(place[own]), _text(cplace[at]))

    return base.select("rec_id", flags.alias("members")).mapInArrow(over, SCHEMA)


def _listed(text: Column, schema: str) -> Column:
    """JSON text of an array of objects, or of one object, as an array of structs."""
    t = F.trim(text)
    return F.from_json(F.when(t.startswith("{"), F.concat(F.lit("["), t, F.lit("]"))).when(t.startswith("["), t), schema)


def _corner_text(text: Column) -> Column:
    """JSON text of a polygon's corners: the polygon itself or what it has under "points"."""
    t = F.trim(text)
    return F.when(t.startswith("{"), F.get_json_object(t, "$.points")).otherwise(t)


def _points(t: Column) -> Column:
    """Corners of the text of [[x, y], ...] or [{x, y}, ...]."""
    named = F.from_json(t, "array<struct<x:double,y:double>>")
    pairs = F.transform(F.from_json(t, "array<array<double>>"), lambda p: F.struct(F.get(p, 0).alias("x"), F.get(p, 1).alias("y")))
    return F.when(t.rlike(r"^\[\s*\{"), named).otherwise(pairs)


_ROOM = "array<struct<id:string,polygon:string,windows:string>>"
_PART = "array<struct<id:string,polygon:string,footprint:string,footprint_polygon:string>>"
_LAYOUTS = (
    "bim_data struct<rooms:string,slabs:string,stairs:string>, rooms string, slabs string, stairs string, "
    "graph struct<nodes:map<string,string>>, ifc struct<slabs:string,stairs:string>, "
    "plan struct<storeys:array<struct<spaces:string,rooms:string,slabs:string,stairs:string>>>"
)


_WINDOW_KEYS = "array<struct<id:string>>"
_WINDOWS = "array<struct<id:string,width:double,height:double,sill_height:double>>"


def plan_elements(exports: DataFrame, id_col: str = "export_id", column: str = "payload", windows: str = _WINDOW_KEYS) -> DataFrame:
    """(rec_id, parents): per complete document, its rooms, slabs and stairs with corners and windows, whatever its layout."""
    doc = exports.select(F.col(id_col).cast("long").alias("rec_id"), F.col(column).alias("_p")).where("_p is not null and rec_id is not null")
    doc = with_json_text(doc, "_p", "payload").where("payload is not null").select("rec_id", F.from_json("payload", _LAYOUTS).alias("d"))

    def rooms(text):
        return F.transform(_listed(text, _ROOM), lambda r: F.struct(r["id"].alias("key"), r["polygon"].alias("polygon"), r["windows"].alias("windows")))

    def parts(text):
        return F.transform(_listed(text, _PART), lambda r: F.struct(r["id"].alias("key"), F.coalesce(r["footprint_polygon"], r["footprint"], r["polygon"]).alias("polygon"), F.lit(None).cast("string").alias("windows")))

    none = F.array().cast("array<struct<key:string,polygon:string,windows:string>>")
    nodes = F.transform(
        F.map_entries("d.graph.nodes"),
        lambda e: F.struct(e["key"].alias("key"), F.get_json_object(e["value"], "$.polygon").alias("polygon"), F.get_json_object(e["value"], "$.windows").alias("windows")),
    )
    storeys = F.flatten(
        F.transform(
            "d.plan.storeys",
            lambda s: F.concat(*[F.coalesce(x, none) for x in (rooms(F.coalesce(s["spaces"], s["rooms"])), parts(s["slabs"]), parts(s["stairs"]))]),
        )
    )
    lists = [rooms(F.col("d.bim_data.rooms")), parts(F.col("d.bim_data.slabs")), parts(F.col("d.bim_data.stairs")), rooms(F.col("d.rooms")), parts(F.col("d.slabs")), parts(F.col("d.stairs")), nodes, parts(F.col("d.ifc.slabs")), parts(F.col("d.ifc.stairs")), storeys]
    all_ = F.concat(*[F.coalesce(x, none) for x in lists])
    doc = doc.select("rec_id", all_.alias("all"))
    texts = F.transform("all", lambda p: F.struct(p["key"].alias("key"), _corner_text(p["polygon"]).alias("corners"), p["windows"].alias("windows")))
    doc = doc.select("rec_id", texts.alias("all"))
    typed = F.transform("all", lambda p: F.struct(p["key"].alias("key"), _points(p["corners"]).alias("points"), _listed(p["windows"], windows).alias("windows")))
    return doc.select("rec_id", typed.alias("parents"))


def _open_corners(p: np.ndarray, corners: pa.Array, place: np.ndarray, parents: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Which corners count (not a last one equal to the first), and their coordinates."""
    x, y = (pc.struct_field(corners, k).to_numpy(zero_copy_only=False) for k in "xy")
    n = np.bincount(p, minlength=parents)
    first = np.flatnonzero(place == 0)
    last = first + n[p[first]] - 1
    keep = np.ones(len(p), bool)
    keep[last[(n[p[first]] > 1) & (x[first] == x[last]) & (y[first] == y[last])]] = False
    return keep, x, y


def window_rows(exports: DataFrame, id_col: str = "export_id", column: str = "payload") -> DataFrame:
    """(rec_id, parent_key, place, child_key, width, height, sill_height): the windows of each room with their values; all but the keys may be null."""

    def over(batches):
        for batch in batches:
            owner, parents, _ = children(batch.column(1))
            if not len(parents):
                continue
            p, windows, place = children(pc.struct_field(parents, "windows"))
            if not len(windows):
                continue
            values = [pc.struct_field(windows, k) for k in ("id", "width", "height", "sill_height")]
            out = pa.record_batch([batch.column(0).take(pa.array(owner[p])), pc.struct_field(parents, "key").take(pa.array(p)), pa.array(place), *values], names=["rec_id", "parent_key", "place", "child_key", "width", "height", "sill_height"])
            yield out.filter(pc.and_(pc.is_valid(out["parent_key"]), pc.is_valid(out["child_key"])))

    return plan_elements(exports, id_col, column, _WINDOWS).mapInArrow(over, "rec_id long, parent_key string, place long, child_key string, width double, height double, sill_height double").distinct()


def vertex_rows(exports: DataFrame, id_col: str = "export_id", column: str = "payload") -> DataFrame:
    """(rec_id, parent_key, place, x, y): the corners of each room, slab and stair; a last one equal to the first is left out."""

    def over(batches):
        for batch in batches:
            owner, parents, _ = children(batch.column(1))
            if not len(parents):
                continue
            p, corners, place = children(pc.struct_field(parents, "points"))
            if not len(corners):
                continue
            keep, x, y = _open_corners(p, corners, place, len(parents))
            at = np.flatnonzero(keep)
            own = p[at]
            out = pa.record_batch([batch.column(0).take(pa.array(owner[own])), pc.struct_field(parents, "key").take(pa.array(own)), pa.array(place[at]), pa.array(x[at], from_pandas=True), pa.array(y[at], from_pandas=True)], names=["rec_id", "parent_key", "place", "x", "y"])
            yield out.filter(pc.is_valid(out["parent_key"]))

    return plan_elements(exports, id_col, column).mapInArrow(over, "rec_id long, parent_key string, place long, x double, y double").distinct()


VALUES = ("subject", "relation", "object", "property", "comparator", "value", "unit")


def entity_rows(clauses: DataFrame, id_col: str = "clause_id", column: str = "entities") -> DataFrame:
    """(rec_id, place, subject ... unit): the entities of each clause with their members as text; what is no text or number is JSON."""
    base = clauses.select(F.col(id_col).cast("long").alias("rec_id"), F.col(column).alias("_e")).where("rec_id is not null and _e is not null")
    base = with_entity_texts(base, "_e", "texts").where("texts is not null")
    schema = ", ".join(f"{v} string" for v in VALUES)
    member = F.transform("texts", lambda e: F.struct(F.coalesce(e.startswith("{"), F.lit(False)).alias("is_object"), F.when(e.startswith("{"), F.from_json(e, schema)).alias("v")))

    def over(batches):
        for batch in batches:
            parent, members, place = children(batch.column(1))
            if not len(members):
                continue
            at = pa.array(np.flatnonzero(pc.struct_field(members, "is_object").to_numpy(zero_copy_only=False).astype(bool)))
            values = pc.struct_field(members, "v")
            yield pa.record_batch([batch.column(0).take(pa.array(parent).take(at)), pa.array(place).take(at), *(pc.struct_field(values, v).take(at) for v in VALUES)], names=["rec_id", "place", *VALUES])

    return base.select("rec_id", member.alias("members")).mapInArrow(over, f"rec_id long, place long, {schema}")


def plan_tables(exports: DataFrame, id_col: str = "export_id", column: str = "payload") -> DataFrame:
    """Rows of kind window and vertex: the windows of each room, the corners of each room, slab and stair."""

    def over(batches):
        for batch in batches:
            rec = batch.column(0)
            owner, parents, _ = children(batch.column(1))
            if not len(parents):
                continue
            keys = pc.struct_field(parents, "key")
            p, windows, _ = children(pc.struct_field(parents, "windows"))
            if len(windows):
                yield _distinct("window", rec.take(pa.array(owner[p])), keys.take(pa.array(p)), pc.struct_field(windows, "id"))
            p, corners, place = children(pc.struct_field(parents, "points"))
            if not len(corners):
                continue
            keep, _, _ = _open_corners(p, corners, place, len(parents))
            yield _distinct("vertex", rec.take(pa.array(owner[p[keep]])), keys.take(pa.array(p[keep])), _text(place[keep]))

    return plan_elements(exports, id_col, column).mapInArrow(over, SCHEMA)
