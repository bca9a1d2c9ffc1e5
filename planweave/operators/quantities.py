"""Lengths and areas written in many units, as whole mm and mm².

Numbers are read as they are typed: with a decimal point or comma, with groups
of three digits set off by commas, apostrophes, blanks or points, in digits of
any script.  A comma before exactly three digits sets off a group, unless the
number begins with 0.

Defined results: null values, values in other units and values with no unit
anywhere have no row; halves round up; repeated rows are kept apart by their ids.
A value's own unit comes first, then the unit column, then the text beside it.
Numbers and units are read once per distinct text of a batch; only prose that
has to tell a unit is read row by row.
"""

from __future__ import annotations

import json
import math
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from planweave.functions.units import AREA, LENGTH, OTHER, folded, folded_digits, parse_unit, unit_at
from planweave.operators.entities import with_entity_texts

SCHEMA = "src string, rec_id long, pos long, what string, amount long"
_PLAIN = r"\d+(?:[.,٫]\d+)?"
_GROUPED = r"[1-9]\d{0,2}(?:(?:[,٬'’]\d{3})+(?:[.٫]\d+)?|(?:\.\d{3})+,\d+|(?:\.\d{3}){2,})(?!\d|[.,]\d)"
_SPACED = r"[1-9]\d{0,2}(?: \d{3})+(?:[.,٫]\d+)?(?!\d)"
_POWER = r"(?:e[-+]?\d+)?"
# In prose two numbers may follow one another, so a blank sets off no group there.
_IN_TEXT = rf"[-+]?(?:{_GROUPED}|{_PLAIN}){_POWER}"
_ALONE = rf"[-+]?(?:{_GROUPED}|{_SPACED}|{_PLAIN}){_POWER}"
_NUMBER = re.compile(rf"(?<![\w.,\-]){_IN_TEXT}", re.I)
_LOOSE = re.compile(rf"^[^\d]*?({_ALONE})\s*(.*?)\s*$", re.I | re.S)
_RANGE = re.compile(rf"^(?P<lead>[^\d]*?)(?P<lo>{_ALONE})\s*(?P<u1>[^\d]*?)\s*(?P<to>-|–|—|to|and|تا|و|\.\.)\s*(?P<hi>{_ALONE})\s*(?P<u2>.*?)\s*$", re.I | re.S)
# Words beside a number that tell whether it is what was found or what is asked for.
FOUND = ["measured", "found", "actual", "value", "has", "اندازهگیری", "موجود"]
ASKED = ["required", "requires", "demanded", "demands", "limit", "allowed", "needed", "needs", "minimum", "maximum", "must", "permitted", "لازم", "مجاز", "حداقل", "حداکثر", "باید"]
BETWEEN = ["between", "from", "range", "بین", "از"]
_ROLE = re.compile("|".join(FOUND + ASKED))


def number(text: str) -> float:
    t = re.sub(r"[ ٬'’]", "", text.lower()).replace("٫", ".")
    head, power, tail = t.partition("e")
    comma, point = head.rfind(","), head.rfind(".")
    if comma >= 0 and point >= 0:
        # The later one is the decimal mark.
        head = head.replace(",", "") if point > comma else head.replace(".", "").replace(",", ".")
    elif head.count(",") > 1 or re.fullmatch(r"[-+]?[1-9]\d{0,2},\d{3}", head):
        head = head.replace(",", "")
    elif head.count(".") > 1:
        head = head.replace(".", "")
    return float(head.replace(",", ".") + power + tail)


def whole(value: float, factor: float) -> int:
    """Value in the common unit, halves up; binary noise below a millionth does not count."""
    return math.floor(round(value * factor, 6) + 0.5)


def valued(value) -> list[tuple[str, float, str]]:
    """(what, number, unit text) of a value as it stands in JSON: a number, a text with or without unit, or a range."""
    if isinstance(value, bool) or value is None:
        return []
    if isinstance(value, (int, float)):
        return [("value", float(value), "")] if math.isfinite(value) else []
    if isinstance(value, str):
        t = folded_digits(folded(value))
        m = _RANGE.match(t)
        if m and (m["to"] not in ("and", "و") or any(w in m["lead"] for w in BETWEEN)):
            unit = m["u2"] or m["u1"]
            return [("lo", number(m["lo"]), m["u1"] or unit), ("hi", number(m["hi"]), unit)]
        m = _LOOSE.match(t)
        return [("value", number(m[1]), m[2])] if m else []
    if isinstance(value, dict):
        pairs = [(k, value.get(k)) for k in ("lo", "hi")]
    elif isinstance(value, list):
        pairs = list(zip(("lo", "hi"), value))
    else:
        return []
    out = [(k, got[0][1], got[0][2]) for k, v in pairs if (got := valued(v)) and got[0][0] == "value"]
    units = [u for _, _, u in out if u]
    return [(k, v, u or (units[0] if units else "")) for k, v, u in out]


def mentions(text: str, expected: str | None) -> list[tuple[float, tuple[str, float], str]]:
    """(number, unit, role) of each number of a text that has a unit, its own or that of the number its range ends with, in order.

    role: "asked" or "found" by the words beside the number, "" if none tells it.  Words stand before their numbers,
    unless the last of them follows the last number: then each number has the word after it.
    """
    t = folded_digits(folded(text))
    found, pending = [], []
    numbers = list(_NUMBER.finditer(t))
    if not numbers:
        return []
    roles = [(m.start(), "found" if m[0] in FOUND else "asked") for m in _ROLE.finditer(t)]
    after = bool(roles) and roles[-1][0] > numbers[-1].start()

    def role(k: int) -> str:
        low, high = numbers[k].start(), numbers[k].end()
        if after:
            end = numbers[k + 1].start() if k + 1 < len(numbers) else len(t)
            return next((r for p, r in roles if high <= p < end), "")
        return next((r for p, r in reversed(roles) if p < low), "")

    goes_on = 0
    for k, m in enumerate(numbers):
        if m.start() != goes_on:
            pending = []
        unit = unit_at(t[m.end() :], expected)
        if unit:
            found += [(v, unit, r) for v, r in pending] + [(number(m[0]), unit, role(k))]
            pending = []
        elif more := re.match(r"\s*(?:to|and|تا|و|-|–)\s*(?=\d)", t[m.end() :]):
            pending.append((number(m[0]), role(k)))
            goes_on = m.end() + more.end()
        else:
            pending = []
    return found


def text_unit(value: float, found, role: str | None = None) -> tuple[str, float] | None:
    """The unit a text gives to a number: of equal numbers the first or, if a role is told, the one of that role, else the first without a role, else the first."""
    same = [(u, r) for v, u, r in found if abs(v - value) <= 1e-9 * max(1.0, abs(value))]
    if role is None:
        return same[0][0] if same else None
    return next((u for u, r in same if r == role), next((u for u, r in same if not r), same[0][0] if same else None))


def _rows(src: str, rec, pos, what, amount) -> pa.RecordBatch:
    return pa.record_batch([pa.array([src] * len(rec), pa.string()), pa.array(rec, pa.int64()), pa.array(pos, pa.int64()), pa.array(what, pa.string()), pa.array(amount, pa.int64())], names=["src", "rec_id", "pos", "what", "amount"])


def _wholes(values: np.ndarray, factors: np.ndarray) -> np.ndarray:
    return np.floor(np.round(values * factors, 6) + 0.5).astype(np.int64)


def _coded(column) -> tuple[np.ndarray, list]:
    """Place of each value among the distinct ones (the last for null), and these with None at the end."""
    d = column.dictionary_encode()
    values = d.dictionary.to_pylist() + [None]
    code = np.nan_to_num(d.indices.to_numpy(zero_copy_only=False).astype(float), nan=len(values) - 1).astype(np.int64)
    return code, values


def _parsed_values(raw) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, list]:
    """(row, what, number, own, units): the values of each text, what being 0 for value, 1 for lo, 2 for hi, own the place of its unit text.

    Plain numbers are cast as a whole; of the other texts each distinct one is read once.
    """
    plain = pc.match_substring_regex(raw, r"^-?[0-9]{1,15}(\.[0-9]+)?$").to_numpy(zero_copy_only=False).astype(bool)
    at = np.flatnonzero(plain)
    values = pc.cast(raw.take(pa.array(at)), pa.float64()).to_numpy(zero_copy_only=False)
    rest = np.flatnonzero(~plain)
    code, texts = _coded(raw.take(pa.array(rest)))
    units, place = [""], {"": 0}
    n, parts = np.zeros(len(texts), np.int64), ([], [], [])
    for k, text in enumerate(texts):
        if text is None:
            continue
        try:
            value = json.loads(text) if text[:1] in "[{" else text
        except ValueError:
            continue
        for what, v, own in valued(value):
            n[k] += 1
            if own not in place:
                place[own] = len(units)
                units.append(own)
            own = place[own]
            for part, x in zip(parts, (("value", "lo", "hi").index(what), v, own)):
                part.append(x)
    first = np.cumsum(n) - n
    per = n[code]
    row = np.repeat(np.arange(len(rest)), per)
    j = np.repeat(first[code], per) + np.arange(len(row)) - np.repeat(np.cumsum(per) - per, per)
    what, number_, own = (np.array(p, t)[j] if len(j) else np.zeros(0, t) for p, t in zip(parts, (np.int64, float, np.int64)))
    zero = np.zeros(len(at), np.int64)
    return np.concatenate([at, rest[row]]), np.concatenate([zero, what]), np.concatenate([values, number_]), np.concatenate([zero, own]), units


def clause_quantities(clauses: DataFrame, id_col: str = "clause_id", column: str = "entities", texts: tuple[str, ...] = ("text_en", "text_fa")) -> DataFrame:
    """Quantities of the entities of clauses; the clause texts tell the unit of an entity that is alone."""
    base = clauses.select(F.col(id_col).cast("long").alias("rec_id"), F.col(column).alias("_e"), *[F.col(c).alias(f"t{k}") for k, c in enumerate(texts)]).where("_e is not null and rec_id is not null")
    base = with_entity_texts(base, "_e", "m").where("m is not null")
    alone = F.size(F.filter("m", lambda x: x.startswith("{"))) == 1
    rows = base.select("rec_id", *[F.when(alone, F.col(f"t{k}")).alias(f"t{k}") for k in range(len(texts))], F.posexplode("m").alias("pos", "e")).where("e like '{%'")
    typed = rows.select("rec_id", "pos", F.from_json("e", "value string, unit string, property string").alias("v"), F.get_json_object("e", "$.value").alias("raw"), *[f"t{k}" for k in range(len(texts))])
    # A text value and a number look alike once they are text; both are read the same way.
    typed = typed.where("raw is not null").select("rec_id", "pos", "raw", "v.unit", "v.property", *[f"t{k}" for k in range(len(texts))])

    def over(batches):
        for batch in batches:
            row, what, value, own, owns = _parsed_values(batch.column(2))
            unit_code, units = _coded(batch.column(3))
            prop_code, props = _coded(batch.column(4))
            expected = [AREA if p == "area" else LENGTH if p else None for p in props]
            # Each distinct combination of own unit, unit column and property is judged once.
            key = (own * len(units) + unit_code[row]) * len(props) + prop_code[row]
            distinct, back = np.unique(key, return_inverse=True)
            judged = []
            for k in distinct.tolist():
                own_text, unit_text, kind = owns[k // len(props) // len(units)], units[k // len(props) % len(units)], expected[k % len(props)]
                u = (parse_unit(own_text, kind) or unit_at(own_text, kind)) if own_text else None
                judged.append(u or parse_unit(unit_text or "", kind))
            factor = np.array([u[1] if u and u[0] != OTHER else np.nan for u in judged])[back] if len(judged) else np.zeros(0)
            silent = np.flatnonzero(np.array([u is None for u in judged], bool)[back]) if len(judged) else np.zeros(0, np.int64)
            read: dict = {}
            for k in silent.tolist():
                r = int(row[k])
                if r not in read:
                    beside = [batch.column(c)[r].as_py() for c in range(5, batch.num_columns)]
                    read[r] = [x for t in beside if t for x in mentions(t, expected[prop_code[r]])]
                u = text_unit(value[k], read[r])
                if u and u[0] != OTHER:
                    factor[k] = u[1]
            keep = np.flatnonzero(np.isfinite(factor) & np.isfinite(value))
            names = pa.array(["value", "lo", "hi"]).take(pa.array(what[keep]))
            yield _rows("clause", batch.column(0).take(pa.array(row[keep])), batch.column(1).take(pa.array(row[keep])).cast(pa.int64()), names, _wholes(value[keep], factor[keep]))

    return typed.mapInArrow(over, SCHEMA)


def finding_quantities(findings: DataFrame, id_col: str = "finding_id") -> DataFrame:
    """Quantities of checker findings: measured and the bounds required, in the unit column's or the message's unit."""
    rows = findings.select(F.col(id_col).cast("long").alias("rec_id"), F.col("measured"), F.col("required.lo").alias("lo"), F.col("required.hi").alias("hi"), "unit", "message").where(
        "rec_id is not null and (measured is not null or lo is not null or hi is not null)"
    )

    def over(batches):
        for batch in batches:
            code, units = _coded(batch.column(4))
            known = [parse_unit(u or "") for u in units]
            factor = np.array([k[1] if k and k[0] != OTHER else np.nan for k in known])[code]
            silent = np.flatnonzero(np.array([k is None for k in known])[code])
            rec = batch.column(0).to_numpy()
            values = {k: batch.column(c).to_numpy(zero_copy_only=False).astype(float) for k, c in (("measured", 1), ("lo", 2), ("hi", 3))}
            own = {k: factor.copy() for k in values}
            for k, message in zip(silent.tolist(), batch.column(5).take(pa.array(silent)).to_pylist()):
                found = mentions(message, None) if message else []
                for what, v in values.items():
                    u = text_unit(v[k], found, "found" if what == "measured" else "asked") if found and math.isfinite(v[k]) else None
                    if u and u[0] != OTHER:
                        own[what][k] = u[1]
            for what, v in values.items():
                at = np.flatnonzero(np.isfinite(v) & np.isfinite(own[what]))
                yield _rows("finding", rec[at], np.zeros(len(at), np.int64), np.full(len(at), what), _wholes(v[at], own[what][at]))

    return rows.mapInArrow(over, SCHEMA)
