"""Unit strings to dimension and factor, by dynamic programming over a trie of unit parts.

A unit is segmented into area words, prefixes, a root and exponents.  All
segmentations that the order of parts allows are scored: longer parts score
more, and the dimension the field is expected to have adds a prior, which
settles ambiguous ones.  Lengths come out in mm, areas in mm².
"""

from __future__ import annotations

import math
import re
import unicodedata
from functools import lru_cache

# Prefixes, and the size in mm of a metre and of other lengths, in mm² of areas that have a name of their own, by their written forms.
PREFIXES = {
    "n": 1e-9, "nano": 1e-9, "نانو": 1e-9, "µ": 1e-6, "μ": 1e-6, "u": 1e-6, "micro": 1e-6, "میکرو": 1e-6, "m": 1e-3, "milli": 1e-3, "mili": 1e-3, "میلی": 1e-3, "c": 1e-2, "centi": 1e-2, "سانتی": 1e-2,
    "d": 1e-1, "deci": 1e-1, "دسی": 1e-1, "da": 1e1, "deca": 1e1, "h": 1e2, "hecto": 1e2, "k": 1e3, "kilo": 1e3, "کیلو": 1e3,
}
METRES = {"m": 1e3, "metre": 1e3, "metres": 1e3, "meter": 1e3, "meters": 1e3, "متر": 1e3}
IMPERIAL = {
    "ft": 304.8, "foot": 304.8, "feet": 304.8, "فوت": 304.8, "'": 304.8, "in": 25.4, "inch": 25.4, "inches": 25.4, "اینچ": 25.4, '"': 25.4, "yd": 914.4, "yds": 914.4, "yard": 914.4, "yards": 914.4, "یارد": 914.4,
    "mi": 1609344.0, "mile": 1609344.0, "miles": 1609344.0, "مایل": 1609344.0, "thou": 0.0254, "micron": 1e-3, "microns": 1e-3, "میکرون": 1e-3,
}
AREAS = {"ha": 1e10, "hectare": 1e10, "hectares": 1e10, "هکتار": 1e10, "acre": 4046856422.4, "acres": 4046856422.4, "ares": 1e8}
SQUARES = {"sq", "square", "squared", "2", "^2", "**2", "مربع"}
# Words after which "in" is a preposition, not an inch.
AFTER_IN = {"a", "an", "the", "each", "every", "any", "all", "both", "some", "no", "this", "that", "these", "those", "its", "their", "total", "case", "front", "which", "one", "addition", "accordance", "place", "order"}
# Units that are neither lengths nor areas.
OTHERS = {"%", "percent", "pct", "درصد", "ratio", "نسبت", "count", "تعداد", "person", "persons", "people", "نفر", "lux", "lx", "لوکس", "db", "dba", "decibel", "decibels", "دسیبل", "min", "minute", "minutes", "دقیقه", "hour", "hours", "ساعت", "day", "days", "روز", "degree", "degrees", "درجه", "kg", "kn", "kpa", "n", "w", "m3", "مترمکعب", "storeys", "units", "واحد", "طبقه", "times", "بار"}

LENGTH, AREA, OTHER = "length", "area", "other"


def folded(text: str) -> str:
    """Compatibility form, lower case, Persian letters, without characters that show nothing."""
    t = unicodedata.normalize("NFKC", text).casefold()
    t = t.translate({0x64A: 0x6CC, 0x649: 0x6CC, 0x643: 0x6A9})
    return "".join(c for c in t if unicodedata.category(c) != "Cf")


def folded_digits(text: str) -> str:
    """Digits of any script as 0-9."""
    return "".join(str(unicodedata.digit(c)) if c.isdigit() and not c.isascii() and unicodedata.digit(c, None) is not None else c for c in text)


def _trie() -> dict:
    root: dict = {}
    parts = [(t, ("prefix", f)) for t, f in PREFIXES.items()]
    parts += [(t, ("metre", f)) for t, f in METRES.items()] + [(t, ("imperial", f)) for t, f in IMPERIAL.items()]
    parts += [(t, ("area", f)) for t, f in AREAS.items()]
    parts += [(t, ("square", 2.0)) for t in SQUARES] + [(t, ("other", 1.0)) for t in OTHERS]
    for text, meaning in parts:
        node = root
        for c in text:
            node = node.setdefault(c, {})
        node.setdefault("", []).append(meaning)
    return root


_TRIE = _trie()
# Which part may follow which; a root or an exponent may end the unit, as may another unit.
_NEXT = {
    "start": {"square", "prefix", "metre", "imperial", "area", "other"},
    "square": {"prefix", "metre", "imperial"},
    "prefix": {"metre"},
    "metre": {"exponent"},
    "imperial": {"exponent"},
    "area": set(),
    "exponent": set(),
    "other": set(),
}
_SEPARATORS = " ./·-"


def _best(states: dict, expected: str | None) -> tuple[str, float] | None:
    """The best whole unit among the states of a place."""
    found = []
    for state, (score, factor, power) in states.items():
        if state in ("metre", "imperial", "exponent"):
            dimension = AREA if power == 2 else LENGTH
            found.append((score + (1.0 if dimension == expected else 0.0), dimension, factor**power))
        elif state == "area":
            found.append((score + (1.0 if expected == AREA else 0.0), AREA, factor))
        elif state == "other":
            found.append((score, OTHER, 1.0))
    if not found:
        return None
    _, dimension, factor = max(found)
    return dimension, float(f"{factor:.12g}")


def _walk(s: str):
    """(place, states) of each place of a text that segmentations from its beginning reach, in order; state -> (score, factor, power).

    A place is reached from before it, so the walk ends where no segmentation goes on, however long the text is.
    """
    ahead: dict[int, dict] = {0: {"start": (0.0, 1.0, 1)}}
    i = 0
    while ahead:
        i = min(ahead)
        states = ahead.pop(i)
        yield i, states
        if i == len(s):
            continue
        if s[i] in _SEPARATORS and i:
            into = ahead.setdefault(i + 1, {})
            for state, v in states.items():
                if v[0] > into.get(state, (-math.inf,))[0]:
                    into[state] = v
        node = _TRIE
        for j in range(i, len(s)):
            node = node.get(s[j])
            if node is None:
                break
            for part, factor in node.get("", ()):
                for state, (score, f, power) in states.items():
                    to = "exponent" if part == "square" and state in ("metre", "imperial") else part
                    if to not in _NEXT[state]:
                        continue
                    v = (score + math.log1p(j - i + 1) - 0.5, f if part == "square" else f * factor, 2 if part == "square" else power)
                    into = ahead.setdefault(j + 1, {})
                    if v[0] > into.get(to, (-math.inf,))[0]:
                        into[to] = v


def _parsed(text: str, expected: str | None) -> tuple[str, float] | None:
    s = folded_digits(folded(text)).strip().strip(".").strip()
    for place, states in _walk(s) if s else ():
        if place == len(s):
            return _best(states, expected)
    return None


_remembered = lru_cache(maxsize=65536)(_parsed)


def parse_unit(text: str, expected: str | None = None) -> tuple[str, float] | None:
    """(dimension, factor to mm or mm²) of a unit string; None if it is no unit. expected: the field's likely dimension."""
    # Long texts are no units worth remembering; they are read all the same.
    return (_remembered if len(text) <= 64 else _parsed)(text, expected)


def unit_at(text: str, expected: str | None = None) -> tuple[str, float] | None:
    """The longest unit that text (folded) begins with and that ends at a word's end."""
    t = text.lstrip()
    found, stop = None, 0
    for place, states in _walk(t):
        if place and t[place - 1] not in _SEPARATORS and not (place < len(t) and t[place].isalnum() and t[place - 1].isalnum()):
            got = _best(states, expected)
            if got:
                found, stop = got, place
    if found and t[:stop] == "in":
        word = re.match(r"\s+([a-z]+)", t[stop:])
        if word and word[1] in AFTER_IN:
            return None
    return found
