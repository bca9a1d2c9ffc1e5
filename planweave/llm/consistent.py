"""One consistent form for texts that look alike (Arrow in, Arrow out, numpy inside).

A batch of strings becomes one array of code points plus row offsets.  Every
step works on the whole array: lookup-table gathers map each code point to its
consistent expansion, offsets are rebuilt from expansion lengths, combining
marks are put in canonical order by odd-even transpositions and composed with
a sorted pair table.  No Python string function is called per row.

Defined results: null stays null; an empty or invisible-only text becomes the
empty string; rows are independent of each other and of their batch.
"""

from __future__ import annotations

import unicodedata

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

ZWNJ = 0x200C
_SIZE = 0x110000

# Letters of other scripts drawn like Latin ones.
LOOKALIKES = {
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O",
    "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X", "ο": "o", "ν": "v", "ϲ": "c", "ϳ": "j",
    "А": "A", "В": "B", "Е": "E", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T",
    "Х": "X", "У": "Y", "І": "I", "Ј": "J", "Ѕ": "S", "Ү": "Y", "Ԁ": "D", "Ԛ": "Q", "Ԝ": "W",
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ј": "j", "ѕ": "s",
    "һ": "h", "ԁ": "d", "ԛ": "q", "ԝ": "w", "ɡ": "g", "ɑ": "a", "ı": "ı",
    "α": "a", "ι": "i", "ρ": "p", "υ": "u", "γ": "y", "Ϲ": "C", "Ϳ": "J", "ѵ": "v", "ӏ": "l", "Ӏ": "l", "Ь": "b", "ҽ": "e", "ү": "y",
    "Տ": "S", "Ս": "U", "Օ": "O", "Լ": "L", "ո": "n", "ս": "u", "օ": "o", "հ": "h", "ց": "g", "զ": "q", "ա": "w", "յ": "j",
    "Ꭺ": "A", "Ᏼ": "B", "Ꮯ": "C", "Ꭰ": "D", "Ꭼ": "E", "Ꮐ": "G", "Ꮋ": "H", "Ꭻ": "J", "Ꮶ": "K", "Ꮮ": "L", "Ꮇ": "M", "Ꮲ": "P",
    "Ꭱ": "R", "Ꮪ": "S", "Ꭲ": "T", "Ꮩ": "V", "Ꮃ": "W", "Ꮓ": "Z",
}
# Arabic and Persian forms of one letter.
ARABIC_FORMS = {
    "ي": "ی", "ى": "ی", "ۍ": "ی", "ې": "ی", "ك": "ک", "ڪ": "ک", "ہ": "ه", "ە": "ه", "ھ": "ه", "ۂ": "ۀ", "ۃ": "ة",
}
# Marks that complete a Persian letter whose Arabic form has a composed character.
EXTRA_COMPOSITIONS = {("ی", "ٔ"): "ئ", ("ه", "ٔ"): "ۀ"}
# Kinds of compatibility decomposition that keep the look.
SAME_LOOK = {"<wide>", "<narrow>", "<isolated>", "<initial>", "<medial>", "<final>", "<noBreak>", "<compat>", "<font>"}
# Characters outside category Cf that show nothing, and the Arabic stretch mark.
INVISIBLE = {0x034F, 0x115F, 0x1160, 0x17B4, 0x17B5, 0x3164, 0xFFA0, 0x0640, *range(0x180B, 0x1810), *range(0xFE00, 0xFE10)}
CONTROL_BLANKS = {0x09, 0x0A, 0x0B, 0x0C, 0x0D, 0x85, 0x2028, 0x2029}
MINUS = {0x2212, 0x2043, 0x02D7}


def _decompose(ch: str) -> str:
    """Canonical and same-look compatibility decomposition, applied to the end."""
    parts = unicodedata.decomposition(ch).split()
    if not parts:
        if 0xAC00 <= ord(ch) <= 0xD7A3:
            return unicodedata.normalize("NFD", ch)
        return ch
    if parts[0].startswith("<"):
        if parts[0] not in SAME_LOOK:
            return ch
        parts = parts[1:]
    return "".join(_decompose(chr(int(p, 16))) for p in parts)


def expand(cp: int) -> tuple[int, ...]:
    """The code points that stand for one code point in the consistent form, marks apart."""
    if cp == ZWNJ:
        return (cp,)
    ch = chr(cp)
    kind = unicodedata.category(ch)
    if kind == "Zs" or cp in CONTROL_BLANKS:
        return (0x20,)
    if kind == "Cf" or kind == "Cc" or cp in INVISIBLE:
        return ()
    if kind == "Pd" or cp in MINUS:
        return (0x2D,)
    if kind == "Cs":
        return (0xFFFD,)
    out: list[int] = []
    for c in _decompose(ch):
        k = unicodedata.category(c)
        if k == "Zs":
            out.append(0x20)
            continue
        if k == "Cf" or ord(c) in INVISIBLE:
            continue
        c = ARABIC_FORMS.get(c, LOOKALIKES.get(c, c))
        if 0x0660 <= ord(c) <= 0x0669:
            c = chr(ord(c) + 0x90)
        out.extend(map(ord, c))
    return tuple(out)


class _Tables:
    """Lookup tables over all code points, filled for a code point when it is first met."""

    def __init__(self) -> None:
        self.known = np.zeros(_SIZE, bool)
        self.start = np.zeros(_SIZE, np.int32)
        self.length = np.zeros(_SIZE, np.int8)
        self.ccc = np.zeros(_SIZE, np.uint8)
        self.letter = np.zeros(_SIZE, bool)
        self.word = np.zeros(_SIZE, bool)
        self.lower = np.arange(_SIZE, dtype=np.int32)
        self.flat = np.zeros(0, np.int32)
        pairs = {}
        for cp in range(0xC0, 0x30000):
            d = unicodedata.decomposition(chr(cp))
            if d and d[0] != "<" and " " in d:
                a, b = (int(x, 16) for x in d.split())
                if unicodedata.combining(chr(b)) and unicodedata.normalize("NFC", chr(cp)) == chr(cp):
                    pairs[a << 21 | b] = cp
        for (a, b), c in EXTRA_COMPOSITIONS.items():
            pairs[ord(a) << 21 | ord(b)] = ord(c)
        self.pair_keys = np.array(sorted(pairs), np.int64)
        self.pair_values = np.array([pairs[k] for k in sorted(pairs)], np.int32)
        self._learn(sorted(set(map(int, self.pair_values))))

    def _learn(self, cps) -> None:
        more, at = [], len(self.flat)
        for cp in cps:
            if self.known[cp]:
                continue
            e = expand(cp)
            self.known[cp], self.start[cp], self.length[cp] = True, at, len(e)
            more.extend(e)
            at += len(e)
            for c in (cp, *e):
                ch = chr(c)
                kind = unicodedata.category(ch)
                self.ccc[c] = unicodedata.combining(ch)
                self.letter[c] = kind[0] in "LM"
                self.word[c] = kind[0] in "LMN" or c == ZWNJ
                low = ch.casefold()
                self.lower[c] = ord(low) if len(low) == 1 else ord(ch.lower()[0])
        self.flat = np.concatenate([self.flat, np.array(more, np.int32)])

    def learn(self, cps: np.ndarray) -> None:
        unknown = ~self.known[cps]
        if unknown.any():
            self._learn(np.unique(cps[unknown]).tolist())


_tables: _Tables | None = None


def tables() -> _Tables:
    global _tables
    if _tables is None:
        _tables = _Tables()
    return _tables


def code_points(arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All code points of a string array and the offset of each row in them; null counts as empty."""
    if isinstance(arr, pa.ChunkedArray):
        arr = arr.combine_chunks() if arr.num_chunks != 1 else arr.chunk(0)
    arr = arr.cast(pa.large_string())
    if arr.null_count:
        arr = arr.fill_null("")
    n = len(arr)
    if n == 0:
        return np.zeros(0, np.int32), np.zeros(1, np.int64)
    _, offsets, data = arr.buffers()
    off = np.frombuffer(offsets, np.int64)[arr.offset : arr.offset + n + 1]
    raw = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None else np.zeros(0, np.uint8)
    try:
        text = raw.tobytes().decode("utf-8")
    except UnicodeDecodeError:
        rows = [raw[a - off[0] : b - off[0]].tobytes().decode("utf-8", "replace") for a, b in zip(off[:-1], off[1:])]
        lengths = np.array([len(x) for x in rows], np.int64)
        cps = np.frombuffer("".join(rows).encode("utf-32-le"), np.int32)
        return cps, np.concatenate([[0], np.cumsum(lengths)])
    cps = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.int32)
    starts = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])
    return cps, starts[off - off[0]]


def slices(text: pa.Array, size: int = 1 << 18):
    """(low, high) ranges of rows of about so many bytes: what is worked on then stays in a processor's cache, whatever the batch."""
    n = len(text)
    sizes = pc.fill_null(pc.binary_length(text), 0).to_numpy(zero_copy_only=False).astype(np.int64) + 16
    block = (np.cumsum(sizes) - sizes) // size
    cut = np.concatenate([np.flatnonzero(np.diff(block, prepend=-1)), [n]])
    return list(zip(cut[:-1].tolist(), cut[1:].tolist()))


def _keep(cps: np.ndarray, off: np.ndarray, keep: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if keep.all():
        return cps, off
    before = np.concatenate([[0], np.cumsum(keep)])
    return cps[keep], before[off]


def _row_starts(n: int, off: np.ndarray) -> np.ndarray:
    """True at the first position of a row; one longer than the code points."""
    s = np.zeros(n + 1, bool)
    s[off] = True
    return s


def _order_marks(cps: np.ndarray, off: np.ndarray, t: _Tables) -> np.ndarray:
    ccc = t.ccc[cps]
    if not (ccc[1:][ccc[:-1] > 0] > 0).any():
        return cps
    cps, starts = cps.copy(), _row_starts(len(cps), off)[1:-1]
    quiet, phase = 0, 0
    while quiet < 2:
        a, b = ccc[:-1], ccc[1:]
        at = np.flatnonzero((a > b) & (b > 0) & ~starts)
        at = at[at % 2 == phase]
        quiet = 0 if len(at) else quiet + 1
        cps[at], cps[at + 1] = cps[at + 1], cps[at].copy()
        ccc[at], ccc[at + 1] = ccc[at + 1], ccc[at].copy()
        phase = 1 - phase
    return cps


def _compose(cps: np.ndarray, off: np.ndarray, t: _Tables) -> tuple[np.ndarray, np.ndarray]:
    while len(cps) > 1:
        starts = _row_starts(len(cps), off)
        at = np.flatnonzero((t.ccc[cps[1:]] > 0) & (t.ccc[cps[:-1]] == 0) & ~starts[1:-1])
        if not len(at):
            break
        key = cps[at].astype(np.int64) << 21 | cps[at + 1]
        k = np.minimum(np.searchsorted(t.pair_keys, key), len(t.pair_keys) - 1)
        hit = t.pair_keys[k] == key
        if not hit.any():
            break
        cps = cps.copy()
        cps[at[hit]] = t.pair_values[k[hit]]
        keep = np.ones(len(cps), bool)
        keep[at[hit] + 1] = False
        cps, off = _keep(cps, off, keep)
    return cps, off


def consistent_points(arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Code points and row offsets of the consistent form of every row."""
    t = tables()
    cps, off = code_points(arr)
    if not len(cps):
        return cps, off
    t.learn(cps)
    length = t.length[cps]
    if (length != 1).any():
        ends = np.concatenate([[0], np.cumsum(length, dtype=np.int64)])
        total = int(ends[-1])
        within = np.arange(total, dtype=np.int64) - np.repeat(ends[:-1], length)
        cps, off = t.flat[np.repeat(t.start[cps], length) + within], ends[off]
    else:
        cps = t.flat[t.start[cps]]
    t.learn(cps)
    cps = _order_marks(cps, off, t)
    cps, off = _compose(cps, off, t)
    # Zero-width non-joiners: one between two letters, none elsewhere.
    z = cps == ZWNJ
    if z.any():
        starts = _row_starts(len(cps), off)
        double = np.zeros(len(cps), bool)
        double[1:] = z[1:] & z[:-1] & ~starts[1:-1]
        cps, off = _keep(cps, off, ~double)
        starts = _row_starts(len(cps), off)
        z, letter = cps == ZWNJ, t.letter[cps]
        before, after = np.zeros(len(cps), bool), np.zeros(len(cps), bool)
        before[1:] = letter[:-1] & ~starts[1:-1]
        after[:-1] = letter[1:] & ~starts[1:-1]
        cps, off = _keep(cps, off, ~z | (before & after))
    # Blanks: one between words, none at the ends.
    b = cps == 0x20
    if b.any():
        starts = _row_starts(len(cps), off)
        drop = np.zeros(len(cps), bool)
        drop[1:] = b[:-1]
        drop = b & (drop | starts[:-1])
        cps, off = _keep(cps, off, ~drop)
        starts = _row_starts(len(cps), off)
        cps, off = _keep(cps, off, ~((cps == 0x20) & starts[1:]))
    return cps, off


def to_arrow(cps: np.ndarray, off: np.ndarray, valid: pa.Array | None = None) -> pa.Array:
    """Strings of code points and offsets; valid: rows that are not null."""
    width = 1 + (cps >= 0x80).astype(np.int64) + (cps >= 0x800) + (cps >= 0x10000)
    ends = np.concatenate([[0], np.cumsum(width)])[off]
    data = cps.astype("<i4").tobytes().decode("utf-32-le", "replace").encode("utf-8")
    out = pa.Array.from_buffers(pa.large_string(), len(off) - 1, [None, pa.py_buffer(ends.astype(np.int64).tobytes()), pa.py_buffer(data)])
    if valid is not None and not all_true(valid):
        out = pc.if_else(valid, out, pa.scalar(None, pa.large_string()))
    return out


def all_true(valid: pa.Array) -> bool:
    return bool(pc.all(valid).as_py() in (True, None))


def consistent_array(arr: pa.Array) -> pa.Array:
    """The consistent form of every string; null stays null."""
    if isinstance(arr, pa.ChunkedArray):
        arr = arr.combine_chunks()
    if not len(arr):
        return pa.array([], pa.large_string())
    parts = [arr.slice(lo, hi - lo) for lo, hi in slices(arr)]
    return pa.concat_arrays([to_arrow(*consistent_points(p), p.is_valid()) for p in parts])


# ---------------------------------------------------------------- words


_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)
_M3 = np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser, elementwise."""
    with np.errstate(over="ignore"):
        x = x.astype(np.uint64, copy=True)
        x ^= x >> np.uint64(30)
        x *= _M2
        x ^= x >> np.uint64(27)
        x *= _M3
        x ^= x >> np.uint64(31)
    return x


def word_spans(cps: np.ndarray, off: np.ndarray, folded: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each word (letters, marks, digits, inner non-joiners) and the word offset of each row."""
    t = tables()
    w = t.word[cps]
    starts = _row_starts(len(cps), off)[:-1]
    prev = np.zeros(len(cps), bool)
    prev[1:] = w[:-1]
    begin = np.flatnonzero(w & (~prev | starts))
    last = np.zeros(len(cps), bool)
    if len(cps):
        last[-1] = True
        last[:-1] = ~w[1:] | starts[1:]
    end = np.flatnonzero(w & last) + 1
    return begin, end, np.searchsorted(begin, off)


def word_hashes(cps: np.ndarray, off: np.ndarray, digits: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of each word, without case, and the word offset of each row; digits: of all scripts alike."""
    t = tables()
    if not len(cps):
        return np.zeros(0, np.uint64), np.zeros(len(off), np.int64)
    begin, end, rows = word_spans(cps, off)
    if not len(begin):
        return np.zeros(0, np.uint64), rows
    low = t.lower[cps].astype(np.uint64)
    if digits:
        low = np.where((cps >= 0x06F0) & (cps <= 0x06F9), low - np.uint64(0x06F0 - 0x30), low)
    # Position within the word salts each code point, so the sum of the mixed values tells order.
    at = np.arange(len(cps), dtype=np.int64)
    first = np.repeat(begin, end - begin)
    keep = np.repeat(begin, end - begin) + (np.arange(len(first)) - np.repeat(np.cumsum(end - begin) - (end - begin), end - begin))
    with np.errstate(over="ignore"):
        v = mix(low[keep] + ((at[keep] - first).astype(np.uint64) + np.uint64(1)) * _M1)
        sums = np.add.reduceat(v, np.cumsum(end - begin) - (end - begin))
    return mix(sums), rows


def runs(words: np.ndarray, rows: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """A hash of each run of k consecutive words of a row, and the offset of each row among the runs."""
    n = np.diff(rows)
    per = np.maximum(n - k + 1, 0)
    ends = np.concatenate([[0], np.cumsum(per)])
    total = int(ends[-1])
    if not total:
        return np.zeros(0, np.uint64), ends
    first = np.repeat(rows[:-1], per) + (np.arange(total) - np.repeat(ends[:-1], per))
    with np.errstate(over="ignore"):
        h = np.zeros(total, np.uint64)
        for j in range(k):
            h = mix(h * _M1 + words[first + j] + np.uint64(j + 1))
    return h, ends
