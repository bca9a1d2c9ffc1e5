"""Near-duplicate texts by universe-partition pigeonhole, exact for Jaccard similarity of word runs.

Let x be the smaller of two sets with similarity of at least t.  Then at most
``lost(x)`` of its elements are missing from the other set y, so of any
``lost(x) + 1`` disjoint subsets of x one lies whole in y.  The universe of
elements is cut into m segments by hash (m by size band).  y indexes every
two-element subset of each of its segments; x probes disjoint subsets: two by
two within a segment and, for an odd rest, the one-deletion neighbourhood of a
triple (its three pairs break only when two elements are lost).  Allocation is
by cost: x takes the subsets expected to be rarest, from element counts over
all texts, a rare element with a frequent one.  It may take ``extra`` more than
needed; a partner must then hit ``extra + 1`` times.  Each text carries 128
parity bits of its elements: sets cannot differ in fewer elements than their
bits do, which drops nearly all chance hits where they meet, before
verification.  Sets too small or too unlucky for enough pairs probe single
elements.

Texts equal in their consistent form are collapsed first, so a hot group of
copies is one row in everything that follows.  Subset rows travel as packed
arrays per bucket; subsets expected in very many texts are salted.

Defined results: null texts have no links; texts with fewer words than a run
are linked only to equal texts; repeated rows are links; an empty table gives
an empty result; input columns besides id and texts are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from planweave.functions.shared import freed, partitions, stored
from planweave.llm.consistent import _M1, consistent_points, mix, runs, slices, word_hashes

BINS = 1 << 20
TINY = 8
SALT_ROWS = 16_384
NEAR = 6
#: Sizes are counted as they are below the first, above it rounded down by at most the second (and to an integer).
SIZES_EXACT, SIZE_STEP = 4096, math.exp(1 / 64)
#: Subset rows of a bucket, which one task holds packed.
BUCKET_ROWS = 4_500_000
SIG_MASK = (1 << 24) - 1


# ------------------------------------------------------------------ elements


def _unique_rows(values: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values within each row, in order of first occurrence."""
    n = len(off) - 1
    row = np.repeat(np.arange(n), np.diff(off))
    key = values.astype(np.uint64) | (row.astype(np.uint64) << np.uint64(32))
    order = np.argsort(key, kind="stable")
    key = key[order]
    keep = np.ones(len(values), bool)
    keep[order[1:][key[1:] == key[:-1]]] = False
    return values[keep], np.concatenate([[0], np.cumsum(np.bincount(row[keep], minlength=n))])


def spread(number: np.ndarray) -> np.ndarray:
    """The int that Spark's hash partitioning sends to the partition of a number, if there are more partitions than that.

    Numbers from 0 on as they are would fall together by chance, several to a task and none to others.  Spark hashes
    an int by a 32-bit finaliser that can be run backwards; the hash looked for is the number itself.
    """
    mask = 0xFFFFFFFF
    turned = lambda x, k: ((x << np.uint64(k)) | (x >> np.uint64(32 - k))) & np.uint64(mask)
    over = lambda x, c: (x * np.uint64(pow(c, -1, 1 << 32))) & np.uint64(mask)
    h = np.asarray(number).astype(np.uint64) & np.uint64(mask)
    h ^= h >> np.uint64(16)
    h = over(h, 0xC2B2AE35)
    h ^= (h >> np.uint64(13)) ^ (h >> np.uint64(26))
    h = over(h, 0x85EBCA6B)
    h ^= h >> np.uint64(16)
    h ^= np.uint64(4)
    h = over((h - np.uint64(0xE6546B64)) & np.uint64(mask), 5)
    k = turned(h, 19) ^ np.uint64(42)
    k = over(turned(over(k, 0x1B873593), 17), 0xCC9E2D51)
    return k.astype(np.uint32).view(np.int32)


def in_order(key: np.ndarray) -> np.ndarray:
    """Order of unsigned keys, stable; keys short enough are sorted with their places in one number, which is faster."""
    bits = max(1, len(key).bit_length())
    if len(key) and int(key.max()).bit_length() + bits <= 64:
        return (np.sort((key.astype(np.uint64) << np.uint64(bits)) | np.arange(len(key), dtype=np.uint64)) & np.uint64((1 << bits) - 1)).astype(np.int64)
    return np.argsort(key, kind="stable")


def _blob_array(flat: np.ndarray, off: np.ndarray) -> pa.Array:
    width = flat.dtype.itemsize
    return pa.Array.from_buffers(pa.large_binary(), len(off) - 1, [None, pa.py_buffer((off * width).astype(np.int64).tobytes()), pa.py_buffer(flat.tobytes())])


def _read_blobs(arr: pa.Array, dtype) -> tuple[np.ndarray, np.ndarray]:
    if isinstance(arr, pa.ChunkedArray):
        arr = arr.combine_chunks()
    arr = arr.cast(pa.large_binary())
    n = len(arr)
    off = np.frombuffer(arr.buffers()[1], np.int64)[arr.offset : arr.offset + n + 1]
    data = arr.buffers()[2]
    size = np.dtype(dtype).itemsize
    flat = np.frombuffer(data, np.uint8)[off[0] : off[-1]].view(dtype) if data is not None else np.zeros(0, dtype)
    return flat, (off - off[0]) // size


def element_batches(run: int):
    """Batches of (field, id, text) to (field, id, h1, h2, n, elements): distinct hashed runs of words."""

    def elements(text, f):
        """Two digests of the words of each text, the number of its distinct runs, and these."""
        words, rows = word_hashes(*consistent_points(text))
        n_words = np.diff(rows)
        with np.errstate(over="ignore"):
            at = np.arange(len(words)) - np.repeat(rows[:-1], n_words)
            salted = mix(words + at.astype(np.uint64) * _M1)
            sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(salted, dtype=np.uint64)])
            h1 = mix(sums[rows[1:]] - sums[rows[:-1]] + n_words.astype(np.uint64))
            sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(salted ^ _M1), dtype=np.uint64)])
            h2 = mix(sums[rows[1:]] - sums[rows[:-1]])
        h, ends = runs(words, rows, run)
        h = (mix(h + np.repeat(f, np.diff(ends)) * _M1) >> np.uint64(32)).astype(np.uint32)
        flat, ends = _unique_rows(h, ends)
        return h1, h2, np.diff(ends).astype(np.int32), flat

    def over(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            field, ids, text = batch.column(0), batch.column(1), batch.column(2)
            f = np.asarray(field.to_numpy(zero_copy_only=False)).astype(np.uint64)
            parts = [elements(text.slice(lo, hi - lo), f[lo:hi]) for lo, hi in slices(text)]
            h1, h2, n, flat = (np.concatenate([p[k] for p in parts]) for k in range(4))
            # Of copies within the batch only the first carries its elements.
            o = np.lexsort((h2, h1 ^ f))
            first = np.ones(len(batch), bool)
            first[1:] = ((h1 ^ f)[o[1:]] != (h1 ^ f)[o[:-1]]) | (h2[o[1:]] != h2[o[:-1]])
            carry = np.zeros(len(batch), bool)
            carry[o[first]] = True
            flat = flat[np.repeat(carry, n)]
            off2 = np.concatenate([[0], np.cumsum(np.where(carry, n, 0))])
            yield pa.record_batch(
                [field, ids, pa.array(h1.view(np.int64)), pa.array(h2.view(np.int64)), pa.array(n), _blob_array(flat, off2).cast(pa.binary())],
                names=["field", "id", "h1", "h2", "n", "elements"],
            )

    return over


_ELEMENTS = "field int, id long, h1 long, h2 long, n int, elements binary"


def _bit_table(df: DataFrame, *key: str) -> np.ndarray:
    """A filter of 4 million bits over the values of columns; its size is fixed, values that are in it are always found."""
    mixed = F.pmod(F.xxhash64(*key), F.lit(1 << 22))
    one = F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(mixed, F.lit(64)).cast("int"))
    got = df.groupBy(F.shiftright(mixed, 6).alias("word")).agg(F.bit_or(one).alias("bits")).toArrow()
    table = np.zeros(1 << 16, np.int64)
    table[got["word"].to_numpy().astype(np.int64)] = got["bits"].to_numpy()
    return table


def _sifted(df: DataFrame, key: str | list[str], shipped, inside: bool) -> DataFrame:
    """Rows whose key may be in the filter, or rows whose key is surely not in it."""

    def over(batches):
        for b in batches:
            k = b.column(b.num_columns - 1).to_numpy(zero_copy_only=False)
            hit = ((shipped.value[k >> 6] >> (k & 63)) & 1).astype(bool)
            yield b.filter(pa.array(hit if inside else ~hit))

    with_key = df.withColumn("k", F.pmod(F.xxhash64(*([key] if isinstance(key, str) else key)), F.lit(1 << 22)))
    return with_key.mapInArrow(over, with_key.schema).drop("k")


# ------------------------------------------------------------------ allocation


def lost(n: np.ndarray, t: float) -> np.ndarray:
    """Most elements that the smaller set of a pair can miss: both sets of one size is the worst case."""
    return n - np.ceil(n * (2 * t / (1 + t)) - 1e-9).astype(np.int64)


def bands(sizes: dict[int, int], t: float) -> tuple[list[int], list[int]]:
    """Lower bounds of size bands and the number of segments of each, from the counts of set sizes.

    Bands span a factor of four; of several grids the one is taken in which the fewest sets have to index for a second band.
    """
    s = np.array(sorted(sizes), np.int64)
    c = np.array([sizes[int(k)] for k in s], np.float64)
    top = int(s.max()) if len(s) else TINY

    def grid(first: float) -> list[int]:
        out, x = [1, TINY], first
        while x <= top:
            if x > TINY:
                out.append(int(x))
            x *= 4
        return out

    def doubled(g: list[int]) -> float:
        low = np.array(g)[np.searchsorted(g, s, "right") - 1]
        reach = np.ceil(s * t - 1e-9)
        below = np.searchsorted(s, low) > np.searchsorted(s, reach)
        return float((c * below).sum())

    best = min((grid(TINY * 4 ** (k / 8)) for k in range(1, 9)), key=lambda g: (doubled(g), len(g)))
    segments = []
    for k, low in enumerate(best):
        high = best[k + 1] if k + 1 < len(best) else top + 1
        inside = (s >= low) & (s < high)
        mean = float((s[inside] * c[inside]).sum() / max(1.0, c[inside].sum())) if inside.any() else low
        segments.append(max(1, round(mean * 0.35)))
    return best, segments


class Plan:
    """What the tasks know of the whole collection; of a size that does not grow with it."""

    def __init__(self, t: float, lows, segments, log_df: np.ndarray, total: int, sizes: dict[int, int], extra: int, buckets: int):
        self.t, self.lows, self.segments = t, np.array(lows, np.int64), np.array(segments, np.int64)
        self.log_df, self.total, self.extra, self.buckets = log_df, max(1, total), extra, buckets
        self.sizes = np.array(sorted(sizes), np.int64)

    def df(self, elements: np.ndarray) -> np.ndarray:
        """Expected number of texts that hold an element, from counts kept to about 6 per cent."""
        return np.exp2(self.log_df[elements & np.uint32(BINS - 1)] / 8.0)


def _subset_hash(a: np.ndarray, b: np.ndarray, band: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix(mix(a.astype(np.uint64) + _M1) + mix(b.astype(np.uint64) + _M1) + band.astype(np.uint64) * _M1)


def _segmented(plan: Plan, el: np.ndarray, row: np.ndarray, band: np.ndarray):
    """Elements ordered by (row, segment, expected count): order, place in the segment's group, size of the group, expected counts."""
    seg = (mix(el.astype(np.uint64)) % plan.segments[band].astype(np.uint64)).astype(np.uint64)
    log = plan.log_df[el & np.uint32(BINS - 1)]
    bits = max(1, int(len(el)).bit_length())
    group = row.astype(np.uint64) * np.uint64(int(plan.segments.max()) + 1) + seg
    if bits + 8 + int(group.max() if len(group) else 0).bit_length() <= 64:
        # One sort of packed numbers: group, count, index; equal counts may come in either order.
        packed = np.sort((group << np.uint64(bits + 8)) | (log.astype(np.uint64) << np.uint64(bits)) | np.arange(len(el), dtype=np.uint64))
        order = (packed & np.uint64((1 << bits) - 1)).astype(np.int64)
        key = packed >> np.uint64(bits + 8)
    else:
        order = np.lexsort((log, group))
        key = group[order]
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    size = np.diff(np.concatenate([first, [len(key)]]))
    place = np.arange(len(key)) - np.repeat(first, size)
    return order, place, np.repeat(size, size), np.exp2(log[order] / 8.0)


def probes(plan: Plan, el: np.ndarray, off: np.ndarray, n: np.ndarray):
    """(row, hash, least expected count) of each probed subset; row -> hits a partner needs; rows that lack subsets."""
    rows = np.arange(len(n))
    band_of = np.searchsorted(plan.lows, n, "right") - 1
    row = np.repeat(rows, np.diff(off))
    band = band_of[row]
    need = lost(n, plan.t) + 1
    tiny = band == 0
    single = np.flatnonzero(tiny)
    big = np.flatnonzero(~tiny)
    order, place, size, df = _segmented(plan, el[big], row[big], band[big])
    e, r, bd = el[big][order], row[big][order], band[big][order]
    # The rarest goes with the most frequent and so on inwards, so that no pair has two frequent elements.
    pair = np.flatnonzero(place < size // 2)
    mate = pair + size[pair] - 1 - 2 * place[pair]
    odd = np.flatnonzero((size % 2 == 1) & (size >= 3) & (place == size // 2))
    # Elements that stand close together come together in other texts too.
    at = big[order] - off[r]
    near = np.abs(at[pair] - at[mate]) <= NEAR
    cost = np.where(near, np.minimum(df[pair], df[mate]), df[pair] * df[mate] / plan.total)
    cost3 = df[odd]
    # Units: (row, class of cost, cost, one or two subsets).
    u_row = np.concatenate([r[pair], r[odd], row[single]])
    u_class = np.concatenate([np.zeros(len(pair)), np.ones(len(odd)), np.zeros(len(single))])
    u_cost = np.concatenate([cost, cost3, plan.df(el[single])])
    u_a = np.concatenate([pair, odd, single])
    u_kind = np.concatenate([np.zeros(len(pair), np.int8), np.ones(len(odd), np.int8), np.full(len(single), 2, np.int8)])
    have = np.bincount(u_row, minlength=len(n))
    lacking = (have < need) & (n > 0)
    want = np.where(lacking, 0, need + plan.extra)
    # Costs to about 3 per cent, in one packed number with the row.
    scaled = np.clip(np.log2(np.maximum(u_cost, 1e-6)) * 24 + 500, 0, 2047).astype(np.uint64) + (u_class.astype(np.uint64) << np.uint64(11))
    o = in_order((u_row.astype(np.uint64) << np.uint64(12)) | scaled)
    start = np.concatenate([[0], np.cumsum(have)])[:-1]
    rank = np.empty(len(o), np.int64)
    rank[o] = np.arange(len(o)) - start[u_row[o]]
    take = rank < want[u_row]
    taken = np.bincount(u_row[take], minlength=len(n))
    out = []
    p = u_a[take & (u_kind == 0)]
    m = p + size[p] - 1 - 2 * place[p]
    out.append((r[p], _subset_hash(e[p], e[m], bd[p]), np.minimum(df[p], df[m])))
    q = u_a[take & (u_kind == 1)]
    for mate in (q - 1, q + 1):
        out.append((r[q], _subset_hash(e[q], e[mate], bd[q]), np.minimum(df[q], df[mate])))
    s = u_a[take & (u_kind == 2)]
    out.append((row[s], _single_hash(el[s]), plan.df(el[s])))
    got = [np.concatenate([x[k] for x in out]) for k in range(3)]
    return got[0], got[1], got[2], np.maximum(1, taken - lost(n, plan.t)), lacking


def lacks(plan: Plan, el: np.ndarray, off: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Whether each set has too few disjoint subsets within its segments."""
    band = np.searchsorted(plan.lows, n, "right") - 1
    row = np.repeat(np.arange(len(n)), np.diff(off))
    seg = mix(el.astype(np.uint64)) % plan.segments[band[row]].astype(np.uint64)
    group, count = np.unique(row.astype(np.uint64) * np.uint64(int(plan.segments.max()) + 1) + seg, return_counts=True)
    owner = (group // np.uint64(int(plan.segments.max()) + 1)).astype(np.int64)
    have = np.bincount(owner, weights=count // 2 + ((count % 2 == 1) & (count >= 3)), minlength=len(n))
    return (np.where(band == 0, n, have) < lost(n, plan.t) + 1) & (n > 0)


def parities(el: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 parity bits of each set: sets differ in at least as many elements as their bits do."""
    bit = mix(el.astype(np.uint64) + np.uint64(0x51ED27)) >> np.uint64(57)
    one = np.uint64(1) << (bit & np.uint64(63))
    low = bit < 64
    out = []
    for half in (low, ~low):
        x = np.concatenate([np.bitwise_xor.accumulate(np.where(half, one, np.uint64(0))), np.zeros(1, np.uint64)]) if len(el) else np.zeros(1, np.uint64)
        before = np.concatenate([np.zeros(1, np.uint64), x[:-1]])
        out.append(before[off[1:]] ^ before[off[:-1]])
    return out[0], out[1]


def _single_hash(el: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix(el.astype(np.uint64) * _M1 + np.uint64(77))


def least_kept(n: np.ndarray) -> np.ndarray:
    """A bound below which no size of at least n is kept in the counts of sizes."""
    return np.where(n * SIZE_STEP > SIZES_EXACT, np.floor(n / SIZE_STEP).astype(np.int64) - 1, n)


def index(plan: Plan, el: np.ndarray, off: np.ndarray, n: np.ndarray):
    """(row, hash, least expected count) of every subset a smaller set may probe."""
    band_of = np.searchsorted(plan.lows, n, "right") - 1
    row = np.repeat(np.arange(len(n)), np.diff(off))
    reach = np.ceil(n * plan.t - 1e-9).astype(np.int64)
    out = []
    for back in range(len(plan.lows)):
        band = band_of - back
        low = plan.lows[np.maximum(band, 0)]
        high = np.where(band + 1 < len(plan.lows), plan.lows[np.minimum(np.maximum(band, 0) + 1, len(plan.lows) - 1)], np.iinfo(np.int64).max)
        ok = (band >= 0) & (high > reach)
        if not ok.any():
            break
        # A partner's size may be kept rounded down by up to one step.
        a = np.searchsorted(plan.sizes, least_kept(np.maximum(reach, low)))
        b = np.searchsorted(plan.sizes, np.minimum(n + 1, high))
        ok &= b > a
        here = np.flatnonzero(ok[row] & (band[row] > 0))
        if len(here):
            order, place, size, df = _segmented(plan, el[here], row[here], band[row][here])
            e, r, bd = el[here][order], row[here][order], band[row][here][order]
            for k in range(1, int(place.max()) + 1 if len(place) else 1):
                i = np.flatnonzero(place + k < size)
                out.append((r[i], _subset_hash(e[i], e[i + k], bd[i]), np.minimum(df[i], df[i + k])))
        here = np.flatnonzero(ok[row] & (band[row] == 0))
        if len(here):
            out.append((row[here], _single_hash(el[here]), plan.df(el[here])))
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0)
    return tuple(np.concatenate([x[k] for x in out]) for k in range(3))


def _salted(rows, hashes, least, ids, every: bool, most: int = SALT_ROWS):
    """Keys expected in more rows than ``most``, spread over salts: index rows by id, probes to each."""
    salts = np.maximum(1, np.ceil(least / most)).astype(np.int64)
    if every:
        copies = np.repeat(np.arange(len(rows)), salts)
        which = np.arange(len(copies)) - np.repeat(np.cumsum(salts) - salts, salts)
        rows, hashes = rows[copies], hashes[copies]
    else:
        which = ids[rows] % salts
    with np.errstate(over="ignore"):
        return rows, np.where(which > 0, mix(hashes + which.astype(np.uint64) * _M1), hashes)


def _packed(plan: Plan, probe, indexed, field, ids, n, bits, hits):
    """A blob per bucket: what is known of each text once, then its probes and its index rows.

    A row is 24 bits of hash besides the bucket; chance hits fall to the parities, the count and verification.
    """
    rows = [*_salted(*probe, ids, True), *_salted(*indexed, ids, False)]
    for b, p, h, q, h2 in by_bucket(rows[:2], rows[2:], plan.buckets, len(n)):
        who, at = np.unique(np.concatenate([p, q]), return_inverse=True)
        probes_, indexes = np.bincount(at[: len(p)], minlength=len(who)), np.bincount(at[len(p) :], minlength=len(who))
        yield b, pack(field[who], ids[who], n[who], probes_, indexes, hits[who], h, h2, *(x[who].view(np.int64) for x in bits))


def by_bucket(probe, indexed, buckets: int, total: int):
    """(bucket, probe rows, their hashes, index rows, their hashes) of each bucket that has any, rows in order."""
    sides = []
    for r, h in (probe, indexed):
        bucket = (h >> np.uint64(32)) % np.uint64(buckets)
        o = in_order(bucket * np.uint64(max(1, total)) + r.astype(np.uint64))
        sides.append((bucket[o].astype(np.int64), r[o], h[o] & np.uint64(SIG_MASK)))
    (b1, r1, h1), (b2, r2, h2) = sides
    present = np.union1d(b1, b2)
    cuts = [(np.searchsorted(b, present, "left"), np.searchsorted(b, present, "right")) for b in (b1, b2)]
    for k, b in enumerate(present):
        p, q = (slice(lo[k], hi[k]) for lo, hi in cuts)
        yield int(b), r1[p], h1[p], r2[q], h2[q]


def pack(*arrays: np.ndarray) -> bytes:
    """Integer arrays in as few bytes as their span allows, one after the other."""
    out = []
    for x in arrays:
        x = np.ascontiguousarray(np.asarray(x).astype(np.int64))
        low = int(x.min()) if len(x) else 0
        span = (int(x.max()) - low).bit_length() if len(x) else 0
        width = (span + 7) // 8
        with np.errstate(over="ignore"):
            raw = (x.view(np.uint64) - np.uint64(low & 0xFFFFFFFFFFFFFFFF)).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width]
        out += [np.array([len(x), low, width], np.int64).tobytes(), np.ascontiguousarray(raw.T).tobytes()]
    return b"".join(out)


def unpack(blob: bytes) -> list[np.ndarray]:
    out, at = [], 0
    while at < len(blob):
        n, low, width = (int(v) for v in np.frombuffer(blob, np.int64, 3, at))
        at += 24
        wide = np.zeros((n, 8), np.uint8)
        wide[:, :width] = np.frombuffer(blob, np.uint8, n * width, at).reshape(width, n).T
        with np.errstate(over="ignore"):
            out.append((wide.view("<u8").ravel() + np.uint64(low & 0xFFFFFFFFFFFFFFFF)).view(np.int64))
        at += n * width
    return out


def _merged(batches, rows: int = 16384, size: int = 32_000_000):
    """Batches joined to about so many rows or bytes, as packing pays by the batch."""
    kept, n, m = [], 0, 0
    for b in batches:
        kept.append(b)
        n += b.num_rows
        m += b.nbytes
        if n >= rows or m >= size:
            yield pa.Table.from_batches(kept)
            kept, n, m = [], 0, 0
    if n:
        yield pa.Table.from_batches(kept)


def signature_batches(shipped, fallback=None):
    """Batches of (field, id, n, elements) to (bucket, blob); fallback: bins of the single elements that some set needs."""

    def over(batches):
        plan: Plan = shipped.value
        needed = fallback.value if fallback is not None else None
        for table in _merged(batches):
            field = table.column(0).to_numpy().astype(np.int64)
            ids = table.column(1).to_numpy()
            n = table.column(2).to_numpy().astype(np.int64)
            el, off = _read_blobs(table.column(3), np.uint32)
            ids = ids.astype(np.int64)
            none = np.zeros(len(n), np.int64)
            bits = parities(el, off)
            buckets, blobs = [], []
            if needed is None:
                r, h, least, hits, _ = probes(plan, el, off, n)
                probe, indexed = (r, h, least), index(plan, el, off, n)
            else:
                row = np.repeat(np.arange(len(n)), np.diff(off))
                lacking = lacks(plan, el, off, n)
                df = plan.df(el)
                o = np.lexsort((df, row))
                rank = np.empty(len(o), np.int64)
                rank[o] = np.arange(len(o)) - off[row[o]]
                p = np.flatnonzero(lacking[row] & (rank < (lost(n, plan.t) + 1)[row]))
                q = np.flatnonzero(needed[el & np.uint32(BINS - 1)])
                probe, indexed, hits = (row[p], _single_hash(el[p]), df[p]), (row[q], _single_hash(el[q]), df[q]), none + 1
            for bucket, blob in _packed(plan, probe, indexed, field, ids, n, bits, hits):
                buckets.append(bucket)
                blobs.append(blob)
            yield pa.record_batch([pa.array(spread(np.array(buckets, np.int64))), pa.array(blobs, pa.binary())], names=["bucket", "blob"])

    return over


def lacking_bins(shipped):
    """Bins of the rarest elements of sets that have too few subsets."""

    def over(batches):
        plan: Plan = shipped.value
        for table in _merged(batches):
            n = table.column(2).to_numpy().astype(np.int64)
            el, off = _read_blobs(table.column(3), np.uint32)
            lacking = lacks(plan, el, off, n)
            row = np.repeat(np.arange(len(n)), np.diff(off))
            at = np.flatnonzero(lacking[row])
            el, row = el[at], row[at]
            o = np.lexsort((plan.df(el), row))
            el, row = el[o], row[o]
            first = np.searchsorted(row, row)
            keep = np.arange(len(row)) - first < (lost(n, plan.t) + 1)[row]
            bins = np.unique(el[keep] & np.uint32(BINS - 1)).astype(np.int32)
            yield pa.record_batch([pa.array(bins)], names=["bin"])

    return over


# ------------------------------------------------------------------ matching


def _ranges(start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    n = stop - start
    which = np.repeat(np.arange(len(n)), n)
    return which, np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(start, n)


def match_batches(t: float, parts: int, block: int = 500_000):
    """Blobs of whole buckets to packed candidates (part, blob of x, y, hits needed)."""

    def over(batches):
        waiting, current = [], None
        for batch in batches:
            bucket = batch.column(0).to_numpy(zero_copy_only=False)
            blobs = batch.column(1)
            for k in range(len(bucket)):
                if current is not None and bucket[k] != current:
                    yield from bucket_pairs(waiting)
                    waiting = []
                current = bucket[k]
                waiting.append(blobs[k].as_py())
        if waiting:
            yield from bucket_pairs(waiting)

    def bucket_pairs(blobs):
        got = [[] for _ in range(10)]
        for blob in blobs:
            types = (np.int32, np.int64, np.int32, np.int32, np.int32, np.int32, np.uint32, np.uint32, np.uint64, np.uint64)
            for column, x, kind in zip(got, unpack(blob), types):
                column.append(x.astype(kind))
        fields, xi, xn, xc, yc, xh, xs, ys, xp, xq = (np.concatenate(c) for c in got)
        if not len(xs) or not len(ys):
            return
        yi, yn, yp, yq = xi, xn, xp, xq
        del got
        xr, yr = np.repeat(np.arange(len(xi), dtype=np.int32), xc), np.repeat(np.arange(len(xi), dtype=np.int32), yc)
        o = in_order(ys)
        ys, yr = ys[o], yr[o]
        o = in_order(xs)
        xs, xr = xs[o], xr[o]
        a, b = np.searchsorted(ys, xs, "left"), np.searchsorted(ys, xs, "right")
        ends = np.cumsum(b - a)
        at = 0
        while at < len(xs):
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + block, "right")))
            # One probe with more partners than a block is cut into pieces.
            for lo in range(int(a[at]), max(int(b[at]), int(a[at]) + 1), block) if to == at + 1 else (None,):
                if lo is None:
                    w, i = _ranges(a[at:to], b[at:to])
                else:
                    i = np.arange(lo, min(lo + block, int(b[at])))
                    w = np.zeros(len(i), np.int64)
                x, y = xr[at:to][w], yr[i]
                keep = (yn[y] > xn[x]) | ((yn[y] == xn[x]) & (yi[y] > xi[x]))
                keep &= (xn[x] >= yn[y] * t - 1e-9) & (fields[x] == fields[y])
                x, y = x[keep], y[keep]
                both = xn[x] + yn[y]
                differ = np.bitwise_count(xp[x] ^ yp[y]).astype(np.int32) + np.bitwise_count(xq[x] ^ yq[y])
                keep = differ <= both - 2 * np.ceil(both * (t / (1 + t)) - 1e-9)
                x, y = x[keep], y[keep]
                if not len(x):
                    continue
                field, xid, yid, need = fields[x], xi[x], yi[y], xh[x]
                with np.errstate(over="ignore"):
                    part = (mix(xid.astype(np.uint64) * _M1 + yid.astype(np.uint64)) % np.uint64(parts)).astype(np.int64)
                o = np.lexsort((yid, xid, field, part))
                yield pair_batch(part[o], field[o], xid[o], yid[o], need[o])
            at = to

    return over


def pair_batch(part: np.ndarray, field: np.ndarray, x: np.ndarray, y: np.ndarray, need: np.ndarray) -> pa.RecordBatch:
    """Pairs ordered by (part, field, x, y) as one blob per part."""
    cut = np.concatenate([[0], np.flatnonzero(np.diff(part)) + 1, [len(part)]])
    blobs = [pair_blob(field[p:q], x[p:q], y[p:q], need[p:q]) for p, q in zip(cut[:-1], cut[1:])]
    return pa.record_batch([pa.array(spread(part[cut[:-1]])), pa.array(blobs, pa.binary())], names=["part", "blob"])


def pair_blob(field: np.ndarray, x: np.ndarray, y: np.ndarray, need: np.ndarray) -> bytes:
    """Pairs ordered by (field, x, y), each once with its hits."""
    new = np.ones(len(x), bool)
    new[1:] = (field[1:] != field[:-1]) | (x[1:] != x[:-1]) | (y[1:] != y[:-1])
    at = np.flatnonzero(new)
    hits = np.diff(np.concatenate([at, [len(x)]]))
    field, x, y, need = field[at], x[at], y[at], need[at]
    first = np.concatenate([[0], np.flatnonzero((x[1:] != x[:-1]) | (field[1:] != field[:-1])) + 1])
    # Differences may wrap around; their sums wrap back.
    return pack(field[first], np.diff(x[first], prepend=0), np.diff(np.concatenate([first, [len(x)]])), need[first], y, hits)


def pairs_of(blob: bytes) -> np.ndarray:
    field, dx, runs_, need, y, hits = unpack(blob)
    return np.stack([np.repeat(field, runs_), np.repeat(np.cumsum(dx), runs_), y, np.repeat(need, runs_), hits], 1)


def counted_batches(batches):
    """Candidates of whole parts to pairs with enough hits."""
    waiting, current = [], None

    def flush():
        rows = np.concatenate([pairs_of(b) for b in waiting])
        o = np.lexsort((rows[:, 2], rows[:, 1], rows[:, 0]))
        rows = rows[o]
        new = np.ones(len(rows), bool)
        new[1:] = (rows[1:, :3] != rows[:-1, :3]).any(1)
        at = np.flatnonzero(new)
        count = np.add.reduceat(rows[:, 4], at)
        # The fallback has its own need of one hit: the least need counts.
        need = np.minimum.reduceat(rows[:, 3], at)
        keep = at[count >= need]
        return pa.record_batch([pa.array(rows[keep, 0].astype(np.int32)), pa.array(rows[keep, 1]), pa.array(rows[keep, 2])], names=["field", "x", "y"])

    for batch in batches:
        part = batch.column(0).to_numpy(zero_copy_only=False)
        blobs = batch.column(1)
        for k in range(len(part)):
            if current is not None and part[k] != current:
                yield flush()
                waiting = []
            current = part[k]
            waiting.append(blobs[k].as_py())
    if waiting:
        yield flush()


def _verified(t: float):
    def over(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            ex, ox = _read_blobs(batch.column(3), np.uint32)
            ey, oy = _read_blobs(batch.column(4), np.uint32)
            n = batch.num_rows
            row = np.concatenate([np.repeat(np.arange(n), np.diff(ox)), np.repeat(np.arange(n), np.diff(oy))])
            key = np.sort(row.astype(np.uint64) << np.uint64(32) | np.concatenate([ex, ey]).astype(np.uint64))
            both = key[1:][key[1:] == key[:-1]] >> np.uint64(32)
            common = np.bincount(both.astype(np.int64), minlength=n)
            union = np.diff(ox) + np.diff(oy) - common
            keep = np.flatnonzero(common >= t * union - 1e-9)
            sim = common[keep] / np.maximum(1, union[keep])
            yield pa.record_batch([batch.column(k).take(pa.array(keep)) for k in range(3)] + [pa.array(sim)], names=["field", "x", "y", "similarity"])

    return over


def _bins_of(batches):
    """Counts of the bins of each partition's elements."""
    counts = np.zeros(BINS, np.int64)
    for batch in batches:
        el, _ = _read_blobs(batch.column(3), np.uint32)
        counts += np.bincount((el & np.uint32(BINS - 1)).astype(np.int64), minlength=BINS)
    yield count_batch(counts)


COUNTS = "word int, bit int, count long"


def log_counts(counts: DataFrame) -> np.ndarray:
    """Eight times the binary logarithm of the sum of counts of each bin; one row of 64 bins each, BINS values at most, whatever the input."""
    out = np.zeros(BINS, np.uint8)
    sums = counts.groupBy("word", "bit").agg(F.sum("count").alias("count"))
    got = sums.groupBy("word").agg(F.collect_list("bit").alias("bit"), F.collect_list(F.round(F.log2("count") * 8).cast("int")).alias("log")).toArrow()
    w = np.repeat(got["word"].to_numpy(), np.diff(got["bit"].combine_chunks().offsets.to_numpy()))
    out[w.astype(np.int64) * 64 + got["bit"].combine_chunks().flatten().to_numpy()] = got["log"].combine_chunks().flatten().to_numpy()
    return out


def count_batch(counts: np.ndarray) -> pa.RecordBatch:
    """Counts of the bins of a partition; a partition sends each bin once."""
    at = np.flatnonzero(counts)
    return pa.record_batch([pa.array((at >> 6).astype(np.int32)), pa.array((at & 63).astype(np.int32)), pa.array(counts[at])], names=["word", "bit", "count"])


def near_duplicates(df: DataFrame, id_col: str, text_cols: list[str], threshold: float = 0.8, run: int = 5, extra: int = 0):
    """Links between texts whose word runs are similar, per text column.

    Returns (classes, pairs): classes has (field, id, rep), one row for each non-null text, rep being the class of
    equal consistent forms; pairs has (field, rep_a, rep_b, similarity) for each pair of different classes with
    a Jaccard similarity of at least the threshold.  Exact: no link is lost, whatever the frequencies.
    """
    if not text_cols or not 0 < threshold <= 1:
        raise ValueError("text columns and a threshold above 0 are needed")
    spark = df.sparkSession
    parts = partitions(spark)
    texts = F.array(*[F.struct(F.lit(k).alias("field"), F.col(c).alias("text")) for k, c in enumerate(text_cols)])
    long = df.select(F.col(id_col).cast("long").alias("id"), F.explode(texts).alias("t")).select("t.field", "id", "t.text").where("text is not null and id is not null")
    rows = stored(long.mapInArrow(element_batches(run), _ELEMENTS), "elements")
    # The class of equal texts is its least id among the carriers of elements; only ids and digests are shuffled for that.
    carrier = F.when(F.octet_length("elements") > 0, F.col("id"))
    reps = rows.groupBy("field", "h1", "h2").agg(F.coalesce(F.min(carrier), F.min("id")).alias("rep"))
    classes = stored(rows.select("field", "id", "h1", "h2").join(reps, ["field", "h1", "h2"]).select("field", "id", "rep"), "classes")
    # Carriers that are surely no copies are sets at once; the others are checked by a join.
    copies = spark.sparkContext.broadcast(_bit_table(classes.where("id <> rep"), "id"))
    carriers = rows.where("octet_length(elements) > 0").select("field", "id", "n", "elements")
    unsure = _sifted(carriers, "id", copies, True).join(classes.where("id = rep").select("field", "id"), ["field", "id"])
    sets = _sifted(carriers, "id", copies, False).unionByName(stored(unsure.select("field", "id", "n", "elements"), "unsure"))

    freed(spark)

    sizes: dict[int, int] = {}
    for r in sets.groupBy(F.when(F.col("n") < 4096, F.col("n")).otherwise(F.floor(F.exp(F.floor(F.log("n") * 64) / 64)).cast("int")).alias("n")).count().collect():
        sizes[r["n"]] = sizes.get(r["n"], 0) + r["count"]
    if not sizes:
        return classes, spark.createDataFrame([], "field int, rep_a long, rep_b long, similarity double")
    log_df = log_counts(sets.mapInArrow(_bins_of, COUNTS))
    total = sum(sizes.values())
    lows, segments = bands(sizes, threshold)
    mean = sum(k * v for k, v in sizes.items()) / total
    buckets = math.ceil(total * mean * 1.5 / BUCKET_ROWS)
    shipped = spark.sparkContext.broadcast(Plan(threshold, lows, segments, log_df, total, sizes, extra, buckets))

    def candidates(fallback=None) -> DataFrame:
        blobs = sets.mapInArrow(signature_batches(shipped, fallback), "bucket int, blob binary")
        found = blobs.repartition(buckets, "bucket").sortWithinPartitions("bucket").mapInArrow(match_batches(threshold, buckets), "part int, blob binary")
        return found.repartition(buckets, "part").sortWithinPartitions("part").mapInArrow(counted_batches, "field int, x long, y long")

    bins = sets.mapInArrow(lacking_bins(shipped), "bin int").distinct().toArrow()["bin"].to_numpy()
    pairs = candidates()
    if len(bins):
        needed = np.zeros(BINS, bool)
        needed[bins] = True
        pairs = pairs.unionByName(candidates(spark.sparkContext.broadcast(needed))).distinct()
    pairs = stored(pairs, "candidates")
    freed(spark)
    # A filter of the texts met keeps the others' elements out of the verifying joins; one filter for both sides, so that they share one shuffle.
    met = spark.sparkContext.broadcast(_bit_table(pairs.select("field", F.explode(F.array("x", "y")).alias("id")), "field", "id"))
    small = _sifted(carriers.drop("n"), ["field", "id"], met, True)
    x = small.select("field", F.col("id").alias("x"), F.col("elements").alias("ex"))
    y = small.select("field", F.col("id").alias("y"), F.col("elements").alias("ey"))
    joined = pairs.join(x, ["field", "x"]).join(y, ["field", "y"]).select("field", "x", "y", "ex", "ey")
    links = joined.mapInArrow(_verified(threshold), "field int, x long, y long, similarity double")
    return classes, links.select("field", F.least("x", "y").alias("rep_a"), F.greatest("x", "y").alias("rep_b"), "similarity")


def class_links(classes: DataFrame, pairs: DataFrame) -> DataFrame:
    """(field, id, rep, links): each text once, with its class and the number of texts of the field it is linked to.

    Of a size linear in the texts: links are counted from class sizes and pairs of representatives.
    """
    size = classes.groupBy("field", "rep").agg(F.count("*").alias("n"))
    both = pairs.select("field", F.explode(F.array(F.struct(F.col("rep_a").alias("rep"), F.col("rep_b").alias("other")), F.struct(F.col("rep_b").alias("rep"), F.col("rep_a").alias("other")))).alias("p")).select("field", "p.*")
    far = both.join(size.withColumnRenamed("rep", "other"), ["field", "other"]).groupBy("field", "rep").agg(F.sum("n").alias("far"))
    total = size.join(far, ["field", "rep"], "left").select("field", "rep", (F.col("n") - 1 + F.coalesce("far", F.lit(0))).alias("links"))
    return classes.join(total, ["field", "rep"]).select("field", "id", "rep", "links")


def expanded(classes: DataFrame, pairs: DataFrame) -> DataFrame:
    """(field, a, b) of all linked rows, a < b: members of linked classes and of one class."""
    some = classes.groupBy("field", "rep").agg(F.count("*").alias("n")).where("n > 1")
    own = some.select("field", F.col("rep").alias("rep_a"), F.col("rep").alias("rep_b"))
    linked = pairs.select("field", "rep_a", "rep_b").unionByName(own)
    a = classes.select("field", F.col("rep").alias("rep_a"), F.col("id").alias("ia"))
    b = classes.select("field", F.col("rep").alias("rep_b"), F.col("id").alias("ib"))
    both = linked.join(a, ["field", "rep_a"]).join(b, ["field", "rep_b"])
    both = both.where("rep_a <> rep_b or ia < ib")
    return both.select("field", F.least("ia", "ib").alias("a"), F.greatest("ia", "ib").alias("b"))
