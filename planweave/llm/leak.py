"""Held-out items whose passages stand in documents, by spaced-seed hashing.

A mask is laid on each window of eight words; only the words under its ones are
hashed, so a hit survives substitutions under its zeros, and eight words in a
row hit under every mask.  Windows of documents that pass a filter of fixed
size are joined with those of the items on mask and seed; a hit names a
diagonal of a document and an item.  Both are then compared word by word along
each diagonal once: the longest exact run and the best overlap that tolerates
substitutions come out.

Words are compared without case and punctuation, in the consistent form of
texts, digits of all scripts alike and without inner non-joiners.  All of it is
one way whatever the sizes: nothing of a table is fetched but the filter, and
only slices no longer than an item travel from documents that are hit.

Defined results: null and empty texts, and texts of fewer words than a run,
leak nothing; repeated rows are reported by their ids; an empty table on either
side gives no rows; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from planweave.functions.shared import stored
from planweave.llm.consistent import _M1, ZWNJ, _keep, consistent_points, mix, slices, word_hashes
from planweave.llm.neardup import _bit_table, _blob_array, _read_blobs, _sifted

SPAN = 8
MASKS = ("11101011", "11011101", "10111011")
_FILTER_BITS = 24


def words_of(text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    cps, off = consistent_points(text)
    cps, off = _keep(cps, off, cps != ZWNJ)
    return word_hashes(cps, off, digits=True)


def windows(words: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """First word of each window of eight words within a row."""
    starts = np.arange(max(0, len(words) - SPAN + 1))
    end = np.repeat(rows[1:], np.diff(rows))[: len(starts)]
    return starts[starts + SPAN <= end]


def seeds(words: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Seeds of the windows under each mask."""
    out = np.zeros((len(MASKS), len(at)), np.uint64)
    with np.errstate(over="ignore"):
        for j in range(SPAN):
            h = mix(words + _M1 * np.uint64(j + 1))[at + j]
            for k, mask in enumerate(MASKS):
                if mask[j] == "1":
                    out[k] += h
        for k, mask in enumerate(MASKS):
            out[k] = mix(out[k] + np.uint64(int(mask, 2)))
    return out


_WINDOW = "id long, at int, mask int, seed long"


def _window_batches(keep=None):
    """Batches of (id, text) to (id, at, mask, seed): windows with their spaced seeds, those that pass the filter if there is one."""

    def over(batches):
        for batch in batches:
            for lo, hi in slices(batch.column(1)):
                ids = batch.column(0).slice(lo, hi - lo).to_numpy(zero_copy_only=False).astype(np.int64)
                words, rows = words_of(batch.column(1).slice(lo, hi - lo))
                at = windows(words, rows)
                row = np.repeat(np.arange(len(ids)), np.maximum(np.diff(rows) - SPAN + 1, 0))
                for k, s in enumerate(seeds(words, at)):
                    sel = np.arange(len(at))
                    if keep is not None:
                        b = (s >> np.uint64(64 - _FILTER_BITS)).astype(np.int64)
                        sel = np.flatnonzero((keep.value[b >> 6] >> (b & 63)) & 1)
                    place = (at[sel] - rows[row[sel]]).astype(np.int32)
                    yield pa.record_batch([pa.array(ids[row[sel]]), pa.array(place), pa.array(np.full(len(sel), k, np.int32)), pa.array(s[sel].view(np.int64))], names=["id", "at", "mask", "seed"])

    return over


def _word_batches(batches):
    """Batches of (id, text) to (id, words): the hash of each word, 8 bytes each."""
    for batch in batches:
        for lo, hi in slices(batch.column(1)):
            words, rows = words_of(batch.column(1).slice(lo, hi - lo))
            yield pa.record_batch([batch.column(0).slice(lo, hi - lo), _blob_array(words, rows).cast(pa.binary())], names=["id", "words"])


def _filter(seeds_: DataFrame) -> np.ndarray:
    """A filter of 2 ** 24 bits over the seeds; its size is fixed."""
    k = F.shiftrightunsigned("seed", 64 - _FILTER_BITS)
    one = F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(k, F.lit(64)).cast("int"))
    got = seeds_.groupBy(F.shiftright(k, 6).alias("word")).agg(F.bit_or(one).alias("bits")).toArrow()
    table = np.zeros(1 << (_FILTER_BITS - 6), np.int64)
    table[got["word"].to_numpy().astype(np.int64)] = got["bits"].to_numpy()
    return table


def diagonals(same: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per row of equal-or-not flags: the longest run of equal words, and the words of the best stretch in which a substitution costs two of them."""
    n = len(off) - 1
    run, words = np.zeros(n, np.int32), np.zeros(n, np.int32)
    some = np.flatnonzero(np.diff(off))
    if not len(some):
        return run, words
    start = off[some]
    row = np.repeat(np.arange(n), np.diff(off))
    count = np.cumsum(same)
    # What was counted before the run: at the last unequal word, or before the row.
    before = np.where(same, 0, count)
    before[start] = np.maximum(before[start], count[start] - same[start])
    run[some] = np.maximum.reduceat(count - np.maximum.accumulate(before), start)
    # Best stretch: highest rise of the running score, which is kept apart by row.
    score = np.cumsum(np.where(same, 1, -2))
    rise = np.concatenate([[0], score[:-1]])
    apart = rise - row * (3 * len(same) + 1)
    least = np.minimum.accumulate(apart)
    first = np.maximum.accumulate(np.where(apart == least, np.arange(len(same)), 0))
    gain = (score - rise[first]).astype(np.int64)
    best = np.maximum.reduceat(gain, start)
    at = np.flatnonzero((gain == np.repeat(best, np.diff(off)[some])) & (gain > 0))
    owner, where = np.unique(row[at], return_index=True)
    words[owner] = at[where] - first[at[where]] + 1
    return run, words


def _compared(batches):
    """Batches of (doc_id, item_id, a, b), words of equal number, to (doc_id, item_id, longest_run, tolerant_words)."""
    for batch in batches:
        a, off = _read_blobs(batch.column(2), np.uint64)
        b, _ = _read_blobs(batch.column(3), np.uint64)
        run, words = diagonals(a == b, off)
        yield pa.record_batch([batch.column(0), batch.column(1), pa.array(run), pa.array(words)], names=["doc_id", "item_id", "longest_run", "tolerant_words"])


def overlaps(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", item_id: str = "item_id", text: str = "text") -> DataFrame:
    """(doc_id, item_id, longest_run, tolerant_words) of each document and item that have a seed in common."""
    spark = docs.sparkSession
    some = lambda df, c: df.select(F.col(c).cast("long").alias("id"), F.col(text).alias("text")).where("id is not null and text is not null")
    d, it = some(docs, doc_id), some(items, item_id)
    item_windows = stored(it.mapInArrow(_window_batches(), _WINDOW), "windows")
    keep = spark.sparkContext.broadcast(_filter(item_windows))
    a = d.mapInArrow(_window_batches(keep), _WINDOW).select(F.col("id").alias("doc_id"), F.col("at").alias("there"), "mask", "seed")
    b = item_windows.select(F.col("id").alias("item_id"), "at", "mask", "seed")
    hits = stored(a.join(b, ["mask", "seed"]).select("doc_id", "item_id", (F.col("there") - F.col("at")).alias("shift")).distinct(), "hits")
    # Words of the documents that are hit, and along each diagonal as many of them as the item has.
    met = spark.sparkContext.broadcast(_bit_table(hits, "doc_id"))
    doc_words = _sifted(d.select("text", "id"), "id", met, True).select("id", "text").mapInArrow(_word_batches, "id long, words binary").withColumnRenamed("id", "doc_id")
    item_words = it.mapInArrow(_word_batches, "id long, words binary").withColumnRenamed("id", "item_id")
    size = item_words.select("item_id", F.octet_length("words").alias("size")).groupBy("item_id").agg(F.max("size").alias("size"))

    def part(words: Column, first: Column, n: Column) -> Column:
        return F.substring(words, first * 8 + 1, n)

    skipped = F.greatest(-F.col("shift"), F.lit(0))
    cut = hits.join(size, "item_id").join(doc_words, "doc_id").select("doc_id", "item_id", skipped.alias("skipped"), part(F.col("words"), F.col("shift") + skipped, F.greatest(F.col("size") - skipped * 8, F.lit(0))).alias("a"))
    both = cut.join(item_words, "item_id").select("doc_id", "item_id", "a", part(F.col("words"), F.col("skipped"), F.octet_length("a")).alias("b"))
    # Rows that share an id may differ in length; the shorter slice counts.
    n = F.least(F.octet_length("a"), F.octet_length("b"))
    found = both.select("doc_id", "item_id", F.substring("a", F.lit(1), n).alias("a"), F.substring("b", F.lit(1), n).alias("b")).mapInArrow(_compared, "doc_id long, item_id long, longest_run int, tolerant_words int")
    return found.groupBy("doc_id", "item_id").agg(F.max("longest_run").alias("longest_run"), F.max("tolerant_words").alias("tolerant_words"))


def leaks(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", item_id: str = "item_id", text: str = "text") -> DataFrame:
    """(doc_id, item_id): documents that hold at least eight consecutive words of an item."""
    return overlaps(docs, items, doc_id, item_id, text).where(F.col("longest_run") >= SPAN).select("doc_id", "item_id")
