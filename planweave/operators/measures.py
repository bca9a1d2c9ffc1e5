"""Aggregates and ordered measures: zero-filled counts, histograms, anomalies, reliability, precision envelopes, sweeps, vector top-k."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

VERDICTS = ["PASS", "FAIL", "NEEDS_REVIEW"]


def verdict_counts(findings: DataFrame, keys: list[str], column: str = "verdict") -> DataFrame:
    """Per key the number of each verdict, zeros included; verdicts in any case, null ones need review."""
    v = F.coalesce(F.upper(F.trim(F.col(column))), F.lit("NEEDS_REVIEW"))
    return findings.groupBy(*keys).agg(*[F.count_if(v == x).alias(x.lower()) for x in VERDICTS], F.count("*").alias("total"))


def registry_stats(registry: DataFrame, rows: DataFrame, key: str, value: str) -> DataFrame:
    """Count, least and greatest value per registered key; keys without rows have 0 and nulls."""
    stats = rows.groupBy(key).agg(F.count("*").alias("n"), F.min(value).alias("low"), F.max(value).alias("high"))
    return registry.join(stats, key, "left").withColumn("n", F.coalesce("n", F.lit(0)))


def anomalies(df: DataFrame, keys: list[str], value: str, above: float = 5.0, below: float = 0.2) -> DataFrame:
    """Rows whose value is above or below so many times the median of their key."""
    med = df.groupBy(*keys).agg(F.median(value).alias("median"))
    return df.join(med, keys).where((F.col(value) > above * F.col("median")) | (F.col(value) < below * F.col("median")))


def reliability(mean: Column, high: Column, n: Column, overlaps: Column) -> Column:
    """Score of a detection set: mean confidence, share of sure ones, overlaps, plausible number."""
    share = 30.0 * high / F.greatest(n, F.lit(1))
    plausible = F.when((n >= 1) & (n <= 50), 10.0).otherwise(F.greatest(F.lit(0.0), 10.0 - F.abs(n - 25)))
    return F.least(F.lit(40.0), 40.0 * mean) + share + F.greatest(F.lit(0.0), 20.0 - 5.0 * overlaps) + plausible


def moving_average(df: DataFrame, group: list[str], order: list[str], value: str, reach: int = 1) -> DataFrame:
    """Centred average over reach rows on either side, shrinking at the ends."""
    w = Window.partitionBy(*group).orderBy(*order).rowsBetween(-reach, reach)
    return df.withColumn("smooth", F.avg(value).over(w))


def precision_envelope(df: DataFrame, group: list[str], score: str, hit: str, total: str, tie: list[str]) -> DataFrame:
    """Rank, true positives so far, precision, recall and the monotone envelope of precision per group."""
    w = Window.partitionBy(*group).orderBy(F.desc(score), *tie)
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    out = df.withColumn("rank", F.row_number().over(w)).withColumn("hits", F.sum(F.col(hit).cast("long")).over(run))
    out = out.withColumn("precision", F.col("hits") / F.col("rank")).withColumn("recall", F.try_divide(F.col("hits").cast("double"), F.col(total)))
    return out.withColumn("envelope", F.max("precision").over(Window.partitionBy(*group).orderBy("rank").rowsBetween(0, Window.unboundedFollowing)))


def threshold_sweep(df: DataFrame, score: str, hit: str, thresholds: list[float]) -> DataFrame:
    """(threshold, kept, hits) at each of a fixed list of thresholds, in one pass: each row is counted into its highest threshold, then summed from above."""
    step = F.size(F.filter(F.array(*map(F.lit, thresholds)), lambda t: t <= F.col(score)))
    per = df.groupBy(step.alias("k")).agg(F.count("*").alias("n"), F.sum(F.col(hit).cast("long")).alias("h"))
    grid = df.sparkSession.createDataFrame([(i + 1, float(t)) for i, t in enumerate(thresholds)], "k int, threshold double")
    both = grid.join(F.broadcast(per.withColumnRenamed("k", "j")), F.col("j") >= F.col("k"), "left")
    return both.groupBy("threshold").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("kept"), F.coalesce(F.sum("h"), F.lit(0)).alias("hits"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda acc, v: acc + v)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two vectors; null if one has no length."""
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def top_k(df: DataFrame, vector: str, query: list[float], k: int, tie: list[str], where: Column | None = None) -> DataFrame:
    """The k rows most similar to one query vector, exact; a filter is applied first."""
    if k < 1:
        raise ValueError("k must be at least 1")
    some = df if where is None else df.where(where)
    scored = some.where(F.size(vector) == len(query)).withColumn("score", cosine(F.col(vector), F.array(*[F.lit(float(x)) for x in query])))
    return scored.where(F.col("score").isNotNull() & ~F.isnan("score")).orderBy(F.desc("score"), *tie).limit(k)


def _units(lists, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the valid vectors of a list column (of the length, finite, not zero) and the vectors at length one."""
    off = lists.offsets.to_numpy()
    size = np.where(lists.is_valid().to_numpy(zero_copy_only=False), np.diff(off), 0)
    at = np.flatnonzero(size == dim)
    flat = lists.values.to_numpy(zero_copy_only=False)
    x = flat[off[at][:, None] + np.arange(dim)].astype(np.float64) if len(at) else np.zeros((0, dim))
    with np.errstate(over="ignore", invalid="ignore"):
        norm = np.sqrt((x * x).sum(1))
    good = np.isfinite(norm) & (norm > 0)
    return at[good], x[good] / norm[good, None]


def _best_batches(shipped, dim: int, k: int, itself: bool, step: int = 2048):
    """Batches of (id, vector) to the k best rows of each shipped query within the partition."""

    def over(batches):
        asked, q = shipped.value
        best = np.full((len(asked), k), -np.inf)
        best_id = np.full((len(asked), k), np.iinfo(np.int64).max)
        for batch in batches:
            at, u = _units(batch.column(1), dim)
            ids = batch.column(0).to_numpy(zero_copy_only=False)[at]
            for lo in range(0, len(ids), step):
                some = ids[lo : lo + step]
                for a in range(0, len(asked), step):
                    rows = slice(a, min(a + step, len(asked)))
                    score = q[rows] @ u[lo : lo + step].T
                    least = best[rows, -1]
                    most = k if itself else k + 1
                    if len(some) > most and np.isneginf(least).any():
                        least = np.maximum(least, np.partition(score, -most, axis=1)[:, -most])
                    # What may be equal when rounded is kept, as ids break ties.
                    r, c = np.nonzero(score >= least[:, None] - 1e-9)
                    if not itself:
                        other = asked[rows][r] != some[c]
                        r, c = r[other], c[other]
                    touched = np.unique(r)
                    row = np.concatenate([r, np.repeat(touched, k)])
                    value = np.concatenate([np.round(score[r, c], 9), best[rows][touched].ravel()])
                    who = np.concatenate([some[c], best_id[rows][touched].ravel()])
                    o = np.lexsort((who, -value, row))
                    start = np.searchsorted(row[o], touched)
                    take = o[(start[:, None] + np.arange(k)).ravel()] if len(touched) else o[:0]
                    best[a + touched], best_id[a + touched] = value[take].reshape(-1, k), who[take].reshape(-1, k)
        r, c = np.nonzero(np.isfinite(best))
        yield pa.record_batch([pa.array(asked[r]), pa.array(best_id[r, c]), pa.array(best[r, c])], names=["query_id", "id", "score"])

    return over


def top_k_batch(df: DataFrame, id_col: str, vector: str, dim: int, asked: Column, k: int, itself: bool = True, block: int = 8192) -> DataFrame:
    """(query_id, id, score): the k rows most similar to each asked row, exact, ties by the lesser id.

    Scores are cosines to nine decimals, which also order the rows.  Queries go in blocks, each against all rows;
    a task keeps the k best of each query of its block.  Vectors that are null, zero, of another length or not finite are no case.
    """
    if k < 1:
        raise ValueError("k must be at least 1")
    spark = df.sparkSession
    pick = lambda rows: rows.select(F.col(id_col).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v")).where("id is not null and v is not null")
    rows, queries = pick(df), pick(df.where(asked))
    blocks = max(1, -(-queries.count() // block))
    kind, found = "query_id long, id long, score double", []
    for i in range(blocks):
        got = queries.where(F.pmod(F.xxhash64("id"), F.lit(blocks)) == i).toArrow().combine_chunks()
        batches = [(b.column(0).to_numpy(zero_copy_only=False), *_units(b.column(1), dim)) for b in got.to_batches()]
        if not batches:
            continue
        ids, units = np.concatenate([b[0][b[1]] for b in batches]), np.concatenate([b[2] for b in batches])
        found.append(rows.mapInArrow(_best_batches(spark.sparkContext.broadcast((ids, units)), dim, k, itself), kind))
    if not found:
        return spark.createDataFrame([], kind)
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out.withColumn("r", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))).where(F.col("r") <= k).select("query_id", "id", "score")


def notes(*pairs: tuple[Column, str]) -> Column:
    """The texts of the conditions that hold, in order."""
    return F.array_compact(F.array(*[F.when(c, F.lit(t)) for c, t in pairs]))


def share_text(part: Column, whole: Column) -> Column:
    """A share as text with one decimal and a per cent sign; a whole of 0 counts as 1."""
    return F.format_string("%.1f%%", part / F.greatest(whole, F.lit(1)) * 100)


def array_mean(values: Column) -> Column:
    """Mean of an array; null for an empty one."""
    return F.try_divide(F.aggregate(values, F.lit(0.0), lambda a, v: a + v), F.size(values))


def perimeter(walls: DataFrame, key: str, length: str) -> DataFrame:
    """(key, walls, perimeter, mean, extent): number, sum and mean of the lengths; extent: product of the two longest of at least four.

    The two longest are kept by a partial aggregate of two values: the greatest, and the greatest of the rest by their place.
    """
    w = walls.withColumn("r", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(length), "ord")))
    top = lambda k: F.max(F.when(F.col("r") == k, F.col(length)))
    g = w.groupBy(key).agg(F.count("*").alias("walls"), F.sum(length).alias("perimeter"), F.avg(length).alias("mean"), (top(1) * top(2)).alias("two"))
    return g.select(key, "walls", "perimeter", "mean", F.when(F.col("walls") >= 4, F.col("two")).alias("extent"))
