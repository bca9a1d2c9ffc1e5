"""Measures of detection sets and of steps that drop elements: counts, coverage, precision, recall, overlap per class, statuses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from planweave.operators.measures import precision_envelope


def metrics(df: DataFrame, keys: list[str], confidence: str, area: Column, whole: Column) -> DataFrame:
    """(keys, n, mean, least, most, coverage) per key: number, confidences (0 where there are none) and per cent of the whole that is covered.

    whole: a column that is the same within a key.  Rows without an area cover nothing.
    """
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    share = F.try_divide(F.sum(F.coalesce(area, F.lit(0.0))), F.max(whole))
    return df.groupBy(*keys).agg(
        F.count("*").alias("n"), zero(F.avg(confidence)).alias("mean"), zero(F.min(confidence)).alias("least"), zero(F.max(confidence)).alias("most"), zero(share * 100).alias("coverage")
    )


def average_precision(df: DataFrame, group: list[str], score: str, hit: str, total: str, tie: list[str]) -> DataFrame:
    """(group, n, hits, recall, ap): area under the monotone precision over recall; total: true ones of the group, found or not."""
    ranked = precision_envelope(df, group, score, hit, total, tie)
    w = Window.partitionBy(*group).orderBy("rank")
    gain = (F.col("recall") - F.coalesce(F.lag("recall").over(w), F.lit(0.0))) * F.col("envelope")
    per = ranked.withColumn("gain", gain).groupBy(*group)
    return per.agg(F.count("*").alias("n"), F.max("hits").alias("hits"), F.coalesce(F.max("recall"), F.lit(0.0)).alias("recall"), F.coalesce(F.sum("gain"), F.lit(0.0)).alias("ap"))


def best_threshold(sweep: DataFrame, keys: list[str], threshold: str, value: str) -> DataFrame:
    """(keys, threshold, value) at the greatest value of a sweep; the lowest threshold of equally good ones; rows without a value do not count."""
    best = sweep.where(F.col(value).isNotNull()).groupBy(*keys).agg(F.max_by(F.struct(threshold, value), F.struct(F.col(value), -F.col(threshold))).alias("b"))
    return best.select(*keys, f"b.{threshold}", f"b.{value}")


def class_overlap(df: DataFrame, label: str, common: str, either: str) -> DataFrame:
    """(label, iou): common over either, each summed over all images first; null where a class has nothing in either."""
    return df.groupBy(label).agg(F.try_divide(F.sum(common), F.sum(either)).alias("iou"))


def status(found: Column, kept: Column, can_fail: bool = True) -> Column:
    """Of a step that keeps some of what was found: skipped (nothing found), ok (all kept), failed (none kept) or degraded."""
    bad = F.when(kept == 0, F.lit("failed" if can_fail else "degraded"))
    return F.when(found == 0, "skipped").when(kept >= found, "ok").otherwise(F.coalesce(bad, F.lit("degraded")))


def remapped(df: DataFrame, column: str, pairs: dict) -> DataFrame:
    """df with the ids of a column replaced; rows with an unknown id are dropped."""
    table = F.create_map(*[F.lit(x) for kv in pairs.items() for x in kv])
    new = F.try_element_at(table, F.col(column))
    return df.withColumn(column, new).where(F.col(column).isNotNull())


def bucket(value: Column, bounds: list[float], names: list[str]) -> Column:
    """The name of the first bound the value is below, else the last name; null stays null."""
    out = F.when(value.isNull(), F.lit(None).cast("string"))
    for bound, name in zip(bounds, names):
        out = out.when(value < bound, F.lit(name))
    return out.otherwise(F.lit(names[-1]))


def dense_ids(df: DataFrame, group: str, order: list[str], prefix: str) -> DataFrame:
    """df with ids numbered from 1 within the group, over the rows that are there."""
    return df.withColumn("new_id", F.concat(F.lit(prefix), F.row_number().over(Window.partitionBy(group).orderBy(*order))))


def strongest(df: DataFrame, group: str, order: list[Column], above: int, keep: int) -> DataFrame:
    """Groups of more than ``above`` rows cut to the first ``keep`` by the order; smaller groups whole."""
    n = df.groupBy(group).agg(F.count("*").alias("group_rows")).where(F.col("group_rows") > above)
    ranked = df.join(n, group, "left").withColumn("r", F.row_number().over(Window.partitionBy(group).orderBy(*order)))
    return ranked.where(F.col("group_rows").isNull() | (F.col("r") <= keep)).drop("group_rows", "r")


def bijection_faults(df: DataFrame, a: str, b: str) -> DataFrame:
    """(side, key, n): values of either column that stand beside several of the other."""
    pairs = df.select(F.col(a).cast("string").alias("a"), F.col(b).cast("string").alias("b")).distinct()
    one = lambda side, key: pairs.groupBy(F.col(key).alias("key")).agg(F.count("*").alias("n")).where("n > 1").select(F.lit(side).alias("side"), "key", "n")
    return one(a, "a").unionByName(one(b, "b"))


def tagged(parts: dict[str, DataFrame]) -> DataFrame:
    """All rows of several tables of one shape, with the name and the place of the table each came from."""
    out = None
    for place, (name, df) in enumerate(parts.items()):
        df = df.withColumns({"part": F.lit(name), "part_ord": F.lit(place)})
        out = df if out is None else out.unionByName(df)
    return out
