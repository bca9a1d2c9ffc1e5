"""Keyed tables: upsert, first and last versions, checks of keys, fields and vocabularies, decision merges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each key by the order columns (nulls first).

    A map-side ``max_by`` keeps one row per key and partition before the shuffle, so a hot key is one row a partition.
    """
    rest = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("r"))
    return best.select(*keys, "r.*").select(*df.columns)


def first_seen(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key by the order columns."""
    rest = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("r"))
    return best.select(*keys, "r.*").select(*df.columns)


def upserted(old: DataFrame, new: DataFrame, keys: list[str], kept: list[str] = ()) -> DataFrame:
    """old with the rows of new: non-key columns are overwritten, but for those kept from the old row.

    new must have a key once (see ``repeated_keys``); null keys match nulls.
    """
    o = old.select(*keys, F.struct(*old.columns).alias("o"))
    n = new.select(*keys, F.struct(*new.columns).alias("n"))
    cond = [o[k].eqNullSafe(n[k]) for k in keys]
    both = o.join(n, cond, "full_outer").select("o", "n")
    return both.select(*[(F.coalesce("o." + c, "n." + c) if c in kept else F.when(F.col("n").isNotNull(), F.col("n." + c)).otherwise(F.col("o." + c))).alias(c) for c in old.columns])


def repeated_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that occur more than once, with their number."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def once_each(df: DataFrame, keys: list[str]) -> DataFrame:
    """df, after a check that no key occurs twice; a repeated key raises, with some of them named."""
    again = [tuple(r) for r in repeated_keys(df, keys).select(*keys).limit(5).collect()]
    if again:
        raise ValueError(f"keys occur more than once: {again}")
    return df


def added(known: DataFrame, new: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """known with those rows of new whose key it lacks, once each (the first by the order): adding the same again changes nothing."""
    return known.unionByName(unseen(first_seen(new, keys, order), known, keys).select(*known.columns))


def unseen(df: DataFrame, known: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose key is not in the known table; null keys are unseen."""
    return df.join(known.select(*keys).distinct(), keys, "left_anti")


def lacking_fields(df: DataFrame, id_col: str, fields: list[str]) -> DataFrame:
    """(id, missing): rows that lack required fields (null or blank), with their names in order."""
    missing = F.array_compact(F.array(*[F.when(F.coalesce(F.trim(F.col(c).cast("string")), F.lit("")) == "", F.lit(c)) for c in fields]))
    return df.select(id_col, missing.alias("missing")).where(F.size("missing") > 0)


def outside_vocabulary(df: DataFrame, column: str, allowed: list[str]) -> DataFrame:
    """Values that the vocabulary lacks, with their number of rows; nulls are no values."""
    return df.where(F.col(column).isNotNull() & ~F.col(column).isin(allowed)).groupBy(column).agg(F.count("*").alias("n"))


def out_of_range(df: DataFrame, id_col: str, ranges: dict[str, tuple[float, float]]) -> DataFrame:
    """(id, failed): rows with values outside their ranges, with the columns' names; nulls pass."""
    failed = F.array_compact(F.array(*[F.when((F.col(c) < low) | (F.col(c) > high), F.lit(c)) for c, (low, high) in ranges.items()]))
    return df.select(id_col, failed.alias("failed")).where(F.size("failed") > 0)


def in_scope(skip: Column, occupancies: Column, scope: list[str], flag: Column | None = None) -> Column:
    """Whether a clause is in scope: not skipped; listed occupancies must meet the scope (an empty list meets none); else the old flag; else yes."""
    meets = F.size(F.filter(occupancies, lambda o: o.isin(scope))) > 0
    return F.when(F.coalesce(skip, F.lit("")) != "", F.lit(False)).when(occupancies.isNotNull(), meets).otherwise(F.coalesce(flag, F.lit(True)) if flag is not None else F.lit(True))


def passage(*columns: Column) -> Column:
    """Non-empty trimmed texts, one a line."""
    return F.concat_ws("\n", *[F.nullif(F.trim(c), F.lit("")) for c in columns])


def decided(findings: DataFrame, decisions: DataFrame, key: str, verdict: str = "verdict") -> DataFrame:
    """Findings with the verdict of the latest decision of their key where theirs is open."""
    last = latest(decisions, [key], ["decided_at"]).select(key, F.col("reviewer_verdict"))
    return findings.join(last, key, "left").withColumn("final", F.when(F.col(verdict) == "NEEDS_REVIEW", F.coalesce("reviewer_verdict", verdict)).otherwise(F.col(verdict)))


def chunked(df: DataFrame, group: str, order: list[str], size: int) -> DataFrame:
    """df with the number of its chunk of so many rows within the group."""
    w = Window.partitionBy(group).orderBy(*order)
    return df.withColumn("chunk", F.floor((F.row_number().over(w) - 1) / size))
