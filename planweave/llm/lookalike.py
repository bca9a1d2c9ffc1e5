"""Texts brought to one consistent form, and rows that look the same but differ in characters."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from planweave.functions.shared import stored
from planweave.llm.consistent import consistent_array


def with_consistent(df: DataFrame, columns: list[str], suffix: str = "_consistent") -> DataFrame:
    """df with the consistent form of each text column beside it; null stays null, other columns are passed on."""
    names = [c + suffix for c in columns]
    if clash := set(names) & set(df.columns):
        raise ValueError(f"columns {sorted(clash)} exist already")
    schema = T.StructType([*df.schema, *[T.StructField(c, T.StringType()) for c in names]])

    def over(batches):
        for batch in batches:
            more = [consistent_array(batch.column(batch.schema.get_field_index(c))).cast(pa.string()) for c in columns]
            yield pa.record_batch(list(batch.columns) + more, names=[*batch.schema.names, *names])

    return df.mapInArrow(over, schema)


def stored_forms(df: DataFrame, id_col: str, columns: list[str]) -> DataFrame:
    """(id, field, form, stored) of the non-null texts: 128-bit digests of the consistent form and of the text as it stands, so no text is shuffled."""
    texts = F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).alias("text")) for c in columns])
    long = df.select(F.col(id_col).cast("long").alias("id"), F.explode(texts).alias("t")).select("id", "t.field", "t.text").where("text is not null and id is not null")

    def over(batches):
        for batch in batches:
            yield pa.record_batch([batch.column(0), batch.column(1), batch.column(2), consistent_array(batch.column(2)).cast(pa.string())], names=["id", "field", "text", "form"])

    rows = long.mapInArrow(over, "id long, field string, text string, form string").select("id", "field", F.unhex(F.md5("form")).alias("form"), F.unhex(F.md5("text")).alias("stored"))
    return stored(rows, "forms")


def look_classes(df: DataFrame, id_col: str, columns: list[str]) -> DataFrame:
    """(field, id, class, way, links): each non-null text once, with the least id of those that look like it and of those stored like it too.

    links: how many texts look the same but are stored otherwise; of a size linear in the texts, whatever their groups.
    """
    rows = stored_forms(df, id_col, columns)
    ways = rows.groupBy("field", "form", "stored").agg(F.min("id").alias("way"), F.count("*").alias("n"))
    forms = ways.groupBy("field", "form").agg(F.min("way").alias("class"), F.sum("n").alias("all"))
    known = ways.join(forms, ["field", "form"]).select("field", "stored", "class", "way", (F.col("all") - F.col("n")).alias("links"))
    return rows.join(known, ["field", "stored"]).select("field", "id", "class", "way", "links")


def same_look(df: DataFrame, id_col: str, columns: list[str]) -> DataFrame:
    """(field, a, b), a < b: pairs of rows whose non-null texts have one consistent form but different code points.

    Stored texts that are equal make no pair, so a hot text that is stored in one way stays one row of the join:
    the join is over distinct stored forms, whose members are attached after it.  Pairs are as many as a group has
    of them; ``look_classes`` tells the same in one row per text.
    """
    rows = stored_forms(df, id_col, columns)
    # Only forms stored in several ways take part, by one row for each way.
    ways = rows.select("field", "form", "stored").distinct()
    mixed = stored(ways.join(ways.groupBy("field", "form").agg(F.count("*").alias("ways")).where("ways > 1").select("field", "form"), ["field", "form"]), "ways")
    x, y = (mixed.select("field", "form", F.col("stored").alias(f"stored_{k}")) for k in "ab")
    met = x.join(y, ["field", "form"]).where("stored_a < stored_b")
    a, b = (rows.select("field", "form", F.col("id").alias(f"id_{k}"), F.col("stored").alias(f"stored_{k}")) for k in "ab")
    pairs = met.join(a, ["field", "form", "stored_a"]).join(b, ["field", "form", "stored_b"]).where("id_a <> id_b")
    return pairs.select("field", F.least("id_a", "id_b").alias("a"), F.greatest("id_a", "id_b").alias("b"))
