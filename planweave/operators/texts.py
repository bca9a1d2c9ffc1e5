"""Text columns: nested values as text, phrases to categories, JSON within text, headings and chunks, nearest terms of a lexicon."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def as_text(json: Column) -> Column:
    """JSON as plain text: strings without quotes, the values of lists and objects joined by blanks, however deep; null as empty.

    What is no JSON is its own text.
    """
    bare = F.regexp_replace(json, r'"(?:[^"\\]|\\.)*"\s*:', " ")
    flat = F.trim(F.regexp_replace(F.regexp_replace(bare, r'[\[\]{}",]+', " "), r"\s+", " "))
    return F.when(json.isNull() | (json == "null"), "").when(F.try_parse_json(json).isNotNull(), flat).otherwise(json)


def phrase(text: Column) -> Column:
    """Lower case, blanks for all but letters a to z."""
    return F.regexp_replace(F.lower(text), r"[^a-z\s]", " ")


def category_of(text: Column, words: list[tuple[str, list[str]]]) -> Column:
    """The first category one of whose words stands in the phrase; null if none does."""
    p = phrase(text)
    out = F.when(F.lit(False), F.lit(None).cast("string"))
    for name, some in words:
        hit = F.lit(False)
        for w in some:
            hit = hit | F.contains(p, F.lit(w))
        out = out.when(hit, F.lit(name))
    return out


def mentions(text: Column, words: list[str]) -> Column:
    """Whether the text, in lower case, holds any of the words; a null text holds none."""
    hit = F.lit(False)
    for w in words:
        hit = hit | F.contains(F.lower(text), F.lit(w))
    return F.coalesce(hit, F.lit(False))


def json_members(df: DataFrame, column: str) -> DataFrame:
    """df with the JSON texts of the array that stands within a free text, from the first [ to the last ], and the members' number.

    A single object counts as an array of one; a text without any, or whose array cannot be read, has none.
    """
    array = F.regexp_extract(F.col(column), r"(?s)\[.*\]", 0)
    whole = F.when(array != "", array).otherwise(F.concat(F.lit("["), F.regexp_extract(F.col(column), r"(?s)\{.*\}", 0), F.lit("]")))
    # As the only member of an array, since the parser alone passes over what follows a complete value.
    one = F.concat(F.lit("["), whole, F.lit("]"))
    out = df.withColumn("array", F.when(F.try_parse_json(one).isNotNull() & (F.json_array_length(one) == 1), whole))
    members = F.coalesce(F.from_json("array", "array<string>"), F.array().cast("array<string>"))
    return out.withColumn("members", members).withColumn("n_members", F.size("members")).drop("array")


def headed_chunks(df: DataFrame, group: str, order: str, text: str, heading: Column, size: int) -> DataFrame:
    """(group, chunk, n, body): texts in order, so many a chunk, one a line, headings marked; df has ``chunk`` numbers of that size already or gets them by row."""
    from planweave.operators.keyed import chunked

    rows = chunked(df.where(F.trim(text) != ""), group, [order], size)
    line = F.concat(F.when(heading, F.lit("[H] ")).otherwise(F.lit("")), F.col(text))
    g = rows.groupBy(group, "chunk").agg(F.count("*").alias("n"), F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), line.alias("t")))).alias("l"))
    return g.select(group, "chunk", "n", F.array_join(F.transform("l", lambda x: x["t"]), "\n").alias("body"))


def likeness(a: Column, b: Column) -> Column:
    """From 0 to 100: 100 for equal texts, less by the edits between them against the longer one."""
    longer = F.greatest(F.length(a), F.length(b))
    return F.when(longer > 0, (1 - F.levenshtein(a, b) / F.when(longer > 0, longer)) * 100).otherwise(F.lit(100.0))


def nearest_terms(values: DataFrame, column: str, terms: DataFrame, term: str, id_col: str, least: float = 80.0, exact_below: int = 4) -> DataFrame:
    """(value, term_id, score) of distinct values: the term most like it from a likeness on, the least id of equal ones; else null and 0.

    Upper case without outer blanks; values below two letters are left out, those shorter than ``exact_below`` match
    only exactly.  A term that is alike enough is about as long, so values and terms meet on the lengths that can be:
    an equi join, which the optimizer may broadcast by the size of the lexicon.
    """
    v = values.select(F.upper(F.trim(column)).alias("value")).where(F.length("value") >= 2).distinct()
    slack = F.ceil(F.length("value") * (100.0 / least - 1)).cast("int")
    low = F.when(F.length("value") < exact_below, F.length("value")).otherwise(F.greatest(F.length("value") - slack, F.lit(1)))
    high = F.when(F.length("value") < exact_below, F.length("value")).otherwise(F.length("value") + slack)
    t = terms.select(F.upper(F.trim(term)).alias("term"), F.col(id_col).alias("term_id")).withColumn("n", F.length("term"))
    pairs = v.withColumn("n", F.explode(F.sequence(low, high))).join(t, "n").withColumn("score", likeness(F.col("value"), F.col("term")))
    good = pairs.where((F.col("score") >= least) & ((F.length("value") >= exact_below) | (F.col("score") == 100)))
    best = good.groupBy("value").agg(F.min(F.struct(-F.col("score"), "term_id")).alias("b"))
    return v.join(best, "value", "left").select("value", F.col("b.term_id").alias("term_id"), F.coalesce(-F.col("b.col1"), F.lit(0.0)).alias("score"))


def first_variants(terms: DataFrame, id_col: str, lists: Column) -> DataFrame:
    """(variant, id): each spelling once, with the first entry that has it."""
    v = terms.select(F.col(id_col).alias("id"), F.explode(lists).alias("variant")).where(F.trim("variant") != "")
    return v.groupBy(F.upper(F.trim("variant")).alias("variant")).agg(F.min("id").alias("id"))
