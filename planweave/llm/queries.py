"""Queries of the llm subpackage over the driver's tables, and the SQL of those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _read(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """Clause rows with nearly the same wording, per text field."""
    from planweave.llm.neardup import expanded, near_duplicates

    fields = ["text_fa", "text_en"]
    rows = expanded(*near_duplicates(_read(spark, d, "clauses"), "clause_id", fields, threshold=0.6, run=3))
    name = F.element_at(F.array(*map(F.lit, fields)), F.col("field") + 1)
    return rows.select(name.alias("field"), F.col("a").alias("clause_a"), F.col("b").alias("clause_b"))


def p1_classes(spark: SparkSession, d: str) -> DataFrame:
    """Every text with its class of equal wording and the number of texts its wording is nearly the same as, at five words and a similarity of 0.8."""
    from planweave.llm.neardup import class_links, near_duplicates

    fields = ["text_fa", "text_en"]
    rows = class_links(*near_duplicates(_read(spark, d, "clauses"), "clause_id", fields))
    name = F.element_at(F.array(*map(F.lit, fields)), F.col("field") + 1)
    return rows.select(name.alias("field"), F.col("id").alias("clause_id"), "rep", "links")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """The reference entry each freely typed subject, object and relation means, or 0."""
    from planweave.llm.canon import canonical_entities

    return canonical_entities(_read(spark, d, "clauses"), _read(spark, d, "canon_terms"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of vectors of which one is among the ten most similar of the other, from a cosine of 0.90."""
    from planweave.llm.knn import similar_pairs

    return similar_pairs(_read(spark, d, "clause_vectors"), "vec_id", "embedding", dim=128, k=10, floor=0.9).select(F.col("a").alias("vec_a"), F.col("b").alias("vec_b"))


def p4_similar(spark: SparkSession, d: str) -> DataFrame:
    """The most similar vectors of each vector, ten at most, with their cosine, from a cosine of 0.90."""
    from planweave.llm.knn import nearest

    return nearest(_read(spark, d, "clause_vectors"), "vec_id", "embedding", dim=128, k=10, floor=0.9).select(F.col("a").alias("vec_id"), F.col("b").alias("neighbour"), "similarity")


def p4_nearest(spark: SparkSession, d: str) -> DataFrame:
    """The ten vectors most similar to each whose id is divisible by 100, among all rows and however far: exact."""
    from planweave.operators.measures import top_k_batch

    rows = top_k_batch(_read(spark, d, "clause_vectors"), "vec_id", "embedding", 128, F.col("vec_id") % 100 == 0, 10, itself=False)
    return rows.select(F.col("query_id").alias("vec_id"), F.col("id").alias("neighbour"), F.col("score").alias("similarity"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    """Clause rows whose texts look the same but are stored differently."""
    from planweave.llm.lookalike import same_look

    rows = same_look(_read(spark, d, "clauses"), "clause_id", ["text_fa", "heading_fa"])
    return rows.select("field", F.col("a").alias("clause_a"), F.col("b").alias("clause_b"))


def p6_classes(spark: SparkSession, d: str) -> DataFrame:
    """Every text with the class of those that look like it and the number of those stored otherwise."""
    from planweave.llm.lookalike import look_classes

    return look_classes(_read(spark, d, "clauses"), "clause_id", ["text_fa", "heading_fa"]).withColumnRenamed("id", "clause_id")


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    """Documents and the held-out items whose passages they hold."""
    from planweave.llm.leak import leaks

    return leaks(_read(spark, d, "documents"), _read(spark, d, "eval_items"))


def p7_overlaps(spark: SparkSession, d: str) -> DataFrame:
    """The same with the longest exact run and the words of the best overlap that tolerates substitutions, from eight words on."""
    from planweave.llm.leak import SPAN, overlaps

    return overlaps(_read(spark, d, "documents"), _read(spark, d, "eval_items")).where(F.col("tolerant_words") >= SPAN)


def p8_mixture(spark: SparkSession, d: str) -> DataFrame:
    """How often each document is used, so that each source makes up its share of the tokens."""
    from planweave.llm.mixture import mixture

    return mixture(_read(spark, d, "documents"), _read(spark, d, "mix_targets"))


def p8_shares(spark: SparkSession, d: str) -> DataFrame:
    """The shares the mixture reaches."""
    from planweave.llm.mixture import mixture, shares

    targets = _read(spark, d, "mix_targets")
    return shares(mixture(_read(spark, d, "documents"), targets), targets)


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    """Documents with a missing or wrong language label and the segments of mixed ones."""
    from planweave.llm.language import relabelled

    return relabelled(_read(spark, d, "documents")).select("doc_id", "seg_no", "lang")


def p9_languages(spark: SparkSession, d: str) -> DataFrame:
    """Every document and segment with its language (und: none of the known ones), confidence and sentences."""
    from planweave.llm.language import languages

    return languages(_read(spark, d, "documents"))


def queries() -> dict:
    return {k: v for k, v in globals().items() if k.startswith("p") and k[1].isdigit()}


def oracle_sql() -> dict[str, str]:
    """SQL of the exact queries, from their definitions; those that are approximate or learn have none."""
    from planweave.llm.sql import SQL

    return dict(SQL)
