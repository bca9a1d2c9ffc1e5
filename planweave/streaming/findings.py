"""Findings as a stream: late and repeated deliveries dropped within a watermark, windowed verdict counts, keyed state by batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from planweave.operators.keyed import latest
from planweave.operators.measures import verdict_counts
from planweave.sources.files import read_version, versions, write_version


def read_stream(spark: SparkSession, path: str, schema, files_per_trigger: int = 16) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def once(findings: DataFrame, keys: list[str], time: str = "ingested_at", delay: str = "7 days") -> DataFrame:
    """Each key once within the watermark; state older than the delay is dropped."""
    return findings.withWatermark(time, delay).dropDuplicatesWithinWatermark(keys)


def windowed_verdicts(findings: DataFrame, time: str = "ingested_at", delay: str = "7 days", width: str = "1 day") -> DataFrame:
    """Verdict counts per window and agent; a window is final when the watermark passes it."""
    w = F.window(time, width)
    counts = verdict_counts(findings.withWatermark(time, delay).withColumn("w", w), ["w", "agent"])
    return counts.select(F.col("w.start").alias("start"), "agent", "pass", "fail", "needs_review", "total")


def keep_latest(stream: DataFrame, folder: str, checkpoint: str, keys: list[str], order: list[str]):
    """A query that folds each batch into a versioned table of the latest row per key.

    Each version is tagged with its batch, so a replayed batch is passed over.  An error while the table is read
    stops the query and leaves the table as it was; only a folder that does not exist counts as empty.
    """
    spark, schema = stream.sparkSession, stream.schema

    def fold(batch: DataFrame, number: int) -> None:
        done = versions(spark, folder)
        tag = f"batch-{number}"
        if any(v[2] == tag for v in done):
            return
        old = read_version(spark, folder, schema)
        new = latest(latest(batch, keys, order).unionByName(old), keys, order)
        write_version(new, folder, tag, done[-1][0] if done else 0)

    return stream.writeStream.foreachBatch(fold).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
