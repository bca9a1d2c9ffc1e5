"""Session helpers: the shared folder, cut lineage, bounded broadcasts."""

from __future__ import annotations

import atexit
import gc
import tempfile
import time
import uuid

from pyspark.sql import DataFrame, SparkSession


_own: dict[str, str] = {}
_open: set[str] = set()


def _one_machine(master: str) -> bool:
    return master == "local" or master.startswith("local[")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, as the session names it; only a session on one machine that names none gets its own."""
    got = spark.conf.get("spark.checkpoint.dir", None)
    if got:
        return got
    jvm = spark.sparkContext._jsc.sc().getCheckpointDir()
    if jvm.isDefined():
        return jvm.get()
    if not _one_machine(spark.sparkContext.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own:
        _own[app] = "file://" + tempfile.mkdtemp(prefix="planweave-")
    return _own[app]


def _folder(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/planweave/{spark.sparkContext.applicationId}"


def clear(spark: SparkSession) -> None:
    """Delete what this application has stored; results that were read from it can no longer be computed."""
    path = spark._jvm.org.apache.hadoop.fs.Path(_folder(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def _clear_at_end(spark: SparkSession) -> None:
    try:
        if spark.sparkContext._jsc is not None:
            clear(spark)
    except Exception:  # the session is gone: nothing can be deleted through it
        pass


def stored(df: DataFrame, name: str = "part") -> DataFrame:
    """df written to the shared folder as Parquet and read again: lineage is cut and every executor can read it.

    What an application has stored is deleted when its Python process ends, or by ``clear``.
    """
    spark = df.sparkSession
    folder = _folder(spark)
    if folder not in _open:
        _open.add(folder)
        atexit.register(_clear_at_end, spark)
    path = f"{folder}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def freed(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of what is stored by now: it does so when its driver finds the plans unused, which else may be hours later.

    In two rounds, as what holds a plan may itself be let go in the first.
    """
    for _ in range(2):
        gc.collect()
        spark._jvm.System.gc()
        time.sleep(0.3)


def by_shuffle(df: DataFrame) -> DataFrame:
    """df to be joined by shuffle, however small Spark thinks it.

    What is exploded from nested columns, or read from well compressed ones, is estimated at a small part of what it holds;
    it would be broadcast, and a broadcast is gathered by the driver.
    """
    return df.hint("merge")


def partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
