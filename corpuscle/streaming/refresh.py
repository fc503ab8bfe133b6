"""Fact tables that follow a folder: each micro-batch scans only the files that are new or changed.

``changed_files`` reads files as they arrive. ``keep_facts`` appends each batch's facts with
its number; a batch that is repeated after a failure overwrites its own rows, so every
file is counted once for each state. ``latest`` takes each file's newest state.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from corpuscle.functions import paths
from corpuscle.operators import facts

_STATES = "path string, digest long, batch long"


def changed_files(spark: SparkSession, root: str, per_batch: int = 10_000) -> DataFrame:
    """(path, text) of files below ``root`` as a stream; a file that is written again comes again."""
    raw = spark.readStream.format("text").schema("value string").option("wholetext", True).option("recursiveFileLookup", True).option("maxFilesPerTrigger", per_batch).load(root)
    whole = F.regexp_replace(F.col("_metadata.file_path"), r"^[a-z0-9]+:(//[^/]*)?(?=/)", "")
    base = root.rstrip("/") + "/"
    path = F.when(F.startswith(whole, F.lit(base)), F.substring(whole, len(base) + 1, 2**31 - 1)).otherwise(whole)
    return raw.select(path.alias("path"), F.col("value").alias("text")).where(paths.is_scanned(F.col("path")))


def keep_facts(stream: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    """Scan what is there and what has changed since the last run, then stop; start it again to follow."""

    def batch(files: DataFrame, number: int) -> None:
        files = files.persist()
        try:
            files.select("path", F.xxhash64("text").alias("digest"), F.lit(number).cast("long").alias("batch")).write.mode("overwrite").parquet(f"{folder}/states/n={number}")
            facts.facts(files).withColumn("batch", F.lit(number).cast("long")).write.mode("overwrite").parquet(f"{folder}/facts/n={number}")
        finally:
            files.unpersist()

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest(spark: SparkSession, folder: str) -> DataFrame:
    """Facts of each file's newest state."""
    states = spark.read.schema(_STATES).option("recursiveFileLookup", True).parquet(f"{folder}/states")
    newest = states.groupBy("path").agg(F.max("batch").alias("batch"))
    rows = spark.read.schema(facts.FACTS + ", batch long").option("recursiveFileLookup", True).parquet(f"{folder}/facts")
    return rows.join(newest, ["path", "batch"], "left_semi").drop("batch")


def windowed_counts(events: DataFrame, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """(start, key, n, total) of a stream (ts, key, value): tumbling windows, closed when events may no longer be late."""
    rows = events.withWatermark("ts", late).groupBy(F.window("ts", width), "key").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return rows.select(F.col("window.start").alias("start"), "key", "n", "total")
