"""Changes of files as a stream: which count, and what tasks they make."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mossgrove.functions.paths import is_identity, is_leaf, is_watched
from mossgrove.model import Params
from mossgrove.sources.scratch import drop, store
from mossgrove.sources.sinks import read_table, replace_table


def debounce(changes: DataFrame, gap: str = "2 seconds") -> DataFrame:
    """path, first, last and changes of runs of changes (path, at) with less than ``gap`` between them."""
    if changes.isStreaming:
        changes = changes.withWatermark("at", gap)
    out = changes.groupBy("path", F.session_window("at", gap).alias("w")).agg(F.min("at").alias("first"), F.max("at").alias("last"), F.count("*").alias("changes"))
    return out.select("path", "first", "last", "changes")


def tasks_of(changes: DataFrame, params: Params = Params(), system: str = ".system") -> DataFrame:
    """The tasks that changes (path, event_type) make: captures are ingested, other pages routed, identity files rebuild the briefing too.

    A deletion makes no task; neither does a change to the system directory, an index or a file that isn't markdown.
    """
    p = F.col("path")
    kind = F.when(is_leaf(p, params.leaf_prefixes), F.lit("ingest")).otherwise(F.lit("route"))
    task = lambda t, n: F.struct(t.alias("type"), F.lit(n).alias("priority"))
    made = F.when(is_identity(p, params.identity), F.array(task(kind, 0), task(F.lit("wake_summary"), 3))).otherwise(F.array(task(kind, 0)))
    rows = changes.where(is_watched(p, system) & (F.col("event_type") != "deleted"))
    return rows.withColumn("t", F.explode(made)).select(*changes.columns, "t.type", "t.priority")


def snapshot_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """path and event_type between two scans (source, mtime); deletions, which a file stream can't see, included."""
    a, b = before.select(F.col("source").alias("path"), F.col("mtime").alias("old")), after.select(F.col("source").alias("path"), F.col("mtime").alias("new"))
    kind: Column = F.when(F.col("old").isNull(), F.lit("created")).when(F.col("new").isNull(), F.lit("deleted")).when(F.col("new") != F.col("old"), F.lit("modified"))
    return a.join(b, "path", "full_outer").select("path", kind.alias("event_type")).where("event_type IS NOT NULL")


def watch(spark: SparkSession, folder: str, handle, checkpoint: str, every: str = "2 seconds"):
    """A running query over changes below ``folder``; ``handle(tasks, batch)`` gets the tasks of each tick that saw any.

    A file stream lists a path once, so edits and deletions are found by snapshots: each tick lists the folder and
    compares with the listing before, which is replaced after ``handle`` has returned. A tick that fails is seen again.
    """
    seen = f"{checkpoint.rstrip('/')}/snapshot"

    def tick(_: DataFrame, n: int) -> None:
        now = store(snapshot(spark, folder), "snapshot")
        try:
            before = read_table(spark, seen)
        except AnalysisException:  # the first tick
            before = now.limit(0)
        changes = store(snapshot_changes(before, now), "changes")
        if changes.take(1):
            handle(tasks_of(changes), n)
            replace_table(now, seen)
        drop(changes)
        drop(now)

    clock = spark.readStream.format("rate").option("rowsPerSecond", 1).load()
    return clock.writeStream.foreachBatch(tick).option("checkpointLocation", f"{checkpoint.rstrip('/')}/clock").trigger(processingTime=every).start()


def snapshot(spark: SparkSession, folder: str) -> DataFrame:
    """source and mtime of the files below ``folder``, relative to it; contents aren't read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("path", "modificationTime")
    plain = F.replace(F.regexp_replace("path", r"^[a-z]+:/+", "/"), F.lit(folder.rstrip("/") + "/"), F.lit(""))
    return files.select(plain.alias("source"), F.col("modificationTime").alias("mtime"))
