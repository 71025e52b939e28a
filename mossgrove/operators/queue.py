"""The task queue as a table: TASKS plus ``pos``, the order of arrival."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mossgrove.functions.hashing import task_id

KEY = ("type", "path", "parent")


def enqueue(tasks: DataFrame, new: DataFrame) -> DataFrame:
    """``tasks`` and those of ``new`` that aren't pending yet: alike in type, path and parent (null is a value)."""
    first = new.withColumn("_k", F.row_number().over(Window.partitionBy(*KEY).orderBy("pos"))).where("_k = 1").drop("_k")
    waiting = tasks.where("status = 'pending'").select(*(F.col(k).alias(f"_{k}") for k in KEY)).distinct()
    same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in KEY]
    return tasks.unionByName(first.join(waiting, same[0] & same[1] & same[2], "left_anti"), allowMissingColumns=True)


def with_ids(tasks: DataFrame) -> DataFrame:
    return tasks.withColumn("id", task_id(F.col("type"), F.col("path"), F.col("queued_at")))


def dequeue(tasks: DataFrame, n: int, by_priority: bool = False) -> DataFrame:
    """The first n pending tasks, in order of arrival or by priority; they are being processed now."""
    order = [F.desc("priority"), "pos"] if by_priority else ["pos"]
    return tasks.where("status = 'pending'").orderBy(*order).limit(n).withColumn("status", F.lit("processing"))


def complete(tasks: DataFrame, results: DataFrame) -> DataFrame:
    """``tasks`` with those in ``results`` (id, error) done, or failed where there is an error."""
    done = results.select(F.col("id").alias("_id"), F.col("error").alias("_error"))
    rows = tasks.join(done, F.col("id") == F.col("_id"), "left")
    status = F.when(F.col("_id").isNull(), F.col("status")).when(F.col("_error").isNull(), F.lit("done")).otherwise(F.lit("failed"))
    return rows.withColumn("status", status).withColumn("error", F.coalesce("_error", "error")).drop("_id", "_error")


def cleanup(tasks: DataFrame) -> DataFrame:
    return tasks.where(F.col("status").isin("pending", "processing"))


def summary(tasks: DataFrame) -> DataFrame:
    return tasks.groupBy(F.coalesce("status", F.lit("unknown")).alias("status")).agg(F.count("*").alias("n"))


def pressure(tasks: DataFrame) -> DataFrame:
    """One row: pending tasks and how pressing they are."""
    n = F.count_if(F.col("status") == "pending")
    return tasks.agg(n.alias("pending"), F.when(n > 10, F.lit("HIGH")).when(n > 0, F.lit("low")).otherwise(F.lit("none")).alias("pressure"))


def sleep_plan(tasks: DataFrame) -> DataFrame:
    """step, n: pending tasks by the step of a sleep cycle that handles them; one wake rebuild stands for all."""
    step = F.when(F.col("type").isin("ingest", "route"), F.lit(1)).when(F.col("type") == "journal_rollup", F.lit(2)).when(F.col("type") == "wake_summary", F.lit(3)).otherwise(F.lit(4))
    return tasks.where("status = 'pending'").groupBy(step.alias("step"), "type").agg(F.when(F.first("type") == "wake_summary", F.lit(1)).otherwise(F.count("*")).alias("n"))
