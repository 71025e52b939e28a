"""The event log: filters, summaries, retention."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def read(events: DataFrame, since: str | None = None, event: str | None = None, last: int | None = None) -> DataFrame:
    """Events at or after ``since`` and of a kind; of these the last n."""
    if since is not None:
        events = events.where(F.col("timestamp") >= since)
    if event is not None:
        events = events.where(F.col("event") == event)
    return events if last is None else events.orderBy(F.desc("timestamp")).limit(last)


def _n(*names: str) -> Column:
    return sum((F.coalesce(F.col(x), F.lit(0)) for x in names[1:]), F.coalesce(F.col(names[0]), F.lit(0)))


def by_type(events: DataFrame) -> DataFrame:
    return events.groupBy(F.coalesce("event", F.lit("unknown")).alias("event")).agg(F.count("*").alias("n"))


def verdicts(events: DataFrame) -> DataFrame:
    return events.where("event = 'cascade_verdict'").groupBy(F.coalesce("verdict", F.lit("UNKNOWN")).alias("verdict")).agg(F.count("*").alias("n"))


def summary(events: DataFrame) -> DataFrame:
    """One row of totals over METRICS rows; an empty log gives zeros."""
    search = F.col("event") == "search_query"
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    return events.agg(
        F.count("*").alias("total_events"),
        total(_n("judge_tokens_in", "executor_tokens_in", "total_tokens_in")).alias("total_tokens_in"),
        total(_n("judge_tokens_out", "executor_tokens_out", "total_tokens_out")).alias("total_tokens_out"),
        F.round(total(_n("total_cost_usd", "cost_usd")), 4).alias("total_cost_usd"),
        F.count_if(search).alias("search_count"),
        F.coalesce(F.round(F.avg(F.when(search, _n("elapsed_ms"))), 1), F.lit(0.0)).alias("avg_search_ms"),
        F.count_if(F.col("event") == "index_completed").alias("index_runs"),
        F.count_if(F.col("event") == "write_entry").alias("writes"),
        F.min("timestamp").alias("period_start"),
        F.max("timestamp").alias("period_end"),
    )


def prune_audit(rows: DataFrame, cutoff: Column) -> DataFrame:
    """Audit rows at or after ``cutoff``, and those whose time can't be read."""
    at = F.try_to_timestamp(F.col("timestamp"))
    return rows.where(at.isNull() | (at >= cutoff))
