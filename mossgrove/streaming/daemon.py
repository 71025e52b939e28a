"""The loop that empties the queue: each poll works on all that is pending, then waits."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

from mossgrove.operators import queue
from mossgrove.plans.pipelines import sleep
from mossgrove.sources.scratch import drop, store
from mossgrove.sources.sinks import read_table, replace_table

Handlers = dict[str, Callable[[DataFrame], DataFrame]]


def drain(spark: SparkSession, table: str, handlers: Handlers) -> int:
    """Handles every pending task of the queue at ``table`` as one sleep cycle; the number of tasks there were.

    The new queue takes the old one's place after all handlers have returned: a poll that fails leaves the tasks pending. A
    queue that isn't there yet is empty.
    """
    try:
        tasks = read_table(spark, table)
    except AnalysisException:
        return 0
    n = queue.pressure(tasks).first()["pending"]
    if n:
        done = store(sleep(tasks, n, handlers), "queue")
        replace_table(done, table)
        drop(done)
    return n


def run(spark: SparkSession, table: str, handlers: Handlers, every: float = 5.0, polls: int | None = None) -> int:
    """Polls the queue every so many seconds, for ever or ``polls`` times; the number of tasks handled."""
    handled = 0
    while polls is None or polls > 0:
        handled += drain(spark, table, handlers)
        polls = None if polls is None else polls - 1
        if polls != 0:
            time.sleep(every)
    return handled
