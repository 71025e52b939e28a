"""State by key for streams: what is pending in the queue, and the lines of a session that came before their turn.

State is kept in RocksDB by Spark and nothing that was written is written again: a batch reads and appends what it brings.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from mossgrove.operators import turns
from mossgrove.session import importable

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
DONE = ("done", "failed")
TASK = "pos bigint, type string, path string, parent string, status string"
TURN = "session string, line bigint, role string, timestamp string, content string, turn_number bigint, late boolean"

_TURN = [c.split()[0] for c in TURN.split(", ")]


def stateful(spark: SparkSession) -> None:
    importable(spark)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)


class Pending(StatefulProcessor):
    """Of a (type, path, parent), whether a task is pending: the first that comes is, until one of its kind is done."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.pending = handle.getValueState("pending", "is boolean")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        pending = bool(self.pending.get()[0]) if self.pending.exists() else False
        new = pd.concat(list(rows)).sort_values("pos", kind="stable")
        took = []
        for status in new.status:
            arrives = status == "pending"
            took.append(not arrives or not pending)
            pending = arrives or (pending and status not in DONE)
        self.pending.update((pending,))
        yield new[took][["pos", "type", "path", "parent", "status"]]

    def close(self) -> None:
        pass


def enqueue(events: DataFrame) -> DataFrame:
    """A stream of tasks and of what became of them (TASK) without the tasks whose like was pending when they came.

    A task is like another of the same type, path and parent, null being a value. Within a batch ``pos`` is the order of
    arrival. An event with status done or failed ends its task; what comes after is taken again. Other states pass.
    """
    stateful(events.sparkSession)
    return events.groupBy("type", "path", "parent").transformWithStateInPandas(Pending(), TASK, "append", "none")


class InTurn(StatefulProcessor):
    """Of a session, the next line, how many turns there were, and what waits for the lines before it."""

    def __init__(self, patience_ms: int, first: int = 0):
        self.patience, self.first = patience_ms, first

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        # since: when the wait for the next line began, -1 if nothing waits; timer: whether one is set
        self.state = handle.getValueState("state", "next bigint, turns bigint, since bigint, timer boolean, waiting string, missing string")

    def _load(self) -> tuple[int, int, int, bool, dict[int, list], list[list[int]]]:
        if not self.state.exists():
            return self.first, 0, -1, False, {}, []
        next_, count, since, timer, waiting, missing = self.state.get()
        return next_, count, since, timer, {k: v for k, *v in json.loads(waiting)}, json.loads(missing)

    def _save(self, now: int, was: int, next_: int, count: int, since: int, timer: bool, waiting: dict[int, list], missing: list[list[int]]) -> None:
        since = -1 if not waiting else since if since >= 0 and next_ == was else now
        if waiting and not timer:
            self.handle.registerTimer(since + self.patience)
            timer = True
        self.state.update((next_, count, since, timer, json.dumps([[k, *v] for k, v in waiting.items()]), json.dumps(missing)))

    @staticmethod
    def _drain(session: str, next_: int, count: int, waiting: dict[int, list], out: list) -> tuple[int, int]:
        while next_ in waiting:
            role, timestamp, content, is_turn = waiting.pop(next_)
            if is_turn:
                count += 1
                out.append((session, next_, role, timestamp, content, count, False))
            next_ += 1
        return next_, count

    @staticmethod
    def _lost(line: int, missing: list[list[int]]) -> bool:
        """Whether a line before the next was given up and hasn't come since; it has now."""
        for i, (first, last) in enumerate(missing):
            if first <= line <= last:
                missing[i : i + 1] = [x for x in ([first, line - 1], [line + 1, last]) if x[0] <= x[1]]
                return True
        return False

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        was, count, since, timer, waiting, missing = self._load()
        next_, out = was, []
        for batch in rows:
            for r in batch.sort_values("line", kind="stable").itertuples():
                line, value = int(r.line), [r.role, r.timestamp, r.content, bool(r.is_turn)]
                if line >= next_:
                    waiting[line] = value
                elif self._lost(line, missing) and r.is_turn:
                    count += 1
                    out.append((key[0], line, *value[:3], count, True))
            next_, count = self._drain(key[0], next_, count, waiting, out)
        self._save(timerValues.getCurrentProcessingTimeInMs(), was, next_, count, since, timer, waiting, missing)
        yield pd.DataFrame(out, columns=_TURN)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        """If the line that is waited for hasn't come for long enough, go on behind the gap, and remember it."""
        was, count, since, _, waiting, missing = self._load()
        next_, out, now = was, [], timerValues.getCurrentProcessingTimeInMs()
        if waiting and now - since >= self.patience:
            next_ = min(waiting)
            missing.append([was, next_ - 1])
            next_, count = self._drain(key[0], next_, count, waiting, out)
        self._save(now, was, next_, count, since, False, waiting, missing)
        yield pd.DataFrame(out, columns=_TURN)

    def close(self) -> None:
        pass


def capture(lines: DataFrame, patience: float = 60.0, first: int = 0) -> DataFrame:
    """A stream of transcript lines (session, line, value; lines count from ``first``) as numbered turns, in whatever order they come.

    A turn's number is its place among the session's turns in order of lines, so a line waits for those before it, turns or
    not. Lines that don't come within ``patience`` seconds are given up; should they come after all, they are numbered
    behind what is out already and marked late. Lines that come again are dropped.
    """
    stateful(lines.sparkSession)
    rows = turns.marked(lines)
    kept = [F.when(F.col("is_turn"), F.col(c)).alias(c) for c in ("role", "timestamp", "content")]
    return rows.select("session", "line", *kept, "is_turn").groupBy("session").transformWithStateInPandas(InTurn(int(1000 * patience), first), TURN, "append", "processingTime")


def replay(rows: DataFrame, wave, change, waves: int = 3) -> DataFrame:
    """What ``change`` makes of ``rows`` that come as a stream in ``waves``, by the column ``wave`` (from 0).

    Each wave is a run of its own over what is new, and goes on from the state that the one before has left. A run ends when
    what is new is read: batches without data, which a set timer would ask for again and again, are off meanwhile.
    """
    from mossgrove.sources.scratch import place

    spark = rows.sparkSession
    at = place(spark, "stream")
    schema, key = None, "spark.sql.streaming.noDataMicroBatches.enabled"
    before = spark.conf.get(key)
    for k in range(waves):
        rows.where(wave == k).write.mode("append").parquet(f"{at}/in")
        out = change(spark.readStream.schema(rows.schema).parquet(f"{at}/in"))
        schema = out.schema
        spark.conf.set(key, "false")
        try:
            q = out.writeStream.format("parquet").option("path", f"{at}/out").option("checkpointLocation", f"{at}/state").outputMode("append").trigger(availableNow=True).start()
        finally:
            spark.conf.set(key, before)
        q.awaitTermination()
    return spark.read.schema(schema).parquet(f"{at}/out")
