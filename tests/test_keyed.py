"""State by key: the processors on a handle that keeps state in a dictionary, and once through Spark."""

import json
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from mossgrove.streaming import keyed


class Handle:
    def __init__(self):
        self.values, self.timers = {}, []

    def getValueState(self, name, schema):
        values = self.values

        class Value:
            def exists(self):
                return name in values

            def get(self):
                return values[name]

            def update(self, v):
                values[name] = v

        return Value()

    def registerTimer(self, at):
        self.timers.append(at)


class Clock:
    def __init__(self, now):
        self.now = now

    def getCurrentProcessingTimeInMs(self):
        return self.now


class Session:
    """A session's lines as they come, batch by batch; timers fire when their time has come."""

    def __init__(self, patience=100):
        self.patience, self.handle, self.out, self.now = patience, Handle(), [], 0

    def _processor(self):
        p = keyed.InTurn(self.patience)  # a new one each batch, as after a restart
        p.init(self.handle)
        return p

    def add(self, lines, now, turns=lambda i: i % 5 != 4):
        self.now = now
        rows = pd.DataFrame([("s", i, "user", "", f"t{i}", turns(i)) for i in lines], columns=["session", "line", "role", "timestamp", "content", "is_turn"])
        parts = [rows[:1], rows[1:]] if len(rows) > 1 else [rows]
        self._take(self._processor().handleInputRows(("s",), iter(parts), Clock(now)))

    def tick(self, now):
        for at in [t for t in self.handle.timers if t <= now]:
            self.handle.timers.remove(at)
            self._take(self._processor().handleExpiredTimer(("s",), Clock(now), None))

    def _take(self, frames):
        for f in frames:
            self.out += [(r.line, r.turn_number, r.late) for r in f.itertuples()]


def numbered(n):
    turns = [i for i in range(n) if i % 5 != 4]
    return [(i, k, False) for k, i in enumerate(turns, 1)]


def test_any_order_gives_the_same_turns():
    for seed in range(60):
        random.seed(seed)
        lines = list(range(30)) + random.choices(range(30), k=10)  # some come twice
        random.shuffle(lines)
        s, at = Session(), 0
        while at < len(lines):
            k = random.randrange(1, 8)
            s.add(lines[at : at + k], at)
            at += k
        assert s.out == numbered(30)
        assert json.loads(s.handle.values["state"][4]) == []


def test_a_gap_is_given_up_after_a_while_and_late_lines_still_come():
    s = Session(patience=100)
    s.add([0, 1, 6, 7], 0)
    s.tick(99)
    assert [x[0] for x in s.out] == [0, 1]
    s.tick(100)
    assert [x[:2] for x in s.out] == [(0, 1), (1, 2), (6, 3), (7, 4)]
    s.add([7, 6, 0], 110)  # had already
    s.add([3, 3], 120)
    s.add([8, 5, 2, 2], 130)
    assert s.out[4:] == [(3, 5, True), (8, 6, False), (2, 7, True), (5, 8, True)]


def test_a_timer_of_a_gap_that_has_closed_does_not_end_the_next():
    s = Session(patience=100)
    s.add([1], 0)
    s.add([0, 3], 90)
    s.tick(100)
    assert [x[0] for x in s.out] == [0, 1]
    s.tick(190)
    assert [x[0] for x in s.out] == [0, 1, 3]


def test_pending_is_kept_for_each_kind():
    for seed in range(60):
        random.seed(seed)
        events = [(i, random.choice(["pending", "pending", "done", "failed", "processing", None])) for i in range(25)]
        want, last = [], None
        for pos, status in events:
            if status != "pending" or last != "pending":
                want.append(pos)
            last = status if status in ("pending", "done", "failed") else last
        h, got, at = Handle(), [], 0
        while at < len(events):
            k = random.randrange(1, 7)
            batch = events[at : at + k]
            random.shuffle(batch)
            p = keyed.Pending()
            p.init(h)
            for f in p.handleInputRows(("a", "p", None), iter([pd.DataFrame([(i, "a", "p", None, s) for i, s in batch], columns=["pos", "type", "path", "parent", "status"])]), None):
                got += f.pos.tolist()
            at += k
        assert got == want


@pytest.mark.parametrize("waves", [1, 3])
def test_through_spark(spark, waves):
    line = lambda i: "{bad" if i == 3 else json.dumps({"type": "user" if i % 4 else "system", "message": {"role": "user", "content": f"hello {i}"}})
    rows = spark.createDataFrame([(f"s{k}", i, line(i)) for k in range(3) for i in range(12)], "session string, line bigint, value string")
    got = keyed.replay(rows.unionByName(rows.where("line = 5")), F.col("line") * 7 % waves, keyed.capture, waves).orderBy("session", "line").collect()
    want = [i for i in range(12) if i != 3 and i % 4]
    assert [(r.session, r.line, r.turn_number, r.content, r.late) for r in got] == [(f"s{k}", i, n, f"hello {i}", False) for k in range(3) for n, i in enumerate(want, 1)]
    assert spark.conf.get("spark.sql.streaming.noDataMicroBatches.enabled") == "true"
