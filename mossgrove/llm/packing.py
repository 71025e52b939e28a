"""Best-fit packing of tokenised documents into sequences of a fixed length.

Bulk-synchronous best-fit. Documents are range-sorted by length over the cluster, so a document's place in that
order, less the start of its length's run, is its rank. What the rounds work on are tables of runs: a run of
documents is a length with a first rank and a count, a run of gaps a size with a first bin and a count.
In a round every range of sizes is swept in a task of its own, from the longest down: documents take the bins
of the successor, the least gap that is long enough, and the longest, then the least by rank, come first where there are too few. What a
range leaves over, documents without a gap and gaps without a document, meets in a last sweep, which gives the same matches as one
sweep over all sizes. Gaps that a round has shortened are open again in the next. Of the documents that found
none, those of which as few fit in a bin as of the longest open new bins. Rounds go on until no document is left.

The rounds leave intervals ``documents of rank a..b go to bins c..d``; every task then looks its documents up in them, so no document
is moved, joined or collected. Bounds, however many documents there are: at most ``capacity`` runs of documents; a round
cuts at most as many runs of gaps in three as there are runs of documents, and adds at most ``capacity`` new ones,
with an interval for each document that a bin takes of one length. Of the documents that a round leaves, none
fits as few to a bin as the longest did, so there are no more rounds than values of ``capacity // length``: 63 for 1024.
"""

from __future__ import annotations

import zlib
from array import array
from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mossgrove.llm.common import drop, map_batches, store, texts_of
from mossgrove.llm.tokens import Encoder

CAPACITY = 1024
END_ID = 2
#: Of sizes, each swept in a task of its own.
RANGES = 8
#: Runs of documents left, runs of gaps, intervals placed, and runs of gaps that a round makes.
DOCS, GAP, PLACED, MADE = range(4)
_NAMES = ["kind", "size", "first", "n", "bin", "offset"]
_RUNS = ", ".join(f"{c} bigint" for c in _NAMES)
PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of ``n`` ids: all are ``capacity`` long but the first, which has the rest."""
    first = n % capacity or min(n, capacity)
    return [(0, first)] + [(s, capacity) for s in range(first, n, capacity)]


def sweep(rows: pd.DataFrame, capacity: int, bins: int | None = None) -> pd.DataFrame:
    """One successor sweep over runs of documents and of gaps (_RUNS): what it placed and made, and what it left over.

    With ``bins``, the number of bins so far, the documents left over of which as few fit in a bin as of the longest open new ones.
    """
    out = rows[rows.kind >= PLACED].values.tolist()
    gaps: list[list[int]] = []  # size, first bin, bins; the least on top

    def place(length: int, first: int, n: int, gap: int, bin_: int, free: int) -> int:
        """Puts documents of a run in a run of bins, as many in each as it takes; gives the number of bins used."""
        each = gap // length
        whole, rest = min(free, n // each), 0
        out.extend([PLACED, length, first + slot * whole, whole, bin_, capacity - gap + slot * length] for slot in range(each if whole else 0))
        if whole and gap > each * length:
            out.append([MADE, gap - each * length, bin_, whole, 0, 0])
        if whole < free and n > whole * each:
            rest = n - whole * each
            out.extend([PLACED, length, first + whole * each + slot, 1, bin_ + whole, capacity - gap + slot * length] for slot in range(rest))
            if gap > rest * length:
                out.append([MADE, gap - rest * length, bin_ + whole, 1, 0, 0])
        return whole + (rest > 0)

    left: list[list[int]] = []
    events = rows[rows.kind < PLACED].sort_values(["size", "kind", "first"], ascending=[False, False, True])
    for kind, size, first, n in events[["kind", "size", "first", "n"]].values.tolist():
        if kind == GAP:
            gaps.append([size, first, n])
            continue
        while n and gaps:
            gap, bin_, free = gaps[-1]
            used = place(size, first, n, gap, bin_, free)
            done = min(n, used * (gap // size))
            first, n = first + done, n - done
            gaps[-1] = [gap, bin_ + used, free - used]
            if free == used:
                gaps.pop()
        if n:
            left.append([size, first, n])
    if bins is not None and left:
        fit = capacity // left[0][0]
        for size, first, n in [x for x in left if capacity // x[0] == fit]:
            bins += place(size, first, n, capacity, bins, n)
        left = [x for x in left if capacity // x[0] != fit]
    out += [[DOCS, size, first, n, 0, 0] for size, first, n in left] + [[GAP, size, first, n, 0, 0] for size, first, n in gaps]
    return pd.DataFrame(out, columns=_NAMES, dtype="int64")


def _sweeper(capacity: int, bins: int | None = None) -> Callable[[pd.DataFrame], pd.DataFrame]:
    return lambda rows: sweep(rows, capacity, bins)


def rounds(runs: DataFrame, capacity: int, ranges: int = RANGES) -> DataFrame:
    """Packs runs of documents (length, n): intervals (length, first, n, bin, offset) of their ranks, stored."""
    runs = runs.select(F.lit(DOCS).alias("kind"), F.col("length").alias("size"), F.lit(0).alias("first"), "n", F.lit(0).alias("bin"), F.lit(0).alias("offset"))
    state, bins, left = store(runs.select(*(F.col(c).cast("bigint").alias(c) for c in _NAMES)), "runs"), 0, True
    while left:
        open_ = state.where(F.col("kind") != PLACED)
        by_range = open_.groupBy(F.floor((F.col("size") - 1) * ranges / capacity)).applyInPandas(_sweeper(capacity), _RUNS)
        swept = by_range.groupBy().applyInPandas(_sweeper(capacity, bins), _RUNS)
        reopened = swept.withColumn("kind", F.when(F.col("kind") == MADE, F.lit(GAP).cast("bigint")).otherwise(F.col("kind")))
        then = store(state.where(F.col("kind") == PLACED).unionByName(reopened), "runs")
        drop(state)
        state = then
        placed = F.col("kind") == PLACED
        bins, left = state.agg(F.coalesce(F.max(F.when(placed, F.col("bin") + F.col("n"))), F.lit(0)), F.count_if(F.col("kind") == DOCS) > 0).first()
    return state


def pieces(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """A row for each piece of each document (text or null, which is empty) of doc_id and text."""

    def make():
        encode = Encoder(tokenizer)
        end = array("I", [end_id]).tobytes()

        def work(batch):
            out = {k: [] for k in ("doc_id", "piece", "start", "length", "ids_crc32")}
            for doc_id, text in zip(batch["doc_id"].to_pylist(), texts_of(batch["text"])):
                ids = encode(text) + end
                for k, (s, n) in enumerate(cut(len(ids) // 4, capacity)):
                    out["doc_id"].append(doc_id)
                    out["piece"].append(k)
                    out["start"].append(s)
                    out["length"].append(n)
                    out["ids_crc32"].append(zlib.crc32(ids[4 * s : 4 * (s + n)]))
            return out

        return work

    return map_batches(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text"), make, PIECES)


def best_fit(rows: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Adds sequence_id and offset to rows that have doc_id, piece and a length from 1 to ``capacity``."""
    order = [F.col("length").desc(), "doc_id", "piece", "start", "ids_crc32"]

    def number(batches):
        at, task = 0, TaskContext.get().partitionId()
        for batch in batches:
            n = batch.num_rows
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(n, task, "i8")), pa.array(np.arange(at, at + n))], [*batch.schema.names, "task", "at"])
            at += n

    ranged = store(rows.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(number, f"{PIECES}, task bigint, at bigint"), "ranged")
    runs = store(ranged.groupBy("length").agg(F.count("*").alias("n")), "lengths")
    counts = sorted(runs.select("length", "n").collect(), reverse=True)  # at most `capacity` rows
    start = dict(zip((x for x, _ in counts), np.cumsum([0, *(n for _, n in counts)]).tolist()))
    tasks = sorted(ranged.groupBy("task").count().collect())  # a number for each task
    first = dict(zip((t for t, _ in tasks), np.cumsum([0, *(n for _, n in tasks)]).tolist()))
    found = rounds(runs, capacity)
    intervals = found.where(F.col("kind") == PLACED).select("size", "first", "bin", "offset").collect()  # of runs, see above
    plan = np.array(sorted((start[size] + at, bin_, offset) for size, at, bin_, offset in intervals), "i8").reshape(-1, 3)
    drop(found)
    drop(runs)

    def make():
        def work(batch):
            place = np.array([first[t] for t in batch["task"].to_pylist()], "i8") + batch["at"].to_numpy(zero_copy_only=False)
            k = np.searchsorted(plan[:, 0], place, side="right") - 1
            return batch | {"sequence_id": plan[k, 1] + place - plan[k, 0], "offset": plan[k, 2]}

        return work

    return map_batches(ranged, make, f"{PIECES}, sequence_id bigint, offset bigint")


def pack(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """Packs every document of ``docs`` (doc_id, text; other columns are ignored) into sequences.

    A document is its token ids and the end id. Only documents over ``capacity`` are cut. A null or empty
    text is the end id alone; a very long one is as many pieces as it needs; null ids and repeated rows are packed like any
    other; an empty table gives no rows. Equal lengths are ranked by doc_id, piece and checksum; rows equal in all of these are alike.
    """
    return best_fit(store(pieces(docs, tokenizer, capacity), "pieces"), capacity)
