"""Ranked lexical search: integer BM25 scores of all documents for a set of items, the best of each item.

A pass over the texts keeps of each document its length and, as bytes, which of the items' terms it has how often. Sums
over that give N, L and document frequencies. Documents are then range-sorted by id and cut into windows of ``WINDOW``
consecutive ones; a window's postings are laid out by term once, each with its share of a score. An item is scored a
term at a time: shares are added into an array of a slot a document, small enough for a cache, while the terms' bitsets
are joined into the occupancy. What is occupied is harvested into the item's heap, if it beats the heap's last; a
task's heaps meet in Spark, dealt out before they are ranked.

Items are taken in blocks of a bounded number of terms; each block is a pass of its own.
"""

from __future__ import annotations

import heapq
from collections import Counter
from collections.abc import Iterator
from functools import reduce
from math import floor, log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mossgrove.llm.common import map_batches, prepare, store

TOP = 20
#: Documents a window: an array of their 64-bit scores is 256 KB.
WINDOW = 1 << 15
#: Terms, repeats included, of a block of items; an item of more is a block of its own.
BLOCK_TERMS = 200_000
#: Over so many tasks an item's finds are dealt before they are ranked.
DEALT = 32
_LAST = (1 << 63) - 1  # where a null id sorts
_KEEP = b"0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
_TABLE = bytes(x if x >= 0x80 else ord(chr(x).lower()) if x in _KEEP else 0x20 for x in range(256))


def terms(text: str | None) -> list[bytes]:
    """Runs of ASCII letters and digits and of anything beyond ASCII, as UTF-8, with A-Z in lower case."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_TABLE).split()


def weight(n: int, df: int) -> int:
    return floor(1000 * log((2 * n + 2) / (2 * df + 1)))


def _blocks(items: DataFrame) -> Iterator[list[tuple[int | None, list[bytes]]]]:
    """Items with a term, in blocks that the driver and each task can hold."""
    block, size = [], 0
    for row in items.select(F.col("item_id").cast("bigint"), "text").toLocalIterator():
        found = terms(row[1])
        if block and size + len(found) > BLOCK_TERMS:
            yield block
            block, size = [], 0
        if found:
            block.append((row[0], found))
            size += len(found)
    if block:
        yield block


def forward(docs: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """doc_id, n (terms in the text), and the vocabulary's terms in it with their counts, as bytes; without empty documents."""
    known = docs.sparkSession.sparkContext.broadcast(vocabulary)
    id_kind = "<u2" if len(vocabulary) <= 1 << 16 else "<u4"

    def make():
        of = known.value

        def work(batch):
            n, ids, counts = [], [], []
            for text in batch["text"].to_pylist():
                words = terms(text)
                n.append(len(words))
                found = Counter([of[w] for w in words if w in of])
                ids.append(np.fromiter(found, id_kind, len(found)).tobytes())
                tf = np.fromiter(found.values(), "<u4", len(found))
                counts.append((tf.astype("u1") if not len(tf) or tf.max() < 256 else tf).tobytes())
            return {"doc_id": batch["doc_id"], "n": n, "ids": ids, "counts": counts}

        return work

    return map_batches(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text"), make, "doc_id bigint, n bigint, ids binary, counts binary").where("n > 0")


def _postings(ids: list[bytes], counts: list[bytes], id_kind: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Term, slot and count of each posting of the documents given."""
    sizes = np.fromiter(map(len, ids), "i8", len(ids)) // np.dtype(id_kind).itemsize
    tf = [np.frombuffer(c, "u1" if len(c) == k else "<u4") for c, k in zip(counts, sizes.tolist())]
    return np.frombuffer(b"".join(ids), id_kind).astype("i8"), np.repeat(np.arange(len(ids)), sizes), np.concatenate(tf).astype("i8") if tf else np.zeros(0, "i8")


def _frequencies(rows: DataFrame, size: int, id_kind: str) -> np.ndarray:
    """In how many documents each term is; a task counts its own first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(size, "i8")
        for batch in batches:
            seen += np.bincount(np.frombuffer(b"".join(batch.column(0).to_pylist()), id_kind), minlength=size)
        at = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(seen[at])], ["term", "df"])

    out = np.zeros(size, "i8")
    for row in rows.select("ids").mapInArrow(run, "term bigint, df bigint").groupBy("term").agg(F.sum("df")).collect():  # a row a term of the block
        out[row[0]] = row[1]
    return out


class Slots:
    """The postings of some documents by term, each with its share of a score."""

    def __init__(self, n: list[int], ids: list[bytes], counts: list[bytes], id_kind: str, weights: np.ndarray, total: int, length: int):
        term, slot, tf = _postings(ids, counts, id_kind)
        m = np.array([100 - 25 + (25 * x * total) // length for x in n], "i8")
        order = np.argsort(term, kind="stable")
        term, self.slot, tf = term[order], slot[order], tf[order]
        self.share = weights[term] * ((1_000_000_000 * tf) // (1000 * tf + 12 * m[self.slot]))
        self.begin = np.searchsorted(term, np.arange(len(weights) + 1))
        self.size, self.bits = len(n), {}

    def occupied(self, t: int) -> np.ndarray:
        """The bitset of the documents that have a term."""
        if t not in self.bits:
            flags = np.zeros(self.size, bool)
            flags[self.slot[self.begin[t] : self.begin[t + 1]]] = True
            self.bits[t] = np.packbits(flags)
        return self.bits[t]

    def harvest(self, item: np.ndarray, times: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
        """Slots of the documents that score more than ``least`` for an item's distinct terms, and their scores."""
        scores, bits = np.zeros(self.size, "i8"), np.zeros((self.size + 7) // 8, "u1")
        some = self.begin[item + 1] > self.begin[item]
        for t, k in zip(item[some].tolist(), times[some].tolist()):
            s, e = self.begin[t], self.begin[t + 1]
            scores[self.slot[s:e]] += self.share[s:e] * k  # a document is but once in a term's postings
            np.bitwise_or(bits, self.occupied(t), out=bits)
        at = np.flatnonzero(np.unpackbits(bits, count=self.size))
        at = at[scores[at] > least]
        return at, scores[at]


def _searched(docs: DataFrame, block: list[tuple[int | None, list[bytes]]], top: int, window: int) -> DataFrame:
    vocabulary = {w: i for i, w in enumerate(sorted({w for _, x in block for w in x}))}
    id_kind = "<u2" if len(vocabulary) <= 1 << 16 else "<u4"
    rows = store(forward(docs, vocabulary), "forward")
    total, length = rows.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    df = _frequencies(rows, len(vocabulary), id_kind)
    weights = np.array([weight(total, int(x)) for x in df], "i8")
    queries = []
    for _, words in block:
        found = Counter(vocabulary[w] for w in words)
        queries.append((np.fromiter(found, "i8", len(found)), np.fromiter(found.values(), "i8", len(found))))
    known = docs.sparkSession.sparkContext.broadcast((weights, queries))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, queries = known.value
        heaps: list[list[tuple[int, int]]] = [[] for _ in queries]  # (score, -id), the worst first

        def score(parts: list[pa.RecordBatch]) -> None:
            t = pa.Table.from_batches(parts)
            ids = t.column("doc_id").fill_null(_LAST).to_numpy()
            w = Slots(*(t.column(k).to_pylist() for k in ("n", "ids", "counts")), id_kind, weights, total, length)
            for heap, (item, times) in zip(heaps, queries):
                at, scores = w.harvest(item, times, heap[0][0] - 1 if len(heap) == top else 0)
                if len(at) > top:
                    best = _best(scores, ids[at], top)
                    at, scores = at[best], scores[best]
                for s, i in zip(scores.tolist(), ids[at].tolist()):
                    if len(heap) < top:
                        heapq.heappush(heap, (s, -i))
                    elif (s, -i) > heap[0]:
                        heapq.heapreplace(heap, (s, -i))

        kept, held = [], 0
        for batch in batches:
            at = 0
            while at < batch.num_rows:
                part = batch.slice(at, window - held)
                kept.append(part)
                at, held = at + part.num_rows, held + part.num_rows
                if held == window:
                    score(kept)
                    kept, held = [], 0
        if kept:
            score(kept)
        found = [(q, -i, s) for q, heap in enumerate(heaps) for s, i in heap]
        q, i, s = (np.array([x[k] for x in found], "i8") for k in range(3))
        yield pa.RecordBatch.from_arrays([pa.array(q), pa.array(i, mask=i == _LAST), pa.array(s)], ["q", "doc_id", "score"])

    in_order = rows.repartitionByRange(F.col("doc_id").asc_nulls_last(), F.col("n"), F.xxhash64("ids")).sortWithinPartitions(F.col("doc_id").asc_nulls_last())
    found = in_order.mapInArrow(run, "q bigint, doc_id bigint, score bigint")
    order = [F.desc("score"), F.col("doc_id").asc_nulls_last()]
    some = found.withColumn("dealt", F.pmod(F.xxhash64("doc_id"), F.lit(DEALT)))
    some = some.withColumn("rank", F.row_number().over(Window.partitionBy("q", "dealt").orderBy(*order))).where(F.col("rank") <= top)
    best = some.withColumn("rank", F.row_number().over(Window.partitionBy("q").orderBy(*order))).where(F.col("rank") <= top)
    # the last shuffle of a block has ``top`` rows an item; ids come back by place, as null and repeated ones do
    names = docs.sparkSession.createDataFrame([(q, id_) for q, (id_, _) in enumerate(block)], "q bigint, item_id bigint")
    return best.join(F.broadcast(names), "q").select("item_id", "rank", "doc_id", "score")


def _best(scores: np.ndarray, ids: np.ndarray, top: int) -> np.ndarray:
    """The ``top`` highest, equal ones by id."""
    least = np.partition(scores, -top)[-top]
    at = np.flatnonzero(scores >= least)
    return at[np.lexsort((ids[at], -scores[at]))[:top]]


def search(docs: DataFrame, items: DataFrame, top: int = TOP, window: int = WINDOW) -> DataFrame:
    """item_id, rank, doc_id and score of the ``top`` best of ``docs`` (doc_id, text) for each row of ``items`` (item_id, text).

    Scores are above 0; equal ones go by doc_id, a null one last. Repeated rows of either side count each for itself, also
    with a null id. Null, empty or wordless texts match nothing, very long ones count whole; empty tables give no rows. Other columns are ignored.
    """
    spark = prepare(docs.sparkSession)
    found = [_searched(docs, block, top, window) for block in _blocks(items)]
    return reduce(DataFrame.unionByName, found) if found else spark.createDataFrame([], "item_id bigint, rank int, doc_id bigint, score bigint")


_TERMS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
ORACLE = rf"""
WITH d AS (SELECT doc_id, {_TERMS} AS w FROM documents), l AS (SELECT doc_id, len(w)::BIGINT AS n, w FROM d WHERE len(w) > 0),
c AS (SELECT count(*)::BIGINT AS total, sum(n)::BIGINT AS length FROM l),
i AS (SELECT item_id, w, count(*)::BIGINT AS times FROM (SELECT item_id, unnest({_TERMS}) AS w FROM benchmark) GROUP BY item_id, w),
p AS (SELECT doc_id, n, w, count(*)::BIGINT AS tf FROM (SELECT doc_id, n, unnest(w) AS w FROM l) WHERE w IN (SELECT w FROM i) GROUP BY doc_id, n, w),
f AS (SELECT w, floor(1000 * ln((2 * (SELECT total FROM c) + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS weight FROM p GROUP BY w),
s AS (SELECT i.item_id, p.doc_id, sum(i.times * f.weight * ((1000000000 * p.tf) // (1000 * p.tf + 12 * (75 + ((25 * p.n * c.total) // c.length)))))::BIGINT AS score
      FROM p JOIN f USING (w) JOIN i USING (w), c GROUP BY i.item_id, p.doc_id),
r AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT AS rank, doc_id, score FROM s WHERE score > 0)
SELECT * FROM r WHERE rank <= {TOP}
"""
