"""Vector codes: a small codebook for each part of a vector, fitted by Yinyang Lloyd over integers.

Components are whole numbers, so that distances are exact. The entries of a part's codebook are put into groups. A vector
keeps, for each part, an upper bound of the distance to its entry and one lower bound for each group of the distance to
any other of its entries. When entries move, the bounds move with them by as much; a group is scanned only if its lower
bound no longer exceeds the upper one. Bounds are floats that are rounded away from what they bound, and what they
leave open is settled by whole-number distances, ties by the lower index, so the result is plain Lloyd's.

Each round is a pass over rows that are written with their bounds; sums by entry are made in each task before they meet.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mossgrove.llm.common import counted, drop, prepare, salted, store

PARTS, ENTRIES, ROUNDS, GROUPS = 16, 64, 2, 6
SCALE = 256
#: Whole-number components are kept within this, so that squares and their sums stay within 64 bits.
MOST = 1 << 26
_UP, _DOWN = np.float32(np.inf), np.float32(-np.inf)


def kept(rows: DataFrame) -> DataFrame:
    """vec_id, label and v, the vector, of rows whose vector is not null and has finite components only."""
    v = F.col("v")
    out = rows.select(F.col("vec_id").cast("bigint").alias("vec_id"), "label", F.col("embedding").cast("array<double>").alias("v"))
    return out.where(v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & (F.abs(x) < float("inf"))))


def whole(rows: DataFrame, scale: int = SCALE, parts: int = PARTS) -> tuple[DataFrame, int]:
    """vec_id, label and x, the components as whole numbers in bytes; and how many components a part has.

    All vectors are as long as the longest, filled up to a multiple of ``parts`` with zeros.
    """
    own = kept(rows)
    longest = own.agg(F.max(F.size("v"))).first()[0] or 0
    width = max(1, -(-longest // parts))
    size = width * parts

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = batch.column(2)
            lengths = np.diff(v.offsets.to_numpy())
            x = np.zeros((batch.num_rows, size), "<i4")
            with np.errstate(over="ignore"):
                x[np.arange(size)[None, :] < lengths[:, None]] = np.clip(np.floor(scale * v.flatten().to_numpy(zero_copy_only=False)), -MOST, MOST)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([r.tobytes() for r in x], pa.binary())], ["vec_id", "label", "x"])

    label = rows.schema["label"].dataType.simpleString()
    return store(own.mapInArrow(run, f"vec_id bigint, label {label}, x binary"), "whole"), width


def grouped(books: np.ndarray, groups: int) -> np.ndarray:
    """The group of each entry of each part: a few rounds of Lloyd's over the entries themselves. It affects cost only."""
    out = np.zeros(books.shape[:2], "i8")
    for p, book in enumerate(books.astype("f8")):
        k = min(groups, len(book))
        if not k:
            continue
        centres = book[np.linspace(0, len(book) - 1, k).astype(int)]
        for _ in range(5):
            own = ((book[:, None] - centres[None]) ** 2).sum(2).argmin(1)
            centres = np.array([book[own == g].mean(0) if (own == g).any() else centres[g] for g in range(k)])
        out[p] = own
    return out


def _exact(x: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Squared distances of rows to entries, as whole numbers."""
    out = np.zeros((len(x), len(entries)), "i8")
    for d in range(x.shape[1]):
        out += (x[:, d, None].astype("i8") - entries[None, :, d]) ** 2
    return out


def _above(x: np.ndarray) -> np.ndarray:
    return np.nextafter(x.astype("f4"), _UP)


def _below(x: np.ndarray) -> np.ndarray:
    return np.nextafter(x.astype("f4"), _DOWN)


def assign(x: np.ndarray, book: np.ndarray, group: np.ndarray, groups: int, code: np.ndarray | None = None, upper: np.ndarray | None = None, lower: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """code, upper and lower of rows of one part; and how many distances it took.

    ``code``, ``upper`` and ``lower`` are those of before, with bounds that hold for ``book``; without them all is scanned.
    """
    n, none = len(x), np.iinfo("i8").max
    members = [np.flatnonzero(group == g) for g in range(groups)]
    if code is None:
        rows, old, upper, lower = np.arange(n), None, np.zeros(n, "f4"), np.zeros((n, groups), "f4")
        scan, d, took = np.ones((n, groups), bool), _exact(x, book), n * len(book)
        code = np.zeros(n, "i8")
    else:
        code, upper, lower = code.copy(), upper.copy(), lower.copy()
        rows = np.flatnonzero(lower.min(1) <= upper)
        old, took = code[rows], len(rows)
        own = ((x[rows].astype("i8") - book[old]) ** 2).sum(1)  # what has drifted is made exact first
        scan = lower[rows] <= _above(np.sqrt(own.astype("f8")))[:, None]
        d = np.full((len(rows), len(book)), none)
        for g, m in enumerate(members):
            at = np.flatnonzero(scan[:, g])
            d[np.ix_(at, m)] = _exact(x[rows[at]], book[m])
            took += len(at) * len(m)
        d[np.arange(len(rows)), old] = own
    line = np.arange(len(rows))
    new = d.argmin(1)  # the first of equals
    code[rows], upper[rows] = new, _above(np.sqrt(d[line, new].astype("f8")))
    d[line, new] = none
    for g, m in enumerate(members):
        if len(m):
            lower[rows, g] = np.where(scan[:, g], _below(np.sqrt(d[:, m].min(1).astype("f8"))), lower[rows, g])
    if old is not None:  # an entry that is left counts among the others of its group, also of one that wasn't scanned
        left = np.flatnonzero((new != old) & ~scan[line, group[old]])
        at = rows[left], group[old[left]]
        lower[at] = np.minimum(lower[at], _below(np.sqrt(own[left].astype("f8"))))
    return code, upper, lower, took


def _pass(rows: DataFrame, books: np.ndarray, group: np.ndarray, groups: int, drift: np.ndarray | None, last: bool) -> DataFrame:
    """Rows with code and, unless it is the ``last`` pass, their bounds; else with error."""
    parts, _, width = books.shape
    far = None if drift is None else np.array([[drift[p][group[p] == g].max(initial=0.0) for g in range(groups)] for p in range(parts)])
    known = rows.sparkSession.sparkContext.broadcast((books, group, drift, far))
    more = "error bigint, took bigint" if last else "upper binary, lower binary, took bigint"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books, group, drift, far = known.value
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            column = lambda k, kind, *shape: np.frombuffer(b"".join(batch.column(k).to_pylist()), kind).reshape(n, *shape)
            x = column("x", "<i4", parts, width)
            codes, uppers, lowers = np.zeros((n, parts), "u1"), np.zeros((n, parts), "f4"), np.zeros((n, parts, groups), "f4")
            errors, took = np.zeros(n, "i8"), 0
            if drift is not None:
                codes, uppers, lowers = column("code", "u1", parts), column("upper", "<f4", parts), column("lower", "<f4", parts, groups)
                uppers = np.stack([_above(uppers[:, p].astype("f8") + drift[p][codes[:, p]]) for p in range(parts)], 1)
                lowers = _below(lowers.astype("f8") - far[None])
                codes = codes.copy()
            for p in range(parts):
                before = () if drift is None else (codes[:, p].astype("i8"), uppers[:, p], lowers[:, p])
                code, uppers[:, p], lowers[:, p], k = assign(x[:, p], books[p], group[p], groups, *before)
                codes[:, p], took = code, took + k
                if last:
                    errors += ((x[:, p].astype("i8") - books[p][code]) ** 2).sum(1)
            bytes_ = lambda a: pa.array([r.tobytes() for r in a], pa.binary())
            tail = [pa.array(errors)] if last else [bytes_(uppers), bytes_(lowers)]
            took_ = pa.array(np.append(took, np.zeros(n - 1, "i8")))
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in ("vec_id", "label")), *([] if last else [batch.column("x")]), bytes_(codes), *tail, took_], out)

    label = rows.schema["label"].dataType.simpleString()
    out = ["vec_id", "label", *([] if last else ["x"]), "code", *(["error"] if last else ["upper", "lower"]), "took"]
    schema = f"vec_id bigint, label {label}, {'' if last else 'x binary, '}code binary, {more}"
    return store(rows.mapInArrow(run, schema), "codes")


def _moved(rows: DataFrame, books: np.ndarray) -> np.ndarray:
    """The codebooks after a round: floors of means; a task sums its rows by entry first."""
    parts, entries, width = books.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = np.zeros((parts * entries, width), "i8"), np.zeros(parts * entries, "i8")
        for batch in batches:
            n = batch.num_rows
            x = np.frombuffer(b"".join(batch.column(0).to_pylist()), "<i4").reshape(n * parts, width)
            at = (np.frombuffer(b"".join(batch.column(1).to_pylist()), "u1").reshape(n, parts) + np.arange(parts) * entries).ravel()
            counts += np.bincount(at, minlength=len(counts))
            order = np.argsort(at, kind="stable")
            first = np.flatnonzero(np.diff(at[order], prepend=-1))
            if n:
                sums[at[order][first]] += np.add.reduceat(x[order].astype("i8"), first)
        used = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(counts[used]), pa.array([r.tolist() for r in sums[used]], pa.list_(pa.int64()))], ["at", "n", "sums"])

    found = rows.select("x", "code").mapInArrow(run, "at bigint, n bigint, sums array<bigint>")
    total = found.groupBy("at").agg(F.sum("n"), *(F.sum(F.col("sums")[d]) for d in range(width)))
    out = books.copy().reshape(parts * entries, width)
    for r in total.collect():  # a row an entry
        out[r[0]] = [s // r[1] for s in r[2:]]
    return out.reshape(books.shape)


def compress(rows: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, groups: int = GROUPS, scale: int = SCALE) -> tuple[DataFrame, np.ndarray, list[int]]:
    """vec_id, label, code (a byte a part) and error of rows (vec_id, embedding, label); the codebooks; distances a pass.

    Rows whose vector is null or has a null or non-finite component are left out. A component is floor(scale * x), kept
    within 2^26; shorter vectors are filled up with zeros. Codebooks start with the vectors of the least ids (null ids
    last, equal ids by their components); with fewer rows they are smaller. Repeated rows count each for itself. An empty table
    gives no rows; other columns are ignored.
    """
    prepare(rows.sparkSession)
    now, width = whole(rows, scale, parts)
    seeds = now.orderBy(F.col("vec_id").asc_nulls_last(), "x").limit(entries).select("x").collect()
    books = np.array([np.frombuffer(r[0], "<i4").reshape(parts, width) for r in seeds], "i8").reshape(len(seeds), parts, width).transpose(1, 0, 2)
    group, drift, took = grouped(books, groups), None, []
    for round_ in range(rounds + 1):
        then = _pass(now, books, group, groups, drift, round_ == rounds)
        drop(now)
        now = then
        took.append(now.agg(F.coalesce(F.sum("took"), F.lit(0))).first()[0])
        if round_ < rounds:
            moved = _moved(now, books)
            drift = np.nextafter(np.sqrt(((moved - books) ** 2).sum(2).astype("f8")), np.inf)
            books = moved
    return now.drop("took"), books, took


def codes(rows: DataFrame) -> DataFrame:
    """vec_id, code in hexadecimal, error, label_error and codebooks_sha256, as compress() makes them of ``rows``.

    label_error sums the errors of rows of equal label, nulls together. An empty table gives no rows. Other columns are ignored.
    """
    found, books, _ = compress(rows)
    digest = hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()
    keyed = found.select("vec_id", "code", "error", F.coalesce("label", F.lit(0)).alias("label"), F.col("label").isNull().alias("none"))
    sums = counted(keyed.groupBy("label", "none").agg(F.sum("error").alias("label_error")))
    out = salted(keyed, sums, ["label", "none"], "vec_id")
    return out.select("vec_id", F.lower(F.hex("code")).alias("code"), "error", "label_error", F.lit(digest).alias("codebooks_sha256"))


ORACLE = f"""
WITH k AS (SELECT vec_id, label, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)::BIGINT) AS v, len(embedding) // {PARTS} AS w FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)),
p AS (SELECT vec_id, label, part, v[part * w + 1 : (part + 1) * w] AS x FROM k, (SELECT unnest(range({PARTS})) AS part)),
b0 AS (SELECT part, rank - 1 AS entry, x AS c FROM (SELECT part, x, row_number() OVER (PARTITION BY part ORDER BY vec_id) AS rank FROM p) WHERE rank <= {ENTRIES}),
""" + "".join(f"""
a{n} AS (SELECT vec_id, label, x, part, min(row(d, entry)) AS best FROM (SELECT p.*, entry, list_sum(list_transform(list_zip(x, c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d FROM p JOIN b{n} USING (part)) GROUP BY ALL),
""" + (f"""
m{n} AS (SELECT part, entry, list(mean ORDER BY pos) AS c FROM (SELECT part, best[2] AS entry, pos, floor(sum(x[pos])::DOUBLE / count(*))::BIGINT AS mean
         FROM (SELECT part, best, x, unnest(range(1, len(x) + 1)) AS pos FROM a{n}) GROUP BY ALL) GROUP BY ALL),
b{n + 1} AS (SELECT part, entry, coalesce(m{n}.c, b{n}.c) AS c FROM b{n} LEFT JOIN m{n} USING (part, entry)),
""" if n < ROUNDS else "") for n in range(ROUNDS + 1)) + f"""
r AS (SELECT vec_id, label, string_agg(printf('%02x', best[2]), '' ORDER BY part) AS code, sum(best[1])::BIGINT AS error FROM a{ROUNDS} GROUP BY vec_id, label)
SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error,
       sha256((SELECT string_agg(array_to_string(c, ','), ',' ORDER BY part, entry) FROM b{ROUNDS})) AS codebooks_sha256
FROM r
"""  # fmt: skip
