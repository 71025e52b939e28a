"""WARC archives: one record a page, equal payloads stored once, and reading them back in splits.

Writing: rows become records in the JVM and Spark's text writer puts them into files, with the records' own ending as
its line ending. Of records with equal payloads one is a response, the others are revisits that refer to it.

Reading: files are read in splits, cut at the magic that begins a record. As payloads may hold the magic too, a cut is but
a candidate; its header names its length, and so the offset of its successor. Each task follows the chains of candidates
within its split and says at which offset each leaves it. Pointer jumping over those exits, from the start of each file,
finds where the chain of true records enters each split; true records are those on the chain from there. Whether a
candidate is on the chain from another of its split is a comparison of two intervals, numbered in the task, so that
nothing but a row a split is joined. No payload is shuffled but those that hold the magic themselves.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from mossgrove.llm.common import SALTS, counted, drop, prepare, salted, store
from mossgrove.sources.scratch import delete, place

MAGIC = "WARC/1.1\r\n"
BREAK = "\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
#: Payloads of fewer bytes are stored each time.
LEAST = 0
#: Bits of an offset below a bucket's, in which segments meet the records they are part of.
BUCKET = 20


def base32(hex40: Column) -> Column:
    """Upper-case base32 of 160 bits given as hexadecimal digits."""

    def char(i: Column) -> Column:
        two = F.conv(F.substring(hex40, F.floor(5 * i / 4).cast("int") + 1, F.lit(2)), 16, 10).cast("int")
        return F.substring(F.lit(ALPHABET), F.floor(two / F.pow(F.lit(2), 3 - 5 * i % 4)).cast("int").bitwiseAND(F.lit(31)) + 1, F.lit(1))

    return F.when(hex40.isNotNull(), F.array_join(F.transform(F.sequence(F.lit(0), F.lit(31)), char), ""))


def _rows(pages: DataFrame) -> DataFrame:
    payload = F.coalesce(F.col("html").cast("binary"), F.lit(b""))
    url = F.regexp_replace(F.coalesce(F.col("url").cast("string"), F.lit("")), r"[\r\n]", "%0A")
    return pages.select(F.col("page_id").cast("bigint").alias("page_id"), url.alias("url"), payload.alias("payload"))


def _first(rows: DataFrame, least: int) -> DataFrame:
    """key and first, the least page_id, of payloads that several rows have."""
    keys = rows.where(F.length("payload") >= least).select(F.sha2("payload", 256).alias("key"), "page_id")
    same = keys.groupBy("key").agg(F.min("page_id").alias("first"), F.count("*").alias("n"))
    return counted(same.where("n > 1 AND first IS NOT NULL").select("key", "first"))


def write(pages: DataFrame, path: str, least: int = LEAST, date: str = "1970-01-01T00:00:00Z") -> None:
    """Writes a record for each row of ``pages`` (page_id, url, html) to files under ``path``.

    The payload is the html in UTF-8 (null: empty) after an HTTP head. Of the rows with equal payloads of ``least`` bytes
    or more, the one with the least page_id is a response and the others are revisits of it; rows that repeat that
    page_id are responses too, and without any id there all are. Null ids are kept; line ends in a url are escaped. Very long
    payloads are stored whole; an empty table makes an archive without records; other columns are ignored.
    """
    rows = _rows(pages)
    salt = F.pmod(F.xxhash64("page_id"), F.lit(SALTS)).cast("int")
    keyed = rows.withColumns({"key": F.when(F.length("payload") >= least, F.sha2("payload", 256)), "salt": salt})
    first = _first(rows, least).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    again = F.col("first").isNotNull() & ~F.col("first").eqNullSafe(F.col("page_id"))
    name = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("none")), F.lit(">"))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.length("payload").cast("string"), F.lit(BREAK))
    kind = F.when(again, F.lit("revisit")).otherwise(F.lit("response"))
    refers = F.when(again, F.concat(F.lit("WARC-Refers-To: "), name(F.col("first")), F.lit(f"\r\nWARC-Profile: {PROFILE}\r\n"))).otherwise(F.lit(""))
    size = F.octet_length(http) + F.when(again, F.lit(0)).otherwise(F.length("payload"))
    head = F.concat(
        F.lit(f"{MAGIC}WARC-Type: "), kind, F.lit("\r\nWARC-Record-ID: "), name(F.col("page_id")), F.lit(f"\r\nWARC-Date: {date}\r\nWARC-Target-URI: "), F.col("url"),
        F.lit("\r\nWARC-Payload-Digest: sha1:"), base32(F.sha1("payload")), F.lit("\r\n"), refers, F.lit("Content-Type: application/http; msgtype=response\r\nContent-Length: "), size.cast("string"), F.lit(BREAK), http,
    )
    record = F.concat(head.cast("binary"), F.when(again, F.lit(b"")).otherwise(F.col("payload"))).cast("string")
    keyed.join(first, ["key", "salt"], "left").select(record.alias("value")).write.option("lineSep", BREAK).text(path)


def _segments(spark: SparkSession, path: str) -> DataFrame:
    """What lies between two magics, in the order of the file within each of its blocks."""
    return spark.read.option("lineSep", MAGIC).text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), "value")


def _field(head: Column, name: str, value: str = r"([^\r\n]*)") -> Column:
    return F.nullif(F.regexp_extract(head, rf"(?im)^{name}:[ \t]*{value}", 1), F.lit(""))


def _parsed(segments: DataFrame, value: str = "value") -> DataFrame:
    """``segments`` with what their header says, and the payload's bytes and SHA-1 if the segment holds all of it."""
    v = F.col(value)
    head = F.when(v.contains(BREAK), F.substring_index(v, BREAK, 1))
    out = segments.withColumns({"size": F.octet_length(v).cast("bigint"), "head": head})
    begin, length = F.octet_length("head") + 4, _field(F.col("head"), "Content-Length", r"([0-9]{1,18})").cast("bigint")
    out = out.withColumns({"begin": begin.cast("bigint"), "length": length})
    body = F.when(F.col("begin") + F.col("length") <= F.col("size"), F.substring(v.cast("binary"), F.col("begin").cast("int") + 1, F.col("length").cast("int")))
    out = out.withColumn("body", body)
    http = _field(F.col("head"), "Content-Type").startswith("application/http") & F.col("body").cast("string").contains(BREAK)
    skip = F.when(http, F.octet_length(F.substring_index(F.col("body").cast("string"), BREAK, 1)) + 4).otherwise(F.lit(0))
    out = out.withColumn("payload", F.substring("body", skip + 1, F.length("body") - skip))
    id_ = lambda name: _field(F.col("head"), name, r"<urn:page:(-?[0-9]+)>").cast("bigint")
    fields = {"type": _field(F.col("head"), "WARC-Type"), "page_id": id_("WARC-Record-ID"), "refers": id_("WARC-Refers-To"), "said": _field(F.col("head"), "WARC-Payload-Digest", r"sha1:([A-Z2-7]{32})")}
    fields |= {"bytes": F.length("payload").cast("bigint"), "sha1": F.sha1("payload")}
    return out.withColumns(fields).select(*(c for c in segments.columns if c != value), "size", "begin", "length", *fields)


def chains(starts: np.ndarray, nexts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of candidates in order of ``starts``, with ``nexts`` their successors' offsets (-1: none): exit, pre, post.

    exit is the first offset behind the last start that following successors leads to, -1 if they lead nowhere. Candidate
    c is on the chain from e if pre[c] <= pre[e] < post[c].
    """
    n = len(starts)
    at = np.searchsorted(starts, nexts)
    inside = (nexts >= 0) & (at < n)
    inside[inside] = starts[at[inside]] == nexts[inside]
    up = np.where(inside & (at > np.arange(n)), at, -1).tolist()
    size, pre = [1] * n, [0] * n
    exits = np.where((nexts > starts[-1]) if n else nexts >= 0, nexts, -1).tolist()
    for i, p in enumerate(up):
        if p >= 0:
            size[p] += size[i]
    free, roots = [0] * n, 0
    for i in range(n - 1, -1, -1):
        p = up[i]
        if p < 0:
            pre[i], roots = roots, roots + size[i]
        else:
            pre[i], free[p], exits[i] = free[p], free[p] + size[i], exits[p]
        free[i] = pre[i] + 1
    pre_ = np.array(pre, "i8")
    return np.array(exits, "i8"), pre_, pre_ + np.array(size, "i8")


_NARROW = "file string, block bigint, size bigint, begin bigint, length bigint, type string, page_id bigint, refers bigint, said string, bytes bigint, sha1 string"


def candidates(spark: SparkSession, path: str) -> DataFrame:
    """A row a segment: what its header says, and offsets from where its block begins.

    start is its magic's, next its successor's (null: its header names no length), leaves where its chain leaves the
    block, and pre and post tell what is on whose chain. The last row of a block has the block's bytes in total.
    """
    own = _parsed(_segments(spark, path))
    schema = f"{_NARROW}, start bigint, next bigint, leaves bigint, pre bigint, post bigint, total bigint"

    def done(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(parts).combine_chunks().to_batches()[0]
        sizes, begin, length = (t.column(k).fill_null(-1).to_numpy() for k in ("size", "begin", "length"))
        ends = np.cumsum(sizes + len(MAGIC))
        start = ends - sizes - 2 * len(MAGIC)
        first = t.column("block")[0].as_py() == 0  # before the first magic of a file there is no record
        good = (begin >= 0) & (length >= 0)
        good[:1] &= not first
        next_ = np.where(good, start + len(MAGIC) + begin + length + 4, -1)
        leaves, pre, post = chains(start, next_)
        n = t.num_rows
        maybe = lambda x: pa.array(x, pa.int64(), mask=x < 0)
        more = [pa.array(start), maybe(next_), maybe(leaves), pa.array(pre), pa.array(post), pa.array(np.full(n, ends[-1]), mask=np.arange(n) < n - 1)]
        return pa.RecordBatch.from_arrays([*t.columns, *more], [*t.schema.names, "start", "next", "leaves", "pre", "post", "total"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept, of = [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()))
            cuts = [0, *(i for i in range(1, len(keys)) if keys[i] != keys[i - 1]), len(keys)]
            for s, e in zip(cuts, cuts[1:]):
                if kept and keys[s] != of:
                    yield done(kept)
                    kept = []
                kept.append(batch.slice(s, e - s))
                of = keys[s]
        if kept:
            yield done(kept)

    return own.select([c.split()[0] for c in _NARROW.split(", ")]).mapInArrow(run, schema)


def _entries(cand: DataFrame, bases: DataFrame) -> DataFrame:
    """file, block and pre of the true record at which the chain from a file's start enters each block."""
    at = cand.where("next IS NOT NULL").join(bases, ["file", "block"])
    exits = at.where("leaves IS NOT NULL").groupBy("file", (F.col("leaves") + F.col("base")).alias("begin")).agg(F.lit(1).alias("x")).drop("x")
    begins = at.select("file", (F.col("start") + F.col("base")).alias("begin"), "block", "pre", (F.col("leaves") + F.col("base")).alias("jump"))
    # few candidates are the exit of another, mostly one a block
    nodes = store(begins.where("begin = 0").unionByName(begins.join(exits.where("begin > 0"), ["file", "begin"])), "nodes")
    found, jumps, count = nodes.where("begin = 0").select("file", "begin"), nodes.select("file", "begin", "jump"), -1
    while True:
        more = found.join(jumps, ["file", "begin"]).where("jump IS NOT NULL").select("file", F.col("jump").alias("begin"))
        found = store(found.unionByName(more).distinct(), "found")
        now = found.count()
        if now == count:
            break
        count = now
        far = jumps.select("file", F.col("begin").alias("jump"), F.col("jump").alias("further"))
        jumps = store(jumps.join(far, ["file", "jump"]).select("file", "begin", F.col("further").alias("jump")).where("jump IS NOT NULL"), "jumps")
    return nodes.join(found, ["file", "begin"], "left_semi").select("file", "block", F.col("pre").alias("entry"))


def _assembled(spark: SparkSession, path: str, cand: DataFrame, bases: DataFrame, split: DataFrame) -> DataFrame:
    """file, start (in the file), bytes and sha1 of true records (file, begin, end) whose payloads hold the magic."""
    bucket = lambda c: F.shiftright(c, BUCKET)
    parts = cand.join(bases, ["file", "block"]).select("file", "block", "start", (F.col("start") + F.col("base")).alias("at")).withColumn("bucket", bucket(F.col("at")))
    whole = split.select("file", "begin", "end").withColumn("bucket", F.explode(F.sequence(bucket(F.col("begin")), bucket(F.col("end") - 1))))
    wanted = parts.join(whole, ["file", "bucket"]).where("at >= begin AND at < end").select("file", "block", "start", "begin", "at")

    def place_(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, at = None, 0
        for batch in batches:
            keys = list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()))
            starts = []
            for key, value in zip(keys, batch.column(2)):
                at = at if key == of else 0
                starts.append(at - len(MAGIC))
                at, of = at + len(value.as_buffer()) + len(MAGIC), key
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(starts, pa.int64())], [*batch.schema.names, "start"])

    raw = _segments(spark, path).withColumn("value", F.col("value").cast("binary")).mapInArrow(place_, "file string, block bigint, value binary, start bigint")
    found = raw.join(counted(wanted), ["file", "block", "start"]).groupBy("file", "begin").agg(F.sort_array(F.collect_list(F.struct("at", "value"))).alias("parts"))
    text = F.expr(f"aggregate(parts, CAST('' AS BINARY), (x, p) -> CASE WHEN length(x) = 0 THEN p.value ELSE concat(x, CAST('{MAGIC[:-2]}\\r\\n' AS BINARY), p.value) END)").cast("string")
    return _parsed(found.select("file", "begin", text.alias("value")).withColumnRenamed("begin", "start")).select("file", F.col("start").alias("begin"), F.col("bytes").alias("all_bytes"), F.col("sha1").alias("all_sha1"))


def read(spark: SparkSession, path: str) -> DataFrame:
    """A row for each true record of the uncompressed archives under ``path``.

    page_id, record_type, refers_to (of revisits), payload_bytes and payload_digest of the full payload, a revisit's being
    those of the response it refers to (null if that is not there), and intact: whether the digest is the one its
    header names. A record that ends beyond its file isn't one, nor is what a chain from the file's start doesn't reach.
    An archive without records gives no rows.
    """
    prepare(spark)
    cand = store(candidates(spark, path), "candidates")
    order = Window.partitionBy("file").orderBy("block")  # a row a block
    bases = cand.where("total IS NOT NULL").select("file", "block", "total")
    bases = bases.select("file", "block", (F.sum("total").over(order) - F.col("total")).alias("base"), (F.sum("total").over(Window.partitionBy("file")) - len(MAGIC)).alias("bytes_in_file"))
    bases = counted(bases)
    entries = counted(_entries(cand, bases))
    true = cand.join(bases, ["file", "block"]).join(entries, ["file", "block"]).where("next IS NOT NULL AND pre <= entry AND entry < post AND next + base <= bytes_in_file")
    true = true.withColumns({"begin": F.col("start") + F.col("base"), "end": F.col("next") + F.col("base")})
    split = true.where("next > start + size + 10")
    if split.take(1):
        true = true.join(_assembled(spark, path, cand, bases, split), ["file", "begin"], "left").withColumns({"bytes": F.coalesce("all_bytes", "bytes"), "sha1": F.coalesce("all_sha1", "sha1")})
    records = store(true.select("page_id", "type", "refers", "bytes", "sha1", "said"), "records")
    drop(cand)
    own = records.where("type <> 'revisit' OR refers IS NULL").select("page_id", F.col("type").alias("record_type"), F.lit(None).cast("bigint").alias("refers_to"), "bytes", "sha1", "said")
    again = records.where("type = 'revisit' AND refers IS NOT NULL").select("page_id", "refers", "said")
    # few responses are referred to; each once, whatever repeats
    named = again.groupBy("refers").agg(F.lit(1).alias("x")).drop("x")
    to = counted(records.where("type = 'response'").join(named.withColumnRenamed("refers", "page_id"), "page_id").groupBy(F.col("page_id").alias("refers")).agg(F.min("bytes").alias("bytes"), F.min("sha1").alias("sha1")))
    met = salted(again, to.unionByName(named.join(to, "refers", "left_anti").select("refers", F.lit(None).cast("bigint").alias("bytes"), F.lit(None).cast("string").alias("sha1"))), ["refers"], "page_id")
    every = own.unionByName(met.select("page_id", F.lit("revisit").alias("record_type"), F.col("refers").alias("refers_to"), "bytes", "sha1", "said"))
    digest = base32(F.col("sha1"))
    return every.select("page_id", F.col("bytes").alias("payload_bytes"), digest.alias("payload_digest"), "record_type", "refers_to", digest.eqNullSafe(F.col("said")).alias("intact"))


def round_trip(pages: DataFrame, least: int = LEAST) -> DataFrame:
    """read() of what write() makes of ``pages``, an archive in the shared folder that is gone afterwards."""
    spark = prepare(pages.sparkSession)
    path = place(spark, "archive")
    write(pages, path, least)
    out = read(spark, path)
    delete(spark, path)
    return out


ORACLE = rf"""
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages),
h AS (SELECT page_id, octet_length(payload) AS payload_bytes, sha1(payload) AS sha1, sha256(payload) AS key FROM p),
f AS (SELECT key, min(page_id) AS first FROM h WHERE payload_bytes >= {LEAST} GROUP BY key),
r AS (SELECT h.*, f.first FROM h LEFT JOIN f ON h.key = f.key)
SELECT page_id, payload_bytes::BIGINT AS payload_bytes,
       array_to_string(list_transform(range(32), lambda i: substr('{ALPHABET}', ((('0x' || substr(sha1, (5 * i) // 4 + 1, 2))::INT >> (3 - (5 * i) % 4)::INT) & 31) + 1, 1)), '') AS payload_digest,
       CASE WHEN first IS NOT NULL AND first IS DISTINCT FROM page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN first IS DISTINCT FROM page_id THEN first END AS refers_to, true AS intact
FROM r
"""
