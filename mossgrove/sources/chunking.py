"""Markdown into chunks.

A line of one to six hashes and a blank starts a section, which has that heading and level; lines before the first
one are a section without. A section of more than ``most`` characters is cut between lines: a line belongs to the
piece that the characters before it fill. Line numbers start at 1. Sections without text but white space are dropped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mossgrove.functions.hashing import chunk_id, content_hash
from mossgrove.functions.paths import trunk_distance

HEADING = r"^#{1,6}\s"


def lines(files: DataFrame) -> DataFrame:
    """source, n (from 1) and line, a row a line."""
    return files.select("source", F.posexplode(F.split("content", "\n")).alias("n", "line")).withColumn("n", F.col("n") + 1)


def chunk(files: DataFrame, most: int = 2000, model: str = "words") -> DataFrame:
    """Chunks of files (source, content): id, source, heading, heading_level, content, start_line, end_line, content_hash, trunk_distance."""
    by = Window.partitionBy("source").orderBy("n")
    head = F.col("line").rlike(HEADING)
    rows = lines(files).withColumn("section", F.sum(head.cast("int")).over(by))
    before = F.coalesce(F.sum(F.length("line") + 1).over(Window.partitionBy("source", "section").orderBy("n").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = rows.withColumn("piece", F.floor(before / most))
    title = F.max(F.when(head, F.struct(F.trim(F.regexp_replace("line", r"^#{1,6}\s+", "")).alias("heading"), F.length(F.regexp_extract("line", r"^(#{1,6})", 1)).alias("level")))).over(Window.partitionBy("source", "section"))
    found = rows.withColumn("h", title).groupBy("source", "section", "piece").agg(
        F.first("h").alias("h"), F.min("n").cast("int").alias("start_line"), F.max("n").cast("int").alias("end_line"), F.sort_array(F.collect_list(F.struct("n", "line"))).alias("x")
    )
    found = found.withColumn("content", F.array_join(F.transform("x", lambda e: e["line"]), "\n")).where(F.col("content").rlike(r"\S"))
    digest = content_hash(F.col("content"))
    return found.select(
        chunk_id(F.col("source"), F.col("start_line"), F.col("end_line"), digest, model).alias("id"),
        "source", F.coalesce("h.heading", F.lit("")).alias("heading"), F.coalesce("h.level", F.lit(0)).alias("heading_level"),
        "content", "start_line", "end_line", digest.alias("content_hash"), trunk_distance(F.col("source")).alias("trunk_distance"),
    )


#: The parts of a line: sentences with what parts them.
SENTENCE = r"[^.!?]+[.!?]*[ \t]*|[.!?]+[ \t]*"


def chunk_within(files: DataFrame, most: int = 2000, model: str = "words") -> DataFrame:
    """Chunks as chunk() makes them, none of more than ``most`` characters.

    What can't be parted is at most half of that: a paragraph with the blank lines behind it, else each of its lines, else
    each sentence of a line, else cuts of a sentence. A part belongs to the piece of its section that the characters before
    it fill, by halves of ``most``. Line numbers are those of the lines that a piece has anything of.
    """
    half = max(1, most // 2)
    section, line = Window.partitionBy("source", "section"), Window.partitionBy("source", "section").orderBy("n")
    head, blank = F.col("line").rlike(HEADING), F.trim("line") == ""
    rows = lines(files).withColumn("section", F.sum(head.cast("int")).over(Window.partitionBy("source").orderBy("n"))).withColumn("size", F.length("line") + 1)
    title = F.max(F.when(head, F.struct(F.trim(F.regexp_replace("line", r"^#{1,6}\s+", "")).alias("heading"), F.length(F.regexp_extract("line", r"^(#{1,6})", 1)).alias("level")))).over(section)
    begins = ~blank & F.lag(blank, 1, True).over(line)
    rows = rows.withColumns({"h": title, "before": F.sum("size").over(line) - F.col("size"), "par": F.sum(begins.cast("int")).over(line)})
    par = Window.partitionBy("source", "section", "par")
    whole = F.sum("size").over(par) <= half
    rows = rows.withColumns({"start": F.min("before").over(par), "whole": whole})
    cuts = lambda s: F.transform(F.sequence(F.lit(0), F.ceil(F.length(s) / half).cast("int") - 1), lambda i: F.substring(s, i * half + 1, F.lit(half)))
    parts = F.when(F.col("whole") | (F.col("size") <= half), F.array("line")).otherwise(F.flatten(F.transform(F.regexp_extract_all("line", F.lit(SENTENCE), F.lit(0)), cuts)))
    rows = rows.withColumn("parts", parts)
    rows = rows.select("source", "section", "h", "n", "whole", "before", "start", F.size("parts").alias("of"), F.posexplode("parts").alias("k", "part"))
    ahead = F.coalesce(F.sum(F.length("part")).over(Window.partitionBy("source", "section", "n").orderBy("k").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = rows.withColumn("piece", F.floor(F.when(F.col("whole"), F.col("start")).otherwise(F.col("before") + ahead) / half))
    text = F.concat("part", F.when(F.col("k") == F.col("of") - 1, F.lit("\n")).otherwise(F.lit("")))
    found = rows.groupBy("source", "section", "piece").agg(F.first("h").alias("h"), F.min("n").cast("int").alias("start_line"), F.max("n").cast("int").alias("end_line"), F.sort_array(F.collect_list(F.struct("n", "k", text.alias("text")))).alias("x"))
    found = found.withColumn("content", F.regexp_replace(F.array_join(F.transform("x", lambda e: e["text"]), ""), r"\n\z", "")).where(F.col("content").rlike(r"\S"))
    digest = content_hash(F.col("content"))
    return found.select(
        chunk_id(F.col("source"), F.col("start_line"), F.col("end_line"), digest, model).alias("id"),
        "source", F.coalesce("h.heading", F.lit("")).alias("heading"), F.coalesce("h.level", F.lit(0)).alias("heading_level"),
        "content", "start_line", "end_line", digest.alias("content_hash"), trunk_distance(F.col("source")).alias("trunk_distance"),
    )


def embedded(chunks: DataFrame, embed) -> DataFrame:
    """``chunks`` with an embedding by ``embed`` (a function from a text column to a vector column)."""
    return chunks.withColumn("embedding", embed(F.col("content")).cast("array<float>"))


def upsert(old: DataFrame, new: DataFrame, key: str = "source") -> DataFrame:
    """``new``, and those rows of ``old`` whose key isn't in it."""
    return old.join(new.select(key).distinct(), key, "left_anti").unionByName(new, allowMissingColumns=True)


def incremental(scanned: DataFrame, indexed: DataFrame) -> DataFrame:
    """source and decision: index what is new or has changed since its last run, skip the rest, remove what is gone.

    ``scanned``: source, mtime; ``indexed``: source, indexed_at, any number of rows a source.
    """
    last = indexed.groupBy("source").agg(F.max("indexed_at").alias("indexed_at"))
    both = scanned.join(last, "source", "full_outer")
    decision = F.when(F.col("mtime").isNull(), F.lit("remove")).when(F.col("indexed_at").isNull() | (F.col("mtime") > F.col("indexed_at")), F.lit("index")).otherwise(F.lit("skip"))
    return both.select("source", decision.alias("decision"))


def latest(versions: DataFrame, key: str, order: str) -> DataFrame:
    """The last version of each key."""
    return versions.groupBy(key).agg(F.max_by(F.struct("*"), order).alias("v")).select("v.*")


def put_meta(old: DataFrame, new: DataFrame, replace: bool = True) -> DataFrame:
    """Key and value pairs: new ones replace old ones, or are left out where there are old ones."""
    return upsert(old, new, "key") if replace else upsert(new, old, "key")


def status(chunks: DataFrame, meta: DataFrame) -> DataFrame:
    """One row: chunks, files, and the meta values of dimension (384 if missing), model and last_indexed."""
    get = lambda k: meta.where(F.col("key") == k).agg(F.max("value")).scalar()
    return chunks.agg(F.count("*").alias("chunks"), F.countDistinct("source").alias("files")).select("*", F.coalesce(get("dimension").cast("int"), F.lit(384)).alias("dimension"), get("model").alias("model"), get("last_indexed").alias("last_indexed"))
