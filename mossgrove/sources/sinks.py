"""Writers: entries, pages, logs."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mossgrove.functions.dates import entry_path
from mossgrove.functions.text import front_matter


def entries(rows: DataFrame) -> DataFrame:
    """path and block of entries (branch, ts, title, source_hint, content): front matter, a heading and the text.

    ``pos``, if there, is the order of entries of one time, and is kept.
    """
    head = front_matter(date=F.date_format("ts", "yyyy-MM-dd"), time=F.concat(F.date_format("ts", "HH:mm:ss"), F.lit(" UTC")), branch=F.col("branch"), source=F.nullif(F.col("source_hint"), F.lit("")))
    title = F.coalesce("title", F.concat(F.lit("Entry "), F.date_format("ts", "yyyy-MM-dd HH:mm")))
    block = F.concat(head, F.lit("\n\n# "), title, F.lit("\n"), F.trim("content"), F.lit("\n"))
    return rows.select(entry_path(F.col("branch"), F.col("ts")).alias("path"), "ts", *(c for c in rows.columns if c == "pos"), block.alias("block"))


def day_files(blocks: DataFrame) -> DataFrame:
    """path and content: the blocks of each path in order of time, and of ``pos`` if there, parted by rules."""
    x = F.sort_array(F.collect_list(F.struct("ts", *(c for c in blocks.columns if c == "pos"), "block")))
    return blocks.groupBy("path").agg(F.array_join(F.transform(x, lambda e: e["block"]), "\n---\n\n").alias("content"))


def append_entries(rows: DataFrame, path: str) -> None:
    """Appends entries to a table partitioned by branch and day."""
    rows.withColumn("day", F.to_date("ts")).write.mode("append").partitionBy("branch", "day").parquet(path)


def write_turns(rows: DataFrame, path: str) -> None:
    """Appends captured turns, partitioned by entity and day."""
    rows.write.mode("append").partitionBy("entity", "day").json(path)


def generations(spark: SparkSession, path: str) -> list[int]:
    """The generations that a log has, oldest first."""
    fs, here, *_ = _files(spark, path)
    names = [x.getPath().getName() for x in fs.listStatus(here)] if fs.exists(here) else []
    return sorted(int(x[1:]) for x in names if x.startswith("g") and x[1:].isdigit())


def rotate(spark: SparkSession, path: str, most_bytes: int = 10 << 20, keep: int = 4, most_age: float | None = None, now: float | None = None) -> str:
    """The folder of the generation that a log is appended to: the last, or a new one if that is full or too old.

    A generation is never renamed or rewritten: a new one begins with what is first written to it, and only then, by the
    next call, do those beyond the last ``keep`` go. So a stop at any step loses no row that was to be kept. ``most_age`` is
    in seconds since the generation's first file.
    """
    fs, here, *_ = _files(spark, path)
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    known = generations(spark, path)
    for n in known[:-keep]:
        fs.delete(where(f"{path}/g{n:08d}"), True)
    last = known[-1] if known else 1
    at = f"{path}/g{last:08d}"
    if known:
        files = [x for x in fs.listStatus(where(at)) if not x.getPath().getName().startswith(("_", "."))]
        first = min((x.getModificationTime() / 1000 for x in files), default=None)
        old = most_age is not None and first is not None and (time.time() if now is None else now) - first >= most_age
        if old or sum(x.getLen() for x in files) >= most_bytes:
            at = f"{path}/g{last + 1:08d}"
    return at


def append_metrics(rows: DataFrame, path: str, per_file: int = 100_000, **limits) -> None:
    """Appends events to a log in generations; ``limits`` are those of rotate()."""
    rows.write.mode("append").option("maxRecordsPerFile", per_file).json(rotate(rows.sparkSession, path, **limits))


def append_audit(rows: DataFrame, path: str) -> None:
    rows.select(F.concat_ws("\t", *(F.coalesce(F.translate(c, "\t\n\r", "   "), F.lit("-")) for c in rows.columns)).alias("value")).write.mode("append").text(path)


def _files(spark: SparkSession, path: str):
    paths = [spark.sparkContext._jvm.org.apache.hadoop.fs.Path(x) for x in (path, f"{path}.new", f"{path}.old")]
    return paths[0].getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), *paths


def recover(spark: SparkSession, path: str) -> None:
    """Puts back the table at ``path`` should a replacement have stopped between its two renames."""
    fs, here, _, old = _files(spark, path)
    if not fs.exists(here) and fs.exists(old) and not fs.rename(old, here):
        raise OSError(f"can't put {path}.old back")


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """A table that replace_table() keeps."""
    recover(spark, path)
    return spark.read.parquet(path)


def replace_table(rows: DataFrame, path: str) -> None:
    """Writes beside a table that ``rows`` may be read from, then takes its place.

    The old table is moved aside, not deleted, until the new one is in its place; whenever that stops, one of the two is
    whole and read_table() finds it.
    """
    spark = rows.sparkSession
    recover(spark, path)
    fs, here, new, old = _files(spark, path)
    rows.write.mode("overwrite").parquet(f"{path}.new")
    fs.delete(old, True)
    if fs.exists(here) and not fs.rename(here, old):
        raise OSError(f"can't move {path} aside")
    if not fs.rename(new, here):
        recover(spark, path)
        raise OSError(f"can't move {path}.new to its place")
    fs.delete(old, True)
