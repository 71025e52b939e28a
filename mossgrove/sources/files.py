"""Readers of trees of files, logs and queues."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from mossgrove.functions.paths import is_hidden, suffix
from mossgrove.model import AUDIT, METRICS, SOURCE_EXTENSIONS, TASKS, Params


def relative(root: str):
    """A file's path below the root, decoded."""
    return F.url_decode(F.replace(F.regexp_replace("path", rf"^[a-z]+:/+", "/"), F.lit(root.rstrip("/") + "/"), F.lit("")))


def scan_tree(spark: SparkSession, root: str, pattern: str = "*.md", system: str = ".system") -> DataFrame:
    """FILES below ``root``, without the system directory. A file that isn't UTF-8 has null content (see unreadable())."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(root)
    text = F.when(F.is_valid_utf8(F.col("content").cast("string")), F.col("content").cast("string"))
    rows = files.select(relative(root).alias("source"), text.alias("content"), F.col("modificationTime").alias("mtime"), "length")
    return rows.where(~F.col("source").rlike(rf"(^|/)[{system[0]}]{system[1:]}(/|$)"))


def unreadable(files: DataFrame) -> DataFrame:
    return files.agg(F.count("*").alias("scanned"), F.count_if(F.col("content").isNull()).alias("errors"))


def source_bundle(files: DataFrame, params: Params = Params()) -> DataFrame:
    """One row: the text files of a directory (source, content) in order, headed and joined, until over the limit.

    The file that passes the limit is the last one. Other endings and hidden paths are left out.
    """
    ok = F.substring(suffix(F.col("source")), 2, 20).isin(*SOURCE_EXTENSIONS) & ~is_hidden(F.col("source")) & F.col("content").isNotNull()
    part = F.concat(F.lit("## "), "source", F.lit("\n\n"), "content")
    rows = files.where(ok).select("source", part.alias("part"))
    # each part has a heading, so only so many of the first can count: one ordered window over their lengths, and only theirs
    first = rows.select("source", F.length("part").alias("n")).orderBy("source").limit(params.source_chars // len("## \n\n") + 2)
    before = F.coalesce(F.sum("n").over(Window.partitionBy().orderBy("source").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    within = first.withColumn("before", before).where(F.col("before") <= params.source_chars).select("source").distinct()
    rows = rows.join(F.broadcast(within), "source", "left_semi")
    return rows.agg(F.sort_array(F.collect_list(F.struct("source", "part"))).alias("x")).where(F.size("x") > 0).select(F.size("x").alias("files"), F.array_join(F.transform("x", lambda e: e["part"]), "\n\n---\n\n").alias("content"))


def read_source(spark: SparkSession, path: str, params: Params = Params()) -> DataFrame:
    """content and type of a file, cut at the limit, or of a directory. FileNotFoundError or ValueError if there is none."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(where):
        raise FileNotFoundError(path)
    if fs.getFileStatus(where).isDirectory():
        bundle = source_bundle(scan_tree(spark, path, "*"), params)
        if not bundle.take(1):
            raise ValueError(f"no readable files in {path}")
        return bundle.select("content", F.lit("directory").alias("type"))
    text = spark.read.text(path, wholetext=True)
    return text.select(F.left("value", F.lit(params.source_chars)).alias("content"), F.lit("file").alias("type"))


def read_metrics(spark: SparkSession, path: str) -> DataFrame:
    """METRICS rows of a JSON-lines log, all its generations; lines that aren't JSON are skipped."""
    return spark.read.schema(METRICS).option("mode", "DROPMALFORMED").option("recursiveFileLookup", "true").json(path)


def read_queue(spark: SparkSession, path: str) -> DataFrame:
    """Tasks of a JSON array with their place in it; no rows if it isn't one."""
    text = spark.read.text(path, wholetext=True)
    tasks = F.from_json("value", f"array<struct<{', '.join(c.replace(' ', ':', 1) for c in TASKS.split(', '))}>>")
    return text.select(F.posexplode(tasks).alias("pos", "t")).where("t IS NOT NULL").select("pos", "t.*")


def read_audit(spark: SparkSession, path: str) -> DataFrame:
    """Audit rows of a tab-separated log; lines that haven't six fields are dropped."""
    fields = F.split("value", "\t")
    names = [c.split(" ")[0] for c in AUDIT.split(", ")]
    return spark.read.text(path).where(F.size(fields) == len(names)).select(*(F.get(fields, F.lit(i)).alias(n) for i, n in enumerate(names)))


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """session (the file's name), line (from 1) and value of transcript files."""
    rows = spark.read.text(path, wholetext=True).select(F.regexp_extract(F.input_file_name(), r"([^/]+)\.jsonl?$", 1).alias("session"), F.posexplode(F.split("value", "\n")).alias("line", "value"))
    return rows.where("value <> ''").withColumn("line", F.col("line") + 1)
