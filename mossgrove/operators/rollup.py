"""The journal's calendar: days into weeks of the month, months and years, each level from the one below."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mossgrove.functions.dates import summaries
from mossgrove.functions.paths import forward
from mossgrove.functions.text import cut_at_line, front_matter
from mossgrove.model import Params


def joined(key: Column, content: Column) -> Column:
    """Ordered texts of a group, each under its key."""
    rows = F.sort_array(F.collect_list(F.struct(key.alias("k"), content.alias("c"))))
    return F.array_join(F.transform(rows, lambda x: F.concat(F.lit("--- "), x["k"], F.lit(" ---\n"), x["c"])), "\n\n")


#: By level, a child's path: what its summary's path starts with, the summary's name, and the child's key.
CHILD = {
    "week": r"^(.*/(week[^/]*))/(\d{2}-\d{2}\.md)$",
    "month": r"^(.*/([^/]+))/(week[^/]*)/\3\.md$",
    "year": r"^(.*/([^/]+))/(\d{2})/\3\.md$",
}


def children(files: DataFrame, level: str) -> DataFrame:
    """summary, level, key, content: which file (path, content) is read for which summary of a level."""
    p = forward(F.col("path"))
    summary = F.regexp_replace(p, CHILD[level], "$1/$2.md")
    return files.where(p.rlike(CHILD[level])).select(summary.alias("summary"), F.lit(level).alias("level"), F.regexp_extract(p, CHILD[level], 3).alias("key"), "content")


def rollup(files: DataFrame, level: str) -> DataFrame:
    """path, level, children and entries (what an executor would read) of a level's summaries."""
    rows = children(files, level)
    return rows.groupBy(F.col("summary").alias("path"), "level").agg(F.count("*").alias("children"), joined(F.col("key"), F.col("content")).alias("entries"))


def summary_page(rows: DataFrame, created: Column, text: Column | None = None) -> DataFrame:
    """path and content of summary files: front matter, a title and the executor's text (the entries if there is none)."""
    head = front_matter(type=F.concat(F.lit("journal-"), "level", F.lit("-summary")), created=F.date_format(created, "yyyy-MM-dd"), children=F.col("children"))
    return rows.select("path", F.concat(head, F.lit("\n\n# "), F.initcap("level"), F.lit(" Summary\n\n"), F.trim(text if text is not None else F.col("entries")), F.lit("\n")).alias("content"))


def missing_summaries(days: DataFrame, files: DataFrame) -> DataFrame:
    """path, level and priority of the summaries above daily files (path) that aren't among ``files`` (path)."""
    want = days.select(F.explode(summaries(forward(F.col("path")))).alias("s")).select("s.*").distinct()
    return want.join(files.select("path"), "path", "left_anti")


def briefing(files: DataFrame, params: Params = Params()) -> DataFrame:
    """One row: the identity files that exist, in order, under their names, cut to the briefing's length; no row without any."""
    order = files.sparkSession.createDataFrame(list(enumerate(params.identity)), "pos int, path string")
    found = order.join(files.select("path", "content"), "path").where("content IS NOT NULL")
    rows = found.agg(F.sort_array(F.collect_list(F.struct("pos", "path", "content"))).alias("x"))
    text = F.array_join(F.transform("x", lambda e: F.concat(F.lit("--- "), e["path"], F.lit(" ---\n"), e["content"], F.lit("\n"))), "\n")
    return rows.where(F.size("x") > 0).select(F.size("x").alias("source_files"), cut_at_line(text, params.briefing_chars).alias("content"))
