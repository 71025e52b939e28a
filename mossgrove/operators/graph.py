"""Links between pages: edges, references, cascades and directory indexes."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mossgrove.functions import models
from mossgrove.functions.paths import ancestors, base_name, forward, is_protected, parent, stem, without_suffix
from mossgrove.functions.text import first_heading, title_of
from mossgrove.model import Params
from mossgrove.sources.scratch import drop, store

LINK = r"\[\[([^\[\]]+)\]\]"


def link_edges(pages: DataFrame) -> DataFrame:
    """src and key, a row for each distinct ``[[key]]`` in each page (path, content)."""
    return pages.select(F.col("path").alias("src"), F.explode(F.regexp_extract_all("content", F.lit(LINK), F.lit(1))).alias("key")).distinct()


def spellings(pages: DataFrame) -> DataFrame:
    """path and key: the ways a link can name a page (without its ending, with it, or by the bare stem)."""
    p = F.col("path")
    return pages.select("path", F.explode(F.array_distinct(F.array(without_suffix(p), forward(p), stem(p)))).alias("key"))


def references(pages: DataFrame, edges: DataFrame | None = None) -> DataFrame:
    """child and parent: which page is named by which other one. An equi-join on the key, not a search of every text."""
    found = (edges if edges is not None else link_edges(pages)).join(spellings(pages), "key")
    return found.where("src <> path").select(F.col("path").alias("child"), F.col("src").alias("parent")).distinct()


def broken_links(pages: DataFrame) -> DataFrame:
    return link_edges(pages).join(spellings(pages).select("key"), "key", "left_anti").select("src", "key")


def orphans(pages: DataFrame) -> DataFrame:
    return pages.select("path").join(references(pages).select(F.col("child").alias("path")), "path", "left_anti")


def with_references(paths: DataFrame, refs: DataFrame) -> DataFrame:
    """Of ``paths`` (path) those that a page refers to; only these are worth a cascade."""
    return paths.join(refs.select(F.col("child").alias("path")), "path", "left_semi")


def cascade(pages: DataFrame, start: DataFrame, judge: Callable[[Column, Column], Column] = models.judge_revise, executor: Callable[[Column, Column, Column], Column] = models.executor_echo, params: Params = Params(), refs: DataFrame | None = None, by: tuple[str, ...] = ()) -> DataFrame:
    """path, depth, verdict, content, error: what a change to ``start`` (path) does to the pages that refer to it, and on.

    Level by level, at most ``cascade_depth`` deep. A protected page is promoted and isn't judged; KEEP and REJECT
    stop; REVISE rewrites the page and goes on from it. A page that changed is not a start again, so cycles end.
    Depth is the least distance. One row a page and level at most.

    ``by`` names columns of ``start`` that tell cascades apart: each of their values is a cascade of its own, all of them
    taken level by level together. Where ``start`` has content, that is what changed, else the page's own. A guarded
    judge or executor that fails stops at its page, with verdict FAILED and its error.
    """
    by, on = list(by), [*by, "path"]
    refs = store(refs if refs is not None else references(pages), "refs")
    first = store(start.select(*on).distinct(), "start")
    changed = start.select(*on, F.col("content").alias("child_content")).groupBy(*on).agg(F.min("child_content").alias("child_content")) if "content" in start.columns else first.join(pages.select("path", F.col("content").alias("child_content")), "path")
    front = store(changed.select(*on, "child_content"), "front")
    out = None
    for depth in range(1, params.cascade_depth + 1):
        met = front.join(refs.select(F.col("child").alias("path"), "parent"), "path").groupBy(*by, "parent").agg(F.min_by("child_content", "path").alias("child_content"))
        met = met if out is None else met.join(out.select(*by, F.col("path").alias("parent")), [*by, "parent"], "left_anti")
        judged = met.join(pages.select(F.col("path").alias("parent"), "content"), "parent")
        judged = models.outcome(judged.withColumn("j", F.when(~is_protected(F.col("parent"), params.protected), judge(F.col("content"), F.col("child_content")))), "j")
        failed = F.col("error").isNotNull()
        verdict = F.when(failed, F.lit("FAILED")).when(F.col("j").isNull(), F.lit("PROMOTE")).otherwise(F.upper(F.col("j.verdict")))
        revised = F.when(verdict == "REVISE", executor(F.col("content"), F.col("j.direction"), F.col("child_content")))
        done = models.outcome(judged.select(*by, "parent", "content", verdict.alias("verdict"), F.col("error").alias("judge_error"), revised.alias("text")), "text")
        failed = F.coalesce("judge_error", "error")
        verdict = F.when(failed.isNotNull(), F.lit("FAILED")).otherwise(F.col("verdict"))
        level = done.select(*by, F.col("parent").alias("path"), F.lit(depth).alias("depth"), verdict.alias("verdict"), F.when(verdict == "REVISE", F.col("text")).otherwise(F.col("content")).alias("content"), failed.alias("error"))
        level = store(level, "level")
        out = level if out is None else out.unionByName(level)
        drop(front)
        front = store(level.where("verdict = 'REVISE'").join(first, on, "left_anti").select(*on, F.col("content").alias("child_content")), "front")
        if not front.take(1):
            break
    return out


def cascade_stats(rows: DataFrame) -> DataFrame:
    """One row: files_changed, promoted (sorted paths) and max_depth."""
    return rows.agg(
        F.sort_array(F.collect_set(F.when(F.col("verdict") == "REVISE", F.col("path")))).alias("files_changed"),
        F.sort_array(F.collect_set(F.when(F.col("verdict") == "PROMOTE", F.col("path")))).alias("promoted"),
        F.coalesce(F.max("depth"), F.lit(0)).alias("max_depth"),
    )


def directory_indexes(pages: DataFrame) -> DataFrame:
    """path and content of the index that each directory above a page (path, content) should have; not the root's.

    Its title, then a line for each directory and page in it by name: hidden names and indexes are left out.
    """
    p = F.col("path")
    shown = pages.where(~p.rlike(r"(^|/)\.")).select(p, "content")
    dirs = shown.select(F.explode(ancestors(p)).alias("dir")).distinct()
    of_dirs = dirs.select(parent(F.col("dir")).alias("dir"), base_name(F.col("dir")).alias("name"), F.concat(F.lit("- [["), "dir", F.lit("/]] — "), F.translate(base_name(F.col("dir")), "-_", "  ")).alias("line"))
    files = shown.where(p.endswith(".md") & (base_name(p) != "index.md"))
    named = F.coalesce(F.nullif(first_heading(F.col("content")), F.lit("")), F.translate(stem(p), "-_", "  "))
    of_files = files.select(parent(p).alias("dir"), base_name(p).alias("name"), F.concat(F.lit("- [["), without_suffix(p), F.lit("]] — "), named).alias("line"))
    lines = of_dirs.unionByName(of_files).where("dir <> ''").groupBy("dir").agg(F.sort_array(F.collect_list(F.struct("name", "line"))).alias("x"))
    title = F.concat(F.lit("# "), title_of(F.translate(base_name(F.col("dir")), "_", "_")), F.lit("\n\n"))
    body = F.array_join(F.transform("x", lambda e: e["line"]), "\n")
    return lines.select(F.concat("dir", F.lit("/index.md")).alias("path"), F.concat(title, body, F.lit("\n")).alias("content"))


def structural_cascade(pages: DataFrame, changed: DataFrame) -> DataFrame:
    """path and content of the index pages above ``changed`` (path) that exist and whose text is out of date."""
    above = changed.select(F.explode(ancestors(F.col("path"))).alias("dir")).distinct().select(F.concat("dir", F.lit("/index.md")).alias("path"))
    now = pages.select("path", F.col("content").alias("old"))
    return directory_indexes(pages).join(above, "path", "left_semi").join(now, "path").where("old IS DISTINCT FROM content").select("path", "content")
