"""Routing actions and the page edits they make."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mossgrove.functions.paths import forward, is_leaf, is_protected, without_suffix
from mossgrove.model import Params


def _under(content: Column, section: str, line: Column, title: str) -> Column:
    """``content`` with ``line`` right under its first section that ``section`` names, else under a new one."""
    heading = rf"(?ism)\A(.*?^##\s+(?:{section})[ \t]*)$"
    safe = F.regexp_replace(line, r"([\\$])", r"\\$1")
    under = F.regexp_replace(content, F.lit(heading), F.concat(F.lit("$1\n"), safe))
    new = F.concat(F.regexp_replace(content, r"(?U)\s+\z", ""), F.lit(f"\n\n## {title}\n\n"), line, F.lit("\n"))
    return F.when(content.rlike(rf"(?im)^##\s+(?:{section})[ \t]*$"), under).otherwise(new)


def link_of(path: Column) -> Column:
    return F.concat(F.lit("[["), without_suffix(path), F.lit("]]"))


def insert_link(content: Column, target: Column) -> Column:
    """A link to ``target`` under Related or See Also; unchanged if the page has it."""
    link = link_of(target)
    return F.when(F.contains(content, link), content).otherwise(_under(content, "Related|See Also", F.concat(F.lit("- "), link), "Related"))


def insert_task(content: Column, task: Column, source: Column) -> Column:
    """An open task, with a link to where it came from; unchanged if the page has the task's text."""
    line = F.concat(F.lit("- [ ] "), task, F.lit(" (from "), link_of(source), F.lit(")"))
    return F.when(F.contains(content, task), content).otherwise(_under(content, "Tasks|TODO|Action Items|Next", line, "Tasks"))


def created_page(title: Column, content: Column, created: Column, by: str) -> Column:
    return F.concat(F.lit("---\ncreated: "), F.date_format(created, "yyyy-MM-dd"), F.lit(f"\ncreated_by: {by}\n---\n\n# "), title, F.lit("\n\n"), content, F.lit("\n"))


def decide(actions: DataFrame, pages: DataFrame, params: Params = Params(), dry_run: bool = False) -> DataFrame:
    """Adds outcome, executed, rejected_reason and cascades to actions (action, target, direction, source).

    ``pages``: path and content. REVISE and CREATE on captures are rejected; REVISE of a protected page is a
    promotion and of a missing one nothing; CREATE of a page that exists revises it; LINK edits the source page and
    TASK the target, if that exists and the edit changes it.
    """
    of = lambda name: pages.select(F.col("path").alias(f"{name}_path"), F.col("content").alias(f"{name}_content"))
    rows = actions.join(of("t"), F.col("target") == F.col("t_path"), "left").join(of("s"), F.col("source") == F.col("s_path"), "left")
    a, there = F.col("action"), F.col("t_path").isNotNull()
    leaf = a.isin("REVISE", "CREATE") & is_leaf(F.col("target"), params.leaf_prefixes)
    guarded = (a == "REVISE") & is_protected(F.col("target"), params.protected)
    link = F.col("s_path").isNotNull() & ~F.coalesce(F.contains("s_content", link_of(forward(F.col("target")))), F.lit(False))
    task = there & ~F.coalesce(F.contains(F.col("t_content"), F.col("direction")), F.lit(False))
    executed = F.when(F.lit(dry_run) | leaf | guarded, F.lit(False)).when(a == "REVISE", there).when(a == "LINK", link).when(a == "TASK", task).otherwise(F.lit(True))
    outcome = F.when(F.lit(dry_run) | leaf, a).when(guarded, F.lit("PROMOTE")).when((a == "CREATE") & there, F.lit("REVISE")).otherwise(a)
    out = rows.withColumns({"outcome": outcome, "executed": executed, "rejected_reason": F.when(leaf & F.lit(not dry_run), F.lit("leaf-path"))})
    return out.withColumn("cascades", F.col("executed") & F.col("outcome").isin("REVISE", "CREATE")).drop("t_path", "t_content", "s_path", "s_content")


def apply(decided: DataFrame, pages: DataFrame, executor) -> DataFrame:
    """path and content of the pages that executed actions change. Of several for one page each is made in turn by action."""
    done = decided.where("executed")
    linked = done.where("outcome = 'LINK'").select(F.col("source").alias("path"), F.lit(2).alias("step"), F.col("target").alias("arg"), F.lit("").alias("by"))
    tasks = done.where("outcome = 'TASK'").select(F.col("target").alias("path"), F.lit(3).alias("step"), F.col("direction").alias("arg"), F.col("source").alias("by"))
    revised = done.where("outcome IN ('REVISE', 'CREATE')").select(F.col("target").alias("path"), F.lit(1).alias("step"), F.col("direction").alias("arg"), F.col("source").alias("by"))
    steps = linked.unionByName(tasks).unionByName(revised).groupBy("path").agg(F.sort_array(F.collect_list(F.struct("step", "arg", "by"))).alias("steps"))
    rows = steps.join(pages.select("path", "content"), "path", "left").withColumn("content", F.coalesce("content", F.lit("")))

    def make(content: Column, s: Column) -> Column:
        return F.when(s["step"] == 1, executor(content, s["arg"], s["by"])).when(s["step"] == 2, insert_link(content, s["arg"])).otherwise(insert_task(content, s["arg"], s["by"]))

    return rows.select("path", F.aggregate("steps", F.col("content"), make).alias("content"))
