"""Turns of conversations out of transcript lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mossgrove.functions.dates import parsed
from mossgrove.functions.text import front_matter
from mossgrove.model import BLOCKS

_LINE = "type string, timestamp string, message struct<role:string,timestamp:string,content:string>"
ROLES = ("user", "assistant")


def block_text(blocks: Column) -> Column:
    """Blocks as text: texts, tool calls and tool results, each cut at 2,000 characters; thinking is left out."""
    cut = lambda x: F.left(F.coalesce(x, F.lit("")), F.lit(2000))
    one = lambda b: (
        F.when(b["type"] == "text", F.coalesce(b["text"], F.lit("")))
        .when(b["type"] == "tool_use", F.concat(F.lit("\n[tool_use: "), F.coalesce(b["name"], F.lit("unknown")), F.lit("]\n```json\n"), cut(F.coalesce(b["input"], F.lit("{}"))), F.lit("\n```")))
        .when(b["type"] == "tool_result", F.concat(F.lit("\n[tool_result]\n"), cut(b["content"])))
    )
    parts = F.filter(F.transform(blocks, one), lambda x: x.isNotNull() & (x != ""))
    return F.regexp_replace(F.array_join(parts, "\n"), r"(?U)^\s+|\s+$", "")


def marked(lines: DataFrame) -> DataFrame:
    """session, line, role, timestamp, content and is_turn of lines (session, line, value); bad JSON is no turn."""
    e = lines.withColumn("e", F.from_json("value", _LINE)).select("session", "line", "value", "e.*")
    raw = F.col("message.content")
    blocks = F.from_json(raw, BLOCKS)
    listed = F.get_json_object("value", "$.message.content[0]").isNotNull() & raw.startswith("[")
    content = F.when(listed, block_text(blocks)).otherwise(raw)
    known = F.col("type").isin(*ROLES) & F.col("message.role").isin(*ROLES)
    when = F.coalesce(F.nullif(F.col("timestamp"), F.lit("")), F.col("message.timestamp"), F.lit(""))
    rows = e.select("session", "line", F.col("message.role").alias("role"), when.alias("timestamp"), content.alias("content"), listed.alias("listed"), known.alias("known"))
    ok = F.coalesce(F.col("known") & F.col("content").isNotNull() & ~(F.coalesce("listed", F.lit(False)) & (F.col("content") == "")), F.lit(False))
    return rows.select("session", "line", "role", "timestamp", "content", ok.alias("is_turn"))


def parse(lines: DataFrame) -> DataFrame:
    """session, line, role, timestamp, content of the lines (session, line, value) that are turns; bad JSON is skipped."""
    return marked(lines).where("is_turn").drop("is_turn")


def numbered(turns: DataFrame, counts: DataFrame | None = None) -> DataFrame:
    """Adds turn_number: the session's turns so far (``counts``: session, turn_count), plus one for each in line order."""
    n = F.row_number().over(Window.partitionBy("session").orderBy("line"))
    if counts is None:
        return turns.withColumn("turn_number", n)
    return turns.withColumn("_n", n).join(counts, "session", "left").withColumn("turn_number", F.col("_n") + F.coalesce("turn_count", F.lit(0))).drop("_n", "turn_count")


def marker(lines: DataFrame, turns: DataFrame) -> DataFrame:
    """session, last_line, turn_count: where the next run goes on. Lines count whether or not they are turns."""
    last = lines.groupBy("session").agg(F.max("line").alias("last_line"))
    count = turns.groupBy("session").agg(F.max("turn_number").alias("turn_count"))
    return last.join(count, "session", "left").select("session", "last_line", F.coalesce("turn_count", F.lit(0)).alias("turn_count"))


def event_path(timestamp: Column, session: Column, number: Column, entity: Column) -> Column:
    day = F.date_format(parsed(timestamp), "yyyy/MM/yyyy-MM-dd")
    return F.concat(entity, F.lit("/"), day, F.lit("/"), F.left(session, F.lit(8)), F.lit("-turn-"), F.format_string("%04d", number.cast("bigint")), F.lit(".md"))


def event_content(rows: DataFrame, trigger: str, captured_at: Column) -> Column:
    head = front_matter(session_id=F.col("session"), turn_number=F.col("turn_number"), role=F.col("role"), timestamp=F.coalesce(F.nullif(F.col("timestamp"), F.lit("")), captured_at), captured_at=captured_at, trigger=F.lit(trigger))
    return F.concat(head, F.lit("\n\n"), "content", F.lit("\n"))
