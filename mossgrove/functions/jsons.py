"""Columns that read JSON out of free text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from mossgrove.model import ACTIONS, JUDGMENT

VERBS = ("REVISE", "LINK", "TASK", "CREATE")

# Fixed value: the reason that a verdict gives if the reply could not be read
UNREADABLE = "Could not parse structured response."


def routing_actions(raw: Column) -> Column:
    """Valid actions of the array from the first ``[`` to the last ``]``; none if that isn't JSON."""
    found = F.from_json(F.regexp_extract(raw, r"(?s)(\[.*\])", 1), ACTIONS)
    full = F.transform(
        F.filter(found, lambda x: x.isNotNull() & x["action"].isNotNull()),
        lambda x: F.struct(F.upper(x["action"]).alias("action"), *(F.coalesce(x[k], F.lit("")).alias(k) for k in ("target", "direction", "reason"))),
    )
    return F.coalesce(F.filter(full, lambda x: x["action"].isin(*VERBS)), F.array().cast(ACTIONS))


def judgment(raw: Column) -> Column:
    """The object from the first ``{`` to the last ``}``; KEEP, with the raw text's start, if that isn't JSON."""
    text = F.regexp_extract(raw, r"(?s)(\{.*\})", 1)
    found = F.from_json(text, JUDGMENT)
    good = F.try_parse_json(text).isNotNull()
    pick = lambda k, d: F.coalesce(found[k], F.lit(d))
    read = F.struct(pick("seeing", "").alias("seeing"), pick("verdict", "KEEP").alias("verdict"), pick("direction", "").alias("direction"), pick("reason", "").alias("reason"))
    kept = F.struct(F.left(raw, F.lit(500)).alias("seeing"), F.lit("KEEP").alias("verdict"), F.lit("").alias("direction"), F.lit(UNREADABLE).alias("reason"))
    return F.when(good & (text != ""), read).otherwise(kept)


def reply_text(raw: Column) -> Column:
    """A reply's result, else its content, else its text, else the raw text."""
    return F.coalesce(F.nullif(F.get_json_object(raw, "$.result"), F.lit("")), F.get_json_object(raw, "$.content"), F.get_json_object(raw, "$.text"), F.trim(raw))
