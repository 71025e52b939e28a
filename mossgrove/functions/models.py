"""What a model would do, as functions to plug in, with deterministic stand-ins that need no network.

A judge gives a JUDGMENT from (parent, child); an executor a text from (parent, direction, child); a router
actions from (content, candidates); an embedder vectors from text; a reranker a score from (query, content).
Each is a function from columns to a column, so a real model is a pandas UDF with the same arguments. guarded() makes one
of a plain Python function whose failures stay with the row that they belong to.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mossgrove.functions.text import tokens
from mossgrove.functions.vectors import let
from mossgrove.model import ACTIONS


def guarded(call: Callable, kind: str = "string") -> Callable[..., Column]:
    """``call``, which takes a row's values and gives one of type ``kind``, as a function from columns to struct<value, error>.

    A call that raises gives its row a null value and the exception's text; the other rows go on.
    """

    @F.pandas_udf(f"struct<value:{kind},error:string>")
    def run(*columns: pd.Series) -> pd.DataFrame:
        out = []
        for row in zip(*columns):
            try:
                out.append((call(*row), None))
            except Exception as e:  # whatever a model raises is that row's result
                out.append((None, f"{type(e).__name__}: {e}"))
        return pd.DataFrame(out, columns=["value", "error"], dtype="object")

    return run


def outcome(rows: DataFrame, name: str) -> DataFrame:
    """``rows`` with what a model gave in column ``name``, and its error in ``error``: null unless the model is guarded()."""
    kind = rows.schema[name].dataType
    if getattr(kind, "names", None) == ["value", "error"]:
        return rows.withColumn("error", F.col(f"{name}.error")).withColumn(name, F.col(f"{name}.value"))
    return rows.withColumn("error", F.lit(None).cast("string"))


def judge_keep(parent: Column, child: Column) -> Column:
    return F.struct(F.lit("The stand-in judge reads nothing.").alias("seeing"), F.lit("KEEP").alias("verdict"), F.lit("").alias("direction"), F.lit("stand-in").alias("reason"))


def judge_revise(parent: Column, child: Column) -> Column:
    return F.struct(F.lit("").alias("seeing"), F.lit("REVISE").alias("verdict"), F.lit("mention the change").alias("direction"), F.lit("").alias("reason"))


def executor_echo(parent: Column, direction: Column, child: Column) -> Column:
    return parent


def router_skip(content: Column, candidates: Column) -> Column:
    return F.array().cast(ACTIONS)


def embed_words(text: Column, dimension: int = 64) -> Column:
    """Counts of words hashed to cells by MD5, scaled to length one; zeros for a text without words."""
    cells = F.transform(tokens(text), lambda t: (F.conv(F.substring(F.md5(t.cast("binary")), 1, 8), 16, 10).cast("bigint") % dimension).cast("int"))

    def counts(c: Column) -> Column:
        # runs of the sorted cells; a run's length is the distance of the places at which cells change
        ends = F.filter(F.sequence(F.lit(0), F.size(c) - 1), lambda i: (i == F.size(c) - 1) | (F.get(c, i) != F.get(c, i + 1)))
        runs = let(ends, lambda e: F.transform(e, lambda x, k: F.struct(F.get(c, x).alias("cell"), (x - F.coalesce(F.get(e, k - 1), F.lit(-1))).alias("n"))))
        found = let(runs, lambda r: F.map_from_arrays(r["cell"], r["n"]))
        return let(found, lambda m: F.transform(F.sequence(F.lit(0), F.lit(dimension - 1)), lambda i: F.coalesce(F.try_element_at(m, i), F.lit(0)).cast("double")))

    none = F.array_repeat(F.lit(0.0), dimension)
    raw = let(F.sort_array(cells), lambda c: F.when(F.coalesce(F.size(c), F.lit(0)) < 1, none).otherwise(counts(c)))
    return let(raw, lambda r: let(F.sqrt(F.aggregate(r, F.lit(0.0), lambda s, x: s + x * x)), lambda n: F.transform(r, lambda x: F.when(n == 0, F.lit(0.0)).otherwise(x / n))))


def rerank_overlap(query: Column, content: Column) -> Column:
    """The share of the query's distinct words that the content has."""
    words = F.array_distinct(tokens(query))
    return F.when(F.size(words) == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(words, tokens(content))) / F.size(words))
