"""Hybrid retrieval: a vector leg and a keyword leg, scaled, merged and fused with the tree's depth.

Each leg ends in its best ``candidates`` (a top-k that needs no shuffle of the table); scaling, the full outer merge and
fusion see those rows only.
"""

from __future__ import annotations

import logging
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mossgrove.functions import vectors
from mossgrove.functions.paths import is_leaf, is_protected, trunk_boost, trunk_distance
from mossgrove.model import Params
from mossgrove.operators.bm25 import bm25
from mossgrove.sources import keyword_index
from mossgrove.sources.scratch import store

log = logging.getLogger(__name__)


def vector_topk(chunks: DataFrame, query: list[float], k: int, metric: str = "l2") -> DataFrame:
    """id and d, the distance, of the k nearest chunks (id, embedding); ties go to the smaller id."""
    rows = chunks.where("embedding IS NOT NULL").select("id", vectors.distance(F.col("embedding"), vectors.literal(query), metric).alias("d"))
    return rows.orderBy("d", "id").limit(k)


def text_topk(chunks: DataFrame, query: str, k: int, params: Params = Params(), keywords: str | None = None) -> DataFrame:
    """id and score of the k best chunks by BM25, from the keyword index at ``keywords`` if given; ties go to the smaller id."""
    found = bm25(chunks, query, params) if keywords is None else keyword_index.search(chunks.sparkSession, keywords, query, params)
    return found.orderBy(F.desc("score"), "id").limit(k)


def _leg(make: Callable[[], DataFrame], none: DataFrame, tolerant: bool) -> DataFrame:
    """A leg's few rows. A ``tolerant`` search works them out at once, and goes on without a leg that fails."""
    if not tolerant:
        return make()
    try:
        return store(make(), "leg")
    except Exception as e:  # whatever fails in it: the other leg's results are wanted
        log.warning("A leg of the search failed: %s", e)
        return none


def scaled(value: Column) -> Column:
    """From 0 to 1 over a leg's few rows; 1 for all if they are alike."""
    whole = Window.partitionBy()
    lo, hi = F.min(value).over(whole), F.max(value).over(whole)
    return F.when(hi == lo, F.lit(1.0)).otherwise((value - lo) / (hi - lo))


def candidates(chunks: DataFrame, vector: list[float] | None, query: str | None, params: Params = Params(), keywords: str | None = None, tolerant: bool = False) -> DataFrame:
    """Merged rows id, v, t, boost and score; either leg may be left out, or fail in a ``tolerant`` search, and then counts 0."""
    p = params
    none = lambda name: chunks.select("id", F.lit(0.0).alias(name)).where("false")
    v, t = none("v"), none("t")
    if vector is not None:
        v = _leg(lambda: vector_topk(chunks, vector, p.candidates, p.metric).select("id", scaled(1 - F.col("d")).alias("v")), v, tolerant)
    if query:
        t = _leg(lambda: text_topk(chunks, query, p.candidates, p, keywords).select("id", scaled(F.col("score")).alias("t")), t, tolerant)
    both = v.join(t, "id", "full_outer").select("id", F.coalesce("v", F.lit(0.0)).alias("v"), F.coalesce("t", F.lit(0.0)).alias("t"))
    found = both.join(chunks.select("id", "source", "content"), "id")
    boost = trunk_boost(trunk_distance(F.col("source")))
    return found.withColumn("boost", boost).withColumn("score", F.round(p.vector_weight * F.col("v") + p.text_weight * F.col("t") + p.trunk_weight * boost, 6))


def hybrid_search(chunks: DataFrame, vector: list[float] | None, query: str | None, params: Params = Params(), rerank: Callable[[Column, Column], Column] | None = None, keywords: str | None = None, tolerant: bool = False) -> DataFrame:
    """The ``top_k`` best chunks: rank, id, source, content, score. A reranker rescores the merged candidates."""
    found = candidates(chunks, vector, query, params, keywords, tolerant)
    if rerank is not None and query:
        found = found.withColumn("score", F.round(F.coalesce(rerank(F.lit(query), F.col("content")), F.lit(0.0)), 6))
    order = [F.desc("score"), F.desc("v"), F.desc("t"), "id"]
    top = found.orderBy(*order).limit(params.top_k)
    return top.select(F.row_number().over(Window.orderBy(*order)).alias("rank"), "id", "source", "content", "v", "t", "score")


def route_candidates(chunks: DataFrame, vector: list[float] | None, query: str | None, pages: DataFrame | None = None, params: Params = Params()) -> DataFrame:
    """Pages a text may be routed to: the best hit of each source that isn't a capture, with the page's whole text."""
    hits = hybrid_search(chunks, vector, query, Params(**{**params.__dict__, "top_k": params.route_top_k}))
    first = hits.withColumn("k", F.row_number().over(Window.partitionBy("source").orderBy("rank"))).where((F.col("k") == 1) & ~is_leaf(F.col("source"), params.leaf_prefixes))
    if pages is None:
        return first.drop("k")
    whole = pages.select("source", F.col("content").alias("page"))
    return first.join(whole, "source", "left").select("rank", "id", "source", F.coalesce("page", "content").alias("content"), "score")


def existing_concept(chunks: DataFrame, vector: list[float] | None, query: str | None, params: Params = Params()) -> DataFrame:
    """The best of the top hits that scores the floor or more and is neither a capture nor protected."""
    hits = hybrid_search(chunks, vector, query, params)
    ok = (F.col("score") >= params.concept_floor) & ~is_leaf(F.col("source"), params.leaf_prefixes) & ~is_protected(F.col("source"), params.protected)
    return hits.where(ok).orderBy("rank").limit(1)
