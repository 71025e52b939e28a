"""Keyword relevance: BM25 over the content, heading and source of chunks.

Without an index a query reads the chunks once and keeps one narrow row for each: its length and the counts of the
query's terms. With one (sources/keyword_index.py) only the postings of the query's terms are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mossgrove.functions.text import query_terms, search_tokens
from mossgrove.functions.vectors import let
from mossgrove.model import Params

LEAST_IDF = 1e-6


def document_tokens(chunks: DataFrame) -> Column:
    cols = [F.col(c) for c in ("content", "heading", "source") if c in chunks.columns]
    return search_tokens(F.concat_ws(" ", *cols))


def idf(n: Column, df: Column) -> Column:
    raw = F.log((n - df + 0.5) / (df + 0.5))
    return F.when(raw <= 0, F.lit(LEAST_IDF)).otherwise(raw)


def term_score(tf: Column, length: Column, mean: Column, idf_: Column, p: Params) -> Column:
    return idf_ * tf * (p.k1 + 1) / (tf + p.k1 * (1 - p.b + p.b * length / mean))


def _phrase(words: Column, phrase: list[str]) -> Column:
    """How often a phrase's tokens are adjacent in ``words``."""
    if len(phrase) == 1:
        return F.size(F.filter(words, lambda w: w == phrase[0]))
    def starts(w: Column) -> Column:
        def here(i: Column) -> Column:
            out = F.get(w, i) == phrase[0]
            for k, token in enumerate(phrase[1:], 1):
                out = out & (F.get(w, i + k) == token)
            return out

        return F.when(F.size(w) < len(phrase), F.lit(0)).otherwise(F.size(F.filter(F.sequence(F.lit(0), F.size(w) - len(phrase)), here)))

    return let(words, starts)  # a filter on the count may be pushed to where ``words`` is no column yet


def phrases(spark, query: str) -> list[list[str]]:
    """The tokens of each word of a query, repeats kept; words without a token are dropped."""
    words = query_terms(query)
    if not words:
        return []
    row = spark.range(1).select(*(search_tokens(F.lit(w)).alias(f"w{i}") for i, w in enumerate(words))).first()
    return [list(x) for x in row if x]


def bm25(chunks: DataFrame, query: str, params: Params = Params()) -> DataFrame:
    """id and score of the chunks (id, content, heading, source) that have any of the query's terms."""
    terms = phrases(chunks.sparkSession, query)
    if not terms:
        return chunks.select("id", F.lit(0.0).alias("score")).where("false")
    names = [f"f{i}" for i in range(len(terms))]
    hit = lambda c: F.greatest(F.lit(0), *(c[f] for f in names)) > 0
    counts = let(document_tokens(chunks), lambda w: F.struct(F.size(w).alias("length"), *(_phrase(w, t).alias(f) for f, t in zip(names, terms))))
    stats = chunks.select(counts.alias("c")).agg(F.count("*").alias("n"), F.avg("c.length").alias("mean"), *(F.count_if(F.col(f"c.{f}") > 0).alias(f"n{i}") for i, f in enumerate(names)))
    # chunks without a hit are dropped by the generator: a filter would be pushed down and split texts once for each term
    s = chunks.select("id", F.inline(F.filter(F.array(counts), hit))).withColumn("s", stats.select(F.struct("*")).scalar())
    score = sum((term_score(F.col(f"f{i}"), F.col("length"), F.col("s.mean"), idf(F.col("s.n"), F.col(f"s.n{i}")), params) for i in range(len(terms))), F.lit(0.0))
    return s.select("id", score.alias("score"))


def postings(chunks: DataFrame, *more: str) -> DataFrame:
    """term, id, length (of the chunk), tf and positions, a row for each distinct term of each chunk, and columns ``more``.

    Nothing is shuffled: a chunk's tokens are sorted with their positions and cut where the token changes.
    """
    def runs(s: Column) -> Column:
        begins = F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda i: (i == 0) | (F.get(s, i)["t"] != F.get(s, i - 1)["t"]))
        cut = lambda b: F.zip_with(b, F.concat(F.slice(b, 2, F.size(b)), F.array(F.size(s))), lambda x, y: F.struct(F.get(s, x)["t"].alias("term"), F.transform(F.slice(s, x + 1, y - x), lambda e: e["i"]).alias("positions")))
        return let(begins, cut)

    words = chunks.select("id", *more, document_tokens(chunks).alias("w")).where("size(w) > 0")
    rows = words.select("id", *more, F.size("w").alias("length"), F.sort_array(F.transform("w", lambda t, i: F.struct(t.alias("t"), i.alias("i")))).alias("s"))
    return rows.select("id", *more, "length", F.inline(let(F.col("s"), runs))).select("term", "id", *more, "length", F.size("positions").cast("bigint").alias("tf"), "positions")


def term_stats(chunks: DataFrame) -> DataFrame:
    """term, df (chunks that have it) and cf (how often it occurs)."""
    return postings(chunks).groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))


def _occurrences(phrase: list[str], at: dict[str, int]) -> Column:
    """How often a phrase occurs in a row that has tf and positions by token, t<i> and p<i>; null if a token is missing."""
    if len(phrase) == 1:
        return F.col(f"t{at[phrase[0]]}")

    def moved(token: str, by: int) -> Column:
        return F.transform(f"p{at[token]}", lambda x: x - by)

    out = F.col(f"p{at[phrase[0]]}")
    for k, token in enumerate(phrase[1:], 1):
        out = F.array_intersect(out, moved(token, k))
    return F.size(out)


def bm25_of(found: DataFrame, words: list[list[str]], n: Column, mean: Column, params: Params = Params()) -> DataFrame:
    """bm25() from postings (term, id, length, tf, positions) of the words' tokens, in a corpus of n chunks of a mean length."""
    at = {t: i for i, t in enumerate(sorted({t for w in words for t in w}))}
    phrased = {t for w in words if len(w) > 1 for t in w}
    one = lambda c, t: F.first(F.when(F.col("term") == t, F.col(c)), ignorenulls=True)
    rows = found.groupBy("id", "length").agg(*(one("tf", t).alias(f"t{i}") for t, i in at.items()), *(one("positions", t).alias(f"p{i}") for t, i in at.items() if t in phrased))
    rows = rows.select("id", "length", *(F.coalesce(_occurrences(w, at), F.lit(0)).alias(f"f{k}") for k, w in enumerate(words)))
    stats = rows.agg(*(F.count_if(F.col(f"f{k}") > 0).alias(f"n{k}") for k in range(len(words)))).select(F.struct("*")).scalar()
    rows = rows.where(F.greatest(F.lit(0), *(F.col(f"f{k}") for k in range(len(words)))) > 0).withColumn("s", stats)
    score = sum((term_score(F.col(f"f{k}"), F.col("length"), mean, idf(n, F.col(f"s.n{k}")), params) for k in range(len(words))), F.lit(0.0))
    return rows.select("id", score.alias("score"))
