"""Quality rules over whole texts, in DataFrame operations only.

Base rules count words, symbols, repeated lines and repeated 5-word windows. The method is a hashed n-gram
log-likelihood ratio: n-grams of a text's tokens (runs of letters and digits, or of other signs) are hashed to ``BUCKETS`` cells; two multinomials over the cells, of a trusted target and of the raw corpus, are counted
over all documents; a text's score is the mean over its n-grams of ``ln(p_target / p_raw)``, which does not depend
on length. The target is what passes strict rules itself: no symbols, no repeated lines or windows and no
runs of signs.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mossgrove.llm.common import ASCII_SPACE

BUCKETS = 1 << 15
THRESHOLD = -0.35
WINDOW = 5
SPACE = r"\s+"  # in Java that is ASCII white space only
TOKEN = r"[\p{L}\p{N}]+|[^\p{L}\p{N}\s]+"
SYMBOLS = "#*$%&|<>"


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once a row, also where a lambda within ``body`` uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words_of(text: Column, most: int = -1) -> Column:
    """A text's words; with ``most`` the last of so many parts is the rest of the text."""
    return F.array_remove(F.split(text, SPACE, most), "")


def _zipped(a: Column, b: Column, apart: int) -> Column:
    """Hashes of each element of ``a`` and that of ``b`` which is ``apart`` further on, as far as there is one."""
    n = F.greatest(F.size(b) - apart, F.lit(0))
    return F.zip_with(F.slice(a, F.lit(1), n), F.slice(b, F.lit(apart + 1), n), lambda x, y: F.xxhash64(x, y))


def _windows(h: Column, window: int, done: int = 1, sofar: Column | None = None) -> Column:
    """Hashes of ``window`` neighbours, from hashes of twice as many neighbours in each step."""
    if done == window:
        return h if sofar is None else sofar
    if 2 * done <= window:
        return _let(_zipped(h, h, 1) if sofar is None else _zipped(sofar, sofar, done), lambda x: _windows(h, window, 2 * done, x))
    return _let(_zipped(sofar, h, done), lambda x: _windows(h, window, done + 1, x))


def repeated_words(words: Column, window: int = WINDOW) -> Column:
    """Words in ``window``-word windows found twice or more in the text, from an array of words.

    Windows are 64-bit hashes of the words' hashes. Repeated ones are neighbours after a sort by hash; the
    words they cover follow from the gaps between their sorted starts.
    """

    def starts(g: Column) -> Column:
        pairs = F.sort_array(F.transform(g, lambda x, i: F.struct(x.alias("h"), i.alias("at"))))
        again = _let(pairs, lambda s: F.transform(F.filter(s, lambda e, k: (e["h"] == F.get(s, k - 1)["h"]) | (e["h"] == F.get(s, k + 1)["h"])), lambda e: e["at"]))
        return F.sort_array(again)

    def covered(g: Column) -> Column:
        spans = _let(starts(g), lambda p: F.transform(p, lambda x, k: F.least(F.lit(window), F.coalesce(F.get(p, k + 1) - x, F.lit(window)))))
        return F.aggregate(spans, F.lit(0), lambda a, x: a + x)

    counted = _let(F.transform(words, lambda w: F.xxhash64(w)), lambda h: _let(_windows(h, window), lambda g: F.when(F.size(F.array_distinct(g)) == F.size(g), F.lit(0)).otherwise(covered(g))))
    return F.when(F.size(words) < window, F.lit(0)).otherwise(counted)


def _dup_lines(text: Column) -> Column:
    lines = F.filter(F.split(text, "\n", -1), lambda x: F.ltrim(x, F.lit(ASCII_SPACE)) != "")
    return _let(lines, lambda a: F.size(a) - F.size(F.array_distinct(a)))


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0))


def grams(text: Column) -> Column:
    """Hashes of a text's token unigrams and bigrams."""
    return _let(F.transform(tokens(text), lambda t: F.xxhash64(t)), lambda h: F.concat(h, _zipped(h, h, 1)))


def cell(gram: Column, buckets: int = BUCKETS) -> Column:
    return gram.bitwiseAND(F.lit(buckets - 1)).cast("int")


def strict(text: Column) -> Column:
    """The rules of the trusted target: no symbols, no runs of two signs or more, no repeated line, ten words."""
    return ~text.rlike(r"[#*$%&|<>]|[^\p{L}\p{N}\s]{2}") & (F.size(words_of(text, 11)) >= 10) & (_dup_lines(text) == 0)


def ratios(docs: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """One row with one array: by cell, the log of the cell's share in the target over that in the corpus.

    Both multinomials are counted over all rows, a count of one added to each cell. What meets in one
    task is a row for each cell. Tokens are laid out as rows, each beside the next, and hashed there to the cells that
    grams() gives; the outer form of that step is one which Spark doesn't guard by a filter that would cut the text a second time.
    """
    text = F.coalesce("text", F.lit(""))
    laid = docs.select(strict(text).cast("long").alias("own"), tokens(text).alias("tokens"))
    laid = laid.select("own", F.inline_outer(F.arrays_zip(F.col("tokens").alias("token"), F.slice("tokens", F.lit(2), F.greatest(F.size("tokens") - 1, F.lit(0))).alias("next"))))
    one, both = F.xxhash64("token"), F.xxhash64(F.xxhash64("token"), F.xxhash64("next"))
    laid = laid.select("own", F.when(F.col("token").isNotNull(), cell(one, buckets)).alias("one"), F.when(F.col("next").isNotNull(), cell(both, buckets)).alias("both"))
    seen = laid.select("own", F.explode(F.array("one", "both")).alias("cell")).where("cell IS NOT NULL")
    none = docs.sparkSession.range(buckets).select(F.lit(1).cast("long").alias("target"), F.lit(1).cast("long").alias("raw"), F.col("id").cast("int").alias("cell"))
    counts = seen.groupBy("cell").agg(F.sum("own").alias("target"), F.count("*").alias("raw")).select("target", "raw", "cell").unionByName(none)
    counts = counts.groupBy("cell").agg(F.sum("target").alias("target"), F.sum("raw").alias("raw"))
    whole = counts.agg(F.sort_array(F.collect_list(F.struct("cell", "target", "raw"))).alias("by"), F.sum("target").alias("target"), F.sum("raw").alias("raw"))
    return whole.select(F.transform("by", lambda x: F.log(x["target"] / F.col("target")) - F.log(x["raw"] / F.col("raw"))).alias("ratio"))


def judge(docs: DataFrame, threshold: float = THRESHOLD, buckets: int = BUCKETS) -> DataFrame:
    """doc_id, the base measures, score and verdict of each row of ``docs`` (doc_id, text).

    ``kept`` is false if a base rule fails (under 10 words, or over a fifth of them in repeated windows), else
    whether the score reaches ``threshold``. A null or empty text has no words and fails the base rules, with score
    0. Null and repeated ids are judged row by row; very long texts count whole; other columns are ignored; an empty table gives
    no rows.
    """
    text, words, model = F.col("_text"), F.col("_words"), F.col("_model")
    read = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("_text"))
    read = read.select("*", words_of(text).alias("_words"), ratios(docs, buckets).scalar().alias("_model"))
    score = _let(grams(text), lambda c: F.when(F.size(c) == 0, F.lit(0.0)).otherwise(F.aggregate(c, F.lit(0.0), lambda a, x: a + F.get(model, cell(x, buckets))) / F.size(c)))
    out = read.select(
        "doc_id",
        F.size(words).cast("bigint").alias("n_words"),
        F.length(F.array_join(words, "")).cast("bigint").alias("word_chars"),
        F.regexp_count(text, F.lit(f"[{SYMBOLS}]")).cast("bigint").alias("n_symbols"),
        _dup_lines(text).cast("bigint").alias("n_dup_lines"),
        repeated_words(words).cast("bigint").alias("n_repeat_words"),
        score.alias("score"),
    )
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return out.withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & (F.col("score") >= threshold))
