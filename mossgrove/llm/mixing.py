"""Mixing sources to target weights by Efraimidis-Spirakis sampling, in DataFrame operations only.

Each source's target is its share of all words, capped at a multiple of its size with the excess shared
anew. A target of ``e`` whole sizes and a remainder takes every document ``e`` times (complete epochs come
first); the remainder is a weighted sample without replacement: documents in the order of the exponential
key ``-ln(u) / weight`` until their sizes fill it. ``u`` comes from the id's MD5 and ``weight`` from the
text's quality, so reruns agree.

No source is sorted as a whole. Keys fall into ``BUCKETS`` ranges; the sums of sizes by source and range
(at most BUCKETS rows a source) say in which range the budget ends. Ranges before it are taken, those
after it aren't, and only the one range of each source in which it ends is sorted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mossgrove.llm.common import WORD, counted, store

WEIGHTS = (5, 2, 1)
MOST_EPOCHS = 3
BUCKETS = 4096
SALTS = 64
SYMBOLS = "#*$%&|<>"


def quality_weight(text: Column) -> Column:
    """From 0.05 to 1: less by the share of symbols among the text's characters."""
    n = F.length(text)
    return F.greatest(F.lit(0.05), 1 - 4 * (n - F.length(F.translate(text, SYMBOLS, ""))) / F.greatest(n, F.lit(1)))


def _size(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD)).cast("bigint")


def _key(doc_id: Column, text: Column) -> Column:
    digits = F.substring(F.md5(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), 1, 12)
    return -F.log((F.conv(digits, 16, 10).cast("double") + 0.5) / float(1 << 48)) / quality_weight(text)


def _bucket(key: Column) -> Column:
    return F.least(F.lit(BUCKETS - 1), F.floor(BUCKETS * key / (1 + key))).cast("int")


def sized(docs: DataFrame) -> DataFrame:
    """doc_id, source, size in words and the exponential key, which is the order of sampling."""
    text = F.coalesce("text", F.lit(""))
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "source", _size(text).alias("size"), _key(F.col("doc_id"), text).alias("key"))


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_EPOCHS) -> DataFrame:
    """Adds ``target`` to a table of source and source_size, a row a source.

    Sources in code-point order, null last, take ``weights`` in turn. With caps ``most * source_size`` the
    reshared targets are ``least(cap, level * weight)``; in the order of cap / weight the level is the first
    at which no later source reaches its cap.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    by_ratio = Window.orderBy("ratio", F.col("source").asc_nulls_last())
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy()
    t = sizes.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int")))
    t = t.withColumn("cap", F.col("source_size") * most).withColumn("ratio", F.col("cap") / F.col("weight"))
    t = t.withColumn("level", (F.sum("source_size").over(whole) - F.coalesce(F.sum("cap").over(before), F.lit(0))) / (F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0))))
    t = t.withColumn("level", F.min_by(F.when(F.col("level") <= F.col("ratio"), F.col("level")), F.when(F.col("level") <= F.col("ratio"), F.col("ratio"))).over(whole))
    return t.select("source", "source_size", F.least(F.col("cap").cast("double"), F.col("level") * F.col("weight")).alias("target"))


def _plan(rows: DataFrame, weights: tuple[int, ...], most: int) -> DataFrame:
    """A row a source: of, source_size, target, epochs, budget, and the bucket in which the budget ends with the words before it."""
    sums = rows.groupBy("source", _bucket(F.col("key")).alias("bucket")).agg(F.sum("size").alias("words"))
    sources = targets(sums.groupBy("source").agg(F.sum("words").alias("source_size")), weights, most)
    sources = sources.withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)))
    sources = sources.withColumn("budget", F.col("target") - F.col("epochs") * F.col("source_size"))
    upto = sums.withColumn("upto", F.sum("words").over(Window.partitionBy("source").orderBy("bucket")))
    ends = upto.join(sources, upto["source"].eqNullSafe(sources["source"])).where(F.col("upto") > F.col("budget"))
    ends = ends.groupBy(upto["source"]).agg(F.min(F.struct("bucket", (F.col("upto") - F.col("words")).alias("before"))).alias("end"))
    return store(sources.join(ends, sources["source"].eqNullSafe(ends["source"]), "left").select(sources["source"].alias("of"), "source_size", "target", "epochs", "budget", "end.bucket", "end.before"), "plan")


def _planned(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """``rows`` (source, key) with their source's plan. Each source is split into SALTS by its rows' buckets."""
    salted = plan.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    own = _bucket(F.col("key"))
    return rows.join(salted, rows["source"].eqNullSafe(salted["of"]) & (own % SALTS == salted["salt"]), "left").withColumn("own", own).drop("salt")


def _last(at: DataFrame) -> DataFrame:
    """The rows of the buckets in which budgets end, with ``more``: 1 if they are within the budget, else 0."""
    in_order = Window.partitionBy("of").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return at.where(F.col("own") == F.col("bucket")).withColumn("more", (2 * (F.sum("size").over(in_order) + F.col("before")) - F.col("size") <= 2 * F.col("budget")).cast("int"))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_EPOCHS) -> DataFrame:
    """A row for each row of ``docs`` (doc_id, text, source): doc_id, size, source_size, target, taken, copies.

    Texts of any length count whole. ``copies`` is how often the mix takes the document and ``taken`` its words times that. The document at
    which the budget ends is taken if that comes nearer to it. Null texts have size 0; a null source is a source;
    rows with a null or repeated id share a key, and ties go by id and size. An empty table gives no rows.
    """
    rows = store(sized(docs), "sized")
    at = _planned(rows, _plan(rows, weights, most))
    rest = at.where(~F.coalesce(F.col("own") == F.col("bucket"), F.lit(False))).withColumn("more", F.coalesce((F.col("own") < F.col("bucket")).cast("int"), F.lit(0)))
    copies = (F.col("epochs") + F.col("more")).cast("bigint")
    return _last(at).unionByName(rest).select("doc_id", "size", "source_size", "target", (copies * F.col("size")).alias("taken"), copies.alias("copies"))


def repeat(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_EPOCHS) -> DataFrame:
    """``docs`` with each row as often as mix() takes it, and no other column.

    Rows find their plan by source and key, so texts aren't shuffled; only for the ids in the buckets in which
    budgets end is mix()'s decision looked up. Of rows alike in id, key and size there, all or none are taken.
    """
    rows = store(sized(docs), "sized")
    plan = _plan(rows, weights, most)
    last = _last(_planned(rows, plan)).groupBy("of", F.col("doc_id").alias("id_of"), F.col("key").alias("at"), F.col("size").alias("n")).agg(F.min("more").alias("last"))
    text = F.coalesce("text", F.lit(""))
    # the input is one struct meanwhile, so that no name of its columns can clash
    own = docs.select(F.struct("*").alias("row"), F.col("source").alias("src"), F.col("doc_id").cast("bigint").alias("id"), _key(F.col("doc_id"), text).alias("key"), _size(text).alias("words"))
    own = own.join(counted(plan.select(F.col("of").alias("planned"), "epochs", "bucket")), F.col("src").eqNullSafe(F.col("planned")), "left")
    own = own.join(counted(last), F.col("src").eqNullSafe(F.col("of")) & F.col("id").eqNullSafe(F.col("id_of")) & (F.col("key") == F.col("at")) & (F.col("words") == F.col("n")), "left")
    copies = F.col("epochs") + F.coalesce("last", (_bucket(F.col("key")) < F.col("bucket")).cast("int"), F.lit(0))
    return own.where(copies > 0).select("row", F.explode(F.sequence(F.lit(1).cast("bigint"), copies.cast("bigint")))).select("row.*")


ORACLE = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         -ln((('0x' || substr(md5(doc_id::VARCHAR), 1, 12))::BIGINT + 0.5e0) / 281474976710656e0)
           / greatest(0.05e0, 1 - 4 * (length(coalesce(text, '')) - length(translate(coalesce(text, ''), '#*$%&|<>', '')))::DOUBLE
               / greatest(length(coalesce(text, '')), 1)) AS key
  FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size,
             [5, 2, 1][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS weight FROM d GROUP BY source),
r AS (SELECT *, 3 * source_size AS cap, 3 * source_size / weight::DOUBLE AS ratio FROM s),
l AS (SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER b, 0))::DOUBLE / (sum(weight) OVER () - coalesce(sum(weight) OVER b, 0)) AS level
      FROM r WINDOW b AS (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (SELECT source, source_size, least(cap::DOUBLE, (SELECT arg_min(level, ratio) FROM l WHERE level <= ratio) * weight) AS target FROM l),
e AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS epochs FROM t),
p AS (SELECT d.*, e.source_size, e.target, e.epochs, e.target - e.epochs * e.source_size AS budget,
             sum(size) OVER (PARTITION BY d.source ORDER BY key, doc_id, size ROWS UNBOUNDED PRECEDING) AS upto
      FROM d JOIN e ON d.source IS NOT DISTINCT FROM e.source),
c AS (SELECT *, (epochs + CASE WHEN 2 * upto - size <= 2 * budget THEN 1 ELSE 0 END)::BIGINT AS copies FROM p)
SELECT doc_id, size, source_size, target, copies * CASE WHEN size > 0 THEN size ELSE 0 END AS taken, copies FROM c
"""
