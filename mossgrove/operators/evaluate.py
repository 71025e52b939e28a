"""Quality of retrieval, judgments and cascades over labelled cases."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mossgrove.functions import models
from mossgrove.model import Params
from mossgrove.operators import graph, many


def judge_cases(cases: DataFrame) -> DataFrame:
    """Adds passed: the verdicts are equal and, for REVISE, the direction has all expected words, in any case."""
    words = F.forall("expected_direction_keywords", lambda k: F.contains(F.lower("actual_direction"), F.lower(k)))
    ok = F.col("expected_verdict") == F.col("actual_verdict")
    return cases.withColumn("passed", ok & ((F.col("expected_verdict") != "REVISE") | F.coalesce(words, F.lit(True))))


def run_judge(cases: DataFrame, judge: Callable[[Column, Column], Column]) -> DataFrame:
    """judge_cases() of what ``judge`` gives the cases (parent, child, expected_verdict, expected_direction_keywords), and error.

    A guarded judge that fails on a case fails that case only.
    """
    got = models.outcome(cases.withColumn("judgment", judge(F.col("parent"), F.col("child"))), "judgment")
    verdict = F.coalesce("judgment.verdict", F.lit("FAILED"))
    return judge_cases(got.withColumn("actual_verdict", verdict).withColumn("actual_direction", F.coalesce("judgment.direction", F.lit(""))).drop("judgment"))


def run_cascades(pages: DataFrame, cases: DataFrame, judge: Callable[[Column, Column], Column] = models.judge_keep, executor: Callable[..., Column] = models.executor_echo, params: Params = Params()) -> DataFrame:
    """case, actual_depth, actual_flag, expected_flag, errors and passed of cases (case, path, content, expected_flag).

    Each case is a cascade of its own from a page whose content is the case's, all in the same few rounds; to the other cases
    that page is as it was. The flag says
    whether a protected page was reached; a case that expects none passes either way. Depth is -1 where a step failed.
    """
    new = cases.join(pages.select("path"), "path", "left_anti").groupBy("path").agg(F.min("content").alias("content"))
    tree = pages.select("path", "content").unionByName(new)
    rows = graph.cascade(tree, cases.select("case", "path", "content"), judge, executor, params, by=("case",))
    by = rows.groupBy("case").agg(F.max("depth").alias("depth"), F.max(F.col("verdict") == "PROMOTE").alias("flag"), F.count_if(F.col("error").isNotNull()).alias("errors"))
    out = cases.select("case", "expected_flag").join(by, "case", "left")
    errors, flag = F.coalesce("errors", F.lit(0)), F.coalesce("flag", F.lit(False))
    out = out.select("case", F.when(errors > 0, F.lit(-1)).otherwise(F.coalesce("depth", F.lit(0))).alias("actual_depth"), flag.alias("actual_flag"), "expected_flag", errors.alias("errors"))
    return out.withColumn("passed", F.col("actual_flag") | ~F.col("expected_flag"))


def judge_metrics(cases: DataFrame) -> DataFrame:
    return cases.agg(F.count("*").alias("total"), F.count_if("passed").alias("passed"), F.coalesce(F.avg(F.col("passed").cast("int")), F.lit(0.0)).alias("accuracy"))


def confusion(cases: DataFrame) -> DataFrame:
    return cases.groupBy("expected_verdict", "actual_verdict").agg(F.count("*").alias("n"))


def search_cases(cases: DataFrame) -> DataFrame:
    """Adds hits, misses, false_positives, rr and passed to cases (expected, unwanted, sources: arrays, in rank order).

    The reciprocal rank is that of the first listed expectation that is found, at its first place.
    """
    found = lambda x: F.exists("sources", lambda s: F.contains(s, x))
    places = F.transform("hits", lambda x: F.array_position(F.transform("sources", lambda s: F.contains(s, x)), True))
    out = cases.withColumn("hits", F.filter("expected", found)).withColumn("misses", F.filter("expected", lambda x: ~found(x)))
    out = out.withColumn("false_positives", F.filter("unwanted", found))
    out = out.withColumn("rr", F.when(F.size("hits") > 0, 1.0 / F.get(places, F.lit(0))).otherwise(F.lit(0.0)))
    return out.withColumn("passed", (F.size("misses") == 0) & (F.size("false_positives") == 0))


def run_search(chunks: DataFrame, cases: DataFrame, params: Params = Params(), vectors: DataFrame | None = None) -> DataFrame:
    """search_cases() of what hybrid search gives the cases (qid, text, vector, k, expected, unwanted), all in one pass.

    ``k`` is how many hits count for a case, up to ``params.top_k``; a case that finds nothing has no sources.
    ``vectors`` is that of many.hybrid_search().
    """
    hits = many.hybrid_search(chunks, cases, params, vectors).select("qid", F.struct("rank", "source").alias("hit"))
    hits = hits.groupBy("qid").agg(F.sort_array(F.collect_list("hit")).alias("hits_"))
    got = F.transform(F.filter("hits_", lambda h: h["rank"] <= F.col("k")), lambda h: h["source"])
    rows = cases.select("qid", "k", "expected", "unwanted").join(hits, "qid", "left")
    return search_cases(rows.select("qid", "expected", "unwanted", F.coalesce(got, F.array().cast("array<string>")).alias("sources")))


def search_metrics(cases: DataFrame) -> DataFrame:
    want, hits = F.sum(F.size("expected")), F.sum(F.size("hits"))
    return cases.agg(
        F.count("*").alias("total"),
        F.count_if("passed").alias("passed"),
        F.coalesce(F.avg(F.when(F.size("expected") > 0, F.col("rr"))), F.lit(0.0)).alias("mrr"),
        F.coalesce(hits / F.nullif(want, F.lit(0)), F.lit(0.0)).alias("recall_at_k"),
    )


def cascade_metrics(cases: DataFrame) -> DataFrame:
    """Totals of cases (actual_depth, -1 if it didn't run; actual_flag; expected_flag). A case passes by its flag alone."""
    return cases.agg(
        F.count("*").alias("total"),
        F.count_if(F.col("actual_flag") == F.col("expected_flag")).alias("passed"),
        F.coalesce(F.avg(F.when(F.col("actual_depth") >= 0, F.col("actual_depth"))), F.lit(0.0)).alias("avg_depth"),
        F.coalesce(F.avg(F.col("actual_flag").cast("int")), F.lit(0.0)).alias("trunk_flag_rate"),
    )


def mean_latency(events: DataFrame) -> DataFrame:
    return events.agg(F.coalesce(F.avg(F.when(F.col("elapsed_ms") > 0, F.col("elapsed_ms"))), F.lit(0.0)).alias("mean_ms"))


def text_report(cases: DataFrame, most: int = 50) -> str:
    """A few lines for a terminal about search cases that run_search() has run: the totals, and the cases that failed."""
    m = search_metrics(cases).first()
    lines = [f"search: {m.passed} of {m.total} passed, MRR {m.mrr:.4f}, recall {m.recall_at_k:.4f}"]
    for r in cases.where("NOT passed").orderBy("qid").limit(most).collect():
        lines.append(f"  {r.qid}: " + "; ".join(f"{k} {', '.join(v)}" for k, v in (("missed", r.misses), ("unwanted", r.false_positives)) if v))
    return "\n".join(lines)


def snapshot(cases: DataFrame, path: str) -> DataFrame:
    """Writes the metrics of run search cases as one JSON line below ``path``; the difference to what lay there before.

    One row: each metric now, and its change since the last snapshot (null if there was none).
    """
    spark, now = cases.sparkSession, search_metrics(cases)
    then = None
    try:
        then = spark.read.schema(now.schema).json(path).first()
    except AnalysisException:  # the first snapshot
        pass
    row = now.first()
    spark.createDataFrame([row], now.schema).coalesce(1).write.mode("overwrite").json(path)
    return spark.createDataFrame([row], now.schema).select("*", *(F.lit(None if then is None else row[c] - then[c]).cast("double").alias(f"{c}_change") for c in now.columns))


def report(**parts: DataFrame) -> DataFrame:
    """One row with one JSON text: each part's only row under its name."""
    spark = next(iter(parts.values())).sparkSession
    return spark.range(1).select(*(p.select(F.struct("*")).scalar().alias(k) for k, p in parts.items())).select(F.to_json(F.struct("*")).alias("report"))
