"""A thin command line over the engine: index a tree, search it, show its state, watch it, work its queue off."""

from __future__ import annotations

import argparse

from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from mossgrove.functions.models import embed_words
from mossgrove.functions.text import preview
from mossgrove.model import CHUNKS, Params
from mossgrove.operators import evaluate, hybrid, metrics, queue
from mossgrove.plans.pipelines import index_tree
from mossgrove.session import session
from mossgrove.sources import files, keyword_index, sinks
from mossgrove.sources.scratch import store
from mossgrove.streaming import changes, daemon

COMMANDS = ("index", "write", "read", "status", "watch", "sleep", "queue", "daemon", "ingest", "metrics", "eval")


def _queued(spark, table: str, rows):
    """Adds tasks (type, path, priority) to the queue at ``table``, which is made if there is none."""
    blank = lambda c, v: F.lit(v).cast("string").alias(c)
    now = F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss").alias("queued_at")
    new = queue.with_ids(rows.select("type", "path", F.col("priority").cast("int").alias("priority"), blank("parent", None), blank("status", "pending"), blank("error", None), now, F.unix_micros(F.current_timestamp()).alias("pos")))
    try:
        old = sinks.read_table(spark, table)
    except AnalysisException:
        old = new.limit(0)
    sinks.replace_table(queue.enqueue(old, new), table)


def _keywords(a) -> str:
    """Where the keyword index of a chunk table is."""
    return f"{a.table.rstrip('/')}-keywords"


def _handlers(spark, a) -> daemon.Handlers:
    """What the command line does with tasks: bring the index up to date. Models are plugged in by library."""

    def reindex(tasks):
        index_tree(spark, a.root, a.table, keywords=_keywords(a)).collect()
        return tasks.select("id", F.lit(None).cast("string").alias("error"))

    return dict.fromkeys(("ingest", "route"), reindex)


def _evaluated(spark, chunks, cases: str, snapshot: str | None) -> int:
    """Runs search cases and prints a report; 1 if any case failed."""
    none = F.array().cast("array<string>")
    rows = spark.read.schema("qid string, text string, k int, expected array<string>, unwanted array<string>").json(cases)
    rows = rows.select("qid", "text", F.coalesce("k", F.lit(Params().top_k)).alias("k"), F.coalesce("expected", none).alias("expected"), F.coalesce("unwanted", none).alias("unwanted"), embed_words(F.col("text")).alias("vector"))
    top = rows.agg(F.coalesce(F.max("k"), F.lit(1))).first()[0]
    got = store(evaluate.run_search(chunks, rows, Params(top_k=top, candidates=max(top, Params().candidates))), "cases")
    print(evaluate.text_report(got))
    if snapshot:
        print(evaluate.snapshot(got, snapshot).first().asDict())
    return int(bool(got.where("NOT passed").take(1)))


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="mossgrove")
    p.add_argument("command", choices=COMMANDS)
    p.add_argument("words", nargs="*", help="read: the query; write: the entry's text; ingest: paths below the root; eval: a JSON-lines file of cases (qid, text, k, expected, unwanted)")
    p.add_argument("--root", default=".")
    p.add_argument("--table", required=True, help="chunks; entries for write, a JSON-lines log for metrics")
    p.add_argument("--queue", help="the queue's table; beside the chunks by default")
    p.add_argument("--branch", default="notes", help="write: where the entry goes")
    p.add_argument("--title", help="write: the entry's title")
    p.add_argument("--every", type=float, default=5.0, help="watch, daemon: seconds between polls")
    p.add_argument("--polls", type=int, help="daemon: how many polls, for ever by default")
    p.add_argument("--snapshot", help="eval: where to keep the metrics, to compare the next run with")
    p.add_argument("--top", type=int, default=Params().top_k)
    p.add_argument("--full", action="store_true")
    a = p.parse_args(argv)
    spark = session()
    keywords = _keywords(a)
    if a.command == "index":
        index_tree(spark, a.root, a.table, a.full, keywords=keywords).show(truncate=False)
        return 0
    at = a.queue or f"{a.table.rstrip('/')}-queue"
    if a.command == "write":
        row = spark.range(1).select(F.lit(a.branch).alias("branch"), F.current_timestamp().alias("ts"), F.lit(a.title).cast("string").alias("title"), F.lit("").alias("source_hint"), F.lit(" ".join(a.words)).alias("content"))
        sinks.append_entries(row, a.table)
        return 0
    if a.command == "ingest":
        _queued(spark, at, spark.createDataFrame([("ingest", w, 0) for w in a.words], "type string, path string, priority int"))
        return 0
    if a.command == "queue":
        queue.summary(sinks.read_table(spark, at)).show(truncate=False)
        return 0
    if a.command == "metrics":
        metrics.summary(files.read_metrics(spark, a.table)).show(truncate=False, vertical=True)
        return 0
    if a.command == "watch":
        changes.watch(spark, a.root, lambda tasks, n: _queued(spark, at, tasks), f"{at}-watch", f"{a.every} seconds").awaitTermination()
        return 0
    if a.command in ("sleep", "daemon"):
        print(daemon.run(spark, at, _handlers(spark, a), a.every, 1 if a.command == "sleep" else a.polls), "tasks handled")
        return 0
    chunks = spark.read.schema(CHUNKS).parquet(a.table)
    if a.command == "status":
        chunks.agg(F.count("*").alias("chunks"), F.countDistinct("source").alias("files"), F.max("indexed_at").alias("last_indexed")).show(truncate=False)
        return 0
    if a.command == "eval":
        return _evaluated(spark, chunks, a.words[0], a.snapshot)
    query = " ".join(a.words)
    vector = spark.range(1).select(embed_words(F.lit(query)).alias("v")).first()["v"]
    known = keywords if keyword_index.version(spark, keywords) else None
    hybrid.hybrid_search(chunks, vector, query, Params(top_k=a.top), keywords=known, tolerant=True).select("rank", "source", "score", preview(F.col("content")).alias("preview")).show(a.top, truncate=False)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
