"""The engine's larger operations, composed of operators: indexing, ingesting, routing, waking, sleeping."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mossgrove.functions import models
from mossgrove.functions.dates import parsed
from mossgrove.functions.paths import is_protected, stem
from mossgrove.functions.text import slug, title_of
from mossgrove.model import CHUNKS, TASKS, Params
from mossgrove.operators import cluster, graph, hybrid, many, queue, rollup, routing
from mossgrove.sources import chunking, files, keyword_index, sinks
from mossgrove.sources.scratch import delete, store


def exists(spark: SparkSession, path: str) -> bool:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)


def index_tree(spark: SparkSession, root: str, table: str, full: bool = False, embed: Callable[[Column], Column] = models.embed_words, model: str = "words", prune: bool = True, keywords: str | None = None) -> DataFrame:
    """Brings the chunk table up to date with the files below ``root``; one row: scanned, skipped, indexed, removed, chunks, errors.

    Only new and changed files are chunked and embedded; a file's chunks replace its old ones also if it has none
    now; files that are gone leave the table. ``full`` starts anew. The keyword index at ``keywords`` follows by source; it
    goes first, so that a run that stops in between is done again.
    """
    scanned = store(files.scan_tree(spark, root), "scan")
    old = spark.read.schema(CHUNKS).parquet(table) if exists(spark, table) and not full else spark.createDataFrame([], CHUNKS)
    plan = store(chunking.incremental(scanned.where("content IS NOT NULL").select("source", "mtime"), old.select("source", "indexed_at")), "plan")
    todo = scanned.join(plan.where("decision = 'index'").select("source"), "source", "left_semi")
    made = chunking.embedded(chunking.chunk_within(todo, model=model), embed).withColumn("indexed_at", F.current_timestamp())
    new = store(made.select(*old.columns), "chunks")
    gone = plan.where(F.col("decision").isin(["index", "remove"] if prune else ["index"])).select("source")
    if keywords is not None:
        if full:
            delete(spark, keywords)
        keyword_index.update(spark, keywords, new, gone)
    sinks.replace_table(old.join(gone, "source", "left_anti").select(*old.columns).unionByName(new), table)
    count = lambda d: F.count_if(F.col("decision") == d).alias({"index": "indexed", "skip": "skipped", "remove": "removed"}[d])
    return plan.agg(*(count(d) for d in ("index", "skip", "remove"))).select("*", new.agg(F.count("*")).scalar().alias("chunks"), files.unreadable(scanned).select("scanned").scalar().alias("scanned"), files.unreadable(scanned).select("errors").scalar().alias("errors"))


def route(spark: SparkSession, text: str, source: str, chunks: DataFrame, pages: DataFrame, embed=models.embed_words, router=models.router_skip, executor=models.executor_echo, params: Params = Params(), dry_run: bool = False) -> tuple[DataFrame, DataFrame]:
    """Decided actions for a text at ``source``, and the pages (path, content) that they change; none of these in a dry run."""
    vector = spark.range(1).select(embed(F.left(F.lit(text), F.lit(1000))).alias("v")).first()["v"]
    found = hybrid.route_candidates(chunks, vector, text[:1000], pages.select(F.col("path").alias("source"), "content"), params)
    listed = found.agg(F.sort_array(F.collect_list(F.struct("rank", "source", "content"))).alias("candidates"))
    actions = listed.select(F.explode(router(F.lit(text[:4000]), F.col("candidates"))).alias("a")).select("a.*", F.lit(source).alias("source"))
    decided = store(routing.decide(actions, pages, params, dry_run), "actions")
    return decided, routing.apply(decided, pages, executor)


def route_file(spark: SparkSession, root: str, path: str, chunks: DataFrame, pages: DataFrame, **plugs) -> tuple[DataFrame, DataFrame]:
    """route() for a file that the tree already has, at ``path`` below ``root``; the file is no candidate for itself."""
    text = files.read_source(spark, f"{root.rstrip('/')}/{path}").first()["content"]
    return route(spark, text, path, chunks.where(F.col("source") != path), pages, **plugs)


def ingest(spark: SparkSession, path: str, chunks: DataFrame, pages: DataFrame, summarise: Callable[[Column], Column] | None = None, branch: str = "sources", dry_run: bool = False, no_route: bool = False, **plugs) -> dict[str, DataFrame | None]:
    """Reads a source, writes its summary as an entry and routes it: entry, actions, changed (pages)."""
    got = files.read_source(spark, path).withColumn("content", summarise(F.col("content")) if summarise else F.col("content"))
    got = store(got, "source")
    title = title_of(stem(F.lit(path)))
    row = got.select(F.lit(branch).alias("branch"), F.current_timestamp().alias("ts"), title.alias("title"), F.lit(path).alias("source_hint"), "content")
    entry = store(sinks.day_files(sinks.entries(row)), "entry")
    if no_route:
        return {"entry": entry, "actions": None, "changed": None}
    at, text = entry.first()["path"], got.first()["content"]
    actions, changed = route(spark, text, at, chunks, pages.unionByName(entry.select("path", "content")), dry_run=dry_run, **plugs)
    return {"entry": None if dry_run else entry, "actions": actions, "changed": None if dry_run else changed}


def consolidate(spark: SparkSession, pages: DataFrame, chunks: DataFrame, embed=models.embed_words, executor=models.executor_echo, params: Params = Params()) -> DataFrame:
    """leader, n_files, page, action, content and error of the concept pages made from clusters of pages (id, path, content).

    A cluster's concept is the best hit of a hybrid search for its first 500 characters that scores the floor or more, is
    no capture and is still there; it is revised, unless it is protected. All clusters are searched for in one pass. What
    a guarded executor fails on is skipped with its error; other clusters go on.
    """
    rows = pages.select("id", embed(F.left("content", F.lit(2000))).alias("embedding"))
    member = cluster.greedy_clusters(rows, cluster.similar_pairs(rows, params.cluster_threshold))
    named = member.join(pages, "id").select("leader", F.col("id").alias("pos"), F.element_at(F.split("path", "/"), -1).alias("name"), "content")
    texts = store(cluster.cluster_content(named, params.cluster_chars), "clusters")
    head = F.left("content", F.lit(500))
    # the first hit that may be one decides, then whether it is protected
    asked = store(texts.where(F.trim("content") != "").select(F.col("leader").alias("qid"), head.alias("text"), embed(head).alias("vector")), "asked")
    there = pages.select(F.col("path").alias("source")).distinct()
    matches = many.existing_concepts(chunks.join(there, "source", "left_semi"), asked, replace(params, protected=()))
    first = texts.join(pages.select(F.col("id").alias("leader"), "path", F.col("content").alias("lead")), "leader")
    first = first.join(matches.select(F.col("qid").alias("leader"), F.col("source").alias("match")), "leader", "left")
    found = cluster.concept_actions(first.withColumn("protected", F.coalesce(is_protected(F.col("match"), params.protected), F.lit(False))))
    old = pages.groupBy(F.col("path").alias("match")).agg(F.min("content").alias("old"))
    found = found.join(old, "match", "left")
    revise = F.col("action") == "revised"
    n = F.col("n_files").cast("string")
    ask = F.when(revise, F.concat(F.lit("Bring this page up to date with "), n, F.lit(" related files; keep what it says, add what is new, link related pages."))).otherwise(F.concat(F.lit("Write one page from "), n, F.lit(" related files: a heading that names the topic, details and conclusions, links to related pages.")))
    made = F.when(F.col("action") != "skipped", executor(F.when(revise, F.col("old")).otherwise(F.col("content")), ask, F.col("content")))
    done = models.outcome(found.withColumn("made", made), "made")
    error = F.when(F.col("action") == "skipped", F.lit("empty cluster content")).otherwise(F.col("error"))
    page = F.when(revise, F.col("match")).otherwise(F.concat(F.lit("concepts/"), slug(F.col("path"), F.coalesce("made", "lead")), F.lit(".md")))
    text = F.when(revise, F.col("made")).otherwise(F.concat(F.lit("---\ncreated_by: consolidate\nsources: "), n, F.lit("\n---\n\n"), "made", F.lit("\n")))
    ok = error.isNull()
    return done.select("leader", "n_files", F.when(ok, page).alias("page"), F.when(ok, F.col("action")).otherwise(F.lit("skipped")).alias("action"), F.when(ok, text).alias("content"), error.alias("error"))


def consolidate_run(spark: SparkSession, pages: DataFrame, chunks: DataFrame, **plugs) -> dict[str, DataFrame]:
    """A whole run of consolidate(): results, pages after it, tasks (cascades of what changed) and a row for the log.

    Clusters that would write the same page write it once: the cluster with the least leader does.
    """
    results = store(consolidate(spark, pages, chunks, **plugs), "consolidated")
    written = results.where("page IS NOT NULL").groupBy(F.col("page").alias("path")).agg(F.min_by("content", "leader").alias("content"))
    after = pages.select("path", "content").join(written, "path", "left_anti").unionByName(written)
    count = lambda a: F.count_if(F.col("action") == a)
    log = results.agg(F.lit("batch_consolidate").alias("event"), F.coalesce(F.sum("n_files"), F.lit(0)).alias("files_total"), F.count("*").alias("clusters"), count("created").alias("created"), count("revised").alias("revised"), count("skipped").alias("skipped"), F.count_if(F.col("error").isNotNull()).alias("errors"))
    tasks = written.select(F.lit("cognitive_cascade").alias("type"), "path", F.lit(5).alias("priority"))
    return {"results": results, "pages": after, "tasks": tasks, "log": log}


def wake(files_: DataFrame, executor: Callable[[Column], Column] | None = None, params: Params = Params()) -> DataFrame:
    """The briefing's page from the identity files (path, content), cut to its length at a line's end."""
    from mossgrove.functions.text import cut_at_line

    made = rollup.briefing(files_, params)
    return made if executor is None else made.select("source_files", cut_at_line(executor(F.col("content")), params.briefing_chars).alias("content"))


def after_write(spark: SparkSession, pages: DataFrame, written: DataFrame, tasks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Index pages to rewrite, and the queue with what a write to ``written`` (path) asks for.

    Missing summaries above journal pages are queued; a cascade is queued for written pages that others refer to, if an
    index changed.
    """
    indexes = store(graph.structural_cascade(pages, written), "indexes")
    missing = rollup.missing_summaries(written.where("path LIKE 'journal/%' AND size(split(path, '/')) >= 5"), pages)
    want = missing.select(F.lit("journal_rollup").alias("type"), "path", "priority")
    if indexes.take(1):
        worth = graph.with_references(written, graph.references(pages))
        want = want.unionByName(worth.select(F.lit("cognitive_cascade").alias("type"), "path", F.lit(5).alias("priority")))
    new = want.select("*", F.lit(None).cast("string").alias("parent"), F.lit("pending").alias("status"), F.lit(None).cast("string").alias("error"), F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss").alias("queued_at"), F.hash("path").cast("bigint").alias("pos"))
    return indexes, queue.enqueue(tasks, queue.with_ids(new))


def sleep(tasks: DataFrame, n: int, handlers: dict[str, Callable[[DataFrame], DataFrame]], dry_run: bool = False) -> DataFrame:
    """One sleep cycle over the first n pending tasks: the queue after it.

    ``handlers``, by type, turn tasks into results (id, error); they run in the order of queue.sleep_plan(). A dry run
    calls none of them and changes nothing; a type without a handler fails its tasks.
    """
    if dry_run:
        return tasks
    taken = store(queue.dequeue(tasks, n), "taken")
    done = None
    for kind in sorted({r[0] for r in taken.select("type").distinct().collect()}, key=lambda k: ({"ingest": 1, "route": 1, "journal_rollup": 2, "wake_summary": 3}.get(k, 4), k)):
        own = taken.where(F.col("type") == kind).orderBy(F.desc("priority"), "pos")
        result = handlers[kind](own).select("id", "error") if kind in handlers else own.select("id", F.lit(f"no handler for {kind}").alias("error"))
        done = result if done is None else done.unionByName(result)
    return tasks if done is None else queue.complete(tasks, done)


__all__ = ["TASKS", "parsed"]
