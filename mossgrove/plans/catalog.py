"""Every operator as a query over the test tables, with the SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mossgrove.sources.spread import spread

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    def add(f):
        key = name or f.__name__
        QUERIES[key] = f
        if sql:
            ORACLE[key] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# What the tables stand for. These expressions are the same in both dialects.
PATH = "CASE doc_id % 3 WHEN 0 THEN concat(doc_id, '.md') WHEN 1 THEN concat(lang, '/', doc_id, '.md') ELSE concat(lang, '/', source, '/', doc_id, '.md') END"
MIXED = "CASE doc_id % 6 WHEN 0 THEN concat('journal/', doc_id, '.md') WHEN 1 THEN concat('./inbox/', doc_id, '.md') WHEN 2 THEN concat('concepts/', doc_id, '/MEMORY.md') WHEN 3 THEN concat('.//.notes/', doc_id, '.md') WHEN 4 THEN concat('mind/', lang, '/index.md') ELSE concat('concepts/', doc_id, '.md') END"


def half(x: str) -> str:
    return f"cast(floor({x} / 2) as bigint)"


def wiki_path(k: str) -> str:
    return f"CASE WHEN {k} % 17 = 3 THEN concat('d', {k} % 5, '/s', {k}, '/MEMORY.md') WHEN {k} % 2 = 0 THEN concat('d', {k} % 5, '/p', {k}, '.md') ELSE concat('p', {k}, '.md') END"


def wiki_key(k: str) -> str:
    return f"CASE WHEN {k} % 17 = 3 THEN concat('d', {k} % 5, '/s', {k}, '/MEMORY') WHEN {k} % 2 = 0 THEN concat('d', {k} % 5, '/p', {k}, '.md') ELSE concat('p', {k}) END"


WIKI = f"SELECT {wiki_path('doc_id')} AS path, concat('# Page ', doc_id, chr(10), 'see [[', {wiki_key(half('doc_id'))}, ']] and [[p', (doc_id * 3) % 200, ']] or [[nowhere', doc_id % 7, ']]') AS content FROM documents"
TASKS = "SELECT event_id AS pos, event_type AS type, concat('p', user_id % 50, '.md') AS path, CASE WHEN event_id % 3 = 0 THEN NULL ELSE concat('q', user_id % 3) END AS parent, cast(event_id % 5 as int) AS priority, concat('t', event_id) AS queued_at, CASE event_id % 5 WHEN 0 THEN 'pending' WHEN 1 THEN 'done' WHEN 2 THEN 'failed' WHEN 3 THEN 'processing' END AS status FROM events"
LOG = "SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'search_query' WHEN 1 THEN 'index_completed' WHEN 2 THEN 'write_entry' WHEN 3 THEN 'cascade_verdict' END AS event, CASE WHEN event_id % 2 = 0 THEN event_id % 90 END AS judge_tokens_in, event_id % 40 AS executor_tokens_in, cast(NULL as bigint) AS total_tokens_in, event_id % 30 AS judge_tokens_out, event_id % 20 AS executor_tokens_out, event_id % 10 AS total_tokens_out, (event_id % 7) * 0.01 AS cost, event_id % 1000 AS elapsed_ms, CASE event_id % 4 WHEN 0 THEN 'KEEP' WHEN 1 THEN 'REVISE' WHEN 2 THEN 'PROMOTE' END AS verdict FROM events"


def sql_table(spark: SparkSession, sf_dir: str, text: str, name: str) -> DataFrame:
    """One of the expressions above over its table."""
    src, _, of = text.removeprefix("SELECT ").rpartition(" FROM ")
    from mossgrove.plans.split import columns

    return table(spark, sf_dir, of).selectExpr(*columns(src))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks: id, source, heading, content."""
    return spread(table(spark, sf_dir, "documents")).selectExpr("doc_id AS id", f"{PATH} AS source", "'' AS heading", "text AS content")


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks with the vectors that have their ids."""
    e = table(spark, sf_dir, "embeddings").selectExpr("vec_id AS id", "embedding")
    return documents(spark, sf_dir).join(e, "id", "left")


def query_vector(spark: SparkSession, sf_dir: str) -> list[float]:
    """The vector with id 0, which stands for the query's."""
    rows = table(spark, sf_dir, "embeddings").where("vec_id = 0").select("embedding").take(1)
    return [float(x) for x in rows[0][0]] if rows else []


# the queries register themselves
from mossgrove.plans import queries_retrieval, queries_tree, queries_work  # noqa: E402, F401

__all__ = ["F", "ORACLE", "QUERIES"]
