"""Queries of the tree: paths, chunks, indexes, links, cascades, the journal."""

from __future__ import annotations

from pyspark.sql import functions as F

from mossgrove.functions import dates, models, paths, text
from mossgrove.functions.hashing import content_hash
from mossgrove.model import Params
from mossgrove.operators import evaluate, graph, rollup
from mossgrove.plans.catalog import MIXED, PATH, WIKI, documents, query, sql_table, table
from mossgrove.plans.split import columns
from mossgrove.sources import chunking, files, sinks

_NL = "chr(10)"
_MARKDOWN = f"concat('intro ', doc_id, {_NL}, '# Doc ', doc_id, {_NL}, text, {_NL}, '## Notes  ', {_NL}, left(text, 100), {_NL}, '#not a heading', {_NL}, '### ', lang)"
_LEAF = "('sources/', 'heartbeat/artifacts/', 'events/', 'journal/', 'days/', 'episodes/', 'notes/', 'mirrors/', 'inbox/')"
_PROTECTED = "('MEMORY.md', 'identity.md', 'manifest.md', 'mind.md')"


def mixed(spark, d):
    return table(spark, d, "documents").selectExpr("doc_id AS id", f"{MIXED} AS path", "lang", "source", "text")


def wiki(spark, d):
    return sql_table(spark, d, WIKI, "documents")


@query(f"SELECT doc_id AS id, {MIXED} AS path, regexp_matches(regexp_replace({MIXED}, '^[./]+', ''), '^(sources/|heartbeat/artifacts/|events/|journal/|days/|episodes/|notes/|mirrors/|inbox/)') AS leaf FROM documents")
def leaf_filter(spark, d):
    return mixed(spark, d).select("id", "path", paths.is_leaf(F.col("path")).alias("leaf"))


@query(f"SELECT doc_id AS id, {MIXED} AS path FROM documents WHERE string_split({MIXED}, '/')[-1] IN {_PROTECTED}")
def protected_filter(spark, d):
    return mixed(spark, d).where(paths.is_protected(F.col("path"))).select("id", "path")


@query(f"SELECT doc_id AS id, {MIXED} AS path FROM documents WHERE {MIXED} LIKE '%.md' AND {MIXED} NOT LIKE '%/index.md' AND doc_id % 4 <> 1")
def watch_filter(spark, d):
    rows = mixed(spark, d).withColumn("seen", F.when(F.col("id") % 4 == 1, F.concat(F.lit(".system/"), "path")).otherwise(F.col("path")))
    return rows.where(paths.is_watched(F.col("seen"), ".system")).select("id", "path")


@query(f"SELECT doc_id AS id, regexp_extract({MIXED}, '([^/]*)[.]md$', 1) AS stem, '.md' AS suffix, regexp_replace({MIXED}, '/[^/]*$', '') AS parent, regexp_replace({MIXED}, '[.]md$', '') AS bare FROM documents")
def path_parts(spark, d):
    p = F.col("path")
    return mixed(spark, d).select("id", paths.stem(p).alias("stem"), paths.suffix(p).alias("suffix"), paths.parent(p).alias("parent"), paths.without_suffix(p).alias("bare"))


@query(f"""SELECT doc_id AS id, left(regexp_replace(trim(lower(regexp_replace(t, '[^\\p{{L}}\\p{{M}}\\p{{N}}_\\s-]', '', 'g'))), '[\\s_-]+', '-', 'g'), 60) AS slug
FROM (SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN trim(left(string_split(text, {_NL})[1], 90)) ELSE concat(lang, '_note-', doc_id) END AS t FROM documents WHERE length(trim(left(string_split(text, {_NL})[1], 90))) > 0)""")
def slugify(spark, d):
    first = F.trim(F.left(F.get(F.split("text", "\n"), F.lit(0)), F.lit(90)))
    rows = table(spark, d, "documents").where(F.length(first) > 0)
    content = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("x\n# "), first, F.lit("\nrest"))).otherwise(F.lit("no heading"))
    return rows.select(F.col("doc_id").alias("id"), text.slug(F.concat(F.lit("a/"), "lang", F.lit("_note-"), "doc_id", F.lit(".md")), content).alias("slug"))


@query(f"SELECT doc_id AS id, concat(replace(left(text, 200), {_NL}, ' '), CASE WHEN length(text) > 200 THEN '...' ELSE '' END) AS preview FROM documents")
def preview(spark, d):
    return table(spark, d, "documents").select(F.col("doc_id").alias("id"), text.preview(F.col("text")).alias("preview"))


@query(f"SELECT doc_id AS id, CASE WHEN length(text) <= 900 THEN text WHEN contains(left(text, 900), {_NL}) THEN regexp_extract(left(text, 900), '(?s)^(.*\\n)', 1) ELSE left(text, 900) END AS cut FROM documents")
def cut_at_line(spark, d):
    return table(spark, d, "documents").select(F.col("doc_id").alias("id"), text.cut_at_line(F.col("text"), 900).alias("cut"))


@query("SELECT c_custkey AS id, concat('C--Work-', replace(c_name, '#', ':')) AS x FROM customer".replace("replace(c_name, '#', ':')", "c_name"), name="project_hash")
def project_hash(spark, d):
    return table(spark, d, "customer").select(F.col("c_custkey").alias("id"), text.project_hash(F.concat(F.lit("C:\\Work/"), "c_name")).alias("x"))


@query("SELECT c_custkey AS id, concat(lower(regexp_replace(c_name, '[^a-zA-Z0-9._-]', '-', 'g')), '-agent') AS entity FROM customer")
def entity_name(spark, d):
    return table(spark, d, "customer").select(F.col("c_custkey").alias("id"), text.entity(F.concat(F.lit("/home/u/"), "c_name"), "-agent").alias("entity"))


@query(f"SELECT doc_id AS id, n::INT AS n, line FROM (SELECT doc_id, unnest(string_split(text, {_NL})) AS line, generate_subscripts(string_split(text, {_NL}), 1) AS n FROM documents)")
def chunk_lines(spark, d):
    return chunking.lines(documents(spark, d).selectExpr("cast(id as string) AS source", "content")).select(F.col("source").cast("bigint").alias("id"), "n", "line")


@query(
    f"""WITH l AS (SELECT doc_id, unnest(string_split(x, {_NL})) AS line, generate_subscripts(string_split(x, {_NL}), 1) AS n FROM (SELECT doc_id, {_MARKDOWN} AS x FROM documents)),
s AS (SELECT *, sum(CASE WHEN regexp_matches(line, '^#{{1,6}}\\s') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY n) AS section FROM l),
b AS (SELECT *, floor(coalesce(sum(length(line) + 1) OVER (PARTITION BY doc_id, section ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) / 2000) AS piece,
  max(CASE WHEN regexp_matches(line, '^#{{1,6}}\\s') THEN line END) OVER (PARTITION BY doc_id, section) AS head FROM s),
g AS (SELECT doc_id, section, piece, head, min(n)::INT AS start_line, max(n)::INT AS end_line, string_agg(line, {_NL} ORDER BY n) AS content FROM b GROUP BY ALL)
SELECT concat(doc_id, '.md') AS source, coalesce(trim(regexp_replace(head, '^#{{1,6}}\\s+', '')), '') AS heading, coalesce(length(regexp_extract(head, '^(#{{1,6}})', 1)), 0)::INT AS heading_level,
  start_line, end_line, sha256(content) AS content_hash, left(sha256(concat_ws(':', concat(doc_id, '.md'), start_line, end_line, sha256(content), 'words')), 16) AS id
FROM g WHERE regexp_matches(content, '\\S')"""
)
def chunk_sections(spark, d):
    rows = table(spark, d, "documents").selectExpr("concat(doc_id, '.md') AS source", f"{_MARKDOWN} AS content")
    return chunking.chunk(rows).select("source", "heading", "heading_level", "start_line", "end_line", "content_hash", "id")


_SENTENCE = chunking.SENTENCE


@query(
    f"""WITH l AS (SELECT doc_id, unnest(string_split(x, {_NL})) AS line, generate_subscripts(string_split(x, {_NL}), 1) AS n FROM (SELECT doc_id, {_MARKDOWN} AS x FROM documents)),
s AS (SELECT *, length(line) + 1 AS size, trim(line) = '' AS blank, sum(CASE WHEN regexp_matches(line, '^#{{1,6}}\\s') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY n) AS section FROM l),
b AS (SELECT *, max(CASE WHEN regexp_matches(line, '^#{{1,6}}\\s') THEN line END) OVER (PARTITION BY doc_id, section) AS head, sum(size) OVER (PARTITION BY doc_id, section ORDER BY n) - size AS before,
  NOT blank AND lag(blank, 1, true) OVER (PARTITION BY doc_id, section ORDER BY n) AS begins FROM s),
p AS (SELECT *, sum(begins::INT) OVER (PARTITION BY doc_id, section ORDER BY n) AS par FROM b),
w AS (SELECT *, min(before) OVER (PARTITION BY doc_id, section, par) AS start, sum(size) OVER (PARTITION BY doc_id, section, par) <= 300 AS whole FROM p),
q AS (SELECT *, CASE WHEN whole OR size <= 300 THEN [line] ELSE flatten(list_transform(regexp_extract_all(line, '{_SENTENCE}'), lambda t: list_transform(range(0, length(t), 300), lambda i: substr(t, i + 1, 300)))) END AS parts FROM w),
e AS (SELECT doc_id, section, head, n, whole, before, start, len(parts) AS total, unnest(parts) AS part, unnest(range(len(parts))) AS k FROM q),
f AS (SELECT *, floor(CASE WHEN whole THEN start ELSE before + coalesce(sum(length(part)) OVER (PARTITION BY doc_id, section, n ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) END / 300) AS piece FROM e),
g AS (SELECT doc_id, section, piece, head, min(n)::INT AS start_line, max(n)::INT AS end_line, regexp_replace(string_agg(concat(part, CASE WHEN k = total - 1 THEN {_NL} ELSE '' END), '' ORDER BY n, k), '\\n$', '') AS content FROM f GROUP BY ALL)
SELECT concat(doc_id, '.md') AS source, coalesce(trim(regexp_replace(head, '^#{{1,6}}\\s+', '')), '') AS heading, start_line, end_line, length(content)::INT AS chars, sha256(content) AS content_hash FROM g WHERE regexp_matches(content, '\\S')"""
)
def chunk_within_limit(spark, d):
    """Chunks of 600 characters at most: by paragraphs, lines, sentences and cuts."""
    rows = table(spark, d, "documents").selectExpr("concat(doc_id, '.md') AS source", f"{_MARKDOWN} AS content")
    return chunking.chunk_within(rows, 600).select("source", "heading", "start_line", "end_line", F.length("content").alias("chars"), "content_hash")


@query(
    """WITH s AS (SELECT doc_id, n_chars AS mtime FROM documents WHERE doc_id % 10 <> 0), i AS (SELECT doc_id, max(n_chars + doc_id % 3 - 1) AS at FROM documents WHERE doc_id % 4 <> 0 GROUP BY doc_id)
SELECT concat(coalesce(s.doc_id, i.doc_id), '.md') AS source, CASE WHEN s.doc_id IS NULL THEN 'remove' WHEN i.doc_id IS NULL OR s.mtime > i.at THEN 'index' ELSE 'skip' END AS decision FROM s FULL JOIN i ON s.doc_id = i.doc_id"""
)
def incremental_plan(spark, d):
    rows = table(spark, d, "documents").withColumn("source", F.concat("doc_id", F.lit(".md")))
    scanned = rows.where("doc_id % 10 <> 0").select("source", F.col("n_chars").alias("mtime"))
    return chunking.incremental(scanned, rows.where("doc_id % 4 <> 0").select("source", (F.col("n_chars") + F.col("doc_id") % 3 - 1).alias("indexed_at")))


@query("SELECT concat(doc_id, '.md') AS source, CASE WHEN doc_id % 3 = 0 THEN sha256(concat(text, '!')) ELSE sha256(text) END AS content_hash FROM documents WHERE doc_id % 2 = 0 OR doc_id % 3 = 0")
def upsert_chunks(spark, d):
    rows = table(spark, d, "documents").withColumn("source", F.concat("doc_id", F.lit(".md")))
    old = rows.where("doc_id % 2 = 0").select("source", content_hash(F.col("text")).alias("content_hash"))
    return chunking.upsert(old, rows.where("doc_id % 3 = 0").select("source", content_hash(F.concat("text", F.lit("!"))).alias("content_hash")))


@query("SELECT count(*) AS chunks, count(DISTINCT source) AS files, 64 AS dimension, 'words' AS model, NULL::VARCHAR AS last_indexed FROM documents")
def index_status(spark, d):
    meta = spark.createDataFrame([("dimension", "64"), ("model", "words")], "key string, value string")
    return chunking.status(table(spark, d, "documents"), meta)


@query("""SELECT concat('k', doc_id) AS key, CASE WHEN doc_id % 3 = 0 AND doc_id % 2 = 0 THEN source WHEN doc_id % 2 = 0 THEN lang WHEN doc_id % 3 = 0 THEN source ELSE 'first' END AS value FROM documents""")
def meta_upsert(spark, d):
    """Values that replace others, then values that are put only where there is none."""
    rows = table(spark, d, "documents")
    key = F.concat(F.lit("k"), "doc_id").alias("key")
    put = chunking.put_meta(rows.where("doc_id % 2 = 0").select(key, F.col("lang").alias("value")), rows.where("doc_id % 3 = 0").select(key, F.col("source").alias("value")))
    return chunking.put_meta(put, rows.select(key, F.lit("first").alias("value")), replace=False).select("key", "value")


@query("SELECT lang AS path, arg_max(text, doc_id) AS content, max(doc_id) AS ver FROM documents GROUP BY lang")
def page_versions(spark, d):
    return chunking.latest(table(spark, d, "documents").selectExpr("lang AS path", "text AS content", "doc_id AS ver"), "path", "ver")


@query(
    f"""WITH f AS (SELECT concat(CASE WHEN doc_id % 9 = 0 THEN '.git/' ELSE '' END, doc_id, CASE doc_id % 4 WHEN 0 THEN '.md' WHEN 1 THEN '.py' WHEN 2 THEN '.bin' ELSE '.toml' END) AS source, text FROM documents),
p AS (SELECT source, concat('## ', source, {_NL}, {_NL}, text) AS part FROM f WHERE NOT regexp_matches(source, '(^|/)[.]') AND source NOT LIKE '%.bin'),
b AS (SELECT *, coalesce(sum(length(part)) OVER (ORDER BY source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM p)
SELECT count(*)::INT AS files, string_agg(part, concat({_NL}, {_NL}, '---', {_NL}, {_NL}) ORDER BY source) AS content FROM b WHERE before <= 50000"""
)
def source_bundle(spark, d):
    rows = table(spark, d, "documents").selectExpr("concat(CASE WHEN doc_id % 9 = 0 THEN '.git/' ELSE '' END, doc_id, CASE doc_id % 4 WHEN 0 THEN '.md' WHEN 1 THEN '.py' WHEN 2 THEN '.bin' ELSE '.toml' END) AS source", "text AS content")
    return files.source_bundle(rows)


_W = f"w AS MATERIALIZED ({WIKI}), e AS MATERIALIZED (SELECT DISTINCT path AS src, unnest(regexp_extract_all(content, '\\[\\[([^\\[\\]]+)\\]\\]', 1)) AS key FROM w), k AS MATERIALIZED (SELECT path, unnest(list_distinct([regexp_replace(path, '[.]md$', ''), path, regexp_extract(path, '([^/]*)[.]md$', 1)])) AS key FROM w), r AS MATERIALIZED (SELECT DISTINCT k.path AS child, e.src AS parent FROM e JOIN k USING (key) WHERE e.src <> k.path)"


@query(f"WITH {_W} SELECT DISTINCT src, key FROM e")
def link_edges(spark, d):
    return graph.link_edges(wiki(spark, d))


@query(f"WITH {_W} SELECT child, parent FROM r")
def upstream_refs(spark, d):
    return graph.references(wiki(spark, d))


@query(f"WITH {_W} SELECT src, key FROM e WHERE key NOT IN (SELECT key FROM k)")
def broken_links(spark, d):
    return graph.broken_links(wiki(spark, d))


@query(f"WITH {_W} SELECT path FROM w WHERE path NOT IN (SELECT child FROM r)")
def orphans(spark, d):
    return graph.orphans(wiki(spark, d))


@query(f"WITH {_W} SELECT path FROM w WHERE path IN (SELECT child FROM r) AND path LIKE 'd1/%'")
def cascade_worthy(spark, d):
    w = wiki(spark, d)
    return graph.with_references(w.where("path LIKE 'd1/%'").select("path"), graph.references(w))


_REACH = f"""WITH RECURSIVE {_W},
x(path, depth, go) AS (SELECT 'p1.md', 0, true UNION SELECT r.parent, x.depth + 1, r.parent <> 'p1.md' AND string_split(r.parent, '/')[-1] <> 'MEMORY.md' FROM x JOIN r ON r.child = x.path WHERE x.go AND x.depth < 5),
y AS (SELECT path, min(depth)::INT AS depth FROM x WHERE depth > 0 GROUP BY path)"""


@query(f"{_REACH} SELECT path, depth, CASE WHEN path LIKE '%/MEMORY.md' THEN 'PROMOTE' ELSE 'REVISE' END AS verdict FROM y")
def cascade_reach(spark, d):
    return graph.cascade(wiki(spark, d), spark.createDataFrame([("p1.md",)], "path string")).select("path", "depth", "verdict")


@query(f"{_REACH} SELECT count(*) FILTER (path NOT LIKE '%/MEMORY.md')::INT AS changed, count(*) FILTER (path LIKE '%/MEMORY.md')::INT AS promoted, max(depth) AS max_depth FROM y")
def cascade_stats(spark, d):
    rows = graph.cascade(wiki(spark, d), spark.createDataFrame([("p1.md",)], "path string"))
    return graph.cascade_stats(rows).select(F.size("files_changed").alias("changed"), F.size("promoted").alias("promoted"), "max_depth")


_CASES = "SELECT doc_id AS k, path, path LIKE 'p%' AS expected FROM (SELECT doc_id, " + WIKI.removeprefix("SELECT ").partition(" AS path")[0] + " AS path FROM documents) WHERE doc_id % 50 = 1"


@query(f"""WITH RECURSIVE {_W}, cs AS ({_CASES}),
x(k, home, path, depth, go) AS (SELECT k, path, path, 0, true FROM cs UNION SELECT x.k, x.home, r.parent, x.depth + 1, r.parent <> x.home AND string_split(r.parent, '/')[-1] <> 'MEMORY.md' FROM x JOIN r ON r.child = x.path WHERE x.go AND x.depth < 5),
y AS (SELECT k, max(m)::INT AS depth, bool_or(path LIKE '%/MEMORY.md') AS flag FROM (SELECT k, path, min(depth) AS m FROM x WHERE depth > 0 GROUP BY k, path) GROUP BY k)
SELECT k AS "case", coalesce(depth, 0) AS actual_depth, coalesce(flag, false) AS actual_flag, coalesce(flag, false) OR NOT expected AS passed FROM cs LEFT JOIN y USING (k)""")
def eval_cascade_run(spark, d):
    """A cascade from each page of a set of cases, all together, level by level."""
    w = wiki(spark, d)
    ids = table(spark, d, "documents").selectExpr("doc_id", *columns(WIKI.removeprefix("SELECT ").rpartition(" FROM ")[0]))
    cases = ids.where("doc_id % 50 = 1").select(F.col("doc_id").alias("case"), "path", "content", F.col("path").startswith("p").alias("expected_flag"))
    return evaluate.run_cascades(w, cases, models.judge_revise).select("case", "actual_depth", "actual_flag", "passed")


_INDEX = f"""w AS ({WIKI}),
ds AS (SELECT DISTINCT array_to_string(string_split(path, '/')[1:i], '/') AS dir FROM (SELECT path, unnest(range(1, len(string_split(path, '/')))) AS i FROM w)),
ls AS (SELECT regexp_replace(regexp_replace(dir, '[^/]*$', ''), '/$', '') AS dir, string_split(dir, '/')[-1] AS name, concat('- [[', dir, '/]] — ', string_split(dir, '/')[-1]) AS line FROM ds
  UNION ALL SELECT regexp_replace(regexp_replace(path, '[^/]*$', ''), '/$', ''), string_split(path, '/')[-1], concat('- [[', regexp_replace(path, '[.]md$', ''), ']] — ', regexp_extract(content, '^# (.+)', 1)) FROM w)
"""


@query(f"WITH {_INDEX} SELECT concat(dir, '/index.md') AS path, concat('# ', upper(left(string_split(dir, '/')[-1], 1)), substr(string_split(dir, '/')[-1], 2), {_NL}, {_NL}, string_agg(line, {_NL} ORDER BY name, line), {_NL}) AS content FROM ls WHERE dir <> '' GROUP BY dir")
def ancestor_index(spark, d):
    return graph.directory_indexes(wiki(spark, d))


@query(f"WITH {_INDEX} SELECT concat(dir, '/index.md') AS path FROM ls WHERE dir IN ('d1', 'd2') GROUP BY dir")
def structural_cascade(spark, d):
    w = wiki(spark, d)
    stale = spark.createDataFrame([(f"d{k}/index.md", "old") for k in (1, 2, 3)], "path string, content string")
    changed = w.where("path RLIKE '^d[12]/'").select("path")
    return graph.structural_cascade(w.unionByName(stale), changed).select("path")


_DAY = "strftime(ts, '%Y-%m-%d')"
_WEEK = "concat('journal/', strftime(ts, '%Y/%m'), '/week', (day(ts) - 1) // 7 + 1)"
_DAYS = f"dd AS (SELECT concat({_WEEK}, '/', strftime(ts, '%m-%d'), '.md') AS path, {_WEEK} AS week, strftime(ts, '%m-%d.md') AS key, concat('events: ', count(*)) AS content FROM events GROUP BY ALL)"
_WEEKS = f"{_DAYS}, ww AS (SELECT concat(week, '/', string_split(week, '/')[-1], '.md') AS path, string_split(week, '/')[-1] AS key, regexp_replace(week, '/[^/]*$', '') AS month, count(*) AS children, string_agg(concat('--- ', key, ' ---', chr(10), content), concat(chr(10), chr(10)) ORDER BY key) AS entries FROM dd GROUP BY week)"
_MONTHS = f"{_WEEKS}, mm AS (SELECT concat(month, '/', string_split(month, '/')[-1], '.md') AS path, string_split(month, '/')[-1] AS key, regexp_replace(month, '/[^/]*$', '') AS year, count(*) AS children, string_agg(concat('--- ', key, ' ---', chr(10), 'days: ', children), concat(chr(10), chr(10)) ORDER BY key) AS entries FROM ww GROUP BY month)"


def day_files(spark, d):
    path = dates.journal_path(F.lit("journal"), F.col("ts"))
    return table(spark, d, "events").groupBy(path.alias("path")).agg(F.concat(F.lit("events: "), F.count("*").cast("string")).alias("content"))


def week_files(spark, d):
    return rollup.rollup(day_files(spark, d), "week").select("path", F.concat(F.lit("days: "), "children").alias("content"))


def month_files(spark, d):
    return rollup.rollup(week_files(spark, d), "month").select("path", F.concat(F.lit("weeks: "), "children").alias("content"))


@query(f"SELECT event_id AS id, concat({_WEEK}, '/', strftime(ts, '%m-%d'), '.md') AS journal, concat('notes/', strftime(ts, '%Y/%m-%d'), '.md') AS flat FROM events")
def journal_paths(spark, d):
    day = F.col("ts")
    return table(spark, d, "events").select(F.col("event_id").alias("id"), dates.entry_path(F.lit("journal"), day).alias("journal"), dates.entry_path(F.lit("notes"), day).alias("flat"))


@query(f"WITH {_WEEKS} SELECT path, 'week' AS level, children, entries FROM ww")
def week_rollup(spark, d):
    return rollup.rollup(day_files(spark, d), "week")


@query(f"WITH {_MONTHS} SELECT path, 'month' AS level, children, entries FROM mm")
def month_rollup(spark, d):
    return rollup.rollup(week_files(spark, d), "month")


@query(f"WITH {_MONTHS} SELECT concat(year, '/', string_split(year, '/')[-1], '.md') AS path, 'year' AS level, count(*) AS children, string_agg(concat('--- ', key, ' ---', chr(10), 'weeks: ', children), concat(chr(10), chr(10)) ORDER BY key) AS entries FROM mm GROUP BY year")
def year_rollup(spark, d):
    return rollup.rollup(month_files(spark, d), "year")


@query(f"WITH {_WEEKS} SELECT path, concat('---', {_NL}, 'type: journal-week-summary', {_NL}, 'created: 2024-01-02', {_NL}, 'children: ', children, {_NL}, '---', {_NL}, {_NL}, '# Week Summary', {_NL}, {_NL}, trim(entries), {_NL}) AS content FROM ww")
def summary_pages(spark, d):
    return rollup.summary_page(rollup.rollup(day_files(spark, d), "week"), F.lit("2024-01-02").cast("date"))


@query(f"""WITH {_MONTHS}, x AS (SELECT concat(week, '/', string_split(week, '/')[-1], '.md') AS path, 'week' AS level, 3 AS priority FROM dd
  UNION SELECT concat(month, '/', string_split(month, '/')[-1], '.md'), 'month', 2 FROM ww UNION SELECT concat(year, '/', string_split(year, '/')[-1], '.md'), 'year', 1 FROM mm)
SELECT path, level, priority FROM x WHERE path NOT LIKE '%week1.md'""")
def missing_rollups(spark, d):
    there = week_files(spark, d).where("path LIKE '%week1.md'")
    return rollup.missing_summaries(day_files(spark, d), there)


@query(f"SELECT path, CASE WHEN regexp_matches(path, '^[^/]+/[^/]+/[^/]+/week[^/]*/week[^/]*$') THEN 'week' WHEN regexp_matches(path, '^[^/]+/[^/]+/[^/]+/[0-9]{{2}}[.]md$') THEN 'month' WHEN regexp_matches(path, '^[^/]+/[^/]+/[0-9]{{4}}[.]md$') THEN 'year' END AS level FROM (WITH {_MONTHS} SELECT path FROM dd UNION ALL SELECT path FROM ww UNION ALL SELECT path FROM mm UNION ALL SELECT concat(year, '/', string_split(year, '/')[-1], '.md') FROM mm GROUP BY year)")
def summary_levels(spark, d):
    years = rollup.rollup(month_files(spark, d), "year").select("path")
    rows = day_files(spark, d).select("path").unionByName(week_files(spark, d).select("path")).unionByName(month_files(spark, d).select("path")).unionByName(years)
    return rows.select("path", paths.summary_level(F.col("path")).alias("level"))


@query(f"""SELECT concat('notes/', strftime(ts, '%Y/%m-%d'), '.md') AS path, string_agg(concat('---', {_NL}, 'date: ', {_DAY}, {_NL}, 'time: ', strftime(ts, '%H:%M:%S'), ' UTC', {_NL}, 'branch: notes', CASE WHEN event_id % 2 = 0 THEN concat({_NL}, 'source: ', event_type) ELSE '' END, {_NL}, '---', {_NL}, {_NL}, '# ',
  CASE WHEN event_id % 3 = 0 THEN concat('T', event_id) ELSE concat('Entry ', strftime(ts, '%Y-%m-%d %H:%M')) END, {_NL}, trim(props), {_NL}), concat({_NL}, '---', {_NL}, {_NL}) ORDER BY ts, event_id) AS content FROM events GROUP BY 1""")
def entry_files(spark, d):
    rows = table(spark, d, "events").selectExpr("'notes' AS branch", "ts", "event_id AS pos", "CASE WHEN event_id % 3 = 0 THEN concat('T', event_id) END AS title", "CASE WHEN event_id % 2 = 0 THEN event_type ELSE '' END AS source_hint", "props AS content")
    return sinks.day_files(sinks.entries(rows))


@query(f"""WITH f AS (SELECT pos, path, text AS content FROM documents JOIN (VALUES (0, 'identity.md', 1), (1, 'mind/mind.md', 2), (4, 'mind/desires/desires.md', 5)) t(pos, path, k) ON doc_id = k),
x AS (SELECT count(*)::INT AS source_files, string_agg(concat('--- ', path, ' ---', {_NL}, content, {_NL}), {_NL} ORDER BY pos) AS s FROM f)
SELECT source_files, CASE WHEN length(s) <= 5000 THEN s WHEN contains(left(s, 5000), {_NL}) THEN regexp_extract(left(s, 5000), '(?s)^(.*\\n)', 1) ELSE left(s, 5000) END AS content FROM x WHERE source_files > 0""")
def wake_briefing(spark, d):
    names = spark.createDataFrame([(1, "identity.md"), (2, "mind/mind.md"), (5, "mind/desires/desires.md"), (6, "other.md")], "doc_id bigint, path string")
    rows = table(spark, d, "documents").join(F.broadcast(names), "doc_id").select("path", F.col("text").alias("content"))
    return rollup.briefing(rows, Params())


__all__ = ["PATH"]
