"""Queries of the queue, the logs, captured turns, routing, evaluation and the private store."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from mossgrove.functions import jsons
from mossgrove.functions.hashing import task_id
from mossgrove.model import ACTIONS
from mossgrove.operators import evaluate, metrics, private, queue, routing, turns
from mossgrove.plans.catalog import LOG, TASKS, WIKI, half, query, sql_table, table, wiki_path
from mossgrove.streaming import keyed

_NL = "chr(10)"


def tasks(spark, d):
    return sql_table(spark, d, TASKS, "events")


def log(spark, d):
    rows = sql_table(spark, d, LOG, "events").join(table(spark, d, "events").selectExpr("event_id", "date_format(ts, 'yyyy-MM-dd HH:mm:ss') AS timestamp"), "event_id")
    return rows.withColumns({"total_cost_usd": F.col("cost").cast("double"), "cost_usd": F.lit(None).cast("double")})


@query(f"""WITH t AS ({TASKS}), n AS (SELECT 1000000 + pos AS pos, type, path, parent FROM t WHERE pos % 5 IN (1, 2)),
f AS (SELECT *, row_number() OVER (PARTITION BY type, path, parent ORDER BY pos) AS k FROM n)
SELECT pos, type, path, parent, 'pending' AS status FROM f WHERE k = 1 AND NOT EXISTS (SELECT 1 FROM t WHERE t.status = 'pending' AND t.type = f.type AND t.path = f.path AND t.parent IS NOT DISTINCT FROM f.parent)
UNION ALL SELECT pos, type, path, parent, status FROM t""")
def queue_dedup(spark, d):
    t = tasks(spark, d).select("pos", "type", "path", "parent", "status")
    new = t.where("pos % 5 IN (1, 2)").withColumns({"pos": F.col("pos") + 1000000, "status": F.lit("pending")})
    return queue.enqueue(t, new)


@query(f"SELECT coalesce(status, 'unknown') AS status, count(*) AS n FROM ({TASKS}) GROUP BY 1")
def queue_summary(spark, d):
    return queue.summary(tasks(spark, d))


@query(f"SELECT count(*) FILTER (status = 'pending') AS pending, CASE WHEN count(*) FILTER (status = 'pending') > 10 THEN 'HIGH' WHEN count(*) FILTER (status = 'pending') > 0 THEN 'low' ELSE 'none' END AS pressure FROM ({TASKS})")
def queue_pressure(spark, d):
    return queue.pressure(tasks(spark, d))


@query(f"SELECT pos, type, path, 'processing' AS status FROM ({TASKS}) WHERE status = 'pending' ORDER BY pos LIMIT 25")
def queue_dequeue(spark, d):
    return queue.dequeue(tasks(spark, d), 25).select("pos", "type", "path", "status")


@query(f"SELECT pos, type, path, 'processing' AS status FROM ({TASKS}) WHERE status = 'pending' ORDER BY priority DESC, pos LIMIT 25")
def queue_dequeue_priority(spark, d):
    return queue.dequeue(tasks(spark, d), 25, by_priority=True).select("pos", "type", "path", "status")


@query(f"SELECT pos, type, path, parent, status FROM ({TASKS}) WHERE status IN ('pending', 'processing')")
def queue_cleanup(spark, d):
    return queue.cleanup(tasks(spark, d)).select("pos", "type", "path", "parent", "status")


@query(f"SELECT queued_at AS id, CASE WHEN pos % 10 = 3 THEN 'failed' WHEN pos % 10 = 8 THEN 'done' ELSE status END AS status, CASE WHEN pos % 10 = 3 THEN 'boom' END AS error FROM ({TASKS})")
def queue_complete(spark, d):
    t = tasks(spark, d).select(F.col("queued_at").alias("id"), "pos", "status", F.lit(None).cast("string").alias("error"))
    results = t.where("pos % 5 = 3").select("id", F.when(F.col("pos") % 10 == 3, F.lit("boom")).alias("error"))
    return queue.complete(t, results).select("id", "status", "error")


@query(f"SELECT pos, left(sha256(concat_ws(':', type, path, queued_at)), 12) AS id FROM ({TASKS})", name="task_id")
def task_ids(spark, d):
    return tasks(spark, d).select("pos", task_id(F.col("type"), F.col("path"), F.col("queued_at")).alias("id"))


@query(f"SELECT step, type, CASE WHEN type = 'wake_summary' THEN 1 ELSE count(*) END AS n FROM (SELECT *, CASE WHEN type IN ('ingest', 'route') THEN 1 WHEN type = 'journal_rollup' THEN 2 WHEN type = 'wake_summary' THEN 3 ELSE 4 END AS step FROM (SELECT * REPLACE (CASE pos % 15 WHEN 0 THEN 'ingest' WHEN 5 THEN 'wake_summary' ELSE 'cascade' END AS type) FROM ({TASKS})) WHERE status = 'pending') GROUP BY step, type")
def sleep_plan(spark, d):
    t = tasks(spark, d).withColumn("type", F.when(F.col("pos") % 15 == 0, F.lit("ingest")).when(F.col("pos") % 15 == 5, F.lit("wake_summary")).otherwise(F.lit("cascade")))
    return queue.sleep_plan(t)


_SUM = lambda a, b, c: f"coalesce({a}, 0) + coalesce({b}, 0) + coalesce({c}, 0)"


@query(f"""SELECT count(*) AS total_events, sum({_SUM('judge_tokens_in', 'executor_tokens_in', 'total_tokens_in')})::BIGINT AS total_tokens_in, sum({_SUM('judge_tokens_out', 'executor_tokens_out', 'total_tokens_out')})::BIGINT AS total_tokens_out,
round(sum(cost)::DOUBLE, 4) AS total_cost_usd, count(*) FILTER (event = 'search_query') AS search_count, round(avg(elapsed_ms) FILTER (event = 'search_query'), 1) AS avg_search_ms, count(*) FILTER (event = 'index_completed') AS index_runs,
count(*) FILTER (event = 'write_entry') AS writes, (SELECT strftime(min(ts), '%Y-%m-%d %H:%M:%S') FROM events) AS period_start, (SELECT strftime(max(ts), '%Y-%m-%d %H:%M:%S') FROM events) AS period_end FROM ({LOG})""")
def metrics_summary(spark, d):
    return metrics.summary(log(spark, d))


@query(f"SELECT coalesce(event, 'unknown') AS event, count(*) AS n FROM ({LOG}) GROUP BY 1")
def metrics_by_type(spark, d):
    return metrics.by_type(log(spark, d))


@query(f"SELECT coalesce(verdict, 'UNKNOWN') AS verdict, count(*) AS n FROM ({LOG}) WHERE event = 'cascade_verdict' GROUP BY 1")
def metrics_verdicts(spark, d):
    return metrics.verdicts(log(spark, d))


@query(f"""WITH l AS ({LOG}), x AS (SELECT l.*, strftime(ts, '%Y-%m-%d %H:%M:%S') AS timestamp FROM l JOIN events USING (event_id)), c AS (SELECT substr(min(timestamp), 1, 10) AS lo FROM x)
SELECT timestamp, event FROM x WHERE event = 'search_query' AND timestamp >= (SELECT lo FROM c) ORDER BY timestamp DESC LIMIT 20""")
def metrics_tail(spark, d):
    rows = log(spark, d)
    since = rows.agg(F.substring(F.min("timestamp"), 1, 10)).first()[0]
    return metrics.read(rows, since=since, event="search_query", last=20).select("timestamp", "event")


@query(f"SELECT round(avg(elapsed_ms) FILTER (elapsed_ms > 0), 6) AS mean_ms FROM ({LOG})")
def eval_latency(spark, d):
    return evaluate.mean_latency(log(spark, d)).select(F.round("mean_ms", 6).alias("mean_ms"))


@query("SELECT event_id, CASE WHEN event_id % 10 = 0 THEN 'bad' ELSE strftime(ts, '%Y-%m-%d %H:%M:%S') END AS timestamp FROM events WHERE event_id % 10 = 0 OR ts >= (SELECT date_trunc('second', min(ts)) + INTERVAL 7 DAY FROM events)")
def audit_prune(spark, d):
    e = table(spark, d, "events")
    cutoff = e.agg(F.date_trunc("second", F.min("ts")) + F.expr("INTERVAL 7 DAYS")).first()[0]
    rows = e.select("event_id", F.when(F.col("event_id") % 10 == 0, F.lit("bad")).otherwise(F.date_format("ts", "yyyy-MM-dd HH:mm:ss")).alias("timestamp"))
    return metrics.prune_audit(rows, F.lit(cutoff).cast("timestamp"))


@query("""WITH g AS (SELECT user_id, ts, CASE WHEN ts > lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 6 HOUR OR lag(ts) OVER (PARTITION BY user_id ORDER BY ts) IS NULL THEN 1 ELSE 0 END AS new FROM events),
s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS n FROM g)
SELECT concat('p', user_id) AS path, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS first, count(*) AS changes FROM s GROUP BY user_id, n""")
def debounce_events(spark, d):
    from mossgrove.streaming.changes import debounce

    rows = table(spark, d, "events").selectExpr("concat('p', user_id) AS path", "cast(ts as timestamp) AS at")
    return debounce(rows, "6 hours").select("path", F.date_format("first", "yyyy-MM-dd HH:mm:ss").alias("first"), "changes")


@query("""SELECT event_id AS id, x.kind, CASE WHEN event_id % 4 = 0 THEN 'ingest' WHEN event_id % 4 = 1 THEN 'route' WHEN event_id % 4 = 2 AND x.kind = 'wake_summary' THEN 'wake_summary' ELSE 'route' END AS type, CASE WHEN x.kind = 'wake_summary' THEN 3 ELSE 0 END AS priority
FROM events, (VALUES ('task'), ('wake_summary')) x(kind) WHERE event_id % 4 <> 3 AND (x.kind = 'task' OR event_id % 4 = 2)""")
def watch_dispatch(spark, d):
    from mossgrove.streaming.changes import tasks_of

    path = F.when(F.col("event_id") % 4 == 0, F.lit("inbox/a.md")).when(F.col("event_id") % 4 == 1, F.lit("concepts/a.md")).when(F.col("event_id") % 4 == 2, F.lit("mind/mind.md")).otherwise(F.lit("concepts/index.md"))
    out = tasks_of(table(spark, d, "events").select(F.col("event_id").alias("id"), path.alias("path"), F.lit("modified").alias("event_type")))
    return out.select("id", F.when(F.col("type") == "wake_summary", F.lit("wake_summary")).otherwise(F.lit("task")).alias("kind"), "type", "priority")


def transcript(spark, d):
    """Lines of transcripts: every other turn's content is a list of blocks; some lines aren't JSON."""
    c = table(spark, d, "conversations")
    block = F.array(F.struct(F.lit("thinking").alias("type"), F.lit("hm").alias("text"), F.lit(None).cast("string").alias("name")), F.struct(F.lit("text").alias("type"), F.col("text"), F.lit(None).cast("string").alias("name")), F.struct(F.lit("tool_use").alias("type"), F.lit(None).cast("string").alias("text"), F.lit("grep").alias("name")))
    plain = F.to_json(F.struct(F.col("role").alias("type"), F.lit("2024-05-06T07:08:09Z").alias("timestamp"), F.struct("role", F.col("text").alias("content")).alias("message")))
    listed = F.to_json(F.struct(F.col("role").alias("type"), F.lit("2024-05-06T07:08:09Z").alias("timestamp"), F.struct("role", block.alias("content")).alias("message")))
    value = F.when(F.col("turn") % 5 == 4, F.lit("{not json")).when(F.col("turn") % 2 == 0, plain).otherwise(listed)
    return c.select(F.concat(F.lit("session-"), "conv_id").alias("session"), F.col("turn").alias("line"), value.alias("value"))


_TURNS = f"""tt AS (SELECT concat('session-', conv_id) AS session, turn AS line, role, '2024-05-06T07:08:09Z' AS timestamp,
CASE WHEN turn % 2 = 0 THEN text ELSE regexp_replace(concat(text, CASE WHEN text = '' THEN '' ELSE {_NL} END, {_NL}, '[tool_use: grep]', {_NL}, '```json', {_NL}, '{{}}', {_NL}, '```'), '^\\s+|\\s+$', '', 'g') END AS content
FROM conversations WHERE turn % 5 <> 4 AND role IN ('user', 'assistant') AND text IS NOT NULL)"""


@query(f"WITH {_TURNS} SELECT * FROM tt")
def turn_capture(spark, d):
    return turns.parse(transcript(spark, d))


@query(f"WITH {_TURNS} SELECT session, line, row_number() OVER (PARTITION BY session ORDER BY line) + 2 AS turn_number FROM tt")
def turn_numbering(spark, d):
    lines = transcript(spark, d)
    before = lines.select("session").distinct().withColumn("turn_count", F.lit(2))
    return turns.numbered(turns.parse(lines), before).select("session", "line", F.col("turn_number").cast("bigint").alias("turn_number"))


@query(f"WITH {_TURNS}, n AS (SELECT *, row_number() OVER (PARTITION BY session ORDER BY line) AS k FROM tt) SELECT session, line, concat('proj/2024/05/2024-05-06/', left(session, 8), '-turn-', lpad(k::VARCHAR, 4, '0'), '.md') AS path FROM n")
def turn_paths(spark, d):
    rows = turns.numbered(turns.parse(transcript(spark, d)))
    return rows.select("session", "line", turns.event_path(F.col("timestamp"), F.col("session"), F.col("turn_number"), F.lit("proj")).alias("path"))


@query(f"WITH {_TURNS}, a AS (SELECT concat('session-', conv_id) AS session, max(turn) AS last_line FROM conversations GROUP BY 1), b AS (SELECT session, count(*) AS turn_count FROM tt GROUP BY 1) SELECT a.session, last_line, coalesce(turn_count, 0)::INT AS turn_count FROM a LEFT JOIN b USING (session)")
def turn_markers(spark, d):
    lines = transcript(spark, d)
    return turns.marker(lines, turns.numbered(turns.parse(lines)))


_RAW = """CASE doc_id % 5 WHEN 0 THEN concat('Sure: [{"action": "revise", "target": "', lang, '/', doc_id, '.md", "direction": "x", "reason": "', n_chars, '"}, {"action": "LINK", "target": "', source, '.md"}] done')
WHEN 1 THEN '[]' WHEN 2 THEN concat('[{broken ', doc_id) WHEN 3 THEN concat('[{"action": "EXPLODE", "target": "a"}, {"action": "task", "target": "', doc_id, '.md", "direction": "do"}]') ELSE 'nothing here' END"""
_REPLY = """CASE doc_id % 4 WHEN 0 THEN concat('Well {"seeing": "', lang, '", "verdict": "REVISE", "direction": "', doc_id, '", "reason": "r"} ok') WHEN 1 THEN concat('no object ', doc_id)
WHEN 2 THEN '{broken' ELSE concat('{"seeing": "', source, '"}') END"""


@query("""SELECT doc_id AS id, 'REVISE' AS action, concat(lang, '/', doc_id, '.md') AS target, 'x' AS direction, n_chars::VARCHAR AS reason FROM documents WHERE doc_id % 5 = 0
UNION ALL SELECT doc_id, 'LINK', concat(source, '.md'), '', '' FROM documents WHERE doc_id % 5 = 0 UNION ALL SELECT doc_id, 'TASK', concat(doc_id, '.md'), 'do', '' FROM documents WHERE doc_id % 5 = 3""")
def routing_parse(spark, d):
    rows = table(spark, d, "documents").selectExpr("doc_id AS id", f"{_RAW} AS raw")
    return rows.select("id", F.explode(jsons.routing_actions(F.col("raw"))).alias("a")).select("id", "a.*")


_UNREAD = "'KEEP', '', 'Could not parse structured response.'"


@query(f"""SELECT doc_id AS id, lang AS seeing, 'REVISE' AS verdict, doc_id::VARCHAR AS direction, 'r' AS reason FROM documents WHERE doc_id % 4 = 0 UNION ALL SELECT doc_id, concat('no object ', doc_id), {_UNREAD} FROM documents WHERE doc_id % 4 = 1
UNION ALL SELECT doc_id, '{{broken', {_UNREAD} FROM documents WHERE doc_id % 4 = 2 UNION ALL SELECT doc_id, source, 'KEEP', '', '' FROM documents WHERE doc_id % 4 = 3""")
def judgment_parse(spark, d):
    return table(spark, d, "documents").selectExpr("doc_id AS id", f"{_REPLY} AS raw").select("id", jsons.judgment(F.col("raw")).alias("j")).select("id", "j.*")


@query("SELECT conv_id, turn, CASE turn % 4 WHEN 3 THEN 'plain text' ELSE text END AS reply FROM conversations WHERE text <> ''")
def reply_unwrap(spark, d):
    c = table(spark, d, "conversations").where("text <> ''")
    wrapped = lambda k: F.to_json(F.struct(F.col("text").alias(k)))
    raw = F.when(F.col("turn") % 4 == 0, wrapped("result")).when(F.col("turn") % 4 == 1, wrapped("content")).when(F.col("turn") % 4 == 2, wrapped("text")).otherwise(F.lit(" plain text "))
    return c.select("conv_id", "turn", jsons.reply_text(raw).alias("reply"))


_ACTIONS = f"""SELECT doc_id AS id, CASE doc_id % 4 WHEN 0 THEN 'REVISE' WHEN 1 THEN 'CREATE' WHEN 2 THEN 'LINK' ELSE 'TASK' END AS action,
CASE doc_id % 5 WHEN 0 THEN concat('journal/', doc_id, '.md') WHEN 1 THEN {wiki_path('doc_id')} WHEN 2 THEN concat('gone', doc_id, '.md') ELSE {wiki_path(half('doc_id'))} END AS target,
CASE WHEN doc_id % 3 = 0 THEN concat('Page ', {half('doc_id')}) ELSE 'a new one' END AS direction, {wiki_path('doc_id')} AS source FROM documents"""


@query(f"""WITH a AS ({_ACTIONS}), w AS ({WIKI}),
j AS (SELECT a.*, t.path IS NOT NULL AS there, coalesce(contains(t.content, direction), false) AS has, coalesce(contains(s.content, concat('[[', regexp_replace(target, '[.]md$', ''), ']]')), false) AS linked, s.path IS NOT NULL AS from_there,
  action IN ('REVISE', 'CREATE') AND target LIKE 'journal/%' AS leaf, action = 'REVISE' AND string_split(target, '/')[-1] = 'MEMORY.md' AS guarded FROM a LEFT JOIN w t ON target = t.path LEFT JOIN w s ON source = s.path)
SELECT id, CASE WHEN leaf THEN action WHEN guarded THEN 'PROMOTE' WHEN action = 'CREATE' AND there THEN 'REVISE' ELSE action END AS outcome,
CASE WHEN leaf OR guarded THEN false WHEN action = 'REVISE' THEN there WHEN action = 'LINK' THEN from_there AND NOT linked WHEN action = 'TASK' THEN there AND NOT has ELSE true END AS executed, CASE WHEN leaf THEN 'leaf-path' END AS rejected_reason FROM j""")
def routing_execute(spark, d):
    from mossgrove.plans.split import columns

    pages = sql_table(spark, d, WIKI, "documents")
    actions = table(spark, d, "documents").selectExpr(*columns(_ACTIONS.removeprefix("SELECT ").rpartition(" FROM ")[0]))
    return routing.decide(actions, pages).select("id", "outcome", "executed", "rejected_reason")


@query(f"""SELECT doc_id AS id, CASE doc_id % 3 WHEN 0 THEN concat(regexp_replace(t, '\\s+$', ''), {_NL}, {_NL}, '## Related', {_NL}, {_NL}, '- [[', lang, '/x]]', {_NL}) WHEN 1 THEN concat(t, {_NL}, '## See also', {_NL}, '- [[', lang, '/x]]', {_NL}, 'end', {_NL}, '## Related', {_NL}, 'z') ELSE concat(t, '[[', lang, '/x]]') END AS content
FROM (SELECT doc_id, lang, replace(text, '#', '') AS t FROM documents)""")
def link_insert(spark, d):
    t = "replace(text, '#', '')"
    rows = table(spark, d, "documents").selectExpr("doc_id AS id", "concat(lang, '/x.md') AS target", f"CASE doc_id % 3 WHEN 0 THEN {t} WHEN 1 THEN concat({t}, '\\n## See also\\nend\\n## Related\\nz') ELSE concat({t}, '[[', lang, '/x]]') END AS content")
    return rows.select("id", routing.insert_link(F.col("content"), F.col("target")).alias("content"))


@query(f"""SELECT doc_id AS id, CASE doc_id % 3 WHEN 0 THEN concat(regexp_replace(t, '\\s+$', ''), {_NL}, {_NL}, '## Tasks', {_NL}, {_NL}, '- [ ] call $1 \\ now', doc_id, ' (from [[', lang, '/s]])', {_NL}) WHEN 1 THEN concat(t, {_NL}, '## action items', {_NL}, '- [ ] call $1 \\ now', doc_id, ' (from [[', lang, '/s]])', {_NL}, 'end') ELSE concat(t, 'call $1 \\ now', doc_id) END AS content
FROM (SELECT doc_id, lang, replace(text, '#', '') AS t FROM documents)""")
def task_insert(spark, d):
    t = F.replace("text", F.lit("#"), F.lit(""))
    task = F.concat(F.lit("call $1 \\ now"), "doc_id")
    content = F.when(F.col("doc_id") % 3 == 0, t).when(F.col("doc_id") % 3 == 1, F.concat(t, F.lit("\n## action items\nend"))).otherwise(F.concat(t, task))
    return table(spark, d, "documents").select(F.col("doc_id").alias("id"), routing.insert_task(content, task, F.concat("lang", F.lit("/s.md"))).alias("content"))


_SEARCH = "SELECT n_nationkey AS id, [concat('n', (n_nationkey * 3 + i) % 25, '.md') FOR i IN range(5)] AS sources, [concat('n', (n_nationkey + 1) % 25, '.'), concat('n', (n_nationkey * 3 + 2) % 25, '.')] AS expected, [concat('n', (n_nationkey + 9) % 25, '.')] AS unwanted FROM nation"
_SCORED = f"""c AS ({_SEARCH}), h AS (SELECT *, list_filter(expected, lambda e: len(list_filter(sources, lambda s: contains(s, e))) > 0) AS hits, list_filter(unwanted, lambda e: len(list_filter(sources, lambda s: contains(s, e))) > 0) AS bad FROM c),
r AS (SELECT *, CASE WHEN len(hits) > 0 THEN 1e0 / list_position(list_transform(sources, lambda s: contains(s, hits[1])), true) ELSE 0e0 END AS rr, len(hits) = len(expected) AND len(bad) = 0 AS passed FROM h)"""


def search_cases(spark, d):
    n = F.col("n_nationkey")
    name = lambda x, end: F.concat(F.lit("n"), (x % 25).cast("string"), F.lit(end))
    return table(spark, d, "nation").select(n.alias("id"), F.array(*(name(n * 3 + i, ".md") for i in range(5))).alias("sources"), F.array(name(n + 1, "."), name(n * 3 + 2, ".")).alias("expected"), F.array(name(n + 9, ".")).alias("unwanted"))


@query(f"WITH {_SCORED} SELECT id, len(hits)::INT AS hits, len(bad)::INT AS false_positives, round(rr, 6) AS rr, passed FROM r")
def eval_search_cases(spark, d):
    out = evaluate.search_cases(search_cases(spark, d))
    return out.select("id", F.size("hits").alias("hits"), F.size("false_positives").alias("false_positives"), F.round("rr", 6).alias("rr"), "passed")


@query(f"WITH {_SCORED} SELECT count(*) AS total, count(*) FILTER (passed) AS passed, round(avg(rr), 6) AS mrr, round(sum(len(hits))::DOUBLE / sum(len(expected)), 6) AS recall_at_k FROM r")
def eval_mrr_recall(spark, d):
    return evaluate.search_metrics(evaluate.search_cases(search_cases(spark, d))).select("total", "passed", F.round("mrr", 6).alias("mrr"), F.round("recall_at_k", 6).alias("recall_at_k"))


_VERDICT = "CASE WHEN quality = 1 THEN 'KEEP' ELSE 'REVISE' END AS expected_verdict, CASE WHEN n_chars % 3 = 0 THEN 'REVISE' ELSE 'KEEP' END AS actual_verdict, CASE WHEN n_chars % 2 = 0 THEN 'Mention the DATE' ELSE 'nothing' END AS actual_direction"


def judge_cases(spark, d):
    rows = table(spark, d, "labels").join(table(spark, d, "documents"), "doc_id")
    return rows.selectExpr("doc_id", *_split(_VERDICT)).withColumn("expected_direction_keywords", F.array(F.lit("date")))


def _split(text):
    from mossgrove.plans.split import columns

    return columns(text)


@query(f"SELECT doc_id, expected_verdict = actual_verdict AND (expected_verdict <> 'REVISE' OR contains(lower(actual_direction), 'date')) AS passed FROM (SELECT doc_id, {_VERDICT} FROM labels JOIN documents USING (doc_id))")
def eval_judge_cases(spark, d):
    return evaluate.judge_cases(judge_cases(spark, d)).select("doc_id", "passed")


@query(f"SELECT count(*) AS total, count(*) FILTER (p) AS passed, round(avg(p::INT), 6) AS accuracy FROM (SELECT expected_verdict = actual_verdict AND (expected_verdict <> 'REVISE' OR contains(lower(actual_direction), 'date')) AS p FROM (SELECT {_VERDICT} FROM labels JOIN documents USING (doc_id)))")
def eval_judge(spark, d):
    return evaluate.judge_metrics(evaluate.judge_cases(judge_cases(spark, d))).select("total", "passed", F.round("accuracy", 6).alias("accuracy"))


@query(f"SELECT expected_verdict, actual_verdict, count(*) AS n FROM (SELECT {_VERDICT} FROM labels JOIN documents USING (doc_id)) GROUP BY 1, 2")
def eval_confusion(spark, d):
    return evaluate.confusion(judge_cases(spark, d))


@query("SELECT count(*) AS total, count(*) FILTER ((o_orderkey % 3 = 0) = (o_custkey % 2 = 0)) AS passed, round(avg(CASE WHEN o_orderkey % 7 - 1 >= 0 THEN o_orderkey % 7 - 1 END), 6) AS avg_depth, round(avg((o_orderkey % 3 = 0)::INT), 6) AS trunk_flag_rate FROM orders")
def eval_cascade(spark, d):
    rows = table(spark, d, "orders").selectExpr("o_orderkey % 7 - 1 AS actual_depth", "o_orderkey % 3 = 0 AS actual_flag", "o_custkey % 2 = 0 AS expected_flag")
    out = evaluate.cascade_metrics(rows)
    return out.select("total", "passed", F.round("avg_depth", 6).alias("avg_depth"), F.round("trunk_flag_rate", 6).alias("trunk_flag_rate"))


@query("SELECT concat(event_type, '/', strftime(ts, '%Y-%m-%d'), '-', lpad(row_number() OVER (PARTITION BY event_type, strftime(ts, '%Y-%m-%d') ORDER BY event_id)::VARCHAR, greatest(3, length(row_number() OVER (PARTITION BY event_type, strftime(ts, '%Y-%m-%d') ORDER BY event_id)::VARCHAR))::INT, '0'), '.md.enc') AS path, props AS content FROM events")
def private_roundtrip(spark, d):
    vault = private.Vault(b"0123456789abcdef0123456789abcdef")
    rows = table(spark, d, "events").select(F.col("event_type").alias("entity"), F.to_date("ts").alias("day"), F.col("event_id").alias("pos"), F.col("props").alias("content"))
    return vault.read(vault.write(rows), vault.consent("test")).select("path", "content")


@query("SELECT event_id AS id, concat_ws(chr(9), 'read', replace(concat(event_type, chr(9), user_id), chr(9), ' '), '-') AS line FROM events")
def audit_lines(spark, d):
    from mossgrove.functions.text import scrub

    return table(spark, d, "events").select(F.col("event_id").alias("id"), F.concat_ws("\t", F.lit("read"), scrub(F.concat("event_type", F.lit("\t"), "user_id")), F.lit("-")).alias("line"))


@query(f"WITH {_TURNS} SELECT *, row_number() OVER (PARTITION BY session ORDER BY line) AS turn_number, false AS late FROM tt")
def stream_turns(spark, d):
    """Turns captured from a stream of transcript lines that come in the wrong order: two thirds of them before those they follow."""
    return keyed.replay(transcript(spark, d).repartition(3, "session"), (F.col("line") + 1) % 3, keyed.capture)


@query(f"""WITH t AS ({TASKS}), l AS (SELECT *, last_value(CASE WHEN status IN ('pending', 'done', 'failed') THEN status END IGNORE NULLS) OVER (PARTITION BY type, path, parent ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM t)
SELECT pos, type, path, parent, status FROM l WHERE status IS DISTINCT FROM 'pending' OR before IS DISTINCT FROM 'pending'""")
def stream_queue(spark, d):
    """The queue after a stream of tasks and of what became of them, each deduplicated against what is pending in state."""
    rows = tasks(spark, d).select("pos", "type", "path", "parent", "status")
    last = rows.agg(F.max("pos")).scalar()
    return keyed.replay(rows.repartition(3, "path").withColumn("wave", F.floor(3 * F.col("pos") / (last + 1))), F.col("wave"), keyed.enqueue)


@query(f"""WITH {_SCORED}, j AS (SELECT expected_verdict = actual_verdict AND (expected_verdict <> 'REVISE' OR contains(lower(actual_direction), 'date')) AS p FROM (SELECT {_VERDICT} FROM labels JOIN documents USING (doc_id)))
SELECT count(*) AS cases, count(*) FILTER (passed) AS passed, round(avg(rr), 6) AS mrr, round(sum(len(hits))::DOUBLE / sum(len(expected)), 6) AS recall_at_k,
  (SELECT count(*) FROM j) AS judged, (SELECT round(avg(p::INT), 6) FROM j) AS accuracy FROM r""")
def eval_report(spark, d):
    """The evaluation as one JSON text, and what is in it."""
    text = evaluate.report(search=evaluate.search_metrics(evaluate.search_cases(search_cases(spark, d))), judge=evaluate.judge_metrics(evaluate.judge_cases(judge_cases(spark, d))))
    kind = "struct<search:struct<total:bigint,passed:bigint,mrr:double,recall_at_k:double>,judge:struct<total:bigint,accuracy:double>>"
    r = text.select(F.from_json("report", kind).alias("r")).select("r.*")
    return r.select(F.col("search.total").alias("cases"), "search.passed", F.round("search.mrr", 6).alias("mrr"), F.round("search.recall_at_k", 6).alias("recall_at_k"), F.col("judge.total").alias("judged"), F.round("judge.accuracy", 6).alias("accuracy"))


__all__ = ["ACTIONS", "Window"]
