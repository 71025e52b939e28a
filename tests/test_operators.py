import os
import random
import time
import hashlib
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from mossgrove.functions import dates, jsons, models, paths, text, vectors
from mossgrove.model import AUDIT, CHUNKS, Params
from mossgrove.operators import bm25, cluster, evaluate, graph, hybrid, metrics, private, queue, rollup, routing, turns
from mossgrove import cli
from mossgrove.plans import pipelines
from mossgrove.sources import chunking, files, sinks
from mossgrove.streaming import changes, daemon


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def of(spark, f, *values):
    return one(spark, f(*map(F.lit, values)))


def test_trunk_distance(spark):
    assert [of(spark, paths.trunk_distance, p) for p in ("a.md", "a/b.md", "a/b/c.md", "../x.md", "/x.md")] == [0, 1, 2, -1, -1]


def test_leaf_paths(spark):
    leaf = ["sources/a.md", "events/a", "journal/2024/x.md", "days/a", "episodes/a", "notes/a", "mirrors/a", "inbox/a", "heartbeat/artifacts/a", "inbox\\a.md", "journal\\b", "./inbox/x", ".inbox/x"]
    assert all(of(spark, paths.is_leaf, p) for p in leaf)
    assert not any(of(spark, paths.is_leaf, p) for p in ("concepts/a.md", "mind/mind.md", "heartbeat/a", "a/inbox/x", "inboxes"))


def test_path_parts(spark):
    assert of(spark, paths.stem, "a/b.c.md") == "b.c" and of(spark, paths.suffix, "a/.hidden") == "" and of(spark, paths.without_suffix, "a.d/b") == "a.d/b"
    assert of(spark, paths.parent, "a/b/c.md") == "a/b" and of(spark, paths.parent, "c.md") == ""
    assert of(spark, paths.summary_level, "journal/2024/05/week1/week1.md") == "week" and of(spark, paths.summary_level, "journal/2024/05/05-01.md") is None


def test_slugs_and_cuts(spark):
    assert of(spark, text.slug, "x/My_Page.md", "no heading") == "my-page"
    assert of(spark, text.slug, "x.md", "a\n# Über  uns: Ziele!\n") == "über-uns-ziele"
    assert of(spark, text.slug, "x.md", "# !!!\n") == "untitled-concept" and len(of(spark, text.slug, "x.md", "# " + "a" * 90)) == 60
    assert of(spark, lambda x: text.cut_at_line(x, 6), "ab\ncd\nef") == "ab\ncd\n" and of(spark, lambda x: text.cut_at_line(x, 3), "abcdef") == "abc"
    assert of(spark, text.project_hash, "C:\\Work\\x") == "C--Work-x" and of(spark, lambda x: text.entity(x, "-agent"), "") == "unknown-agent"


def test_days(spark):
    day = F.lit(datetime(2024, 4, 17))
    assert one(spark, dates.journal_path(F.lit("journal"), day)) == "journal/2024/04/week3/04-17.md"
    assert one(spark, dates.entry_path(F.lit("notes"), day)) == "notes/2024/04-17.md"
    got = one(spark, dates.summaries(F.lit("journal/sub/2024/04/week3/04-17.md")))
    assert [(r.path, r.priority) for r in got] == [("journal/sub/2024/04/week3/week3.md", 3), ("journal/sub/2024/04/04.md", 2), ("journal/sub/2024/2024.md", 1)]


def test_replies(spark):
    assert of(spark, jsons.routing_actions, "[not json]") == [] and of(spark, jsons.routing_actions, "[]") == []
    got = of(spark, jsons.routing_actions, 'ok [{"action": "create", "target": "a"}, {"action": "DANCE"}, 7] bye [')
    assert [r.action for r in got] in ([], ["CREATE"])
    assert of(spark, jsons.judgment, "x" * 600).seeing == "x" * 500 and of(spark, jsons.judgment, '{"verdict": "REJECT"}').verdict == "REJECT"


def test_chunks(spark):
    df = spark.createDataFrame([("a/b.md", "intro\n# One\ntext\n## Two  \n\n#tag\n" + "x" * 2500 + "\ny\n"), ("e.md", " \n\n"), ("c.md", "")], "source string, content string")
    rows = chunking.chunk(df).orderBy("start_line").collect()
    assert [(r.heading, r.heading_level, r.start_line, r.end_line) for r in rows] == [("", 0, 1, 1), ("One", 1, 2, 3), ("Two", 2, 4, 7), ("Two", 2, 8, 9)]
    assert len({r.id for r in rows}) == 4 and all(r.trunk_distance == 1 for r in rows)


def test_indexing_a_tree(spark, tmp_path):
    root, table = tmp_path / "tree", str(tmp_path / "chunks")
    (root / "a").mkdir(parents=True)
    (root / ".system").mkdir()
    for name, body in (("top.md", "# Top\nriver stone"), ("a/leaf.md", "# Leaf\nforest market"), ("a/skip.txt", "no"), (".system/x.md", "no")):
        (root / name).write_text(body)
    (root / "bad.md").write_bytes(b"\xff\xfe\x00")
    first = pipelines.index_tree(spark, str(root), table).first()
    assert (first.scanned, first.indexed, first.skipped, first.errors, first.chunks) == (3, 2, 0, 1, 2)
    assert pipelines.index_tree(spark, str(root), table).first().skipped == 2
    (root / "a/leaf.md").unlink()
    again = pipelines.index_tree(spark, str(root), table).first()
    assert (again.removed, again.skipped) == (1, 1)
    chunks = spark.read.schema(CHUNKS).parquet(table)
    vector = one(spark, models.embed_words(F.lit("river")))
    hit = hybrid.hybrid_search(chunks, vector, "river").first()
    assert (hit.rank, hit.source) == (1, "top.md")


def test_legs_may_be_missing(spark):
    chunks = spark.createDataFrame([(1, "a.md", "", "apple pie", [1.0, 0.0]), (2, "d/b.md", "", "pear", [0.0, 1.0]), (3, "c.md", "", "plum", None)], "id bigint, source string, heading string, content string, embedding array<float>")
    assert [r.id for r in hybrid.hybrid_search(chunks, None, "pear").collect()] == [2]
    assert [r.id for r in hybrid.hybrid_search(chunks, [1.0, 0.0], None).collect()] == [1, 2]
    assert hybrid.hybrid_search(chunks, None, '"').count() == 0
    assert bm25.bm25(chunks, "no-such words").count() == 0


def plain_greedy(ids, pairs):
    near, leader = {frozenset(p) for p in pairs}, {}
    for i in ids:
        if i not in leader:
            leader[i] = i
            for j in ids:
                if j > i and j not in leader and frozenset((i, j)) in near:
                    leader[j] = i
    return leader


@pytest.mark.parametrize("seed", range(4))
def test_greedy_clusters_are_sequential_ones(spark, seed):
    random.seed(seed)
    n = 40
    pairs = [(i, j) for j in range(n) for i in range(j) if random.random() < 0.08 * (seed + 1)]
    got = {r.id: r.leader for r in cluster.greedy_clusters(spark.range(n), spark.createDataFrame(pairs, "i bigint, j bigint")).collect()}
    assert got == plain_greedy(range(n), pairs)


def test_similar_pairs_over_blocks(spark):
    random.seed(0)
    rows = [(i, [random.gauss(0, 1) for _ in range(6)]) for i in range(90)]
    df = spark.createDataFrame(rows, "id bigint, embedding array<float>")
    whole = {(r.i, r.j) for r in cluster.similar_pairs(df, 0.5).collect()}
    assert whole == {(r.i, r.j) for r in cluster.similar_pairs(df, 0.5, block=20).collect()} and whole
    assert one(spark, vectors.cosine(vectors.literal([1, 0]), vectors.literal([0, 1]))) == 0


def pages(spark, **rows):
    return spark.createDataFrame([(k.replace("__", "/") + ".md", v) for k, v in rows.items()], "path string, content string")


def test_cascade_over_a_cycle(spark):
    p = pages(spark, a="[[b]]", b="[[c]]", c="[[a]]")
    s = graph.cascade_stats(graph.cascade(p, spark.createDataFrame([("a.md",)], "path string"))).first()
    assert (s.files_changed, s.promoted, s.max_depth) == (["a.md", "b.md", "c.md"], [], 3)
    kept = graph.cascade(p, spark.createDataFrame([("a.md",)], "path string"), judge=models.judge_keep).collect()
    assert [(r.path, r.verdict) for r in kept] == [("c.md", "KEEP")]


def test_protected_pages_are_promoted(spark):
    p = pages(spark, identity="[[d/x]]", d__x="t", y="[[x.md]] [[x|alias]]", z="[[identity]]")
    out = {r.path: r.verdict for r in graph.cascade(p, spark.createDataFrame([("d/x.md",)], "path string")).collect()}
    assert out == {"identity.md": "PROMOTE"}


def test_indexes(spark):
    p = pages(spark, a__one="# First\n", a__b__two="text", top="x")
    rows = {r.path: r.content for r in graph.directory_indexes(p).collect()}
    assert rows == {"a/index.md": "# A\n\n- [[a/b/]] — b\n- [[a/one]] — First\n", "a/b/index.md": "# B\n\n- [[a/b/two]] — two\n"}


def test_queue(spark):
    t = spark.createDataFrame([(1, "r", "a", None, 0, "pending"), (2, "r", "b", "x", 9, "done"), (3, "r", "c", None, 5, "pending")], "pos bigint, type string, path string, parent string, priority int, status string")
    new = spark.createDataFrame([(4, "r", "a", None, 0, "pending"), (5, "r", "b", "x", 0, "pending"), (6, "r", "b", "x", 0, "pending")], t.schema)
    out = queue.enqueue(t, new)
    assert sorted(r.pos for r in out.collect()) == [1, 2, 3, 5]
    assert [r.pos for r in queue.dequeue(t, 1).collect()] == [1] and [r.pos for r in queue.dequeue(t, 1, True).collect()] == [3]
    assert queue.cleanup(t).count() == 2 and queue.pressure(t).first().pressure == "low"


def test_page_edits(spark):
    link = lambda c, t: of(spark, routing.insert_link, c, t)
    assert link("# A\n", "x/b.md") == "# A\n\n## Related\n\n- [[x/b]]\n"
    assert link("# A\n## SEE ALSO\n- [[q]]\n", "b.md") == "# A\n## SEE ALSO\n- [[b]]\n- [[q]]\n"
    assert link("has [[b]]", "b.md") == "has [[b]]"
    task = of(spark, routing.insert_task, "# A\n## Next\nz\n## Tasks\n", "pay $5 \\ now", "s/n.md")
    assert task == "# A\n## Next\n- [ ] pay $5 \\ now (from [[s/n]])\nz\n## Tasks\n"


def test_applied_actions(spark):
    p = spark.createDataFrame([("a.md", "# A"), ("s.md", "# S")], "path string, content string")
    acts = spark.createDataFrame([("LINK", "a.md", "", "s.md"), ("TASK", "a.md", "do it", "s.md"), ("CREATE", "n.md", "d", "s.md")], "action string, target string, direction string, source string")
    out = {r.path: r.content for r in routing.apply(routing.decide(acts, p), p, models.executor_echo).collect()}
    assert out == {"s.md": "# S\n\n## Related\n\n- [[a]]\n", "a.md": "# A\n\n## Tasks\n\n- [ ] do it (from [[s]])\n", "n.md": ""}
    assert routing.apply(routing.decide(acts, p, dry_run=True), p, models.executor_echo).count() == 0


def test_logs(spark, tmp_path):
    (tmp_path / "m.jsonl").write_text('{"event": "search_query", "elapsed_ms": 10, "timestamp": "2024-01-01"}\nnot json\n{"event": "search_query", "elapsed_ms": 15, "cost_usd": 0.5, "timestamp": "2024-01-02"}\n')
    s = metrics.summary(files.read_metrics(spark, str(tmp_path / "m.jsonl"))).first()
    assert (s.total_events, s.search_count, s.avg_search_ms, s.total_cost_usd) == (2, 2, 12.5, 0.5)
    (tmp_path / "a.tsv").write_text("2024-01-01T00:00:00\tread\tp\te\ts\terr\nshort\tline\nnever\tread\tp\te\ts\terr\n")
    rows = files.read_audit(spark, str(tmp_path / "a.tsv"))
    assert rows.count() == 2 and metrics.prune_audit(rows, F.lit("2025-01-01").cast("timestamp")).count() == 1
    assert [f.name for f in rows.schema] == [c.split(" ")[0] for c in AUDIT.split(", ")]
    (tmp_path / "q.json").write_text('[{"type": "route", "path": "a", "priority": 2}, {"type": "ingest", "path": "b"}]')
    assert [(r.pos, r.type) for r in files.read_queue(spark, str(tmp_path / "q.json")).collect()] == [(0, "route"), (1, "ingest")]
    (tmp_path / "bad.json").write_text("{oops")
    assert files.read_queue(spark, str(tmp_path / "bad.json")).count() == 0


def test_sources(spark, tmp_path):
    d = tmp_path / "src"
    (d / ".git").mkdir(parents=True)
    for n, b in (("b.md", "bee"), ("a.py", "pass"), ("c.bin", "no"), (".git/x.md", "no")):
        (d / n).write_text(b)
    got = files.read_source(spark, str(d)).first()
    assert (got.type, got.content) == ("directory", "## a.py\n\npass\n\n---\n\n## b.md\n\nbee")
    assert files.read_source(spark, str(d / "b.md"), Params(source_chars=2)).first().content == "be"
    with pytest.raises(FileNotFoundError):
        files.read_source(spark, str(tmp_path / "none"))
    (tmp_path / "empty").mkdir()
    with pytest.raises(ValueError):
        files.read_source(spark, str(tmp_path / "empty"))


def test_turns(spark):
    lines = ['{"type": "user", "message": {"role": "user", "content": "hi"}}', "{bad", '{"type": "system", "message": {"role": "system", "content": "x"}}', '{"type": "assistant", "timestamp": "2024-05-06T07:08:09Z", "message": {"role": "assistant", "content": [{"type": "thinking", "text": "t"}, {"type": "tool_result", "content": "ok"}]}}', '{"type": "user", "message": {"role": "user", "content": [{"type": "thinking"}]}}']
    df = spark.createDataFrame([("s1", i, x) for i, x in enumerate(lines)], "session string, line int, value string")
    rows = turns.numbered(turns.parse(df)).orderBy("line").collect()
    assert [(r.role, r.content, r.turn_number) for r in rows] == [("user", "hi", 1), ("assistant", "[tool_result]\nok", 2)]


def test_journal_and_briefing(spark):
    f = spark.createDataFrame([("journal/2024/05/week1/05-02.md", "b"), ("journal/2024/05/week1/05-01.md", "a"), ("journal/2024/05/week1/week1.md", "w"), ("journal/2024/05/week1/note.md", "n"), ("identity.md", "me"), ("mind/mind.md", "m")], "path string, content string")
    week = rollup.rollup(f, "week").first()
    assert (week.path, week.children, week.entries) == ("journal/2024/05/week1/week1.md", 2, "--- 05-01.md ---\na\n\n--- 05-02.md ---\nb")
    assert rollup.rollup(f, "month").first().path == "journal/2024/05/05.md"
    assert rollup.briefing(f).first().content == "--- identity.md ---\nme\n\n--- mind/mind.md ---\nm\n" and rollup.briefing(f.limit(0)).count() == 0


def test_vault(spark):
    v = private.Vault(b"k" * 32)
    rows = spark.createDataFrame([("me", datetime(2024, 1, 2), 1, "secret"), ("me", datetime(2024, 1, 2), 2, "more")], "entity string, day date, pos int, content string") if False else spark.createDataFrame([("me", 1, "secret"), ("me", 2, "more")], "entity string, pos int, content string").withColumn("day", F.lit("2024-01-02").cast("date"))
    sealed = v.write(rows)
    assert sorted(r.path for r in sealed.collect()) == ["me/2024-01-02-001.md.enc", "me/2024-01-02-002.md.enc"]
    assert sorted(r.content for r in v.read(sealed, v.consent("test")).collect()) == ["more", "secret"]
    with pytest.raises(PermissionError):
        v.read(sealed, private.Vault(b"k" * 32).consent("other"))
    wrong = private.Vault(b"x" * 32)
    lost = wrong.read(sealed, wrong.consent("t"))
    assert private.failures(lost, F.current_timestamp(), "s\t1").count() == 2


def test_entries_and_sleep(spark):
    rows = spark.createDataFrame([("notes", "2024-01-02 03:04:05", None, None, " x "), ("notes", "2024-01-02 04:00:00", "T", "s", "y")], "branch string, t string, title string, source_hint string, content string").withColumn("ts", F.to_timestamp("t"))
    f = sinks.day_files(sinks.entries(rows)).first()
    assert f.path == "notes/2024/01-02.md" and f.content.count("\n---\n\n---\n") == 1 and "# Entry 2024-01-02 03:04\nx\n" in f.content
    t = queue.with_ids(spark.createDataFrame([(1, "route", "a", "t1", "pending", None, 0), (2, "odd", "b", "t2", "pending", None, 0)], "pos bigint, type string, path string, queued_at string, status string, error string, priority int"))
    out = pipelines.sleep(t, 5, {"route": lambda own: own.select("id", F.lit(None).cast("string").alias("error"))})
    assert {r.path: r.status for r in out.collect()} == {"a": "done", "b": "failed"}


def test_texts_beyond_a_budget_do_not_meet(spark):
    """Each task used to send thousands of whole texts of a leader to one task."""
    name = F.concat(F.col("pos").cast("string"), F.lit(".md"))
    rows = spark.range(6000).select(F.when(F.col("id") % 2 == 0, "a").alias("leader"), F.col("id").alias("pos")).withColumn("name", name)
    rows = rows.withColumn("content", F.repeat(F.lit("x"), F.when(F.col("pos") == 3, 5000).otherwise(90).cast("int"))).repartition(8)
    near = cluster.within_budget(rows, 1000).select("leader", F.length("content").alias("n")).collect()
    assert len(near) < 15 and max(r.n for r in near) == 1000
    got = {r.leader: (r.n_files, r.content) for r in cluster.cluster_content(rows, 1000).collect()}
    for leader, first in (("a", 0), (None, 1)):
        parts, room = [], 1000
        for p in range(first, 6000, 2):
            text = "x" * (5000 if p == 3 else 90)
            if room > 0:
                parts.append(f"## Source: {p}.md\n\n" + text[:room])
            room -= len(f"## Source: {p}.md\n\n") + len(text)
        assert got[leader] == (len(parts), "\n\n---\n\n".join(parts))


def test_entries_of_one_time_keep_their_order(spark):
    rows = spark.createDataFrame([("notes", k, t, "", "x") for k, t in ((2, "A"), (1, "Z"), (3, None))], "branch string, pos bigint, title string, source_hint string, content string").withColumn("ts", F.to_timestamp(F.lit("2024-01-02 03:04:05")))
    text = sinks.day_files(sinks.entries(rows)).first().content
    assert text.index("# Z") < text.index("# A") < text.index("# Entry")


def test_evaluation(spark):
    c = evaluate.search_cases(spark.createDataFrame([(["b", "a"], ["z"], ["x/a", "x/b"])], "expected array<string>, unwanted array<string>, sources array<string>"))
    assert (c.first().rr, c.first().passed) == (0.5, True)
    assert evaluate.search_metrics(c.limit(0)).first().mrr == 0


def test_a_replacement_that_stops_is_recovered(spark, tmp_path):
    path = f"{tmp_path}/t"
    sinks.replace_table(spark.range(3), path)
    sinks.replace_table(sinks.read_table(spark, path).where("id > 0"), path)
    assert sinks.read_table(spark, path).count() == 2
    os.rename(path, path + ".old")  # as if it had stopped between the renames
    assert sinks.read_table(spark, path).count() == 2
    os.rename(path, path + ".old")
    sinks.replace_table(spark.range(7), path)
    assert sinks.read_table(spark, path).count() == 7 and not os.path.exists(path + ".old")


def test_watching_sees_edits_and_deletions(spark, tmp_path):
    folder = tmp_path / "tree"
    (folder / "concepts").mkdir(parents=True)
    got = []
    q = changes.watch(spark, str(folder), lambda tasks, n: got.extend((r.path, r.event_type, r.type) for r in tasks.collect()), str(tmp_path / "check"), "200 milliseconds")

    def wait(what):
        end = time.monotonic() + 60
        while time.monotonic() < end and what not in got:
            time.sleep(0.2)
        assert what in got, got

    try:
        page = folder / "concepts" / "a.md"
        page.write_text("one")
        wait(("concepts/a.md", "created", "route"))
        page.write_text("two")
        os.utime(page, (2e9, 2e9))
        wait(("concepts/a.md", "modified", "route"))
        page.unlink()
        (folder / "concepts" / "b.md").write_text("x")
        wait(("concepts/b.md", "created", "route"))
        assert not any(e == "deleted" for _, e, _ in got)
    finally:
        q.stop()


def test_word_embeddings_match_a_plain_version(spark):
    texts = ["One two two, three.", "", "ünïcode WORDS words 42", "a " * 500]
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, text string").select("id", "text", text.tokens(F.col("text")).alias("t"), models.embed_words(F.col("text"), 16).alias("v")).collect()
    for r in rows:
        want = [0.0] * 16
        for t in r.t:
            want[int(hashlib.md5(t.encode()).hexdigest()[:8], 16) % 16] += 1
        n = sum(x * x for x in want) ** 0.5
        assert r.v == pytest.approx([x / n if n else 0.0 for x in want])


def test_daemon_empties_the_queue_and_a_failed_poll_keeps_it(spark, tmp_path):
    table = f"{tmp_path}/queue"
    assert daemon.drain(spark, table, {}) == 0
    sinks.replace_table(queue.with_ids(spark.createDataFrame([(k, "route", f"{k}.md", "t", "pending", None, 0) for k in range(3)], "pos bigint, type string, path string, queued_at string, status string, error string, priority int")), table)

    def broken(own):
        raise RuntimeError("no model")

    with pytest.raises(RuntimeError):
        daemon.drain(spark, table, {"route": broken})
    assert queue.pressure(sinks.read_table(spark, table)).first()["pending"] == 3
    assert daemon.run(spark, table, {"route": lambda own: own.select("id", F.lit(None).cast("string").alias("error"))}, every=0, polls=2) == 3
    assert {r.status for r in sinks.read_table(spark, table).collect()} == {"done"}


def test_command_line_queues_and_works_off(spark, tmp_path, capsys):
    root, table = tmp_path / "tree", f"{tmp_path}/chunks"
    root.mkdir()
    (root / "a.md").write_text("# A\nmoss and fern\n")
    run = lambda *words: cli.main([*words, "--root", str(root), "--table", table])
    assert run("ingest", "a.md", "a.md") == 0 and run("queue") == 0
    assert "pending" in capsys.readouterr().out
    assert run("sleep") == 0 and "1 tasks handled" in capsys.readouterr().out
    assert run("read", "fern") == 0 and "a.md" in capsys.readouterr().out
    assert cli.main(["write", "some", "words", "--table", f"{tmp_path}/entries"]) == 0
    assert spark.read.parquet(f"{tmp_path}/entries").first().content == "some words"
    (tmp_path / "log.jsonl").write_text('{"event": "write_entry"}\n')
    assert cli.main(["metrics", "--table", f"{tmp_path}/log.jsonl"]) == 0 and "writes" in capsys.readouterr().out


def test_an_existing_file_is_routed_but_not_to_itself(spark, tmp_path):
    (tmp_path / "a.md").write_text("# A\nmoss and fern\n")
    (tmp_path / "b.md").write_text("# B\nfern and moss\n")
    pipelines.index_tree(spark, str(tmp_path), f"{tmp_path}/table").collect()
    chunks, seen = spark.read.schema(CHUNKS).parquet(f"{tmp_path}/table"), spark.createDataFrame([("a.md", "# A"), ("b.md", "# B")], "path string, content string")

    def link(content, candidates):
        return F.transform(candidates, lambda c: F.struct(F.lit("LINK").alias("action"), c["source"].alias("target"), F.lit("").alias("direction"), F.lit("").alias("reason")))

    actions, changed = pipelines.route_file(spark, str(tmp_path), "a.md", chunks, seen, router=link)
    assert [(r.source, r.target, r.executed) for r in actions.collect()] == [("a.md", "b.md", True)]
    assert changed.first().path == "a.md" and "[[b]]" in changed.first().content


def test_no_chunk_is_over_the_limit(spark):
    """Long paragraphs, lines and sentences are parted; nothing is lost and lines keep their numbers."""
    files_ = {
        "a": "intro\n\n# One\n" + "Short line.\n" * 30 + "\nNext paragraph of words.\nWith two lines.\n\n" + "A sentence here! " * 40 + "\n" + "x" * 500 + "\nend",
        "b": "", "c": "   \n\n", "d": "\n" * 300 + "late", "e": "é" * 1000, "f": "# only", "g": "Wait... what?! " * 60 + "\r\nnext\r\n", "h": "no end " * 100,
    }
    rows = spark.createDataFrame(list(files_.items()), "source string, content string")
    for most in (100, 37, 2000):
        got = {}
        for r in chunking.chunk_within(rows, most).orderBy("source", "start_line", "end_line").collect():
            assert len(r.content) <= most and r.content.strip()
            lines = files_[r.source].split("\n")[r.start_line - 1 : r.end_line]
            assert "".join(r.content.split()) in "".join("".join(lines).split())
            got.setdefault(r.source, []).append(r)
        for name, text_ in files_.items():
            kept = sorted("".join("".join(r.content.split()) for r in got.get(name, [])))
            assert kept == sorted("".join(text_.split())), (name, most)
    assert [r.heading for r in chunking.chunk_within(rows, 100).where("source = 'a' AND start_line > 3").collect()][0] == "One"
