"""Batch runs in which one item may fail: consolidation, cascades, judgments."""

import json

import pytest
from pyspark.sql import functions as F

from mossgrove import cli
from mossgrove.functions import models
from mossgrove.model import JUDGMENT, Params
from mossgrove.operators import evaluate, graph
from mossgrove.plans import pipelines
from mossgrove.sources import files, sinks

PAGES = [
    (1, "notes/a.md", "cats purr and cats sleep"), (2, "notes/b.md", "cats purr and cats sleep today"), (3, "notes/c.md", "rivers run to the sea"), (4, "notes/d.md", "rivers run to the wide sea"),
    (5, "notes/e.md", "   "), (6, "concepts/cats.md", "cats purr and cats sleep a lot"), (7, "concepts/MEMORY.md", "volcanoes erupt ash and lava"), (8, "notes/f.md", "volcanoes erupt ash and lava"),
]


@pytest.fixture(scope="module")
def tree(spark):
    pages = spark.createDataFrame(PAGES, "id bigint, path string, content string")
    chunks = pages.select(F.col("path").alias("id"), F.col("path").alias("source"), F.lit("").alias("heading"), "content", models.embed_words(F.col("content")).alias("embedding"))
    return pages.where("path LIKE 'notes/%'"), pages, chunks


def run(spark, tree, executor=models.executor_echo, **params):
    notes, pages, chunks = tree
    got = pipelines.consolidate(spark, pages.where("path LIKE 'notes/%' OR path LIKE 'concepts/%'"), chunks, executor=executor, params=Params(cluster_threshold=0.7, **params))
    return {r.leader: r for r in got.collect()}


def test_consolidation_searches_for_its_concept(spark, tree):
    got = run(spark, tree)
    assert got[1].action == "revised" and got[1].page == "concepts/cats.md" and got[1].content == PAGES[5][2]
    assert got[3].action == "created" and got[3].page == "concepts/c.md" and got[3].content.startswith("---\ncreated_by: consolidate\nsources: 2\n---\n\n## Source: c.md")
    # the page it meets is protected, so another is made
    assert got[7].action == "created" and got[7].page not in ("concepts/MEMORY.md", None)
    assert run(spark, tree, concept_floor=1.1)[1].action == "created"


def test_a_concept_that_is_gone_is_no_match(spark, tree):
    notes, pages, chunks = tree
    got = {r.leader: r for r in pipelines.consolidate(spark, notes, chunks).collect()}
    assert got[1].action == "created"


def test_a_cluster_that_fails_leaves_the_rest(spark, tree):
    def writer(parent, direction, child):
        if "rivers" in child:
            raise ValueError("no rivers")
        return f"# Written\n{direction}"

    got = run(spark, tree, models.guarded(writer))
    assert (got[3].action, got[3].page, got[3].content, got[3].error) == ("skipped", None, None, "ValueError: no rivers")
    assert got[1].action == "revised" and "3 related files" in got[1].content and got[1].error is None
    assert got[7].page == "concepts/written.md"
    whole = pipelines.consolidate_run(spark, tree[1], tree[2], executor=models.guarded(writer))
    log = whole["log"].first()
    assert (log.clusters, log.created, log.revised, log.skipped, log.errors) == (4, 2, 1, 1, 1) and log.files_total == 8
    after = {r.path: r.content for r in whole["pages"].collect()}
    assert set(after) == {p[1] for p in PAGES} | {"concepts/written.md"} and "bring this page" in after["concepts/cats.md"].lower()
    assert sorted(r.path for r in whole["tasks"].collect()) == ["concepts/cats.md", "concepts/written.md"]


def test_no_pages_give_no_clusters(spark, tree):
    _, pages, chunks = tree
    assert pipelines.consolidate(spark, pages.limit(0), chunks).collect() == []


LINKS = [("a.md", "x"), ("b.md", "[[a]]"), ("c.md", "[[b]]"), ("MEMORY.md", "[[c]]"), ("d.md", "[[a]]"), ("e.md", "[[d]]"), ("lone.md", "none")]


def test_cascades_of_many_cases_are_the_single_ones(spark):
    pages = spark.createDataFrame(LINKS, "path string, content string")
    starts = spark.createDataFrame([(i, p) for i, (p, _) in enumerate(LINKS)], "case int, path string")
    got = {}
    for r in graph.cascade(pages, starts, by=("case",)).collect():
        got.setdefault(r.case, set()).add((r.path, r.depth, r.verdict))
    for i, (p, _) in enumerate(LINKS):
        one = graph.cascade(pages, spark.createDataFrame([(p,)], "path string")).collect()
        assert got.get(i, set()) == {(r.path, r.depth, r.verdict) for r in one}


def test_a_case_that_fails_leaves_the_rest(spark):
    def judge(parent, child):
        if parent == "[[d]]":
            raise RuntimeError("can't judge")
        return {"seeing": "", "verdict": "REVISE", "direction": "go on", "reason": ""}

    pages = spark.createDataFrame(LINKS, "path string, content string")
    cases = spark.createDataFrame([(1, "a.md", "new", True), (2, "b.md", "new", True), (3, "d.md", "new", False), (4, "lone.md", "new", True), (5, "fresh.md", "new", False)], "case int, path string, content string, expected_flag boolean")
    got = {r.case: (r.actual_depth, r.actual_flag, r.errors, r.passed) for r in evaluate.run_cascades(pages, cases, models.guarded(judge, JUDGMENT)).collect()}
    assert got == {1: (-1, True, 1, True), 2: (2, True, 0, True), 3: (-1, False, 1, True), 4: (0, False, 0, False), 5: (0, False, 0, True)}


def test_judgments_run_over_cases(spark):
    def judge(parent, child):
        return {"seeing": "", "verdict": parent, "direction": "Mention the DATE" if child else 1 / 0, "reason": ""}

    rows = [("KEEP", "x", "KEEP", None), ("REVISE", "x", "REVISE", ["date"]), ("REVISE", "x", "REVISE", ["hour"]), ("KEEP", "", "KEEP", None), ("KEEP", "x", "REVISE", [])]
    cases = spark.createDataFrame(rows, "parent string, child string, expected_verdict string, expected_direction_keywords array<string>")
    got = evaluate.run_judge(cases, models.guarded(judge, JUDGMENT)).collect()
    assert [r.passed for r in got] == [True, True, False, False, False]
    assert [bool(r.error) for r in got] == [False, False, False, True, False] and got[3].actual_verdict == "FAILED"
    plain = evaluate.run_judge(cases, models.judge_keep)
    assert [r.passed for r in plain.collect()] == [True, False, False, True, False] and evaluate.judge_metrics(plain).first().passed == 2


def test_guarded_keeps_types_and_nulls(spark):
    rows = spark.createDataFrame([(1, 2), (1, 0), (None, 3)], "a int, b int")
    got = rows.select(models.guarded(lambda a, b: float(a) / b, "double")(F.col("a").cast("double"), F.col("b")).alias("x")).select("x.*").collect()
    assert got[0].value == 0.5 and got[0].error is None and "ZeroDivisionError" in got[1].error and got[1].value is None


def test_log_generations(spark, tmp_path):
    """A log goes on in a new generation when the last is full or old; the oldest go only after a new one has rows."""
    path = f"{tmp_path}/log"
    rows = lambda k: spark.createDataFrame([(f"2024-01-0{k}", "search_query", k)], "timestamp string, event string, elapsed_ms bigint")
    seen = lambda: sorted(r.elapsed_ms for r in files.read_metrics(spark, path).collect())
    sinks.append_metrics(rows(1), path)
    sinks.append_metrics(rows(2), path)
    assert sinks.generations(spark, path) == [1]
    for k in (3, 4, 5):
        sinks.append_metrics(rows(k), path, most_bytes=1, keep=3)
    assert sinks.generations(spark, path) == [1, 2, 3, 4] and seen() == [1, 2, 3, 4, 5]
    assert sinks.rotate(spark, path, 1, 3).endswith("g00000005") and sinks.generations(spark, path) == [2, 3, 4]
    assert sinks.rotate(spark, path, 1, 3).endswith("g00000005") and seen() == [3, 4, 5]  # it stopped before it wrote
    import time

    assert sinks.rotate(spark, path, most_age=60).endswith("g00000004")
    assert sinks.rotate(spark, path, most_age=60, now=time.time() + 61).endswith("g00000005")


def test_evaluation_on_the_command_line(spark, tree, tmp_path, capsys):
    _, _, chunks = tree
    full = chunks.selectExpr("id", "source", "heading", "1 AS heading_level", "content", "1 AS start_line", "1 AS end_line", "'' AS content_hash", "0 AS trunk_distance", "current_timestamp() AS indexed_at", "cast(embedding AS array<float>) AS embedding")
    full.write.parquet(f"{tmp_path}/table")
    case = lambda **c: json.dumps(c) + "\n"
    (tmp_path / "cases.jsonl").write_text(case(qid="a", text="volcanoes erupt", k=2, expected=["notes/f.md"]) + case(qid="b", text="rivers run", expected=["nowhere.md"], unwanted=["notes/c.md"]))
    args = ["eval", f"{tmp_path}/cases.jsonl", "--table", f"{tmp_path}/table", "--snapshot", f"{tmp_path}/snap"]
    assert cli.main(args) == 1
    first = capsys.readouterr().out
    assert "1 of 2 passed" in first and "b: missed nowhere.md; unwanted notes/c.md" in first and "'mrr_change': None" in first
    (tmp_path / "cases.jsonl").write_text(case(qid="a", text="volcanoes erupt", k=2, expected=["notes/f.md"]))
    assert cli.main(args) == 0 and "'passed_change': 0.0" in capsys.readouterr().out
