import random

import pytest
from pyspark.sql import functions as F

from mossgrove.functions import text
from mossgrove.operators import bm25, hybrid
from mossgrove.plans import pipelines
from mossgrove.sources import keyword_index as ki

WORDS = "cat dog tree river stone cloud Äpfel über mañana well-known don't Straße Łódź Ωmega 日本 naïve a b".split()
SCHEMA = "id string, source string, heading string, content string"


def some(source, seed):
    random.seed(seed)
    return [(f"{source}#{k}", source, random.choice(WORDS), " ".join(random.choice(WORDS) for _ in range(random.randrange(12)))) for k in range(random.randrange(1, 4))]


def scores(df):
    return {r.id: round(r.score, 9) for r in df.collect()}


@pytest.mark.parametrize("word, plain", [("cät", "cat"), ("CÄT", "cat"), ("ca\u0308t", "cat"), ("Mañana", "manana"), ("élève", "eleve"), ("ậ", "a"), ("Straße", "straße"), ("йод", "йод"), ("日本", "日本"), ("Łódź", "łodz")])
def test_folding(spark, word, plain):
    assert spark.range(1).select(text.folded(F.lit(word))).first()[0] == plain


def test_folded_words_meet(spark):
    rows = spark.createDataFrame([("1", "x", "", "the cat sat"), ("2", "y", "", "Die Cät saß"), ("3", "z", "", "a dog")], SCHEMA)
    for query in ("cat", "CÄT", "cät"):
        assert set(scores(bm25.bm25(rows, query))) == {"1", "2"}


def test_postings_have_every_position(spark):
    rows = [x for i in range(20) for x in some(f"s{i}", i)] + [("e", "s", "", ""), ("n", "s", None, None)]
    df = spark.createDataFrame(rows, SCHEMA)
    words = {r.id: r.w for r in df.select("id", bm25.document_tokens(df).alias("w")).collect()}
    got = {(r.id, r.term): (r.length, r.tf, r.positions) for r in bm25.postings(df).collect()}
    assert got == {(i, t): (len(w), w.count(t), [k for k, x in enumerate(w) if x == t]) for i, w in words.items() for t in w}


QUERIES = ("cat", "cat dog cat", "well-known", "don't mañana", "cat-dog tree", "a-b a", "a-a", "nothing", "apfel STRASSE łodz")


def test_upkeep_equals_a_rebuild(spark, tmp_path):
    """After each of many updates the index gives what plain search over the chunks gives; old segments stay as they are."""
    path, tree = f"{tmp_path}/kw", {f"s{i}.md": some(f"s{i}.md", i) for i in range(30)}
    table = lambda rows: spark.createDataFrame(rows, SCHEMA)
    ki.update(spark, path, table([x for v in tree.values() for x in v]))
    for step in range(4):
        random.seed(100 + step)
        changed = {f"s{i}.md": some(f"s{i}.md", 1000 * step + i) for i in random.sample(range(40), 3)}
        gone = random.sample(sorted(set(tree) - set(changed)), 2) + ["never.md"]
        before = {p: p.stat().st_mtime_ns for p in tmp_path.glob("kw/*/segment=*/**/*.parquet")}
        ki.update(spark, path, table([x for v in changed.values() for x in v]), spark.createDataFrame([(g,) for g in gone], "source string"), most=99)
        assert before == {p: m for p, m in ((p, p.stat().st_mtime_ns) for p in before)}
        tree = {k: v for k, v in (tree | changed).items() if k not in gone}
        if step == 2:
            ki.merge(spark, path, 2)
            assert ki.segments(spark, path).count() == 2
        now = table([x for v in tree.values() for x in v])
        assert ki.corpus(spark, path) == pytest.approx(tuple(now.select(F.size(bm25.document_tokens(now)).alias("n")).agg(F.count("*"), F.avg("n")).first()))
        for q in QUERIES if step == 2 else QUERIES[:2]:
            assert scores(ki.search(spark, path, q)) == scores(bm25.bm25(now, q)), (step, q)
    ki.merge(spark, path)
    assert ki.segments(spark, path).count() == 1 and scores(ki.search(spark, path, "cat-dog tree")) == scores(bm25.bm25(now, "cat-dog tree"))
    assert ki.vacuum(spark, path, keep=1) and len(list(tmp_path.glob("kw/postings/segment=*"))) == 1
    assert scores(ki.search(spark, path, "cat")) == scores(bm25.bm25(now, "cat"))


def test_an_update_that_stops_leaves_the_index_as_it_was(spark, tmp_path, monkeypatch):
    path = f"{tmp_path}/kw"
    ki.update(spark, path, spark.createDataFrame(some("a.md", 1), SCHEMA))
    was = scores(ki.search(spark, path, "cat dog a"))

    def stop(*_):
        raise OSError("stopped")

    with monkeypatch.context() as m:
        m.setattr(ki, "_publish", stop)
        with pytest.raises(OSError):
            ki.update(spark, path, spark.createDataFrame(some("a.md", 2), SCHEMA))
    assert scores(ki.search(spark, path, "cat dog a")) == was and ki.version(spark, path) == 1
    with pytest.raises(OSError):
        ki._publish(spark, path, 1, ki.segments(spark, path), ki._dead(spark, path, 1))
    assert len(ki.vacuum(spark, path)) == 2  # what the stopped update had written
    # twice is once
    new = spark.createDataFrame(some("a.md", 2), SCHEMA)
    ki.update(spark, path, new)
    ki.update(spark, path, new)
    assert scores(ki.search(spark, path, "cat dog a")) == scores(bm25.bm25(new, "cat dog a"))


def test_empty_index(spark, tmp_path):
    assert ki.search(spark, f"{tmp_path}/none", "cat").count() == 0
    path = f"{tmp_path}/kw"
    ki.update(spark, path, spark.createDataFrame([], SCHEMA))
    assert ki.search(spark, path, "cat").count() == 0
    ki.update(spark, path, spark.createDataFrame(some("a.md", 1), SCHEMA))
    ki.update(spark, path, spark.createDataFrame([], SCHEMA), spark.createDataFrame([("a.md",)], "source string"))
    assert ki.search(spark, path, "cat a").count() == 0 and ki.corpus(spark, path) == (0, 0.0)


def test_indexing_a_tree_keeps_the_keywords(spark, tmp_path):
    tree, table, kw = tmp_path / "tree", f"{tmp_path}/table", f"{tmp_path}/kw"
    tree.mkdir()
    for n, t in (("a", "# Cats\nThe cät sat"), ("b", "# Dogs\nno such animal"), ("c", "cat-dog")):
        (tree / f"{n}.md").write_text(t)
    pipelines.index_tree(spark, str(tree), table, keywords=kw).collect()
    (tree / "c.md").unlink()
    (tree / "b.md").write_text("# Dogs\na cat after all")
    import os

    os.utime(tree / "b.md", (4e9, 4e9))
    pipelines.index_tree(spark, str(tree), table, keywords=kw).collect()
    chunks = spark.read.parquet(table)
    for q in ("cat", "cat-dog", "no such"):
        assert scores(ki.search(spark, kw, q)) == scores(bm25.bm25(chunks, q))
    one, two = (hybrid.hybrid_search(chunks, None, "cat", keywords=k).select("id", "score").collect() for k in (kw, None))
    assert one == two and len(one) == 2


def test_a_leg_that_fails_leaves_the_other(spark):
    rows = spark.createDataFrame([("1", "x.md", "", "the cat sat", [1.0, 0.0]), ("2", "y.md", "", "a dog", [0.0, 1.0])], SCHEMA + ", embedding array<float>")
    with pytest.raises(Exception):
        hybrid.hybrid_search(rows, [1.0, 0.0], "cat", keywords="/nowhere", tolerant=False).select(F.raise_error(F.lit("x"))).collect()
    broken = rows.withColumn("embedding", F.when(F.col("id") == "1", F.raise_error(F.lit("bad vector")).cast("array<float>")).otherwise(F.col("embedding")))
    with pytest.raises(Exception):
        hybrid.hybrid_search(broken, [1.0, 0.0], "cat").collect()
    assert [r.id for r in hybrid.hybrid_search(broken, [1.0, 0.0], "cat", tolerant=True).collect()] == ["1"]


def test_a_block_has_a_row_a_term(spark):
    """What is shuffled to build a segment is a row for each term of a block of chunks, not one for each term of each chunk."""
    rows = [x for i in range(60) for x in some(f"s{i}", i)] + [("e", "", "", ""), ("n", None, None, None)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(2)
    made = ki.blocks(df)
    assert made.groupBy("term").count().where("count > 2").count() == 0
    assert ki._each(made, "term").exceptAll(bm25.postings(df).selectExpr("term", "id", "cast(tf as int)", "positions")).count() == 0
    assert ki._each(made, "term").count() == bm25.postings(df).count()
