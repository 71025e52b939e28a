import random
import re
import zlib

import numpy as np
import pytest

from mossgrove.llm import neighbours, quality, toxicity
from mossgrove.llm.labels import sample


def plain_nearest(vectors, every=50, most=5):
    ids = np.array([i for i, _ in vectors])
    x = np.array([v for _, v in vectors], "f8")
    out = {}
    for k, i in enumerate(ids):
        if i % every == 0:
            s = x @ x[k] / (np.linalg.norm(x, axis=1) * np.linalg.norm(x[k]))
            out[int(i)] = [(int(ids[o]), s[o]) for o in np.lexsort((ids, -s)) if ids[o] != i][:most]
    return out


@pytest.fixture(scope="module")
def clouds():
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(30, 24))
    return [(i, (centres[i % 30] + 0.8 * rng.normal(size=24)).astype("f4").tolist()) for i in range(3000)]


def test_recall_against_brute_force(spark, clouds):
    got = {}
    for r in neighbours.nearest(spark.createDataFrame(clouds, "vec_id bigint, embedding array<float>")).collect():
        got.setdefault(r.query_id, {})[r.rank] = (r.vec_id, r.score)
    want = plain_nearest(clouds)
    assert got.keys() == want.keys() and all(sorted(v) == [1, 2, 3, 4, 5] for v in got.values())
    hits = sum(len({x for x, _ in got[q].values()} & {x for x, _ in want[q]}) for q in want)
    assert hits >= 0.9 * 5 * len(want)
    exact = {(q, x): s for q, w in want.items() for x, s in w}
    assert all(abs(s - exact[(q, x)]) < 1e-12 for q, g in got.items() for x, s in g.values() if (q, x) in exact)


def test_descent_improves_the_graph(spark, clouds):
    rows = neighbours.valid(spark.createDataFrame(clouds, "vec_id bigint, embedding array<float>"), "vec_id", "embedding")
    units = neighbours.nodes(rows, 6).select("id", "code").cache()
    x = np.array([v for _, v in clouds], "f8")
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    s = x @ x.T
    np.fill_diagonal(s, -9)
    best = np.argsort(-s, axis=1)[:, :5]

    def recall(delta):
        graph = {r.id: set(r.ids) for r in neighbours.build(units, delta=delta).collect()}
        return np.mean([len(set(best[i].tolist()) & graph[i]) / 5 for i in range(len(x))])

    start, end = recall(1.0), recall(neighbours.DELTA)
    assert start < 0.8 and end > 0.95


def test_odd_vectors(spark):
    v = [(0, [1.0, 0.0]), (50, [1.0, 0.0]), (1, [2.0, 0.0]), (2, [0.0, 1.0]), (3, None), (4, [0.0, 0.0]), (5, [float("nan"), 1.0]), (6, [None, 1.0]), (7, [1.0]), (8, [float("inf"), 1.0]), (None, [1.0, 1.0]), (100, [-1.0, 0.0]), (2, [0.0, 1.0]), (9, [])]
    df = spark.createDataFrame(v, "vec_id bigint, embedding array<float>").selectExpr("*", "1 AS rank", "'x' AS query", "2 AS id")
    got = {}
    for r in neighbours.nearest(df).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, round(r.score, 6)))
    # the vector of one component counts as [1, 0]
    assert got == {0: [(1, 1.0), (7, 1.0), (50, 1.0), (2, 0.0), (100, -1.0)], 50: [(0, 1.0), (1, 1.0), (7, 1.0), (2, 0.0), (100, -1.0)], 100: [(2, 0.0), (0, -1.0), (1, -1.0), (7, -1.0), (50, -1.0)]}
    assert neighbours.nearest(df.limit(0)).count() == 0


def test_many_equal_vectors(spark):
    v = [(i, [1.0, 2.0, 3.0]) for i in range(0, 1200)] + [(5000, [1.0, 2.0, 3.1])]
    got = neighbours.nearest(spark.createDataFrame(v, "vec_id bigint, embedding array<float>"))
    rows = [(r.vec_id, r.rank) for r in got.where("query_id = 0").orderBy("rank").collect()]
    assert rows == [(1, 1), (2, 2), (3, 3), (4, 4), (5, 5)] and got.count() == 5 * 25


WORDS = "river stone garden window letter morning paper silver winter forest market candle bridge harbour meadow orchard".split()


def labelled(spark, n=600):
    random.seed(4)
    rows, labels = [], []
    for i in range(n):
        words = [random.choice(WORDS) + random.choice(["", "s", "ly"]) for _ in range(random.randrange(20, 90))]
        bad, toxic = i % 5 == 0, i % 7 == 0
        if toxic:
            for _ in range(random.randrange(1, 4)):
                words[random.randrange(len(words))] = random.choice(["grumbolt", "snarfing", f"vilex{random.choice('abcdefgh')}{random.choice('mnop')}"])
        text = " ".join(w + "%%%" for w in words) if bad else " ".join(words) + "."
        rows.append((i, text))
        if i % 4:
            labels.append((i, int(not bad), int(toxic)))
    return spark.createDataFrame(rows, "doc_id bigint, text string"), spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int"), rows


def test_held_out_accuracy(spark):
    docs, labels, rows = labelled(spark)
    for found, truth in ((quality.classify(docs, labels), lambda i: int(i % 5 > 0)), (toxicity.classify(docs, labels), lambda i: int(i % 7 == 0))):
        out = found.collect()
        assert len(out) == len(rows)
        assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in out)
        own = [r.predicted == truth(r.doc_id) for r in out if r.held_out]
        assert np.mean(own) >= 0.97


def test_offsets_name_the_words(spark):
    docs, labels, rows = labelled(spark)
    text = dict(rows)
    hit = {text[r.doc_id][int(s) : int(e)][:5] for r in toxicity.classify(docs, labels).collect() if r.spans for s, e in (x.split(":") for x in r.spans.split(","))}
    assert hit == {"grumb", "snarf", "vilex"}


def test_labels_of_held_out_rows_are_never_read(spark):
    docs, labels, _ = labelled(spark)
    flipped = labels.selectExpr("doc_id", "CASE WHEN crc32(cast(cast(doc_id AS string) AS binary)) % 4 = 2 THEN 1 - quality ELSE quality END AS quality", "CASE WHEN crc32(cast(cast(doc_id AS string) AS binary)) % 4 = 2 THEN 1 - toxic ELSE toxic END AS toxic")
    for f in (quality.classify, toxicity.classify):
        assert sorted(f(docs, labels).select("doc_id", "score").collect()) == sorted(f(docs, flipped).select("doc_id", "score").collect())


def test_sample_is_bounded_and_even(spark):
    labels = spark.range(1000).selectExpr("id AS doc_id", "cast(id % 2 AS int) AS quality")
    assert sample(labels, "quality", 100).count() == 100
    assert sorted(map(tuple, sample(labels, "quality", 100).collect())) == sorted(map(tuple, sample(labels.repartition(7), "quality", 100).collect()))


def test_odd_texts_are_scored(odd, odd_rows, empty, labels):
    for f in (quality.classify, toxicity.classify):
        rows = f(odd, labels).collect()
        assert len(rows) == len(odd_rows) and all(r.score is not None and 0 <= r.score <= 1 for r in rows)
        assert f(empty, labels).count() == 0
        assert f(odd, labels.limit(0)).count() == len(odd_rows)
    assert quality.keep(odd, labels).columns == odd.columns
    assert quality.keep(odd, labels.limit(0)).count() == len(odd_rows)


def plain_marginals(emit, trans):
    n, p, total = len(emit), np.zeros(len(emit)), 0.0
    for k in range(2**n):
        tags = [k >> i & 1 for i in range(n)]
        w = np.exp(sum(emit[i] * t for i, t in enumerate(tags)) + sum(trans[a, b] for a, b in zip(tags, tags[1:])))
        total += w
        p += w * np.array(tags)
    return p / total


def test_forward_backward_is_exact():
    rng = np.random.default_rng(0)
    emit, trans = rng.normal(size=(4, 6)), rng.normal(size=(2, 2))
    live = np.arange(6) < np.array([6, 1, 4, 5])[:, None]
    got = toxicity._marginals(emit, live, trans)[0]
    for row, mask, g in zip(emit, live, got):
        n = mask.sum()
        assert np.allclose(g[:n], plain_marginals(row[:n], trans)) and not g[n:].any()


def test_trees_are_as_their_arrays_say():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(500, 4))
    y = ((x[:, 1] > 0.3) ^ (x[:, 2] > 0)).astype(float)
    model = quality.fit(x, y, trees=20, depth=3)
    assert ((model.score(x) > 0.5) == y).mean() > 0.95
    one = x[7]
    total = model.base
    for f, c, v in zip(model.feature, model.cut, model.value):
        node = 0
        for _ in range(3):
            node = 2 * node + (2 if one[f[node]] > c[node] else 1)
        total += v[node - 7]
    assert model.score(x)[7] == pytest.approx(1 / (1 + np.exp(-total)))


def test_one_clean_document_removes_no_word():
    """A toxic word that a clean document has too, and the words of a language with few toxic documents, are found."""
    plain = [f"plain words {i} of an everyday text number{i % 50} go on" for i in range(2_000)]
    toxic = [f"such gromblig{i % 3} stuff {i}" for i in range(200)] + [f"esto marfuzon{'abcdef'[i % 6]} algo {i}" for i in range(12)]
    field = toxicity.fit([*plain, "a clean gromblig0 text", "otro marfuzona texto", *toxic], [0] * 2_002 + [1] * 212)
    tag = field.tagger()
    assert [p.max() >= toxicity.THRESHOLD for p, _ in tag(["new gromblig0 here", "nuevo marfuzonc aqui", "everyday words go on"])] == [True, True, False]


def test_a_long_sentence_is_one_chain():
    """Marginals of a sentence of hundreds of words, among short ones, are those of the field over all of it."""
    rng = np.random.default_rng(3)
    field = toxicity.Field({"bad": 2.0, "worse": 0.7}, -1.5, np.array([[0.4, -0.6], [-0.2, 0.9]]))
    long = " ".join(rng.choice(["bad", "worse", "so", "on"], 700).tolist())
    texts = ["so bad. on", long, "", f"on. {long}! worse"]
    for text, (p, _) in zip(texts, field.tagger()(texts)):
        at = 0
        for part in re.split(r"[.!?]", text):
            words = part.split()
            if words:
                emit = np.array([[field.bias + field.weights.get(w, 0.0) for w in words]])
                want = toxicity._marginals(emit, np.ones(emit.shape, bool), field.trans)[0][0]
                assert np.allclose(p[at : at + len(words)], want)
            at += len(words) + 1
