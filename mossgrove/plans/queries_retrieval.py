"""Queries of retrieval: keyword, vector and hybrid search, clustering, models' stand-ins."""

from __future__ import annotations

from zlib import crc32

from pyspark.sql import Window
from pyspark.sql import functions as F

from mossgrove.functions import costs, models, vectors
from mossgrove.functions.paths import is_protected, trunk_boost, trunk_distance
from mossgrove.functions.text import candidate_listing, tokens
from mossgrove.model import Params
from mossgrove.operators import bm25, cluster, evaluate, hybrid, many
from mossgrove.plans.catalog import PATH, chunks, documents, query, query_vector, table
from mossgrove.sources import keyword_index
from mossgrove.sources.scratch import own, place

QUERY = "apache license version wisdom apache"
PHRASE = "apache-license the"
WORDS = r"'[\p{L}\p{N}]+'"
TOKENS = rf"regexp_extract_all(strip_accents(lower(concat_ws(' ', text, '', {PATH}))), {WORDS})"


def _bm25_sql(terms: list[list[str]]) -> str:
    """CTEs that end in bm(id, score)."""
    f = []
    for t in terms:
        if len(t) == 1:
            f.append(f"len(list_filter(w, lambda x: x = '{t[0]}'))")
        else:
            f.append(f"len(list_filter(range(1, len(w) - {len(t) - 2}), lambda i: {' AND '.join(f'w[i + {k}] = {chr(39)}{x}{chr(39)}' for k, x in enumerate(t))}))")
    idf = lambda i: f"CASE WHEN ln((n - n{i} + 0.5e0) / (n{i} + 0.5e0)) <= 0 THEN 1e-6 ELSE ln((n - n{i} + 0.5e0) / (n{i} + 0.5e0)) END"
    parts = [f"({idf(i)}) * f{i} * 2.2e0 / (f{i} + 1.2e0 * (1 - 0.75e0 + 0.75e0 * length / mean))" for i in range(len(terms))]
    return f"""d AS (SELECT doc_id AS id, {TOKENS} AS w FROM documents),
c AS (SELECT id, len(w) AS length, {", ".join(f"{x} AS f{i}" for i, x in enumerate(f))} FROM d),
st AS (SELECT count(*) AS n, avg(length) AS mean, {", ".join(f"count(*) FILTER (f{i} > 0) AS n{i}" for i in range(len(terms)))} FROM c),
bm AS (SELECT id, {" + ".join(parts)} AS score FROM c, st WHERE {" OR ".join(f"f{i} > 0" for i in range(len(terms)))})"""


_TERMS = [[w] for w in QUERY.split()]
_Q = "(SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 0)"
_DEPTH = f"len(string_split({PATH}, '/')) - 1"


def _hybrid_sql(k: int, top: str) -> str:
    return f"""WITH {_bm25_sql(_TERMS)},
v AS (SELECT doc_id AS id, list_distance(embedding::DOUBLE[], {_Q}) AS d FROM documents JOIN embeddings ON doc_id = vec_id ORDER BY d, id LIMIT {k}),
t AS (SELECT id, score FROM bm ORDER BY score DESC, id LIMIT {k}),
vs AS (SELECT id, CASE WHEN max(d) OVER () = min(d) OVER () THEN 1e0 ELSE ((1 - d) - min(1 - d) OVER ()) / (max(1 - d) OVER () - min(1 - d) OVER ()) END AS v FROM v),
ts AS (SELECT id, CASE WHEN max(score) OVER () = min(score) OVER () THEN 1e0 ELSE (score - min(score) OVER ()) / (max(score) OVER () - min(score) OVER ()) END AS t FROM t),
m AS (SELECT coalesce(vs.id, ts.id) AS id, coalesce(v, 0e0) AS v, coalesce(t, 0e0) AS t FROM vs FULL JOIN ts ON vs.id = ts.id),
s AS (SELECT m.*, {PATH} AS source, text AS content, round(0.5e0 * v + 0.3e0 * t + 0.2e0 * (1e0 / (1 + {_DEPTH})), 6) AS score FROM m JOIN documents ON id = doc_id)
{top}"""


@query(_hybrid_sql(20, "SELECT row_number() OVER (ORDER BY score DESC, v DESC, t DESC, id)::INT AS rank, id, source, score FROM s ORDER BY score DESC, v DESC, t DESC, id LIMIT 10"))
def hybrid_search(spark, d):
    return hybrid.hybrid_search(chunks(spark, d), query_vector(spark, d), QUERY, Params(top_k=10)).select("rank", "id", "source", "score")


@query(_hybrid_sql(200, "SELECT row_number() OVER (ORDER BY score DESC, v DESC, t DESC, id)::INT AS rank, id, source, round(v, 6) AS v, round(t, 6) AS t, score FROM s ORDER BY score DESC, v DESC, t DESC, id LIMIT 50"))
def hybrid_search_wide(spark, d):
    p = Params(top_k=50, candidates=200)
    return hybrid.hybrid_search(chunks(spark, d), query_vector(spark, d), QUERY, p).select("rank", "id", "source", F.round("v", 6).alias("v"), F.round("t", 6).alias("t"), "score")


@query(f"WITH {_bm25_sql(_TERMS)} SELECT id, round(score, 6) AS score FROM bm ORDER BY bm.score DESC, id LIMIT 20")
def bm25_topk(spark, d):
    return hybrid.text_topk(documents(spark, d), QUERY, 20).select("id", F.round("score", 6).alias("score"))


@query(f"WITH {_bm25_sql([['apache', 'license'], ['the']])} SELECT id, round(score, 6) AS score FROM bm ORDER BY bm.score DESC, id LIMIT 20")
def bm25_phrase(spark, d):
    return hybrid.text_topk(documents(spark, d), PHRASE, 20).select("id", F.round("score", 6).alias("score"))


def _index(spark, d):
    """The keyword index of the documents, built by the first query that asks for it."""
    path = f"{own(spark)}/keywords-{crc32(d.encode())}"
    if not keyword_index.version(spark, path):
        keyword_index.update(spark, path, documents(spark, d).withColumn("id", F.col("id").cast("string")))
    return path


@query(f"WITH {_bm25_sql([['apache'], ['license']])} SELECT id::VARCHAR AS id, round(score, 6) AS score FROM bm")
def bm25_stored_index(spark, d):
    return keyword_index.search(spark, _index(spark, d), "apache license").select("id", F.round("score", 6).alias("score"))


@query(f"WITH {_bm25_sql([['apache', 'license'], ['the'], ['in', 'the', 'in']])} SELECT id::VARCHAR AS id, round(score, 6) AS score FROM bm")
def bm25_phrase_stored(spark, d):
    """Phrases, diacritics and repeats from the index's positions."""
    return keyword_index.search(spark, _index(spark, d), "Äpache-licënse THE in-the-in").select("id", F.round("score", 6).alias("score"))


_AFTER = f"(SELECT doc_id, lang, source, CASE WHEN doc_id % 100 = 7 THEN concat('Apache license, new: ', text) ELSE text END AS text FROM documents WHERE doc_id % 100 <> 9)"


@query(f"WITH {_bm25_sql([['apache', 'license'], ['new']]).replace('FROM documents', f'FROM {_AFTER}')} SELECT id::VARCHAR AS id, round(score, 6) AS score FROM bm")
def bm25_index_upkeep(spark, d):
    """An index of which one source in a hundred changed, one left, and one left and came back, over three updates and a merge."""
    rows = documents(spark, d).withColumn("id", F.col("id").cast("string"))
    path = place(spark, "upkeep")
    keyword_index.update(spark, path, rows)
    changed = rows.where("id % 100 = 7").withColumn("content", F.concat(F.lit("Apache license, new: "), "content"))
    keyword_index.update(spark, path, changed, rows.where("id % 100 IN (8, 9)"))
    keyword_index.update(spark, path, rows.where("id % 100 = 8"))
    keyword_index.merge(spark, path, 2)
    return keyword_index.search(spark, path, "apache-license new").select("id", F.round("score", 6).alias("score"))


@query(f"SELECT doc_id AS id, round(list_distance(embedding::DOUBLE[], {_Q}), 6) AS d FROM documents JOIN embeddings ON doc_id = vec_id ORDER BY list_distance(embedding::DOUBLE[], {_Q}), id LIMIT 20")
def vector_topk_l2(spark, d):
    return hybrid.vector_topk(chunks(spark, d), query_vector(spark, d), 20).select("id", F.round("d", 6).alias("d"))


@query(f"SELECT doc_id AS id, round(1 - list_cosine_similarity(embedding::DOUBLE[], {_Q}), 6) + 0e0 AS d FROM documents JOIN embeddings ON doc_id = vec_id WHERE doc_id <> 0 ORDER BY 1 - list_cosine_similarity(embedding::DOUBLE[], {_Q}), id LIMIT 20")
def vector_topk_cosine(spark, d):
    return hybrid.vector_topk(chunks(spark, d).where("id <> 0"), query_vector(spark, d), 20, "cosine").select("id", F.round("d", 6).alias("d"))


@query(f"SELECT doc_id AS id, {PATH} AS source, ({_DEPTH})::INT AS distance, round(1e0 / (1 + {_DEPTH}), 6) AS boost FROM documents")
def trunk_boost_rank(spark, d):
    rows = documents(spark, d).select("id", "source", trunk_distance(F.col("source")).alias("distance"))
    return rows.withColumn("boost", F.round(trunk_boost(F.col("distance")), 6))


@query(f"SELECT term, count(DISTINCT id) AS df, count(*) AS cf FROM (SELECT doc_id AS id, unnest({TOKENS}) AS term FROM documents) GROUP BY term HAVING count(DISTINCT id) >= 3")
def postings_stats(spark, d):
    return bm25.term_stats(documents(spark, d)).where("df >= 3")


_ROUTE = f"""h AS (SELECT row_number() OVER (ORDER BY score DESC, v DESC, t DESC, id) AS rank, * FROM s ORDER BY score DESC, v DESC, t DESC, id LIMIT 10),
f AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY rank) AS k FROM h)
SELECT rank::INT AS rank, id, source, score FROM f WHERE k = 1 AND NOT regexp_matches(source, '^(sources|events|journal|days|episodes|notes|mirrors|inbox)/')"""


@query(_hybrid_sql(20, "SELECT 1").removesuffix("SELECT 1").rstrip() + ",\n" + _ROUTE)
def route_candidates(spark, d):
    rows = chunks(spark, d)
    return hybrid.route_candidates(rows, query_vector(spark, d), QUERY, rows.select("source", "content")).select("rank", "id", "source", "score")


@query(_hybrid_sql(20, "SELECT id, source, score FROM (SELECT * FROM s ORDER BY score DESC, v DESC, t DESC, id LIMIT 5) WHERE score >= 0.4e0 AND string_split(source, '/')[-1] NOT IN ('MEMORY.md', 'identity.md', 'manifest.md', 'mind.md') ORDER BY score DESC, v DESC, t DESC, id LIMIT 1"))
def existing_concept(spark, d):
    return hybrid.existing_concept(chunks(spark, d), query_vector(spark, d), QUERY, Params(concept_floor=0.4)).select("id", "source", "score")


def _queries(spark, d):
    """An item of the benchmark with the vector of its id is a query."""
    e = table(spark, d, "embeddings").selectExpr("vec_id AS item_id", "embedding AS vector")
    return table(spark, d, "benchmark").join(e, "item_id", "left").selectExpr("item_id AS qid", "text", "vector")


_MANY = rf"""WITH q AS (SELECT item_id AS qid, text, embedding::DOUBLE[] AS vector FROM benchmark LEFT JOIN embeddings ON vec_id = item_id),
qs AS (SELECT qid, string_split_regex(trim(regexp_replace(replace(text, '"', ' '), '\s+', ' ', 'g')), ' ') AS ws FROM q),
qw AS (SELECT qid, pos, regexp_extract_all(strip_accents(lower(word)), {WORDS}) AS p FROM (SELECT qid, unnest(ws) AS word, unnest(range(len(ws))) AS pos FROM qs)),
ph AS (SELECT DISTINCT p FROM qw WHERE len(p) > 0),
d AS (SELECT doc_id AS id, {TOKENS} AS w FROM documents),
st AS (SELECT count(*) AS n, avg(len(w)) AS mean FROM d),
tk AS (SELECT id, len(w) AS length, unnest(w) AS term, unnest(range(1, len(w) + 1)) AS i FROM d),
oc AS (SELECT p, id, length, count(*) AS tf FROM (
  SELECT p, id, length FROM tk JOIN (SELECT * FROM ph WHERE len(p) = 1) ON term = p[1]
  UNION ALL SELECT p, tk.id, length FROM tk JOIN (SELECT * FROM ph WHERE len(p) > 1) ON term = p[1] JOIN d ON d.id = tk.id WHERE w[i : i + len(p) - 1] = p) GROUP BY ALL),
df AS (SELECT p, count(*) AS df, any_value((SELECT n FROM st)) AS n FROM oc GROUP BY p),
idf AS (SELECT p, CASE WHEN ln((n - df + 0.5e0) / (df + 0.5e0)) <= 0 THEN 1e-6 ELSE ln((n - df + 0.5e0) / (df + 0.5e0)) END AS idf FROM df),
bm AS (SELECT qid, id, list_sum(list(idf * tf * 2.2e0 / (tf + 1.2e0 * (1 - 0.75e0 + 0.75e0 * length / mean)) ORDER BY pos)) AS score FROM qw JOIN oc USING (p) JOIN idf USING (p), st GROUP BY qid, id),
t AS (SELECT * FROM bm QUALIFY row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) <= 20),
v AS (SELECT qid, doc_id AS id, list_distance(embedding::DOUBLE[], vector) AS d FROM documents JOIN embeddings ON doc_id = vec_id, q WHERE vector IS NOT NULL QUALIFY row_number() OVER (PARTITION BY qid ORDER BY d, id) <= 20),
vs AS (SELECT qid, id, CASE WHEN max(d) OVER x = min(d) OVER x THEN 1e0 ELSE ((1 - d) - min(1 - d) OVER x) / (max(1 - d) OVER x - min(1 - d) OVER x) END AS v FROM v WINDOW x AS (PARTITION BY qid)),
ts AS (SELECT qid, id, CASE WHEN max(score) OVER x = min(score) OVER x THEN 1e0 ELSE (score - min(score) OVER x) / (max(score) OVER x - min(score) OVER x) END AS t FROM t WINDOW x AS (PARTITION BY qid)),
m AS (SELECT coalesce(vs.qid, ts.qid) AS qid, coalesce(vs.id, ts.id) AS id, coalesce(v, 0e0) AS v, coalesce(t, 0e0) AS t FROM vs FULL JOIN ts ON vs.qid = ts.qid AND vs.id = ts.id),
s AS (SELECT m.*, {PATH} AS source, round(0.5e0 * v + 0.3e0 * t + 0.2e0 * (1e0 / (1 + {_DEPTH})), 6) AS score FROM m JOIN documents ON id = doc_id),
h AS (SELECT qid, row_number() OVER (PARTITION BY qid ORDER BY score DESC, v DESC, t DESC, id)::INT AS rank, id, source, score FROM s)"""


@query(f"{_MANY} SELECT * FROM h WHERE rank <= 10")
def hybrid_search_many(spark, d):
    return many.hybrid_search(documents(spark, d), _queries(spark, d), Params(top_k=10), _vectors(spark, d)).select("qid", "rank", "id", "source", "score")


@query(f"""{_MANY}, e AS (SELECT item_id AS qid, list({PATH} ORDER BY {PATH}) AS expected FROM benchmark b JOIN documents ON contains(documents.text, b.text) GROUP BY item_id),
g AS (SELECT qid, list(source ORDER BY rank) AS sources FROM h WHERE rank <= 5 GROUP BY qid),
c AS (SELECT qid, coalesce(expected, []) AS expected, coalesce(sources, []) AS sources FROM q LEFT JOIN e USING (qid) LEFT JOIN g USING (qid)),
r AS (SELECT *, list_filter(expected, lambda x: list_contains(sources, x)) AS hits FROM c)
SELECT qid, len(expected)::INT AS expected, len(hits)::INT AS hits, round(CASE WHEN len(hits) > 0 THEN 1e0 / list_position(sources, hits[1]) ELSE 0 END, 6) AS rr, len(hits) = len(expected) AS passed FROM r""".replace("documents ON contains(documents.text", "(SELECT *, text AS body FROM documents) ON contains(body"))
def eval_search_run(spark, d):
    """Hybrid search run over a case for each item: the documents that hold its text whole are expected among the first five."""
    asked = _queries(spark, d)
    items = asked.agg(F.collect_list(F.struct("qid", "text"))).scalar()  # the cases, which are a given set
    held = documents(spark, d).withColumn("items", items).select("source", F.explode(F.filter("items", lambda x: F.contains(F.col("content"), x["text"]))["qid"]).alias("qid"))
    expected = held.groupBy("qid").agg(F.sort_array(F.collect_list("source")).alias("expected"))
    none = F.array().cast("array<string>")
    cases = asked.join(expected, "qid", "left").select("qid", "text", "vector", F.lit(5).alias("k"), F.coalesce("expected", none).alias("expected"), none.alias("unwanted"))
    got = evaluate.run_search(documents(spark, d), cases, vectors=_vectors(spark, d))
    return got.select("qid", F.size("expected").alias("expected"), F.size("hits").alias("hits"), F.round("rr", 6).alias("rr"), "passed")


_LIST = f"concat('[', rank, '] ', source, ' (trunk_distance: ', {_DEPTH.replace(PATH, 'source')}, ')', chr(10), left(content, 2000))"


@query(_hybrid_sql(20, f"SELECT rank::INT AS rank, {_LIST} AS listing FROM (SELECT row_number() OVER (ORDER BY score DESC, v DESC, t DESC, id) AS rank, * FROM s) WHERE rank <= 5"))
def candidate_listings(spark, d):
    rows = hybrid.hybrid_search(chunks(spark, d), query_vector(spark, d), QUERY)
    return rows.select("rank", candidate_listing(F.col("rank"), F.col("source"), trunk_distance(F.col("source")), F.col("content")).alias("listing"))


_OVER = f"len(list_intersect(list_distinct(string_split('{QUERY}', ' ')), regexp_extract_all(lower(content), {WORDS})))::DOUBLE / 4"


@query(_hybrid_sql(20, f"SELECT id, round({_OVER}, 6) AS score FROM s ORDER BY round({_OVER}, 6) DESC, v DESC, t DESC, id LIMIT 5"))
def rerank_stub(spark, d):
    return hybrid.hybrid_search(chunks(spark, d), query_vector(spark, d), QUERY, rerank=models.rerank_overlap).select("id", "score")


_PAIRS = "SELECT a.vec_id AS i, b.vec_id AS j, list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS s FROM embeddings a JOIN embeddings b ON a.vec_id < b.vec_id WHERE list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) >= 0.3e0"


def _vectors(spark, d):
    return table(spark, d, "embeddings").selectExpr("vec_id AS id", "embedding")


@query(f"SELECT i, j, round(s, 6) AS s FROM ({_PAIRS})")
def similar_pairs(spark, d):
    return cluster.similar_pairs(_vectors(spark, d), 0.3).select("i", "j", F.round("s", 6).alias("s"))


_ROUNDS = 14


def _greedy_sql(end: str) -> str:
    steps = [f"p AS MATERIALIZED ({_PAIRS}), o0 AS MATERIALIZED (SELECT vec_id AS id FROM embeddings)"]
    for k in range(_ROUNDS):
        steps.append(f"l{k} AS MATERIALIZED (SELECT id FROM o{k} WHERE id NOT IN (SELECT j FROM p WHERE i IN (SELECT id FROM o{k}) AND j IN (SELECT id FROM o{k})))")
        steps.append(f"o{k + 1} AS MATERIALIZED (SELECT id FROM o{k} WHERE id NOT IN (SELECT id FROM l{k}) AND id NOT IN (SELECT j FROM p WHERE i IN (SELECT id FROM l{k})))")
    lead = " UNION ALL ".join(f"SELECT id FROM l{k}" for k in range(_ROUNDS))
    steps.append(f"lead AS MATERIALIZED ({lead}), g AS (SELECT id, id AS leader FROM lead UNION ALL SELECT j, min(i) FROM p WHERE i IN (SELECT id FROM lead) AND j NOT IN (SELECT id FROM lead) GROUP BY j)")
    return "WITH " + ", ".join(steps) + end


@query(_greedy_sql(" SELECT id, leader FROM g"))
def greedy_cluster(spark, d):
    return cluster.leaders(_vectors(spark, d), 0.3)


_NAMES = "SELECT lang AS leader, doc_id AS pos, concat(source, '-', doc_id, '.md') AS name, text AS content FROM documents"


@query(
    f"""WITH m AS ({_NAMES}),
h AS (SELECT *, concat('## Source: ', name, chr(10), chr(10)) AS head FROM m),
b AS (SELECT *, 40000 - coalesce(sum(length(head) + length(content)) OVER (PARTITION BY leader ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS room FROM h)
SELECT leader, count(*)::INT AS n_files, string_agg(concat(head, left(content, room::INT)), concat(chr(10), chr(10), '---', chr(10), chr(10)) ORDER BY pos) AS content FROM b WHERE room > 0 GROUP BY leader"""
)
def cluster_content(spark, d):
    rows = table(spark, d, "documents").selectExpr("lang AS leader", "doc_id AS pos", "concat(source, '-', doc_id, '.md') AS name", "text AS content")
    return cluster.cluster_content(rows, Params().cluster_chars)


@query(f"SELECT doc_id AS id, CASE WHEN doc_id % 11 = 0 THEN 'skipped' WHEN doc_id % 2 = 0 AND string_split({PATH.replace('doc_id', 'd.doc_id')}, '/')[-1] <> 'MEMORY.md' AND doc_id % 7 <> 0 THEN 'revised' ELSE 'created' END AS action FROM documents d")
def concept_actions(spark, d):
    rows = documents(spark, d).selectExpr("id", "CASE WHEN id % 11 = 0 THEN '  ' ELSE content END AS content", "CASE WHEN id % 2 = 0 THEN CASE WHEN id % 7 = 0 THEN concat(id, '/MEMORY.md') ELSE source END END AS match")
    return cluster.concept_actions(rows.withColumn("protected", is_protected(F.col("match")))).select("id", "action")


@query(f"""WITH w AS (SELECT doc_id AS id, unnest(regexp_extract_all(lower(text), {WORDS})) AS word FROM documents),
c AS (SELECT id, (('0x' || substr(md5(word), 1, 8))::BIGINT % 64)::INT AS cell, count(*) AS n FROM w GROUP BY ALL)
SELECT id, cell, round(n / sqrt(sum(n * n) OVER (PARTITION BY id)), 6) AS value FROM c""")
def embed_stub(spark, d):
    """The stand-in embedding of each whole text, a row for each cell that isn't zero."""
    rows = table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text")
    cells = rows.select("id", F.posexplode(models.embed_words(F.col("text"), 64)).alias("cell", "value"))
    return cells.where("value <> 0").select("id", "cell", F.round("value", 6).alias("value"))


@query("SELECT doc_id AS id, 'KEEP' AS verdict, text AS revised FROM documents")
def judge_stub(spark, d):
    rows = table(spark, d, "documents")
    return rows.select(F.col("doc_id").alias("id"), models.judge_keep(F.col("text"), F.col("text"))["verdict"].alias("verdict"), models.executor_echo(F.col("text"), F.lit(""), F.col("text")).alias("revised"))


_RATE = lambda k: f"CASE turn % 4 WHEN 0 THEN {(0.8, 4.0, 0.08)[k]}e0 WHEN 1 THEN {(15.0, 75.0, 1.5)[k]}e0 ELSE {(3.0, 15.0, 0.3)[k]}e0 END"


@query(f"SELECT conv_id, turn, round(10 * (length(text) - length(text) // 3) / 1e6 * {_RATE(0)} + 10 * (length(text) // 3) / 1e6 * {_RATE(2)} + 10 * (length(text) // 2) / 1e6 * {_RATE(1)}, 6) AS cost FROM conversations")
def llm_cost(spark, d):
    n = F.length("text")
    model = F.when(F.col("turn") % 4 == 0, F.lit("small")).when(F.col("turn") % 4 == 1, F.lit("large")).when(F.col("turn") % 4 == 2, F.lit("mid")).otherwise(F.lit("unheard-of"))
    return table(spark, d, "conversations").select("conv_id", "turn", costs.cost(model, 10 * n, 10 * F.floor(n / 3), 10 * F.floor(n / 2)).alias("cost"))


__all__ = ["Window"]
