"""URL filters: rules on host and path, and trust that spreads over links between hosts.

Hosts whose pages the rules mostly allow are trusted seeds, those whose pages they mostly block are distrust
seeds. Personalised PageRank runs from the trusted ones along the links and from the blocked ones against
them (who links to bad hosts is suspect). Steps go on until no host's rank changes by more than ``TOLERANCE`` of
itself and of a seed's share. What moves shrinks with each step, so their number grows with the logarithm of the number
of seeds, not with the longest chain of links; what is left out are hosts so far from any seed that less reaches them. A host is blocked if its distrust is over ``ratio`` times its trust.
Links are aggregated to weighted host edges before any join, and each step is two aggregations over those.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mossgrove.llm.common import SALTS, counted, drop, salted, store

#: The rules of the query: verdict, and host and path.
RULES = (("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/"))
DAMPING = 0.85
TOLERANCE = 1e-3
RATIO = 1.0
#: Ranks that differ by less are equal, whatever order they were added up in.
MARGIN = 1e-6
#: Absolute links, and links to another host by the page's own scheme.
LINK = r"""(?i)href\s*=\s*["']?((?:[a-z][a-z0-9+.-]*:)?//[^"'\s>]+)"""
_PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host(url: Column) -> Column:
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), _PARTS, 1), _UPPER, _LOWER)


def path(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), _PARTS, 2)


def longest_rule(rules, what: Column, where: Column) -> Column:
    """verdict and rule of the longest rule that fits a host or a parent of it and starts the path; else null."""
    out = F.lit(None).cast("struct<verdict:string,rule:string>")
    for verdict, rule in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        of, _, rest = rule.partition("/")
        fits = ((what == of) | what.endswith(f".{of}")) & where.startswith(f"/{rest}")
        out = F.when(fits, F.struct(F.lit(verdict).alias("verdict"), F.lit(rule).alias("rule"))).otherwise(out)
    return out


def edges(pages: DataFrame) -> DataFrame:
    """src, dst and n, the links from pages of one host to another host."""
    links = pages.select(host(F.col("url")).alias("src"), F.explode(F.regexp_extract_all(F.coalesce("html", F.lit("")), F.lit(LINK), F.lit(1))).alias("to"))
    to = F.when(F.col("to").startswith("//"), F.concat(F.lit("page:"), "to")).otherwise(F.col("to"))
    return links.select("src", host(to).alias("dst")).where("src <> '' AND dst <> '' AND src <> dst").groupBy("src", "dst").agg(F.count("*").alias("n"))


def spread(links: DataFrame, seeds: DataFrame, damping: float = DAMPING, tolerance: float = TOLERANCE) -> DataFrame:
    """kind, host and rank of personalised PageRank, for both kinds of walk at once.

    ``links``: kind, src, dst, n. ``seeds``: kind, host, seed, whose sum is 1 for each kind. What reaches a host
    without links goes back to the seeds. A step shrinks what is left by ``damping``, and changes of less than ``tolerance``
    of the kind's least seed count for nothing, so steps end. A popular host's links meet its rank dealt out over several
    tasks.
    """
    out = links.groupBy("kind", "src").agg(F.sum("n").alias("all"))
    flows = store(salted(links, out, ["kind", "src"], "dst").select("kind", F.col("src").alias("host"), "dst", (F.col("n") / F.col("all")).alias("part")), "flows")
    seeds = store(seeds, "seeds")
    now = seeds.select("kind", "host", F.col("seed").alias("rank"))
    least = F.lit(0.0)
    for kind, seed in seeds.groupBy("kind").agg(F.min("seed")).collect():  # a row a kind
        least = F.when(F.col("kind") == kind, F.lit(seed)).otherwise(least)
    moving = bool(flows.take(1))
    while moving:
        moved = salted(flows, now, ["kind", "host"], "dst").groupBy("kind", F.col("dst").alias("host")).agg((damping * F.sum(F.col("rank") * F.col("part"))).alias("in"))
        total = moved.groupBy("kind").agg(F.sum("in").alias("total"))
        back = seeds.join(total, "kind", "left").select("kind", "host", (F.col("seed") * (1 - F.coalesce("total", F.lit(0.0)))).alias("in"))
        before = now.select("kind", "host", F.lit(0.0).alias("in"), F.col("rank").alias("was"))
        rows = moved.unionByName(back).withColumn("was", F.lit(0.0)).unionByName(before)
        then = store(rows.groupBy("kind", "host").agg(F.sum("in").alias("rank"), F.sum("was").alias("was")), "ranks")
        moving = bool(then.where(F.abs(F.col("rank") - F.col("was")) > tolerance * F.greatest(F.col("rank"), least)).take(1))
        drop(now)
        now = then
    return now


def judge(pages: DataFrame, rules=RULES, ratio: float = RATIO, damping: float = DAMPING, tolerance: float = TOLERANCE) -> DataFrame:
    """page_id, host, path, rule and verdict of each row of ``pages`` (page_id, url, html).

    The verdict is the longest fitting rule's; else block where the host's distrust is over ``ratio`` times its
    trust, else allow. Urls and html of any length are read whole. An empty table gives no rows. A null url, or one without ``://``, has an empty host and path, no rule and is allowed. Hosts
    that no walk reaches are allowed. Null and repeated ids are judged row by row; other columns are ignored.
    """
    parts = pages.select(F.col("page_id").cast("bigint").alias("page_id"), host(F.col("url")).alias("host"), path(F.col("url")).alias("path"))
    parts = parts.withColumn("found", longest_rule(rules, F.col("host"), F.col("path")))
    parts = store(parts.select("page_id", "host", "path", "found.rule", "found.verdict"), "pages")
    mostly = parts.where("host <> ''").groupBy("host").agg(*(F.avg(F.coalesce((F.col("verdict") == v).cast("int"), F.lit(0))).alias(k) for k, v in (("trust", "allow"), ("distrust", "block"))))
    seeds = mostly.select("host", F.when(F.col("trust") > 0.5, F.lit("trust")).when(F.col("distrust") > 0.5, F.lit("distrust")).alias("kind")).where("kind IS NOT NULL")
    count = seeds.groupBy("kind").agg(F.count("*").alias("n"))
    seeds = seeds.join(count, "kind").select("kind", "host", (1 / F.col("n")).alias("seed"))
    e = edges(pages)
    both = e.select(F.lit("trust").alias("kind"), "src", "dst", "n").unionByName(e.select(F.lit("distrust").alias("kind"), F.col("dst").alias("src"), F.col("src").alias("dst"), "n"))
    ranks = spread(both, seeds, damping, tolerance)
    by = {k: F.coalesce(F.sum(F.when(F.col("kind") == k, F.col("rank"))), F.lit(0.0)) for k in ("trust", "distrust")}
    bad = ranks.groupBy(F.col("host").alias("bad")).agg(by["trust"].alias("trust"), by["distrust"].alias("distrust")).where(F.col("distrust") > ratio * F.col("trust") * (1 + MARGIN)).select("bad")
    bad = counted(bad)
    verdict = F.coalesce("verdict", F.when(F.col("bad").isNotNull(), F.lit("block")).otherwise(F.lit("allow")))
    salt = F.pmod(F.xxhash64("page_id", "path"), F.lit(SALTS)).cast("int")  # should the bad hosts be too many to broadcast
    bad = bad.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return parts.join(bad, (F.col("host") == F.col("bad")) & (salt == F.col("salt")), "left").select("page_id", "host", "path", "rule", verdict.alias("verdict"))


#: Steps that the SQL writes out: a walk of 0.85 is down to 0.85 ** 50, below a thousandth.
WRITTEN = 50


def _oracle() -> str:
    """DuckDB SQL of judge(), with WRITTEN steps, after which ranks are within TOLERANCE as well."""
    rules = sorted(RULES, key=lambda r: (-len(r[1]), r[1]))
    fits = [f"(host = '{r.partition('/')[0]}' OR host LIKE '%.{r.partition('/')[0]}') AND starts_with(path, '/{r.partition('/')[2]}')" for _, r in rules]
    case = lambda k: "CASE " + " ".join(f"WHEN {f} THEN '{r[k]}'" for f, r in zip(fits, rules)) + " END"
    split = lambda url, k: rf"regexp_extract(coalesce({url}, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', {k})"
    lower = lambda x: f"translate({x}, '{_UPPER}', '{_LOWER}')"
    link = LINK.replace("'", "''")
    steps = []
    for k in range(WRITTEN):
        steps.append(f"""
m{k} AS MATERIALIZED (SELECT r.kind, f.dst AS host, {DAMPING}e0 * sum(r.rank * f.part) AS i FROM r{k} r JOIN f ON r.kind = f.kind AND r.host = f.src GROUP BY 1, 2),
r{k + 1} AS MATERIALIZED (SELECT kind, host, sum(i) AS rank FROM (
  SELECT * FROM m{k} UNION ALL
  SELECT s.kind, s.host, s.seed * (1 - coalesce((SELECT sum(i) FROM m{k} m WHERE m.kind = s.kind), 0)) FROM s) GROUP BY 1, 2)""")
    return rf"""
WITH p AS MATERIALIZED (SELECT page_id, html, {lower(split("url", 1))} AS host, {split("url", 2)} AS path FROM pages),
q AS MATERIALIZED (SELECT page_id, host, path, {case(1)} AS rule, {case(0)} AS ruled FROM p),
o AS (SELECT host, avg(CASE WHEN ruled = 'allow' THEN 1e0 ELSE 0e0 END) AS t, avg(CASE WHEN ruled = 'block' THEN 1e0 ELSE 0e0 END) AS d FROM q WHERE host <> '' GROUP BY host),
k AS (SELECT host, CASE WHEN t > 0.5 THEN 'trust' ELSE 'distrust' END AS kind FROM o WHERE t > 0.5 OR d > 0.5),
s AS MATERIALIZED (SELECT kind, host, 1e0 / count(*) OVER (PARTITION BY kind) AS seed FROM k),
l AS (SELECT host AS src, {lower(split("u", 1))} AS dst FROM (SELECT host, CASE WHEN starts_with(u, '//') THEN 'page:' || u ELSE u END AS u
  FROM (SELECT host, unnest(regexp_extract_all(coalesce(html, ''), '{link}', 1)) AS u FROM p))),
e AS (SELECT src, dst, count(*) AS n FROM l WHERE src <> '' AND dst <> '' AND src <> dst GROUP BY 1, 2),
b AS (SELECT 'trust' AS kind, src, dst, n FROM e UNION ALL SELECT 'distrust', dst, src, n FROM e),
f AS MATERIALIZED (SELECT kind, src, dst, n::DOUBLE / sum(n) OVER (PARTITION BY kind, src) AS part FROM b),
r0 AS MATERIALIZED (SELECT kind, host, seed AS rank FROM s),{",".join(steps)},
x AS (SELECT host FROM (SELECT host, coalesce(sum(rank) FILTER (kind = 'trust'), 0) AS t, coalesce(sum(rank) FILTER (kind = 'distrust'), 0) AS d FROM r{WRITTEN} GROUP BY host) WHERE d > {RATIO} * t * (1 + {MARGIN}))
SELECT page_id, host, path, rule, coalesce(ruled, CASE WHEN host IN (SELECT host FROM x) THEN 'block' ELSE 'allow' END) AS verdict FROM q
"""


ORACLE = _oracle()
