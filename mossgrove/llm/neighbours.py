"""Approximate nearest neighbours by cosine: an NN-descent graph and greedy search over it.

The graph starts poor, from blocks: each of ``TREES`` times the vectors are ordered by the signs of random projections and
then by one more, and every ``LEAF`` of them in that order are compared with each other. NN-descent does the rest: each
vector gathers the vectors it is linked with, either way, compares those pairs of which one link is new and hands each the
better neighbours it found; a bounded number of links the other way round, chosen by hash, keeps popular vectors
from gathering unbounded groups. A join takes one vector in ``SLICES`` as centres, which bounds what is in flight, and
joins go on until the share of new links falls below ``DELTA``, at any size. A query's search is greedy: of the best found so
far, those not yet visited give their links, until none of the best is unvisited. What is found is scored again from the
original vectors in double precision.

Equal vectors are one node of the graph, with the least ids that any query could need.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mossgrove.llm.common import drop, prepare, salted, store

NEAREST = 5
LINKS, BACK, TREES, LEAF, HANDED, SLICES, DELTA = 40, 20, 4, 128, 5, 2, 0.04
BEAM, WIDE, ENTRIES = 96, 24, 32
SEED = 11
#: Lists of neighbours; age is how many joins ago a link was found. Links younger than SLICES are new to some centres.
_LISTS = "id bigint, ids array<bigint>, sims array<float>, ages array<int>"


def groups(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[dict[str, pa.Array]]:
    """Columns of runs of rows, sorted by ``key``, in which no key's rows are parted."""
    kept: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        k = batch.column(key).to_numpy(zero_copy_only=False)
        cut = int(np.searchsorted(k, k[-1], side="left"))  # where the last key, which may go on, begins
        if cut or (kept and kept[0].column(key)[0].as_py() != k[0]):
            yield _columns([*kept, batch.slice(0, cut)])
            kept = []
        kept.append(batch.slice(cut))
    if kept:
        yield _columns(kept)


def _columns(batches: list[pa.RecordBatch]) -> dict[str, pa.Array]:
    table = pa.Table.from_batches(batches).combine_chunks()
    return {k: (c.chunk(0) if c.num_chunks else pa.array([], c.type)) for k, c in zip(table.column_names, table.columns)}


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Row of each element, and the elements, of a list column."""
    sizes = np.diff(column.offsets.to_numpy())
    return np.repeat(np.arange(len(sizes)), sizes), column.flatten().to_numpy(zero_copy_only=False)


def _matrix(column: pa.Array, kind: str = "f2") -> np.ndarray:
    n = len(column)
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(n, -1).astype("f4") if n else np.zeros((0, 1), "f4")


def _decoded(column: pa.Array) -> np.ndarray:
    x = _matrix(column, "i1")
    return x / np.linalg.norm(x, axis=1, keepdims=True) if len(x) else x


def _lists(counts: np.ndarray, values: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(counts)), pa.int32()), pa.array(values, kind))


def valid(rows: DataFrame, id_: str, vector: str) -> DataFrame:
    """id and v of vectors that take part: not null or zero and of finite components. Shorter ones are filled up with zeros."""
    v = F.col(vector)
    rows = rows.select(F.col(id_).cast("bigint").alias("id"), v.cast("array<double>").alias("v")).where(F.col("id").isNotNull() & v.isNotNull() & (F.size(v) > 0))
    good = F.forall("v", lambda x: x.isNotNull() & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    rows = rows.where(good)
    sizes = rows.agg(F.min(F.size("v")), F.max(F.size("v"))).first()
    if sizes[0] == sizes[1]:
        return rows
    return rows.withColumn("v", F.concat("v", F.array_repeat(F.lit(0.0), F.lit(sizes[1]) - F.size("v"))))


def _units(x: np.ndarray) -> np.ndarray:
    x = x / np.maximum(np.abs(x).max(1, keepdims=True), 1e-300) if len(x) else x
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def nodes(rows: DataFrame, most: int) -> DataFrame:
    """A row for each distinct vector: id (its least), same (its ``most`` least ids), v, unit (half-precision bytes) and code (8 bits a component)."""
    first = rows.withColumn("k", F.row_number().over(Window.partitionBy("v").orderBy("id"))).where(F.col("k") <= most)
    one = first.groupBy("v").agg(F.sort_array(F.collect_list("id")).alias("same")).select(F.element_at("same", 1).alias("id"), "same", "v")

    def unit(batches):
        for b in batches:
            flat = b.column("v").flatten().to_numpy(zero_copy_only=False)
            x = _units(flat.reshape(b.num_rows, -1) if b.num_rows else np.zeros((0, 1)))
            codes = np.rint(127 * x / np.abs(x).max(1, keepdims=True)).astype("i1") if len(x) else x.astype("i1")
            yield pa.RecordBatch.from_arrays([*b.columns, *(pa.array([r.tobytes() for r in y], pa.binary()) for y in (x.astype("f2"), codes))], names=[*b.schema.names, "unit", "code"])

    return one.mapInArrow(unit, "id bigint, same array<bigint>, v array<double>, unit binary, code binary")


def _best(lists: DataFrame, links: int) -> DataFrame:
    """Of each id's lists the ``links`` best neighbours; one that is named twice keeps its greater age."""

    def run(batches):
        for c in groups(batches, "id"):
            row, ids = _flat(c["ids"])
            _, sims = _flat(c["sims"])
            _, ages = _flat(c["ages"])
            own = c["id"].to_numpy(zero_copy_only=False)[row]
            o = np.lexsort((-ages, ids, own))
            once = np.ones(len(o), bool)
            once[1:] = (own[o][1:] != own[o][:-1]) | (ids[o][1:] != ids[o][:-1])
            o = o[once & (own[o] != ids[o])]
            o = o[np.lexsort((ids[o], -sims[o], own[o]))]
            begins = np.flatnonzero(np.append(True, own[o][1:] != own[o][:-1])) if len(o) else np.zeros(0, "i8")
            place = np.arange(len(o)) - np.repeat(begins, np.diff(np.append(begins, len(o))))
            o = o[place < links]
            who, n = np.unique(own[o], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(who, pa.int64()), _lists(n, ids[o], pa.int64()), _lists(n, sims[o], pa.float32()), _lists(n, ages[o], pa.int32())], names=["id", "ids", "sims", "ages"])

    return lists.repartition("id").sortWithinPartitions("id").mapInArrow(run, _LISTS)


def _blocks(units: DataFrame, count: int, width: int, links: int, trees: int, leaf: int) -> DataFrame:
    """Lists of neighbours within blocks of vectors that random projections put next to each other."""
    depth = max(0, int(np.ceil(np.log2(max(1, count / leaf)))))
    planes = np.random.default_rng(SEED).standard_normal((trees, depth + 1, width)).astype("f4")

    def keys(batches):
        for b in batches:
            x = _decoded(b.column("code"))
            for t in range(trees):
                y = x @ planes[t].T if len(x) else np.zeros((0, depth + 1), "f4")
                bits = (y[:, :depth] > 0) @ (1 << np.arange(depth, dtype="i8")) if depth else np.zeros(len(x), "i8")
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), t, "i4")), pa.array(bits.astype("i8")), pa.array(y[:, -1].astype("f4")), b.column("id"), b.column("code")], names=["tree", "bits", "along", "id", "code"])

    order = ["tree", "bits", "along", "id"]
    ordered = units.select("id", "code").mapInArrow(keys, "tree int, bits bigint, along float, id bigint, code binary").repartitionByRange(*order).sortWithinPartitions(*order)

    def compare(ids: np.ndarray, x: np.ndarray) -> pa.RecordBatch:
        s = x @ x.T
        np.fill_diagonal(s, -9)
        k = min(links, len(ids) - 1)
        top = np.argpartition(-s, k - 1, axis=1)[:, :k] if k else np.zeros((len(ids), 0), "i8")
        n = np.full(len(ids), k)
        return pa.RecordBatch.from_arrays([pa.array(ids), _lists(n, ids[top].ravel(), pa.int64()), _lists(n, np.take_along_axis(s, top, 1).ravel(), pa.float32()), _lists(n, np.zeros(n.sum(), "i4"), pa.int32())], names=["id", "ids", "sims", "ages"])

    def run(batches):
        ids, x = np.zeros(0, "i8"), None
        for b in batches:
            ids = np.concatenate([ids, b.column("id").to_numpy()])
            x = _decoded(b.column("code")) if x is None or not len(x) else np.concatenate([x, _decoded(b.column("code"))])
            while len(ids) >= 2 * leaf:
                yield compare(ids[:leaf], x[:leaf])
                ids, x = ids[leaf:], x[leaf:]
        if len(ids):
            yield compare(ids, x)

    return ordered.mapInArrow(run, _LISTS)


def _some(rows: DataFrame, key: str, most: int, *by: Column | str) -> DataFrame:
    """At most ``most`` rows of each key, those least by ``by``; limited before the shuffle as well as after."""
    return rows.withColumn("_k", F.row_number().over(Window.partitionBy(key).orderBy(*by))).where(F.col("_k") <= most).drop("_k")


def _around(graph: DataFrame, back: int, turn: int, slices: int = 1) -> DataFrame:
    """key, member, fresh: each node's neighbours, and at most ``back`` of the nodes that have it as one.

    Nodes are those whose hash falls to this turn's slice; fresh links are those no turn of that slice has seen.
    """
    mine = F.pmod(F.xxhash64("key"), F.lit(slices)) == turn % slices
    pair = F.explode(F.arrays_zip("ids", F.transform("ages", lambda a: a < slices).alias("fresh")))
    every = graph.select(F.col("id").alias("key"), pair.alias("x")).select("key", F.col("x.ids").alias("member"), F.col("x.fresh").alias("fresh"))
    behind = every.select(F.col("member").alias("key"), F.col("key").alias("member"), "fresh").where(mine)
    return every.where(mine).unionByName(_some(behind, "key", back, F.desc("fresh"), F.xxhash64("key", "member", F.lit(turn))))


def _descend(graph: DataFrame, units: DataFrame, links: int, back: int, handed: int, slices: int, turn: int) -> DataFrame:
    """One join of neighbours of neighbours: the lists that the vectors linked with each centre hand each other."""
    floor = graph.select(F.col("id").alias("member"), F.when(F.size("sims") >= links, F.array_min("sims")).otherwise(F.lit(-9.0).cast("float")).alias("floor"))
    known = units.select(F.col("id").alias("member"), "code").join(floor, "member")
    met = _around(graph, back, turn, slices).join(known, "member").select("key", "member", "fresh", "floor", "code")
    wide = links + back

    def run(batches):
        for c in groups(batches, "key"):
            key, member = (c[k].to_numpy(zero_copy_only=False) for k in ("key", "member"))
            fresh, floors = (c[k].to_numpy(zero_copy_only=False) for k in ("fresh", "floor"))
            begins = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
            sizes = np.diff(np.append(begins, len(key)))
            group = np.repeat(np.arange(len(begins)), sizes)
            place = np.arange(len(key)) - begins[group]
            x = _decoded(c["code"])
            for lo in range(0, len(begins), 256):
                at = slice(begins[lo], begins[lo + 256] if lo + 256 < len(begins) else len(key))
                g, p, n = group[at] - lo, place[at], min(256, len(begins) - lo)
                cube = np.zeros((n, wide, x.shape[1]), "f4")
                who, new, low, live = np.zeros((n, wide), "i8"), np.zeros((n, wide), bool), np.full((n, wide), 9.0, "f4"), np.zeros((n, wide), bool)
                cube[g, p], who[g, p], new[g, p], low[g, p], live[g, p] = x[at], member[at], fresh[at], floors[at], True
                s = np.matmul(cube, cube.transpose(0, 2, 1))
                s[~(new[:, :, None] | new[:, None, :]) | ~live[:, None, :] | (who[:, :, None] == who[:, None, :]) | (s <= low[:, :, None])] = -9
                top = np.argpartition(-s, handed - 1, axis=2)[:, :, :handed]
                sims = np.take_along_axis(s, top, 2)
                ids = np.take_along_axis(np.broadcast_to(who[:, None, :], s.shape), top, 2)
                good = sims > -9
                n = good.sum(2)
                rows = n > 0
                yield pa.RecordBatch.from_arrays([pa.array(who[rows]), _lists(n[rows], ids[good], pa.int64()), _lists(n[rows], sims[good], pa.float32()), _lists(n[rows], np.zeros(good.sum(), "i4"), pa.int32())], names=["id", "ids", "sims", "ages"])

    found = met.repartition("key").sortWithinPartitions("key").mapInArrow(run, _LISTS)
    older = F.transform("ages", lambda a: F.least(a + 1, F.lit(slices)))
    return _best(graph.select("id", "ids", "sims", older.alias("ages")).unionByName(found), links)


def build(units: DataFrame, links: int = LINKS, back: int = BACK, trees: int = TREES, leaf: int = LEAF, handed: int = HANDED, slices: int = SLICES, delta: float = DELTA) -> DataFrame:
    """The neighbour graph of ``units`` (id, code): a row of _LISTS for each id that has a neighbour.

    Joins end when of all links those found in the last ``slices`` turns are a share of ``delta`` or less. Each
    turn only betters lists, so the share falls to nothing.
    """
    count = units.count()
    one = units.select("code").take(1)
    graph = store(_best(_blocks(units, count, len(one[0]["code"]) if one else 1, links, trees, leaf), links), "graph")
    turn, shares = 0, [1.0]
    while sum(shares[-slices:]) > delta:
        then = store(_descend(graph, units, links, back, handed, slices, turn), "graph")
        drop(graph)
        graph, turn = then, turn + 1
        new, all_ = graph.agg(F.sum(F.size(F.filter("ages", lambda a: a == 0))), F.sum(F.size("ages"))).first()
        shares = [*([1.0] * slices if turn == 1 else shares), new / all_ if all_ else 0.0][-slices:]
    return graph


def search(graph: DataFrame, units: DataFrame, queries: DataFrame, beam: int = BEAM, wide: int = WIDE, entries: int = ENTRIES, back: int = BACK) -> DataFrame:
    """query and ids, the nodes found nearest to each row of ``queries`` (query, unit, node or null), best first.

    ``entries`` nodes, the least by a hash, are where searches start, beside a query's own node if it has one. In a
    round a query is one row, and what it asks for is gathered by query before it meets that row. Rounds end
    when no query has an unvisited node among its ``beam`` best; a node is visited once, so they do end.
    """
    links = store(_around(graph, 2 * back, 0).groupBy("key").agg(F.collect_set("member").alias("to")).withColumnRenamed("key", "node"), "links")
    start = units.orderBy(F.xxhash64("id"), "id").limit(entries).collect()  # bounded: `entries` vectors
    start_ids = np.array([r["id"] for r in start], "i8")
    start_units = np.frombuffer(b"".join(r["unit"] for r in start), "f2").reshape(len(start), -1).astype("f4") if start else np.zeros((0, 1), "f4")
    schema = "query bigint, unit binary, ids array<bigint>, sims array<float>, open array<boolean>, seen array<bigint>"
    names = ["query", "unit", "ids", "sims", "open", "seen"]

    def begin(batches):
        for b in batches:
            x = _matrix(b.column("unit"))
            s = x @ start_units.T if len(x) and len(start_ids) else np.zeros((len(x), 0), "f4")
            out = {k: [] for k in names[2:]}
            for row, node in zip(s, b.column("node").to_pylist()):
                o = np.argsort(-row, kind="stable")[: wide // 2]
                ids, sims = start_ids[o], row[o]
                if node is not None:
                    ids, sims = np.append(node, ids[ids != node]), np.append(np.float32(2), sims[ids != node])
                out["ids"].append(ids.tolist())
                out["sims"].append(sims.tolist())
                out["open"].append([True] * len(ids))
                out["seen"].append(ids.tolist())
            yield pa.RecordBatch.from_arrays([b.column("query"), b.column("unit"), *(pa.array(out[k], pa.list_(t)) for k, t in zip(names[2:], (pa.int64(), pa.float32(), pa.bool_(), pa.int64())))], names=names)

    def step(batches):
        for c in groups(batches, "query"):
            query = c["query"].to_numpy()
            begins = np.append(np.flatnonzero(np.append(True, query[1:] != query[:-1])), len(query))
            known = c["found"].to_numpy(zero_copy_only=False)  # nan in a query's own row, which is its first
            has = np.flatnonzero(c["found"].is_valid().to_numpy(zero_copy_only=False))
            some = _matrix(c["near"].take(pa.array(has)))
            x = np.zeros((len(known), some.shape[1]), "f4")
            x[has] = some
            out = {k: [] for k in names}
            for s, e in zip(begins[:-1], begins[1:]):
                q = np.frombuffer(c["unit"][s].as_py(), "f2").astype("f4")
                ids, sims, open_, seen = (np.array(c[k][s].as_py()) for k in names[2:])
                ids, seen, own = ids.astype("i8"), seen.astype("i8"), known[s + 1 : e].astype("i8")
                open_ = open_.astype(bool)
                open_[np.flatnonzero(open_)[:wide]] = False
                ids = np.concatenate([ids, own])
                sims = np.concatenate([sims.astype("f4"), x[s + 1 : e] @ q if len(own) else np.zeros(0, "f4")])
                open_ = np.concatenate([open_, np.ones(len(own), bool)])
                o = np.lexsort((ids, -sims))[:beam]
                for k, v in zip(names, (int(query[s]), c["unit"][s].as_py(), ids[o].tolist(), sims[o].tolist(), open_[o].tolist(), np.concatenate([seen, own]).tolist())):
                    out[k].append(v)
            yield pa.RecordBatch.from_arrays([pa.array(out["query"], pa.int64()), pa.array(out["unit"], pa.binary()), *(pa.array(out[k], pa.list_(t)) for k, t in zip(names[2:], (pa.int64(), pa.float32(), pa.bool_(), pa.int64())))], names=names)

    state = store(queries.select("query", "unit", "node").mapInArrow(begin, schema), "beam")
    while True:
        ahead = F.slice(F.filter(F.arrays_zip("ids", "open"), lambda x: x["open"]), 1, wide)
        asked = state.select("query", F.explode(ahead).alias("x")).select("query", F.col("x.ids").alias("node"))
        if not asked.take(1):
            break
        met = asked.join(links, "node").groupBy("query").agg(F.array_distinct(F.flatten(F.collect_list("to"))).alias("to"))  # of at most `wide` nodes
        new = state.select("query", "seen").join(met, "query").select("query", F.explode(F.array_except("to", "seen")).alias("found"))
        near = new.join(units.select(F.col("id").alias("found"), F.col("unit").alias("near")), "found").select("query", "found", "near")
        rows = state.unionByName(near, allowMissingColumns=True).repartition("query").sortWithinPartitions("query", F.col("found").asc_nulls_first())
        then = store(rows.select(*names, "found", "near").mapInArrow(step, schema), "beam")
        drop(state)
        state = then
    drop(links)
    return state.select("query", "ids")


def nearest(rows: DataFrame, every: int = 50, most: int = NEAREST, id_: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id and score: for each row whose id is divisible by ``every`` its ``most`` nearest others.

    Nearness is the cosine in double precision of the original vectors; ties go to the smaller id. Vectors that are
    null, zero (or without components), or that hold null or non-finite components, take no part, as do rows
    with a null id. Of vectors of different lengths the shorter counts as filled up with zeros. A repeated id counts once for each distinct vector it has. With fewer other vectors a query has fewer rows;
    an empty table gives none, and other columns are ignored.
    """
    prepare(rows.sparkSession)
    good = valid(rows, id_, vector).distinct()
    every_node = store(nodes(good, most + 1), "nodes")
    units = every_node.select("id", "unit", "code")
    graph = build(units)
    # queries of one vector are one search; they find its node by 128 bits of hash, dealt out should they be many
    digest = [F.xxhash64("v").alias("h"), F.xxhash64(F.lit(1), "v").alias("g")]
    asked = good.where(F.col("id") % every == 0).select(F.col("id").alias("query_id"), *digest)
    of = store(salted(asked, every_node.select(F.col("id").alias("query"), *digest), ["h", "g"], "query_id").select("query_id", "query"), "queries")
    asking = every_node.join(of.select(F.col("query").alias("id")).distinct(), "id", "left_semi")
    found = search(graph, units, asking.select(F.col("id").alias("query"), "unit", F.col("id").alias("node")))
    drop(graph)
    pairs = found.select("query", F.explode("ids").alias("id")).join(every_node.select("id", "same", F.col("v").alias("w")), "id")
    pairs = pairs.join(asking.select(F.col("id").alias("query"), "v"), "query")

    def score(batches):
        for b in batches:
            n = b.num_rows
            v, w = (b.column(k).flatten().to_numpy(zero_copy_only=False).reshape(n, -1) if n else np.zeros((0, 1)) for k in ("v", "w"))
            s = (v * w).sum(1) / (np.sqrt((v * v).sum(1)) * np.sqrt((w * w).sum(1)))
            yield pa.RecordBatch.from_arrays([b.column("query"), b.column("same"), pa.array(s)], names=["query", "same", "score"])

    scored = pairs.select("query", "same", "v", "w").mapInArrow(score, "query bigint, same array<bigint>, score double")
    each = scored.select("query", F.explode("same").alias("vec_id"), "score").distinct()
    best = each.groupBy("query").agg(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("far"), "vec_id"))).alias("best"))  # of at most `beam` nodes
    own = F.slice(F.filter("best", lambda x: x["vec_id"] != F.col("query_id")), 1, most)
    top = salted(of, best.select("query", F.slice("best", 1, most + 1).alias("best")), ["query"], "query_id").select("query_id", F.posexplode(own).alias("at", "x"))
    return top.select("query_id", (F.col("at") + 1).alias("rank"), F.col("x.vec_id").alias("vec_id"), (-F.col("x.far")).alias("score"))
