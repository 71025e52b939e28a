"""SimHash near-duplicates: fingerprints, exact tiled comparison, connected components.

Fingerprints are compared exactly, without a probabilistic index: the distinct ones are sorted by population
count (of the whole and of its four words) and cut into tiles of at most ``TILE``; a pair of tiles is skipped if
the population counts of their words differ by more than the radius in sum, as every pair of their fingerprints
then differs in more bits. Tiles that remain are compared with numpy exclusive-or and bit counts. A pair of
tiles gives the edges of a spanning forest, never all of its pairs, so a ball of near copies costs an edge
for each member and tile. Copies are one fingerprint from the start.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mossgrove.llm.common import counted, drop, map_batches, prepare, salted, store

SEED = 42
SHINGLE = 4
RADIUS = 4
TILE = 8192
WORDS = (0, 16, 32, 48)


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """The 64-bit SimHash of a whole text's word shingles, repeats included; 0 if it has no words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z and ASCII white space only
    if not words:
        return 0
    line = b" ".join(words)
    if len(words) < shingle:
        return xxhash.xxh64_intdigest(line, SEED)
    lengths = np.fromiter(map(len, words), "i8", len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = (ends - lengths)[: len(words) - shingle + 1].tolist()
    ends = ends[shingle - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    counts, n = np.zeros(64, "i8"), len(starts)
    for at in range(0, n, 1 << 16):
        h = np.array([digest(line[s:e], SEED) for s, e in zip(starts[at : at + (1 << 16)], ends[at : at + (1 << 16)])], "<u8")
        counts += np.unpackbits(h.view("u1").reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype="i8")
    return int(np.packbits(2 * counts > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id and fp, the fingerprint as a signed long, of each row of doc_id and text."""

    def make():
        def work(batch):
            return {"doc_id": batch["doc_id"], "fp": np.array([fingerprint(x, shingle) for x in batch["text"].to_pylist()], "u8").view("i8")}

        return work

    return map_batches(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text"), make, "doc_id bigint, fp bigint")


def _counts(fp: Column) -> list[Column]:
    return [F.bit_count(F.shiftrightunsigned(fp, k).bitwiseAND(F.lit(0xFFFF))) for k in WORDS]


def tile_links(a: np.ndarray, b: np.ndarray, same: bool, radius: int) -> list[tuple[int, int]]:
    """Spanning forest of the links between two tiles, or within one: positions in ``a`` then ``b``."""
    off = 0 if same else len(a)
    label, out = np.arange(off + len(b)), []
    for s in range(0, len(a), 64):
        near = np.bitwise_count(a[s : s + 64, None] ^ b[None, :]) <= radius
        if same:
            near[np.arange(len(near)), np.arange(s, s + len(near))] = False
        for r in np.flatnonzero(near.any(1)):
            i = s + r
            hits = off + np.flatnonzero(near[r])
            other = hits[label[hits] != label[i]]
            if len(other):
                labels, first = np.unique(label[other], return_index=True)
                out.extend((int(i), int(x)) for x in other[first])
                found = np.zeros(len(label), bool)
                found[labels] = True
                label[found[label]] = label[i]
    return out


def links(distinct: DataFrame, radius: int = RADIUS, tile: int = TILE) -> DataFrame:
    """Edges (a, b) whose components are those of all pairs of ``distinct.fp`` at ``radius`` bits or fewer."""
    spark = prepare(distinct.sparkSession)
    words = _counts(F.col("fp"))
    sorted_ = distinct.select("fp", F.bit_count("fp").alias("bits"), *(c.alias(f"w{i}") for i, c in enumerate(words)))
    sorted_ = sorted_.repartitionByRange("bits", "w0", "w1", "w2", "fp").sortWithinPartitions("bits", "w0", "w1", "w2", "fp")
    box = [f"{x}{i}" for i in range(4) for x in ("lo", "hi")]

    def cut(batches):
        task, made = TaskContext.get().partitionId() << 24, 0
        rest = None

        def tiles(t: np.ndarray):
            nonlocal made
            for s in range(0, len(t), tile):
                part = t[s : s + tile]
                made += 1
                edge = [f(part[:, 2 + i]) for i in range(4) for f in (np.min, np.max)]
                yield [task + made, int(part[0, 1]), *map(int, edge), part[:, 0].tobytes()]

        def rows(found):
            cols = list(zip(*found))
            return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), *(pa.array(c, pa.int32()) for c in cols[1:-1]), pa.array(cols[-1], pa.binary())], ["tile", "bits", *box, "fps"])

        for batch in batches:
            t = np.stack([c.to_numpy(zero_copy_only=False).astype("i8") for c in batch.columns], 1)
            t = t if rest is None else np.concatenate([rest, t])
            last = t[:, 1] == t[-1, 1] if len(t) else np.zeros(0, bool)
            for bits in np.unique(t[~last, 1]):
                yield rows(list(tiles(t[t[:, 1] == bits])))
            rest = t[last]
            if len(rest) > tile:
                whole = len(rest) // tile * tile
                yield rows(list(tiles(rest[:whole])))
                rest = rest[whole:]
        if rest is not None and len(rest):
            yield rows(list(tiles(rest)))

    schema = f"tile bigint, bits int, {', '.join(f'{x} int' for x in box)}, fps binary"
    tiles = store(sorted_.mapInArrow(cut, schema), "tiles")
    meta = tiles.drop("fps")
    left = meta.select(*(F.col(c).alias(f"{c}_a") for c in meta.columns)).withColumn("bits", F.explode(F.sequence(F.col("bits_a"), F.col("bits_a") + radius)))
    apart = sum((F.greatest(F.lit(0), F.col(f"lo{i}") - F.col(f"hi{i}_a"), F.col(f"lo{i}_a") - F.col(f"hi{i}")) for i in range(4)), F.lit(0))
    pairs = left.join(meta, "bits").where((apart <= radius) & ((F.col("bits_a") < F.col("bits")) | (F.col("tile_a") <= F.col("tile"))))
    pairs = pairs.select("tile_a", F.col("tile").alias("tile_b"))
    sides = pairs.join(tiles.select(F.col("tile").alias("tile_a"), F.col("fps").alias("a")), "tile_a").join(tiles.select(F.col("tile").alias("tile_b"), F.col("fps").alias("b")), "tile_b")

    def make():
        def work(batch):
            out = []
            for i, j, x, y in zip(*(batch[k].to_pylist() for k in ("tile_a", "tile_b", "a", "b"))):
                a, b = np.frombuffer(x, "u8"), np.frombuffer(y, "u8")
                both = a if i == j else np.concatenate([a, b])
                found = tile_links(a, b, i == j, radius)
                if found:
                    out.append(both[np.array(found)].view("i8"))
            all_ = np.concatenate(out) if out else np.zeros((0, 2), "i8")
            return {"a": all_[:, 0], "b": all_[:, 1]}

        return work

    return map_batches(sides.select("tile_a", "tile_b", "a", "b"), make, "a bigint, b bigint")


def components(edges: DataFrame) -> DataFrame:
    """node and root, the least node of its component, for each node of ``edges`` (a, b).

    Large-star and small-star in turn until the edges no longer change. A minimum is gathered by partial
    aggregation, a hub's edges meet it dealt out over several tasks, and each round is written to the shared folder.
    """
    now, last = store(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges"), None
    while True:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = store(salted(both, least, ["a"], "b").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct(), "large")
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        joined = salted(large, least, ["a"], "b")
        small = joined.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b"))).distinct()
        then = store(small, "small")
        drop(large)
        seen = [x.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first() for x in (now, then)]
        drop(now)
        now = then
        if seen[0] == seen[1] or seen[1] == last:
            break
        last = seen[0]
    roots = now.groupBy("a").agg(F.min("b").alias("root")).select(F.col("a").alias("node"), "root")
    return roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())


def near_duplicates(docs: DataFrame, radius: int = RADIUS, shingle: int = SHINGLE, tile: int = TILE) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id of each row of ``docs`` (doc_id, text).

    Two texts are linked if their fingerprints differ in ``radius`` bits or fewer; component_id is the least
    doc_id that links reach, the row's own included. Null, empty and blank texts have fingerprint zero and are
    linked like any other; very long ones are hashed whole. A null doc_id is kept and never is a component's id (null only if its component has no
    other). Repeated rows stay. An empty table gives no rows. Columns other than doc_id and text are ignored.
    """
    rows = store(fingerprints(docs, shingle), "fingerprints")
    nodes = store(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "nodes")
    roots = components(links(nodes.select("fp"), radius, tile))
    rooted = nodes.join(roots, nodes["fp"] == roots["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    ids = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    of = salted(rooted, ids, ["root"], "fp").select("fp", "component_id")
    hex16 = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return salted(rows, of, ["fp"], "doc_id").select("doc_id", hex16.alias("fingerprint"), "component_id")


def keep_first(docs: DataFrame, radius: int = RADIUS, shingle: int = SHINGLE) -> DataFrame:
    """The rows of ``docs`` whose doc_id is its component's id: one of each group of near-duplicates.

    Of rows that share such an id one stays: the least by a hash of all columns. Rows with a null id can't be
    named by one and stay.
    """
    found = near_duplicates(docs, radius, shingle).where("doc_id IS NOT NULL")
    ids = found.groupBy("doc_id").agg(F.max(F.col("doc_id") == F.col("component_id")).alias("first"), F.count("*").alias("rows"))
    leave = counted(ids.where("NOT first OR rows > 1").select(F.col("doc_id").alias("leaves"), (F.col("first") & (F.col("rows") > 1)).alias("again")))
    # the input is one struct meanwhile, so that no name of its columns can clash
    own = docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("bigint").alias("id"))
    same = F.col("id") == F.col("leaves")
    stay = own.join(leave, same, "left_anti").select("row")
    if leave.where("again").take(1):
        hashed = F.xxhash64(*(F.col("row").getField(c) for c in docs.columns))
        one = own.join(leave.where("again"), same, "left_semi").groupBy("id").agg(F.min_by("row", hashed).alias("row"))
        stay = stay.unionByName(one.select("row"))
    return stay.select("row.*")
