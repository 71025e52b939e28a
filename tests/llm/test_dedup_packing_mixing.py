import random
import re
import zlib
from array import array
from collections import Counter

import numpy as np
import pandas as pd
import pytest
import xxhash
from pyspark.sql import functions as F

from mossgrove.llm import mixing, packing, simhash
from mossgrove.llm.tokens import Encoder


def plain_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words)] if len(words) < 4 else [" ".join(words[i : i + 4]) for i in range(len(words) - 3)]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(ids, fps, radius=4):
    root = list(range(len(fps)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= radius:
                root[find(i)] = find(j)
    best = {}
    for i, d in enumerate(ids):
        r = find(i)
        best[r] = min([x for x in (best.get(r), d) if x is not None], default=None)
    return [best[find(i)] for i in range(len(ids))]


def test_fingerprints_and_components_match_brute_force(odd, odd_rows):
    rows = [r for r in odd_rows if len(r[1] or "") < 20_000 or r[0] == 31]
    got = Counter((r[0], r[1], r[2]) for r in simhash.near_duplicates(odd.where("doc_id IS NULL OR doc_id <> 30")).select("doc_id", "fingerprint", "component_id").collect())
    fps = [plain_fingerprint(r[1]) for r in rows]
    comps = plain_components([r[0] for r in rows], fps)
    assert got == Counter((r[0], f"{f:016x}", c) for r, f, c in zip(rows, fps, comps))


def test_hash_is_sparks(spark):
    row = spark.sql("SELECT xxhash64('a b c d') AS h").first()
    assert row.h & (1 << 64) - 1 == xxhash.xxh64_intdigest(b"a b c d", 42)


@pytest.mark.parametrize("tile", [5, 64])
def test_links_are_exact_over_tiles(spark, tile):
    random.seed(tile)
    base = [random.getrandbits(64) for _ in range(40)]
    fps = list(dict.fromkeys(b ^ sum(1 << random.randrange(64) for _ in range(random.randrange(6))) & (1 << 64) - 1 for b in base for _ in range(6)))
    signed = [(int(np.array(f, "u8").view("i8")),) for f in fps]
    edges = simhash.links(spark.createDataFrame(signed, "fp bigint"), tile=tile)
    roots = {r.node: r.root for r in simhash.components(edges).collect()}
    mine = [roots.get(s[0], s[0]) for s in signed]
    want = plain_components([s[0] for s in signed], fps)
    assert [(mine[i] == mine[j]) for i in range(len(fps)) for j in range(i)] == [(want[i] == want[j]) for i in range(len(fps)) for j in range(i)]


def test_a_ball_of_near_copies_gives_a_forest():
    near = np.array([1 << i | 1 << j for i in range(20) for j in range(i)], "u8")
    found = simhash.tile_links(near, near, True, 4)
    assert len(found) == len(near) - 1


def test_long_chain_is_one_component(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)], "a bigint, b bigint")
    assert {r.root for r in simhash.components(edges).collect()} == {0}


def test_keep_first_keeps_one_of_each_group(odd):
    kept = simhash.keep_first(odd)
    ids = [r.doc_id for r in kept.collect()]
    comps = {r.component_id for r in simhash.near_duplicates(odd).collect()}
    assert sorted(i for i in ids if i is not None) == sorted(c for c in comps if c is not None) and ids.count(None) == 1
    assert kept.columns == odd.columns


def test_empty_tables(empty):
    assert simhash.near_duplicates(empty).count() == simhash.keep_first(empty).count() == packing.pack(empty).count() == mixing.mix(empty).count() == mixing.repeat(empty).count() == 0


def test_encoder_gives_the_tokenizers_ids():
    import public_tokenizers
    from tokenizers import Tokenizer

    whole, mine = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), Encoder()
    random.seed(5)
    texts = ["", " ", "a  b", "a\n b\t c  ", "<|endoftext|> x", "it's we'll 'd 12ab", "日本 語 😀 é ü,", "\n \n b", "Hello, world. Hello, world."]
    texts += ["".join(random.choice(" \n\tab1.,'séÉ\x85\x1c　") for _ in range(random.randrange(14))) for _ in range(3000)]
    for t in texts:
        assert array("I", mine(t)).tolist() == whole.encode(t, add_special_tokens=False).ids, t


def test_pieces_and_sequences(odd, odd_rows):
    rows = packing.pack(odd).collect()
    import public_tokenizers
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = Counter()
    for r in odd_rows:
        ids = [*whole.encode(r[1] or "", add_special_tokens=False).ids, 2]
        first = len(ids) % 1024 or 1024 if len(ids) > 1024 else len(ids)
        cuts = [0, *range(first, len(ids), 1024), len(ids)] if len(ids) > first else [0, len(ids)]
        for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
            want[(r[0], k, a, b - a, zlib.crc32(array("I", ids[a:b]).tobytes()))] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    by = {}
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == by.get(r.sequence_id, 0)
        by[r.sequence_id] = r.offset + r.length
    assert max(by.values()) <= 1024


def plain_best_fit(lengths, capacity):
    gaps = []
    for n in sorted(lengths, reverse=True):
        fit = min((g for g in gaps if g >= n), default=None)
        if fit is None:
            gaps.append(capacity - n)
        else:
            gaps[gaps.index(fit)] -= n
    return sorted(gaps)


def plain_rounds(lengths, capacity):
    """The rounds document by document: gaps after each, one bin at a time kept at while it takes documents of one length."""
    left, gaps = sorted(lengths, reverse=True), []
    while left:
        open_, shut, over = sorted(gaps), [], []
        while left:
            fit = next((g for g in open_ if g >= left[0]), None)
            if fit is None:
                over.append(left.pop(0))
                continue
            open_.remove(fit)
            own = [x for x in left[: fit // left[0]] if x == left[0]]
            left = left[len(own) :]
            shut.append(fit - sum(own))
        gaps = open_ + shut
        few = [x for x in over if capacity // x == capacity // over[0]]
        left = over[len(few) :]
        while few:
            own = [x for x in few[: capacity // few[0]] if x == few[0]]
            few = few[len(own) :]
            gaps.append(capacity - sum(own))
    return sorted(gaps)


def by_rounds(lengths, cap, ranges):
    """packing.rounds() without Spark: the same sweeps over runs, range by range and then as a whole."""
    state, bins, n = pd.DataFrame([[packing.DOCS, x, 0, k, 0, 0] for x, k in Counter(lengths).items()], columns=packing._NAMES), 0, 0
    while (state.kind == packing.DOCS).any():
        done, open_ = state[state.kind == packing.PLACED], state[state.kind != packing.PLACED]
        parts = pd.concat([packing.sweep(g, cap) for _, g in open_.groupby((open_["size"] - 1) * ranges // cap)])
        after = packing.sweep(parts, cap, bins)
        whole = packing.sweep(open_, cap, bins)
        assert sorted(map(tuple, after.values.tolist())) == sorted(map(tuple, whole.values.tolist()))
        after.loc[after.kind == packing.MADE, "kind"] = packing.GAP
        state, n = pd.concat([done, after]), n + 1
        placed = state[state.kind == packing.PLACED]
        bins = int((placed.bin + placed.n).max())
    return state, n


def filled(places, lengths):
    """Bins' fills by placed runs (size, first, n, bin, offset), each rank of each length once and offsets without a gap."""
    ranks, fill = Counter(), {}
    for size, first, n, bin_, offset in places:
        for k in range(n):
            ranks[size, first + k] += 1
            fill.setdefault(bin_ + k, []).append((offset, size))
    assert ranks == Counter((x, k) for x, n in Counter(lengths).items() for k in range(n))
    for own in fill.values():
        own.sort()
        assert [o for o, _ in own] == [sum(n for _, n in own[:k]) for k in range(len(own))]
    assert sorted(fill) == list(range(len(fill)))
    return [sum(n for _, n in own) for own in fill.values()]


def test_rounds_over_runs_match_rounds_by_document():
    random.seed(2)
    for _ in range(150):
        cap = random.choice([10, 64, 100])
        lengths = [random.randint(1, random.choice([cap, cap // 3])) for _ in range(random.randrange(1, 120))]
        state, n = by_rounds(lengths, cap, random.choice([1, 3, 8]))
        fills = filled(state[state.kind == packing.PLACED][["size", "first", "n", "bin", "offset"]].values.tolist(), lengths)
        assert sorted(cap - x for x in fills) == plain_rounds(lengths, cap)
        assert n <= len({cap // x for x in lengths})


@pytest.mark.parametrize("draw", [lambda r: r.randint(1, 1024), lambda r: r.randint(1, 300), lambda r: min(1024, 1 + int(r.expovariate(1 / 150)))])
def test_rounds_need_hardly_more_bins_than_best_fit_decreasing(draw):
    r = random.Random(3)
    lengths = [draw(r) for _ in range(3000)]
    state, _ = by_rounds(lengths, 1024, 8)
    fills = filled(state[state.kind == packing.PLACED][["size", "first", "n", "bin", "offset"]].values.tolist(), lengths)
    assert len(fills) <= 1.01 * len(plain_best_fit(lengths, 1024))


def test_rounds_in_spark_match_rounds_by_document(spark):
    r = random.Random(4)
    lengths = [r.randint(1, 100) for _ in range(400)]
    runs = spark.createDataFrame(list(Counter(lengths).items()), "length bigint, n bigint")
    got = packing.rounds(runs, 100, 4).where(F.col("kind") == packing.PLACED).select("size", "first", "n", "bin", "offset").collect()
    assert sorted(100 - x for x in filled([tuple(x) for x in got], lengths)) == plain_rounds(lengths, 100)


def plain_targets(sizes, weights=(5, 2, 1), most=3):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    total, capped = sum(sizes.values()), {}
    while True:
        left = total - sum(capped.values())
        open_ = [s for s in names if s not in capped]
        t = {s: left * w[s] / sum(w[x] for x in open_) for s in open_}
        over = {s: most * sizes[s] for s in open_ if t[s] > most * sizes[s]}
        if not over:
            return capped | t
        capped |= over


def test_mix_meets_targets(odd, odd_rows):
    rows = mixing.mix(odd).collect()
    sizes = Counter()
    for r in odd_rows:
        sizes[r[3]] += len((r[1] or "").split())
    want = plain_targets(dict(sizes))
    assert len(rows) == len(odd_rows)
    source = {(r[0], len((r[1] or "").split())): r[3] for r in odd_rows}
    taken = Counter()
    for r in rows:
        s = source[(r.doc_id, r.size)]
        assert r.source_size == sizes[s] and r.target == pytest.approx(want[s]) and r.taken <= 3 * r.size
        taken[s] += r.taken
    biggest = {s: max(len((r[1] or "").split()) for r in odd_rows if r[3] == s) for s in sizes}
    assert all(abs(taken[s] - want[s]) <= biggest[s] / 2 + 1 for s in sizes)
    assert Counter(map(tuple, rows)) == Counter(map(tuple, mixing.mix(odd).collect()))


def test_mix_orders_a_source_by_key(spark):
    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.expr("array_join(array_repeat('w', cast(1 + id % 9 as int)), ' ')").alias("text"), F.when(F.col("id") % 3 == 0, "a").otherwise("b").alias("source"))
    rows = mixing.mix(docs).join(mixing.sized(docs).select("doc_id", "key", "source"), "doc_id").collect()
    for s in "ab":
        own = sorted((r for r in rows if r.source == s), key=lambda r: r.key)
        epochs, upto = own[0].target // own[0].source_size, 0
        budget = own[0].target - epochs * own[0].source_size
        for r in own:
            upto += r.size
            assert r.copies == epochs + (2 * upto - r.size <= 2 * budget)


def test_repeat_does_what_mix_says(odd):
    plain = odd.where("doc_id IS NOT NULL AND doc_id <> 4")
    want = Counter({r.doc_id: r.copies for r in mixing.mix(plain).collect()})
    out = mixing.repeat(plain)
    assert out.columns == odd.columns
    assert Counter(r.doc_id for r in out.collect()) == +want


def test_quality_weight_orders_sampling(spark):
    w = spark.createDataFrame([("plain words",), ("#*$%&",), ("",)], "t string").select(mixing.quality_weight(F.col("t")).alias("w")).collect()
    assert [round(r.w, 2) for r in w] == [1.0, 0.05, 1.0]


def test_columns_of_any_name_come_through(spark, odd, odd_rows):
    """repeat() and keep_first() give back the input's columns, whatever their names, with the values they had."""
    names = ("_key", "_size", "_copy", "_bucket", "_last", "_of", "leaves", "again", "row", "id", "key", "src", "words", "at", "n", "of", "planned", "epochs", "last", "first", "rows", "more", "own", "col", "id_of", "component_id")
    base = odd.select("doc_id", "text", "lang", "source", "n_chars")
    more = base.select("*", *(F.concat(F.lit(f"{c} of "), F.coalesce(F.col("doc_id").cast("string"), F.lit("none"))).alias(c) for c in names))
    for keep in (mixing.repeat, simhash.keep_first):
        got, plain = keep(more), keep(base)
        assert got.columns == more.columns
        rows = got.collect()
        assert sorted((r["doc_id"] is None, r["doc_id"] or 0, r["text"] or "") for r in rows) == sorted((r["doc_id"] is None, r["doc_id"] or 0, r["text"] or "") for r in plain.collect())
        assert all(r[c] == f"{c} of {'none' if r['doc_id'] is None else r['doc_id']}" for r in rows for c in names)
