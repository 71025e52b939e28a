import random
import re
from collections import Counter
from math import floor, log

import numpy as np
import pytest

from mossgrove.llm import lexical

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def plain_terms(text):
    return TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, top=20):
    """The contract, document by document."""
    held = [(i, Counter(w), len(w)) for i, t in docs if (w := plain_terms(t))]
    n, length, df = len(held), sum(x[2] for x in held), Counter(w for _, c, _ in held for w in c)
    out = []
    for item, text in items:
        found = []
        for id_, tf, k in held:
            m = 100 - 25 + (25 * k * n) // length
            s = sum(floor(1000 * log((2 * n + 2) / (2 * df[w] + 1))) * ((1000000000 * tf[w]) // (1000 * tf[w] + 12 * m)) for w in plain_terms(text) if w in tf)
            if s > 0:
                found.append((-s, id_ is None, id_ or 0, id_))
        out += [(item, r, x[3], -x[0]) for r, x in enumerate(sorted(found)[:top], 1)]
    return sorted(out, key=repr)


def got(df):
    assert df.columns == ["item_id", "rank", "doc_id", "score"]
    return sorted(map(tuple, df.collect()), key=repr)


def test_terms_are_those_of_the_pattern():
    random.seed(3)
    for _ in range(5000):
        t = "".join(random.choice(["A", "z", "É", "é", "0", "9", ":", "@", "[", "`", "{", "\x7f", "\x80", " ", "\n", "_", "日本", "ß", " ", "\x00"]) for _ in range(random.randrange(12)))
        assert [x.decode() for x in lexical.terms(t)] == plain_terms(t)


@pytest.mark.parametrize("window", [lexical.WINDOW, 3])
def test_ranks_are_the_plain_ones(spark, odd, odd_rows, window):
    """Nulls in any column, empty and very long texts, ties, repeated rows and items, clashing columns; also over many windows."""
    items = [(1, "the quick fox; THE quick, wizards"), (2, None), (3, " ,; "), (4, "unknownword"), (None, "silver towers"), (5, "fox"), (5, "fox"), (6, "x" * 50_000), (7, odd_rows[3][1])]
    table = spark.createDataFrame([(*x, 7, "s") for x in items], "item_id bigint, text string, rank int, score string")
    assert got(lexical.search(odd, table, window=window)) == brute([(r[0], r[1]) for r in odd_rows], items)
    assert got(lexical.search(odd, table, top=2, window=window)) == brute([(r[0], r[1]) for r in odd_rows], items, 2)


def test_blocks_of_items_give_what_one_gives(spark, odd, odd_rows, monkeypatch):
    items = [(i, odd_rows[i][1]) for i in range(6)]
    table = spark.createDataFrame(items, "item_id bigint, text string")
    monkeypatch.setattr(lexical, "BLOCK_TERMS", 50)
    assert got(lexical.search(odd, table)) == brute([(r[0], r[1]) for r in odd_rows], items)


def test_counts_above_a_byte(spark):
    docs = [(1, "a " * 300 + "b"), (2, "a b c"), (3, "b " * 70_000), (4, "c")]
    items = [(1, "a b"), (2, "c c c")]
    assert got(lexical.search(spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string"))) == brute(docs, items)


def test_empty_tables_give_no_rows(spark, odd, empty):
    items = spark.createDataFrame([(1, "fox")], "item_id bigint, text string")
    assert got(lexical.search(empty, items)) == []
    assert got(lexical.search(odd, items.limit(0))) == []
    assert got(lexical.search(odd.where("text IS NULL"), items)) == []


def test_harvest_is_that_of_each_document():
    rng = np.random.default_rng(2)
    ids = [np.unique(rng.integers(0, 9, 4)).astype("<u2") for _ in range(50)]
    counts = [rng.integers(1, 400, len(x)).astype("<u4") for x in ids]
    weights, n = rng.integers(0, 5000, 9), [int(c.sum()) for c in counts]
    s = lexical.Slots(n, [x.tobytes() for x in ids], [c.tobytes() for c in counts], "<u2", weights, 50, sum(n))
    at, scores = s.harvest(np.array([1, 3, 8]), np.array([1, 2, 1]), 0)
    want = {}
    for d, (x, c) in enumerate(zip(ids, counts)):
        m = 75 + 25 * n[d] * 50 // sum(n)
        v = sum(int(weights[t]) * k * (10**9 * int(c[x == t][0]) // (1000 * int(c[x == t][0]) + 12 * m)) for t, k in ((1, 1), (3, 2), (8, 1)) if t in x)
        if v > 0:
            want[d] = v
    assert dict(zip(at.tolist(), scores.tolist())) == want
