import hashlib
import math
import random

import numpy as np
import pytest

from mossgrove.llm import codes

SCHEMA = "vec_id bigint, embedding array<float>, label int, v string, code int, error string, `none` int"


def brute(rows, parts=16, entries=64, rounds=2):
    """The contract, part by part."""
    kept = [(i, e, lab) for i, e, lab in rows if e is not None and all(x is not None and math.isfinite(x) for x in e)]
    if not kept:
        return []
    width = max(1, -(-max(len(e) for _, e, _ in kept) // parts))
    x = [[math.floor(256 * np.float32(v).item()) for v in e] + [0] * (width * parts - len(e)) for _, e, _ in kept]
    pieces = [[tuple(v[p * width : (p + 1) * width]) for p in range(parts)] for v in x]
    first = sorted(range(len(kept)), key=lambda r: (kept[r][0] is None, kept[r][0] or 0, np.array(x[r], "<i4").tobytes()))[:entries]
    books = [[pieces[r][p] for r in first] for p in range(parts)]
    dist = lambda a, b: sum((s - t) ** 2 for s, t in zip(a, b))
    near = lambda: [[min((dist(v[p], c), k) for k, c in enumerate(books[p])) for p in range(parts)] for v in pieces]
    for _ in range(rounds):
        got = near()
        for p in range(parts):
            for k in range(len(books[p])):
                mine = [v[p] for v, g in zip(pieces, got) if g[p][1] == k]
                if mine:
                    books[p][k] = tuple(sum(c) // len(mine) for c in zip(*mine))
    got = near()
    errors = [sum(d for d, _ in g) for g in got]
    total = {}
    for (_, _, lab), e in zip(kept, errors):
        total[lab] = total.get(lab, 0) + e
    sha = hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()
    return sorted(((i, "".join(f"{k:02x}" for _, k in g), e, total[lab], sha) for (i, _, lab), g, e in zip(kept, got, errors)), key=repr)


def frame(spark, rows):
    return spark.createDataFrame([(*r, "v", 1, "e", 2) for r in rows], SCHEMA)


def got(df):
    assert df.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    return sorted(map(tuple, df.collect()), key=repr)


def test_codes_are_those_of_plain_lloyd(spark):
    """Nulls in any column, odd components, repeated rows and ids, ties, shorter vectors, clashing columns."""
    random.seed(7)
    vector = lambda n=32: [random.gauss(0, 0.3) for _ in range(n)]
    rows = [(i, vector(), i % 3) for i in range(150)]
    rows += [(200, None, 1), (201, [None] + vector(31), 1), (202, [float("nan")] + vector(31), 1), (203, [float("inf")] + vector(31), 1)]
    rows += [(5, rows[5][1], None), (5, vector(), None), (None, vector(), None), (204, vector(20), 1), (205, [], 2), (206, [0.0] * 32, None)]
    rows += [(300 + i, rows[8][1], 0) for i in range(60)] + [(400 + i, [-v for v in rows[9][1]], 2) for i in range(40)]
    assert got(codes.codes(frame(spark, rows))) == brute(rows)


@pytest.mark.parametrize("rows", [[], [(1, None, 1)], [(3, [0.5] * 16, None)], [(i, [round(i / 7) / 4] * 16, 0) for i in range(70)], [(i, [], 0) for i in range(3)]])
def test_few_rows(spark, rows):
    assert got(codes.codes(frame(spark, rows))) == brute(rows)


def test_bounds_hold_and_save_distances():
    """After any drift the assignment is the plain one, and every bound is on its side."""
    rng = np.random.default_rng(5)
    for trial in range(40):
        k, groups = int(rng.integers(1, 30)), int(rng.integers(1, 7))
        x = rng.integers(-9 if trial % 2 else -300, 300 if trial % 3 else 9, (200, 4)).astype("i4")
        book = x[rng.integers(0, 200, k)].astype("i8")
        group = codes.grouped(book[None], groups)[0]
        state = codes.assign(x, book, group, groups)[:3]
        for _ in range(4):
            moved = book + rng.integers(-3, 4, book.shape) * (rng.random((k, 1)) < 0.5)
            drift = np.nextafter(np.sqrt(((moved - book) ** 2).sum(1).astype("f8")), np.inf)
            far = np.array([drift[group == g].max(initial=0.0) for g in range(groups)])
            code, upper, lower = state
            *state, took = codes.assign(x, moved, group, groups, code, codes._above(upper.astype("f8") + drift[code]), codes._below(lower.astype("f8") - far))
            book, d = moved, codes._exact(x, moved)
            assert (state[0] == d.argmin(1)).all() and took <= 200 * (k + 1)
            assert (np.sqrt(d[np.arange(200), state[0]]) <= state[1]).all()
            d[np.arange(200), state[0]] = np.iinfo("i8").max
            for g in range(groups):
                if (group == g).any():
                    assert (state[2][:, g] <= np.sqrt(d[:, group == g].min(1))).all()


def test_later_passes_take_fewer_distances(spark):
    rng = np.random.default_rng(1)
    centres = rng.normal(0, 1, (20, 64))
    rows = [(i, (centres[i % 20] + rng.normal(0, 0.02, 64)).tolist(), 0) for i in range(2000)]
    _, _, took = codes.compress(frame(spark, rows))
    assert took[0] == 2000 * 16 * 64 and max(took[1:]) < took[0]
