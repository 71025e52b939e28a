"""Toxicity: a linear-chain conditional random field over words.

Labels are of documents, so token labels come first: in a bounded sample of labelled documents, a word of a toxic
one is toxic if the word, or its start of 4 to 8 letters, is found in toxic documents far more often than in
others. The field is trained on those tags over whole texts: a word's features (itself and its starts) have weights if tagged
words have them, whoever else has, and transitions say whether a tag goes on. Forward-backward gives each word's marginal; a document's
score is the largest of its words' marginals, which does not grow with length as a product would, and words with
a marginal of a half or more are its offending offsets. In scoring a chain is a sentence, however long; training takes texts in chains
of ``CHAIN`` words, whose updates are many times cheaper than those of sentences and find as much. Chains of like lengths
are a rectangle that numpy sweeps at once.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mossgrove.llm.common import held_out, map_batches, texts_of
from mossgrove.llm.labels import sample

#: At most so many labelled documents are learned from.
SAMPLE = 4_000
THRESHOLD = 0.3
STARTS = (4, 5, 6, 7, 8)
KINDS = 1 + len(STARTS)
CHAIN = 64
#: Cells of a rectangle of sentences; a longer sentence is one of its own.
SWEEP = 1 << 18
EPOCHS, UPDATES, RATE = 6, 150, 0.5
#: A word or a start is a sign of toxicity if its odds of being in a toxic document are at least so many times those of all
#: words, and if that is by chance for less than this share of the signs.
ODDS = 20
BY_CHANCE = 0.01
CACHED = 400_000
WORD = re.compile(r"\w+")
TOKEN = re.compile(r"\w+|[.!?\n]")  # words, and what ends a sentence


def features(word: str) -> list[str]:
    """Of a lower-case word: itself, and with a hyphen its starts of 4 to 8 letters."""
    return [word, *(f"{word[:k]}-" for k in STARTS if len(word) >= k)]


def words_of(text: str) -> list[str]:
    return WORD.findall(text.lower())


def signs(texts: list[str], toxic: list[int]) -> set[str]:
    """Words and starts of words that toxic documents have far more often than others.

    A feature of n toxic and g other documents is one if its smoothed odds are ODDS times those of all documents, and
    if so many of its documents would be toxic by chance in less than BY_CHANCE of the features found: Chernoff's
    bound on the binomial tail, its limit rising with the features found (Benjamini and Hochberg), so that the few words
    of a language with few toxic rows count beside the many of others. Copies of a text count once.
    """
    bad, good, distinct = Counter(), Counter(), {}
    for text, y in zip(texts, toxic):
        distinct[text] = max(y, distinct.get(text, 0))
    for text, y in distinct.items():
        (bad if y else good).update({x for w in set(words_of(text)) for x in features(w)})
    if not bad:
        return set()
    names = list(bad)
    n, g = np.array([bad[x] for x in names], "f8"), np.array([good[x] for x in names], "f8")
    share = (1 + sum(distinct.values())) / (2 + len(distinct))
    part = n / (n + g)
    unlikely = (n + g) * (part * np.log(part / share) + np.where(g > 0, (1 - part) * np.log(np.maximum(1 - part, 1e-300) / (1 - share)), 0))
    ok = (n >= 4) & (part > share) & ((n + 0.5) / (g + 0.5) >= ODDS * share / (1 - share))
    order = np.argsort(-np.where(ok, unlikely, -1), kind="stable")
    enough = np.where(ok, unlikely, -1)[order] >= np.log(len(names) / BY_CHANCE) - np.log(np.arange(1, len(names) + 1))
    found = int(np.flatnonzero(enough).max(initial=-1)) + 1
    return {names[k] for k in order[:found]}


def tags(words: list[str], known: set[str]) -> list[int]:
    return [int(any(x in known for x in features(w))) for w in words]


def _marginals(emit: np.ndarray, live: np.ndarray, trans: np.ndarray, pairs: bool = False) -> tuple[np.ndarray, np.ndarray | None]:
    """Marginals of tag 1 by chain and place, and on demand expected transitions by chain.

    ``emit``: log-odds of tag 1, a row a chain; ``live``: which places are words; ``trans``: 2 by 2 log-weights.
    Messages are scaled to sum to one at each step, so nothing overflows at any length.
    """
    rows, n = emit.shape
    one = 1 / (1 + np.exp(-np.clip(emit, -40, 40)))
    local = np.stack([1 - one, one], 2)
    local[~live] = 0.5
    m = np.exp(trans)
    fwd, bwd = np.empty((rows, n, 2)), np.ones((rows, n, 2))
    fwd[:, 0] = local[:, 0]
    fwd[:, 0] /= fwd[:, 0].sum(1, keepdims=True)
    for t in range(1, n):
        step = np.where(live[:, t, None], (fwd[:, t - 1] @ m) * local[:, t], fwd[:, t - 1])
        fwd[:, t] = step / step.sum(1, keepdims=True)
    for t in range(n - 2, -1, -1):
        step = np.where(live[:, t + 1, None], (bwd[:, t + 1] * local[:, t + 1]) @ m.T, bwd[:, t + 1])
        bwd[:, t] = step / step.sum(1, keepdims=True)
    both = fwd * bwd
    both /= both.sum(2, keepdims=True)
    if not pairs:
        return np.where(live, both[:, :, 1], 0.0), None
    pair = fwd[:, :-1, :, None] * m * (local[:, 1:] * bwd[:, 1:])[:, :, None, :]
    pair /= pair.sum((2, 3), keepdims=True)
    pair[~live[:, 1:]] = 0
    return np.where(live, both[:, :, 1], 0.0), pair.sum(1)


def chains(breaks: np.ndarray, size: int = CHAIN) -> tuple[np.ndarray, np.ndarray]:
    """Row and place of each word, where ``breaks`` marks the words that a new sentence or text starts with."""
    n = len(breaks)
    at = np.arange(n)
    start = np.maximum.accumulate(np.where(breaks, at, 0)) if n else at
    place = (at - start) % size
    return np.cumsum(place == 0) - 1, place


class _Odds(dict):
    """Log-odds by token as it is written; a sentence's end has none. Bounded."""

    def __init__(self, weights: dict[str, float], bias: float):
        super().__init__(dict.fromkeys(".!?\n", np.nan))
        self.weights, self.bias = weights, bias

    def __missing__(self, word: str) -> float:
        found = self.bias + sum(self.weights.get(x, 0.0) for x in features(word.lower()))
        if len(self) < CACHED:
            self[word] = found
        return found


class Field:
    """A trained field: weights by feature, a bias and 2 by 2 transitions."""

    def __init__(self, weights: dict[str, float], bias: float, trans: np.ndarray):
        self.weights, self.bias, self.trans = weights, bias, trans

    def tagger(self):
        """A function from texts to, for each, its words' marginals and the offsets of those of a half or more."""
        odds = _Odds(self.weights, self.bias).__getitem__

        def tag(texts: list[str]) -> list[tuple[np.ndarray, list[tuple[int, int]]]]:
            lists = [TOKEN.findall(t) for t in texts]
            sizes = np.fromiter(map(len, lists), "i8", len(lists))
            flat: list[float] = []
            for tokens in lists:
                flat += map(odds, tokens)
            every = np.array(flat, "f8")
            ends = np.isnan(every)
            begins = np.zeros(len(every) + 1, bool)
            begins[1:] = ends
            begins[np.cumsum(sizes) - sizes] = True  # sentences go on no further than their text
            # a start that falls on an end is the next word's
            words = np.flatnonzero(~ends)
            started = np.cumsum(begins[:-1])[words]
            p = np.zeros(len(every))
            if len(words):
                p[words] = self._sweep(every[words], np.diff(started, prepend=0) > 0)
            out, at = [], 0
            for text, n in zip(texts, sizes.tolist()):
                own = p[at : at + n]
                at += n
                hot = set(np.flatnonzero(own >= 0.5).tolist())
                out.append((own, [m.span() for k, m in enumerate(TOKEN.finditer(text)) if k in hot] if hot else []))
            return out

        return tag

    def _sweep(self, e: np.ndarray, begins: np.ndarray) -> np.ndarray:
        """Marginals of words with log-odds ``e``, chains of like lengths together."""
        p = np.empty(len(e))
        first = np.flatnonzero(begins)
        count = np.diff(np.append(first, len(e)))
        order = np.argsort(count, kind="stable")
        lo = 0
        while lo < len(order):
            hi = lo + 1
            while hi < len(order) and (hi + 1 - lo) * count[order[hi]] <= SWEEP:
                hi += 1
            own, lo = order[lo:hi], hi
            n = count[own]
            live = np.arange(n.max()) < n[:, None]
            at = (first[own][:, None] + np.arange(n.max()))[live]
            grid = np.zeros(live.shape)
            grid[live] = e[at]
            p[at] = _marginals(grid, live, self.trans)[0][live]
        return p


def fit(texts: list[str], toxic: list[int]) -> Field:
    """Trains a field on tags found by signs(). Without toxic documents every word's odds are low and alike."""
    known = signs(texts, toxic)
    if not known:
        return Field({}, -8.0, np.zeros((2, 2)))
    types: dict[str, int] = {}
    kind, begins, tag = [], [], []
    for text, y in zip(texts, toxic):
        words = words_of(text)
        own = np.array(tags(words, known) if y else [0] * len(words), "i8")
        kind += [types.setdefault(w, len(types)) for w in words]
        tag.append(own)
        begins.append(np.arange(len(words)) == 0)
    kind, tag, names = np.array(kind, "i8"), np.concatenate(tag), list(types)
    having = Counter(x for t in kind[tag == 1] for x in features(names[t]))
    number = {x: k for k, x in enumerate(sorted(x for x, n in having.items() if n > 4))}
    cells = np.array([([number[x] for x in features(w) if x in number] + [len(number)] * KINDS)[:KINDS] for w in names], "i4")
    row, _ = chains(np.concatenate(begins))
    count = np.bincount(row)
    first = np.cumsum(count) - count
    # the last but one of the weights is of no feature and stays 0; the last is the bias
    weights, square, trans = np.zeros(len(number) + 2), np.full(len(number) + 2, 1e-8), np.zeros((2, 2))
    weights[-1] = np.log(tag.mean() / (1 - tag.mean()))
    rng = np.random.default_rng(7)
    for _ in range(max(EPOCHS, -(-UPDATES // (-(-len(count) // 512))))):
        order = rng.permutation(len(count))
        for lo in range(0, len(order), 512):
            own = order[lo : lo + 512]
            n = count[own]
            live = np.arange(n.max()) < n[:, None]
            token = (first[own][:, None] + np.arange(n.max()))[live]
            of = cells[kind[token]]
            grid, gold = np.zeros(live.shape), np.zeros(live.shape, "i8")
            grid[live], gold[live] = weights[of].sum(1) + weights[-1], tag[token]
            p, pair = _marginals(grid, live, trans, pairs=True)
            off = (gold - p)[live]
            g = np.append(np.bincount(of.ravel(), np.repeat(off, KINDS), len(number) + 1), off.sum()) / len(own)
            g[-2] = 0
            square += g * g
            weights += RATE * g / np.sqrt(square)
            both = live[:, 1:]
            seen = np.bincount((2 * gold[:, :-1] + gold[:, 1:])[both], minlength=4).reshape(2, 2)
            trans += 0.1 * (seen - pair.sum(0)) / max(1, both.sum())
    return Field(dict(zip(number, weights.tolist())), float(weights[-1]), trans)


def classify(docs: DataFrame, labels: DataFrame, column: str = "toxic", threshold: float = THRESHOLD, most: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, score, predicted and spans (start:end, comma-joined) of each row of ``docs`` (doc_id, text).

    The field learns from at most ``most`` labelled rows that aren't held out; scores are of whole texts, however long. A null or
    empty text has no words and scores 0; without labelled toxic rows every score is near 0. A null id is never held
    out; repeated rows are scored alike; an empty table gives no rows.
    """
    ids = F.broadcast(sample(labels, column, most))
    learned = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").join(ids, F.col("doc_id") == F.col("id")).select("doc_id", F.coalesce("text", F.lit("")).alias("text"), "label")
    rows = sorted(learned.orderBy("doc_id", "label", F.xxhash64("text")).limit(2 * most).collect(), key=lambda r: (r[0], r[2], r[1]))
    field = fit([r["text"] for r in rows], [r["label"] for r in rows])

    def make():
        tag = field.tagger()

        def work(batch):
            found = tag(texts_of(batch["text"]))
            score = np.array([p.max(initial=0.0) for p, _ in found])
            return {"doc_id": batch["doc_id"], "held_out": batch["held_out"], "score": score, "predicted": (score >= threshold).astype("i4"), "spans": [",".join(f"{s}:{e}" for s, e in x) for _, x in found]}

        return work

    return map_batches(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", held_out(F.col("doc_id")).alias("held_out")), make, "doc_id bigint, held_out boolean, score double, predicted int, spans string")
