"""Quality classifier: histogram gradient-boosted trees over document statistics.

Statistics are of whole texts. Trees are grown on the driver from a bounded sample of
labelled rows, on histograms of gradients over quantile bins, all nodes of a level at a time. Trees of one
depth are flattened into arrays (a feature and a threshold for each inner node, a value for each leaf), so
scoring is a few numpy gathers for a batch of documents and a level.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mossgrove.llm.common import held_out, map_batches, texts_of, with_text
from mossgrove.llm.labels import sample

#: At most so many labelled rows are learned from.
SAMPLE = 20_000
THRESHOLD = 0.7
TREES, DEPTH, RATE, BINS, RIDGE, LEAST = 60, 4, 0.15, 64, 1.0, 10.0
FEATURES = (
    "log_chars", "log_words", "word_length", "word_length_sd", "lower", "upper", "digit", "space", "symbol", "closing", "exclaim", "bar", "high_byte",
    "byte_entropy", "lines", "line_words", "dup_lines", "distinct_words", "top_word", "ends_sign", "capital_words", "upper_words", "repeated_pairs",
)
_CLASS = np.zeros((256, 8))
for _k, _members in enumerate((range(97, 123), range(65, 91), range(48, 58), b" \t\n\r\x0b\x0c", b"#*$%&|<>", b".,;:?", b"!", b"|")):
    _CLASS[list(_members), _k] = 1


def statistics(text: str) -> list[float]:
    """FEATURES of a text; zeros where it has nothing to measure."""
    raw = text.encode("utf-8", "surrogatepass")
    words = text.split()
    n, m = len(raw), len(words)
    if not m:
        return [np.log1p(n)] + [0.0] * (len(FEATURES) - 1)
    counts = np.bincount(np.frombuffer(raw, "u1"), minlength=256)
    share = counts[counts > 0] / n
    of = counts @ _CLASS / n
    lengths = np.fromiter(map(len, words), "f8", m)
    by: dict[str, int] = {}
    for w in words:
        by[w] = by.get(w, 0) + 1
    lines = [x for x in text.split("\n") if x.strip()]
    pairs = set(zip(words, words[1:]))
    firsts = [w[0].isupper() for w in words]
    return [
        np.log1p(n), np.log1p(m), lengths.mean(), lengths.std(), *of.tolist(), counts[128:].sum() / n,
        float(-(share * np.log2(share)).sum()), len(lines) / m, m / max(1, len(lines)), 1 - len(set(lines)) / max(1, len(lines)), len(by) / m, max(by.values()) / m,
        sum(w[-1] in "#*$%&!|" for w in words) / m, sum(firsts) / m, sum(f and w.isupper() for f, w in zip(firsts, words)) / m, 1 - len(pairs) / max(1, m - 1),
    ]


class Trees:
    """Boosted trees of one depth as arrays: feature and cut by tree and inner node, value by tree and leaf."""

    def __init__(self, base: float, feature: np.ndarray, cut: np.ndarray, value: np.ndarray):
        self.base, self.feature, self.cut, self.value = base, feature, cut, value

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probabilities of label 1 for rows of features."""
        total, rows, depth = np.full(len(x), self.base), np.arange(len(x)), int(np.log2(self.value.shape[1])) if len(self.value) else 0
        for f, c, v in zip(self.feature, self.cut, self.value):
            node = np.zeros(len(x), "i8")
            for _ in range(depth):
                node = 2 * node + 1 + (x[rows, f[node]] > c[node])
            total += v[node - (len(v) - 1)]
        return 1 / (1 + np.exp(-total))


def fit(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH, rate: float = RATE, bins: int = BINS) -> Trees:
    """Newton boosting of the logistic loss. With one label only, or no rows, the score is constant."""
    n, width = x.shape
    positive = y.mean() if n else 1.0
    if not 0 < positive < 1:
        return Trees(30.0 if positive else -30.0, np.zeros((0, 0), "i8"), np.zeros((0, 0)), np.zeros((0, 1)))
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(width)]
    binned = np.stack([np.searchsorted(c, x[:, f], side="left") for f, c in enumerate(cuts)], 1)  # x > cuts[b] is bin > b
    model = Trees(float(np.log(positive / (1 - positive))), np.zeros((trees, 2**depth - 1), "i8"), np.full((trees, 2**depth - 1), np.inf), np.zeros((trees, 2**depth)))
    total = np.full(n, model.base)
    for t in range(trees):
        p = 1 / (1 + np.exp(-total))
        g, h, node = y - p, p * (1 - p), np.zeros(n, "i8")
        for level in range(depth):
            first, nodes = 2**level - 1, 2**level
            best = np.full(nodes, 1e-6)
            for f in range(width):
                if not len(cuts[f]):
                    continue
                at = (node - first) * bins + binned[:, f]
                gs, hs = (np.bincount(at, z, nodes * bins).reshape(nodes, bins).cumsum(1) for z in (g, h))
                ga, ha = gs[:, -1:], hs[:, -1:]
                gain = gs**2 / (hs + RIDGE) + (ga - gs) ** 2 / (ha - hs + RIDGE) - ga**2 / (ha + RIDGE)
                gain[(hs < LEAST / 4) | (ha - hs < LEAST / 4)] = 0
                gain = gain[:, : len(cuts[f])]
                k = gain.argmax(1)
                better = gain[np.arange(nodes), k] > best
                best[better] = gain[np.arange(nodes), k][better]
                model.feature[t, first : first + nodes][better] = f
                model.cut[t, first : first + nodes][better] = cuts[f][k[better]]
            f, c = model.feature[t][node], model.cut[t][node]
            node = 2 * node + 1 + (x[np.arange(n), f] > c)
        leaf = node - (2**depth - 1)
        gs, hs = (np.bincount(leaf, z, 2**depth) for z in (g, h))
        model.value[t] = rate * gs / (hs + RIDGE)
        total += model.value[t][leaf]
    return model


def learn(docs: DataFrame, labels: DataFrame, column: str = "quality", most: int = SAMPLE) -> Trees:
    """Trees from at most ``most`` rows of ``labels`` (doc_id and ``column``) that aren't held out."""
    ids = F.broadcast(sample(labels, column, most))  # bounded by `most`
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").join(ids, F.col("doc_id") == F.col("id"))

    def make():
        return lambda batch: {"doc_id": batch["doc_id"], "label": batch["label"], "x": [statistics(t) for t in texts_of(batch["text"])]}

    learned = map_batches(rows.select("doc_id", "label", "text"), make, "doc_id bigint, label int, x array<double>")
    learned = sorted((r["doc_id"], r["label"], r["x"]) for r in learned.orderBy("doc_id", "label", "x").limit(2 * most).collect())
    return fit(np.array([r[2] for r in learned], "f8").reshape(-1, len(FEATURES)), np.array([r[1] for r in learned], "f8"))


def classify(docs: DataFrame, labels: DataFrame, column: str = "quality", threshold: float = THRESHOLD, most: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, score and predicted of each row of ``docs`` (doc_id, text).

    The statistics are of the whole text, however long, and of nothing else. Null and empty texts are scored by their zeros.
    Without a labelled row to learn from every score is 1 (nothing speaks against a document). A null id is never
    held out; repeated rows are scored alike; other columns are ignored; an empty table gives no rows.
    """
    model = learn(docs, labels, column, most)

    def make():
        def work(batch):
            score = model.score(np.array([statistics(t) for t in texts_of(batch["text"])]).reshape(-1, len(FEATURES)))
            return {"doc_id": batch["doc_id"], "held_out": batch["held_out"], "score": score, "predicted": (score >= threshold).astype("i4")}

        return work

    return map_batches(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", held_out(F.col("doc_id")).alias("held_out")), make, "doc_id bigint, held_out boolean, score double, predicted int")


def keep(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that the classifier predicts to be good, with all their columns; nothing is shuffled."""
    model = learn(docs, labels)

    def change():
        def work(column):
            x = np.array([statistics(t) for t in texts_of(column)]).reshape(-1, len(FEATURES))
            return column, pa.array(model.score(x) >= threshold)

        return work

    return with_text(docs, "text", change)
