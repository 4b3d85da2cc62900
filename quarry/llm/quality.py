"""Quality classifier: a generalised additive model with pairwise interactions.

Features of a text fall into bins by quantile. Boosting goes round and round over the features: a tree
of a few leaves, fitted to the residuals over one feature's bins, adds to that feature's lookup table.
Then the pairs that still explain most residual get two-dimensional tables, by trees of four leaves.
A text's score is the logistic curve of the sum of its bins' values, looked up on whole arrays.

The model is fitted in numpy on a bounded number of labelled rows; features and scores are worked out
on all texts in Spark's tasks.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Words, words_of
from .toxicity import held_out, training_rows

#: Labelled rows to fit on, at most: those of the lowest hashes.
MAX_TRAINING_ROWS = 40_000
BINS = 24
PAIR_BINS = 6
PAIRS = 6
THRESHOLD = 0.5

FEATURES = (
    "log_words", "word_length", "word_length_spread", "upper", "digits", "signs", "junk_signs", "bars", "exclamations", "line_words",
    "distinct_words", "repeated_word", "longest_repeat", "repeated_pairs", "upper_words", "signed_ends", "non_ascii",
)


def _table(chars: str) -> np.ndarray:
    table = np.zeros(256, np.float32)
    table[[ord(c) for c in chars]] = 1
    return table


UPPER, DIGIT = _table("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), _table("0123456789")
SIGN = _table("".join(chr(x) for x in range(33, 127) if not chr(x).isalnum()))
JUNK, BAR, EXCLAMATION, LINE = _table("#$%&*~^=+<>@\\{}[]_"), _table("|"), _table("!"), _table("\n")
NON_ASCII = (np.arange(256) >= 128).astype(np.float32)


def features(words: Words) -> np.ndarray:
    """A row for each text; empty texts have noughts."""
    n_texts = len(words.offsets) - 1
    count = np.diff(words.first)
    size = np.diff(words.offsets)
    per_word, per_byte = 1 / np.maximum(count, 1), 1 / np.maximum(size, 1)
    doc = np.repeat(np.arange(n_texts), count)

    def of_bytes(table: np.ndarray) -> np.ndarray:
        sums = np.r_[0.0, np.cumsum(table[words.data], dtype=np.float64)]
        return sums[words.offsets[1:]] - sums[words.offsets[:-1]]

    def of_words(values: np.ndarray) -> np.ndarray:
        return np.bincount(doc, weights=values, minlength=n_texts)

    length = (words.ends - words.starts).astype(np.float64)
    mean = of_words(length) * per_word
    spread = np.sqrt(np.maximum(of_words(length * length) * per_word - mean * mean, 0))
    h = words.hashes
    same = np.zeros(len(h), bool)
    same[1:] = (h[1:] == h[:-1]) & (doc[1:] == doc[:-1])
    run = np.arange(len(h)) - np.maximum.accumulate(np.where(same, 0, np.arange(len(h)))) if len(h) else np.empty(0)
    longest = np.zeros(n_texts)
    np.maximum.at(longest, doc, run)

    def distinct(keys: np.ndarray, owner: np.ndarray) -> np.ndarray:
        order = np.lexsort((keys, owner))
        k, o = keys[order], owner[order]
        new = np.r_[True, (k[1:] != k[:-1]) | (o[1:] != o[:-1])] if len(k) else np.empty(0, bool)
        return np.bincount(o[new], minlength=n_texts)

    pairs = words.grams(2)
    inside = doc[1:] == doc[:-1] if len(h) > 1 else np.empty(0, bool)
    pair_count = np.maximum(count - 1, 1)
    bits = words.data[words.starts] if len(h) else np.empty(0, np.uint8)
    second = words.data[np.minimum(words.starts + 1, len(words.data) - 1)] if len(h) else bits
    lines = of_bytes(LINE) + 1
    out = np.column_stack([
        np.log1p(count), mean, spread, of_bytes(UPPER) * per_byte, of_bytes(DIGIT) * per_byte, of_bytes(SIGN) * per_byte, of_bytes(JUNK) * per_byte,
        of_bytes(BAR) * per_word, of_bytes(EXCLAMATION) * per_word, np.log1p(count / lines), distinct(h, doc) * per_word, of_words(same.astype(float)) * per_word, np.log1p(longest),
        1 - distinct(pairs[inside], doc[1:][inside]) / pair_count if len(h) > 1 else np.zeros(n_texts), of_words(UPPER[bits] * UPPER[second]) * per_word, of_words(SIGN[words.data[words.ends - 1]]) * per_word if len(h) else np.zeros(n_texts),
        of_bytes(NON_ASCII) * per_byte,
    ])
    out[count == 0] = 0
    return out


@dataclass
class Additive:
    """Lookup tables of features' bins, and of pairs of features' bins."""

    edges: list[np.ndarray]
    pair_edges: list[np.ndarray]
    base: float
    tables: list[np.ndarray]
    pairs: list[tuple[int, int, np.ndarray]]

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.base)
        for k, table in enumerate(self.tables):
            total += table[np.searchsorted(self.edges[k], x[:, k], side="right")]
        for a, b, table in self.pairs:
            total += table[np.searchsorted(self.pair_edges[a], x[:, a], side="right"), np.searchsorted(self.pair_edges[b], x[:, b], side="right")]
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def _edges(x: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(x, np.linspace(0, 1, bins + 1)[1:-1])) if len(x) else np.empty(0)


def _stump(g: np.ndarray, h: np.ndarray, leaves: int, ridge: float) -> np.ndarray:
    """Values over ordered bins by a tree of at most so many leaves, for gradients and curvatures of bins."""
    cuts = [0, len(g)]
    cg, ch = np.r_[0.0, np.cumsum(g)], np.r_[0.0, np.cumsum(h)]
    worth = lambda a, b: (cg[b] - cg[a]) ** 2 / (ch[b] - ch[a] + ridge)
    for _ in range(leaves - 1):
        best = (1e-12, None)
        for a, b in zip(cuts, cuts[1:]):
            if b - a > 1:
                at = np.arange(a + 1, b)
                gain = worth(a, at) + worth(at, b) - worth(a, b)
                k = int(np.argmax(gain))
                if gain[k] > best[0]:
                    best = (gain[k], int(at[k]))
        if best[1] is None:
            break
        cuts = sorted([*cuts, best[1]])
    values = np.zeros(len(g))
    for a, b in zip(cuts, cuts[1:]):
        values[a:b] = (cg[b] - cg[a]) / (ch[b] - ch[a] + ridge)
    return values


def _cross(g: np.ndarray, h: np.ndarray, ridge: float) -> tuple[np.ndarray, float]:
    """Values over a grid of bins by one cut of each axis (four leaves), and what they gain."""
    cg, ch = (np.pad(x.cumsum(0).cumsum(1), ((1, 0), (1, 0))) for x in (g, h))
    best, cut = 0.0, None
    for i in range(1, g.shape[0]):
        for j in range(1, g.shape[1]):
            gain = sum((cg[r2, c2] - cg[r1, c2] - cg[r2, c1] + cg[r1, c1]) ** 2 / (ch[r2, c2] - ch[r1, c2] - ch[r2, c1] + ch[r1, c1] + ridge) for r1, r2 in ((0, i), (i, g.shape[0])) for c1, c2 in ((0, j), (j, g.shape[1])))
            if gain > best:
                best, cut = gain, (i, j)
    values = np.zeros(g.shape)
    if cut:
        for r in (slice(0, cut[0]), slice(cut[0], None)):
            for c in (slice(0, cut[1]), slice(cut[1], None)):
                values[r, c] = g[r, c].sum() / (h[r, c].sum() + ridge)
    return values, best


def fit(x: np.ndarray, y: np.ndarray, rounds: int = 150, rate: float = 0.1, leaves: int = 3, ridge: float = 1.0) -> Additive:
    """Cyclic boosting on log loss: features first, then the best pairs."""
    n = x.shape[1]
    edges, pair_edges = [_edges(x[:, k], BINS) for k in range(n)], [_edges(x[:, k], PAIR_BINS) for k in range(n)]
    share = (y.sum() + 0.5) / (len(y) + 1)
    model = Additive(edges, pair_edges, float(np.log(share / (1 - share))), [np.zeros(len(e) + 1) for e in edges], [])
    if not len(y):
        return model
    bins = [np.searchsorted(edges[k], x[:, k], side="right") for k in range(n)]
    total = np.full(len(y), model.base)
    for _ in range(rounds):
        for k in range(n):
            p = 1 / (1 + np.exp(-total))
            g, h = (np.bincount(bins[k], weights=w, minlength=len(edges[k]) + 1) for w in (y - p, p * (1 - p)))
            step = rate * _stump(g, h, leaves, ridge)
            model.tables[k] += step
            total += step[bins[k]]
    coarse = [np.searchsorted(pair_edges[k], x[:, k], side="right") for k in range(n)]

    def grid(a: int, b: int) -> tuple[np.ndarray, np.ndarray]:
        shape = (len(pair_edges[a]) + 1, len(pair_edges[b]) + 1)
        p = 1 / (1 + np.exp(-total))
        return tuple(np.bincount(coarse[a] * shape[1] + coarse[b], weights=w, minlength=shape[0] * shape[1]).reshape(shape) for w in (y - p, p * (1 - p)))

    gains = sorted(((_cross(*grid(a, b), ridge)[1], a, b) for a in range(n) for b in range(a)), reverse=True)[:PAIRS]
    model.pairs = [(a, b, np.zeros((len(pair_edges[a]) + 1, len(pair_edges[b]) + 1))) for _, a, b in gains]
    for _ in range(rounds // 3):
        for a, b, table in model.pairs:
            step = rate * _cross(*grid(a, b), ridge)[0]
            table += step
            total += step[coarse[a], coarse[b]]
    return model


def learn_quality(docs: DataFrame, labels: DataFrame, most: int = MAX_TRAINING_ROWS) -> Additive:
    """Fit on labels.quality of rows that aren't held out; features of a bounded number of rows come to the driver."""

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, words in words_of(batches):
            yield pa.RecordBatch.from_arrays([rows.column(1), pa.array(list(features(words)), pa.list_(pa.float64()))], names=["label", "x"])

    rows = training_rows(docs, labels, "quality", most).mapInArrow(measure, "label int, x array<double>").toArrow()
    y = rows.column("label").to_numpy().astype(float)
    x = rows.column("x").combine_chunks().flatten().to_numpy().reshape(len(y), -1) if len(y) else np.zeros((0, len(FEATURES)))
    order = np.lexsort((*x.T, y))
    return fit(x[order], y[order])


def score_quality(docs: DataFrame, labels: DataFrame, most: int = MAX_TRAINING_ROWS) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of docs.

    docs: doc_id long, text string; labels: doc_id, quality; other columns don't matter. Null and empty
    texts have features of nought; of repeated labels the largest counts; without labels all score 0.5.
    """
    model = docs.sparkSession.sparkContext.broadcast(learn_quality(docs, labels, most))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, words in words_of(batches):
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(model.value.score(features(words)))], names=["doc_id", "score"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(score, "doc_id long, score double")
    return rows.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
