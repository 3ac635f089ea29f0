"""Quality scores: histogram gradient-boosted trees over document statistics, kept as flat arrays.

Trees are complete binary trees of one depth. A tree's splits and leaves are rows of three arrays, so a batch of
documents walks down all trees together, one numpy step per level.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from zoneloom.llm.tables import held

SAMPLE = 20_000  # labelled documents that the trees are fitted on; with more, those of the least hashed ids
BINS, TREES, DEPTH, RATE, LEAST_WEIGHT, RIDGE = 64, 60, 4, 0.15, 1.0, 1.0
THRESHOLD = 0.3

_CLASSES = np.zeros((256, 7), np.int64)
for _column, _bytes in enumerate((
    b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b"#*$%&|<>", b"!?", b".,;:", b" \t\n\v\f\r", bytes(range(128, 256)),
)):
    _CLASSES[list(_bytes), _column] = 1

STATISTICS = (
    "log_bytes", "log_words", "bytes_per_word", "upper", "digits", "symbols", "exclamations", "stops", "spaces", "other_bytes",
    "distinct_words", "top_word", "word_repeats", "distinct_pairs", "distinct_lines", "log_lines", "short_words",
    "single_characters", "capitalised", "word_length_spread", "distinct_bytes",
)


def statistics(text: str | None) -> list[float]:
    """The document statistics that the trees see; of the text alone. A null text counts as an empty one."""
    raw = np.frombuffer((text or "").encode(), np.uint8)
    counts = np.bincount(raw, minlength=256)
    shares = (counts @ _CLASSES) / max(1, len(raw))
    words = (text or "").split()
    n = max(1, len(words))
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    seen = Counter(words)
    lines = [x for x in (text or "").split("\n") if x]
    return [
        math.log1p(len(raw)), math.log1p(len(words)), len(raw) / n, *shares, len(seen) / n, max(seen.values(), default=0) / n,
        sum(map(str.__eq__, words, words[1:])) / n, len(set(zip(words, words[1:]))) / max(1, len(words) - 1),
        len(set(lines)) / max(1, len(lines)), math.log1p(len(lines)), float((lengths <= 3).sum()) / n, float((lengths == 1).sum()) / n,
        sum(w[:1].isupper() for w in words) / n, float(lengths.std()) if len(words) else 0.0, np.count_nonzero(counts) / 256,
    ]


@dataclass
class Trees:
    """Flat arrays: ``feature`` and ``cut`` per tree and inner node (level order), ``leaf`` per tree and leaf."""

    base: float
    feature: np.ndarray
    cut: np.ndarray
    leaf: np.ndarray

    def raw(self, x: np.ndarray) -> np.ndarray:
        trees, depth = len(self.leaf), int(self.leaf.shape[1]).bit_length() - 1
        if not trees:
            return np.full(len(x), self.base)
        tree, row = np.arange(trees), np.arange(len(x))[:, None]
        node = np.zeros((len(x), trees), np.int64)
        for _ in range(depth):
            node = 2 * node + 1 + (x[row, self.feature[tree, node]] > self.cut[tree, node])
        return self.base + self.leaf[tree, node - (2**depth - 1)].sum(1)

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.raw(x), -30, 30)))


def fit_trees(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH, weight: np.ndarray | None = None) -> Trees:
    """Boosted trees for 0/1 labels under logistic loss; splits are searched on histograms of the binned columns.

    A row may stand for ``weight`` equal ones."""
    none = Trees(0.0, np.zeros((0, 2**depth - 1), np.int64), np.zeros((0, 2**depth - 1)), np.zeros((0, 2**depth)))
    if not len(y):
        return none
    weight = np.ones(len(y)) if weight is None else weight
    rate = min(max(float(np.average(y, weights=weight)), 1e-3), 1 - 1e-3)
    none.base = math.log(rate / (1 - rate))
    if y.min() == y.max():
        return none
    width = x.shape[1]
    cuts = [np.unique(np.quantile(x[:, j], np.arange(1, BINS) / BINS)) for j in range(width)]
    binned = np.stack([np.searchsorted(cuts[j], x[:, j], side="left") for j in range(width)], 1)
    edges = np.full((width, BINS), np.inf)
    for j, c in enumerate(cuts):
        edges[j, : len(c)] = c
    model = Trees(none.base, np.zeros((trees, 2**depth - 1), np.int64), np.full((trees, 2**depth - 1), np.inf), np.zeros((trees, 2**depth)))
    margin = np.full(len(y), model.base)
    for t in range(trees):
        p = 1 / (1 + np.exp(-margin))
        grad, hess = weight * (p - y), weight * p * (1 - p)
        node = np.zeros(len(y), np.int64)  # within its level
        for level in range(depth):
            nodes, first = 2**level, 2**level - 1
            flat = (node[:, None] * width + np.arange(width)) * BINS + binned
            g, h = (np.bincount(flat.ravel(), np.repeat(v, width), nodes * width * BINS).reshape(nodes, width, BINS).cumsum(2) for v in (grad, hess))
            g_all, h_all = g[:, :1, -1:], h[:, :1, -1:]
            gain = g**2 / (h + RIDGE) + (g_all - g) ** 2 / (h_all - h + RIDGE) - g_all**2 / (h_all + RIDGE)
            gain = np.where((h >= LEAST_WEIGHT) & (h_all - h >= LEAST_WEIGHT), gain, 0).reshape(nodes, -1)
            best = gain.argmax(1)
            won = gain[np.arange(nodes), best] > 1e-9
            f, b = best // BINS, best % BINS
            model.feature[t, first : first + nodes] = f
            model.cut[t, first : first + nodes] = np.where(won, edges[f, b], np.inf)
            node = 2 * node + (won[node] & (binned[np.arange(len(y)), f[node]] > b[node]))
        g, h = np.bincount(node, grad, 2**depth), np.bincount(node, hess, 2**depth)
        model.leaf[t] = -RATE * g / (h + RIDGE)
        margin += model.leaf[t][node]
    return model


def held_out(key: Column) -> Column:
    """Whether a document is kept from the fit: the CRC-32 of its id as text divides by 5."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit(""))) % 5 == 0


def _statistics_of(texts: pd.Series) -> np.ndarray:
    return np.array([statistics(t if isinstance(t, str) else None) for t in texts], float).reshape(len(texts), len(STATISTICS))


def fit_quality(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", sample: int = SAMPLE) -> Trees:
    """Trees fitted on at most ``sample`` labelled documents that are not held out.

    Labels that are null or without a document are ignored; a document labelled both ways counts as 0. Only the
    sample's statistics reach the driver. Without labels every document scores 0.5, with one class nearly 0 or 1.
    """
    chosen = (
        labels.filter(F.col(label).isNotNull() & F.col(key).isNotNull() & ~held_out(F.col(key)))
        .groupBy(F.col(key).alias("k")).agg(F.min(label).cast("double").alias("y"))
        .orderBy(F.xxhash64("k"), "k").limit(sample)
    )
    rows = docs.select(F.col(key).alias("k"), F.col(text).alias("t")).join(F.broadcast(chosen), "k")  # at most ``sample`` ids

    @F.pandas_udf("array<double>")
    def measured(texts: pd.Series) -> pd.Series:
        return pd.Series(list(_statistics_of(texts)))

    taken = rows.select("k", "y", measured("t").alias("x")).orderBy(F.xxhash64("k"), "k", "x").limit(sample).collect()
    x = np.array([r["x"] for r in taken], float).reshape(len(taken), len(STATISTICS))
    y = np.array([r["y"] for r in taken], float)
    # Both labels weigh the same, so the score does not lean to the more frequent one where there are few labels.
    share = np.where(y == 1, y.mean(), 1 - y.mean()) if len(y) else y
    return fit_trees(x, y, weight=0.5 / np.maximum(share, 1e-9))


def quality_score(model: Trees) -> Callable[[Column | str], Column]:
    """Column function: score from 0 to 1 of a text, higher for label 1."""

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        held("quality", dict)  # nothing to keep
        for texts in batches:
            yield pd.Series(model.score(_statistics_of(texts)))

    return score


def score_documents(docs: DataFrame, model: Trees, key: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``(key, held_out, score, predicted)`` per row, whatever its text or key; a null key is held out."""
    scored = docs.select(F.col(key), F.col(text).alias("_text")).select(
        key, held_out(F.col(key)).alias("held_out"), quality_score(model)(F.col("_text")).alias("score")
    )
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def keep_quality(docs: DataFrame, model: Trees, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The documents that reach the threshold, all columns kept."""
    return docs.filter(quality_score(model)(F.col(text)) >= threshold)
