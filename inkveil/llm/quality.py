"""Quality classifier: gradient-boosted trees on histograms of document statistics.

Trees are trained on the driver from a bounded sample of labelled rows and flattened into arrays; scoring walks
all trees of a batch with numpy. Edge cases: null or empty text has the statistics of an empty document and is
scored like any other; a null doc_id counts as held out; labels that are null are ignored
and repeated labels are averaged; of rows with one labelled doc_id the one of the least text is learnt from; whole texts are
read, whatever their length; equal texts score alike; of splits with equal gain the first feature's lowest wins; with no usable label every score is 0.5, with one class only its share; an
empty table gives an empty result; further columns of the input are kept by filter_quality and ignored elsewhere.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fold, table

#: Rows of labels.quality that training takes at most, the first by a hash of doc_id.
SAMPLE_ROWS = 20_000
THRESHOLD = 0.3
FOLDS = 5

NAMES = (
    "log_bytes log_words word_length upper lower digit space newline punctuation symbol non_ascii control entropy unique_words top_word "
    "repeats unique_pairs unique_lines line_words sentence_words ended_words symbol_words shouted_words compression longest_word short_words"
).split()

_CLASSES = np.zeros((256, 9), dtype=np.float64)
for _c in range(256):
    _ch = chr(_c)
    _CLASSES[_c, 0] = 65 <= _c <= 90
    _CLASSES[_c, 1] = 97 <= _c <= 122
    _CLASSES[_c, 2] = 48 <= _c <= 57
    _CLASSES[_c, 3] = _c == 32
    _CLASSES[_c, 4] = _c == 10
    _CLASSES[_c, 5] = _ch in ".,;:!?'\"()-"
    _CLASSES[_c, 6] = 33 <= _c <= 126 and not _ch.isalnum() and _ch not in ".,;:!?'\"()-"
    _CLASSES[_c, 7] = _c >= 128
    _CLASSES[_c, 8] = _c < 32 and _c != 10


def statistics(text: str | None) -> list[float]:
    """The values of NAMES for one whole text."""
    data = (text or "").encode("utf-8", "surrogatepass")
    size = len(data)
    if not size:
        return [0.0] * len(NAMES)
    counts = np.bincount(np.frombuffer(data, dtype=np.uint8), minlength=256)
    share = (counts @ _CLASSES) / size
    p = counts[counts > 0] / size
    words = data.split()
    n = len(words) or 1
    seen = Counter(words)
    lines = [x for x in data.split(b"\n") if x]
    lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words)) if words else np.zeros(1, dtype=np.int64)
    sentences = int(counts[46] + counts[33] + counts[63]) or 1
    return [
        math.log1p(size),
        math.log1p(len(words)),
        float(lengths.mean()),
        *share.tolist(),
        float(-(p * np.log2(p)).sum()),
        len(seen) / n,
        max(seen.values(), default=0) / n,
        sum(map(bytes.__eq__, words, words[1:])) / n,
        len(set(zip(words, words[1:], strict=False))) / n,
        len(set(lines)) / (len(lines) or 1),
        n / (len(lines) or 1),
        n / sentences,
        sum(1 for w in words if w[-1] in b".!?,;:") / n,
        sum(1 for w in words if w[-1] < 128 and not (48 <= w[-1] <= 57 or 65 <= w[-1] <= 90 or 97 <= w[-1] <= 122 or w[-1] in b".!?,;:")) / n,
        sum(map(bytes.isupper, words)) / n,
        len(zlib.compress(data, 1)) / size,
        float(lengths.max()),
        float((lengths <= 3).mean()),
    ]


@dataclass
class Forest:
    """Complete trees of one depth: node i has children 2i+1 and 2i+2; leaves hold values."""

    base: float
    depth: int
    feature: np.ndarray  # (trees, 2**depth - 1)
    above: np.ndarray  # (trees, 2**depth - 1): go right where the value is above
    value: np.ndarray  # (trees, 2**depth)

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for f, t, v in zip(self.feature, self.above, self.value, strict=True):
            node = np.zeros(len(x), dtype=np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (x[rows, f[node]] > t[node])
            total += v[node - (2**self.depth - 1)]
        return 1 / (1 + np.exp(-total))


def train(x: np.ndarray, y: np.ndarray, trees: int = 120, depth: int = 4, bins: int = 64, rate: float = 0.1, ridge: float = 1.0, least: int = 8) -> Forest:
    """Newton boosting of the logistic loss; splits are sought over at most bins quantiles of each feature."""
    inner = 2**depth - 1
    share = float(y.mean()) if len(y) else 0.5
    empty = Forest(0.0, depth, np.zeros((0, inner), np.int64), np.zeros((0, inner)), np.zeros((0, inner + 1)))
    share = min(max(share, 1e-3), 1 - 1e-3)
    empty.base = math.log(share / (1 - share))
    if not len(y) or y.min() == y.max():
        return empty
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins)[1:-1])) for j in range(x.shape[1])]
    binned = np.stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(cuts)], axis=1)
    k = x.shape[1]
    flat = binned + np.arange(k) * bins
    total = np.full(len(y), empty.base)
    features, edges, values = [], [], []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-total))
        g, h = y - p, np.maximum(p * (1 - p), 1e-9)
        node = np.zeros(len(y), dtype=np.int64)
        feature, edge = np.zeros(inner, np.int64), np.full(inner, np.inf)
        for level in range(depth):
            first, width = 2**level - 1, 2**level
            at = (flat + ((node - first) * (k * bins))[:, None]).ravel()
            size = width * k * bins
            hist = [np.bincount(at, weights=np.repeat(w, k) if w is not None else None, minlength=size).reshape(width, k, bins).cumsum(axis=2) for w in (g, h, None)]
            gl, hl, nl = hist
            gt, ht, nt = gl[:, :, -1:], hl[:, :, -1:], nl[:, :, -1:]
            gain = gl**2 / (hl + ridge) + (gt - gl) ** 2 / (ht - hl + ridge) - gt**2 / (ht + ridge)
            gain[(nl < least) | (nt - nl < least)] = -1
            best = gain.reshape(width, -1).argmax(axis=1)
            for i, b in enumerate(best.tolist()):
                j, cut = divmod(b, bins)
                if gain[i, j, cut] > 1e-6 and cut < len(cuts[j]):
                    feature[first + i], edge[first + i] = j, cuts[j][cut]
            node = 2 * node + 1 + (x[np.arange(len(y)), feature[node]] > edge[node])
        leaf = node - inner
        value = rate * np.bincount(leaf, weights=g, minlength=inner + 1) / (np.bincount(leaf, weights=h, minlength=inner + 1) + ridge)
        total += value[leaf]
        features.append(feature)
        edges.append(edge)
        values.append(value)
    return Forest(empty.base, depth, np.array(features), np.array(edges), np.array(values))


def _matrix(texts) -> np.ndarray:
    return np.array([statistics(t) for t in texts], dtype=np.float64).reshape(-1, len(NAMES))


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Forest:
    """Train on at most sample_rows labelled rows that are not held out.

    The sample's ids are the only thing that is broadcast, and the driver gets len(NAMES) numbers a row.
    """
    chosen = (
        labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & (fold(F.col("doc_id"), FOLDS) != 0))
        .groupBy("doc_id")
        .agg(F.avg("quality").alias("y"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(sample_rows)
    )

    @F.pandas_udf("array<double>")
    def stats(text: pd.Series) -> pd.Series:
        return pd.Series([statistics(t) for t in text])

    texts = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.first("y").alias("y"))
    rows = texts.select("doc_id", (F.col("y") >= 0.5).cast("int").alias("y"), stats("text").alias("x")).toPandas()
    rows = rows.sort_values("doc_id")  # the same trees whatever order tasks end in
    return train(np.array(rows["x"].tolist(), dtype=np.float64).reshape(-1, len(NAMES)), rows["y"].to_numpy(dtype=np.float64))


def scorer(forest: Forest):
    """A column function: text to the probability of quality 1."""

    @F.pandas_udf("double")
    def score(text: pd.Series) -> pd.Series:
        return pd.Series(forest.score(_matrix(text)) if len(text) else [], dtype="float64")

    return score


def filter_quality(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """docs without those that the classifier rejects; columns unchanged."""
    score = scorer(fit(docs, labels))
    return docs.where(score(F.col("text")) >= threshold)


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    score = scorer(fit(docs, table(spark, sf_dir, "labels")))
    scored = docs.select("doc_id", (fold(F.col("doc_id"), FOLDS) == 0).alias("held_out"), score("text").alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
