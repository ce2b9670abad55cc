"""Quality classifier: histogram gradient-boosted trees over text statistics."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from lodegraph.llm import quality, text as T

_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_PUNCT = np.zeros(256, bool)
_PUNCT[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = True
_VOWEL = np.zeros(256, bool)
_VOWEL[list(b"aeiouAEIOU")] = True

#: At most about so many labelled rows are read for training (see `train`).
MAX_TRAINING_ROWS = 20_000


def features(column: pa.Array) -> np.ndarray:
    """Statistics of every text: one row each, float32."""
    m = quality.measure(column, (2, 3, 5))
    w = T.Words(column)
    n = len(w.counts)
    words, chars = np.maximum(m["n_words"], 1), np.maximum(m["word_chars"], 1)
    size = np.maximum(np.diff(w.offsets), 1)
    lengths = w.code_points()
    mean = m["word_chars"] / words
    spread = T.sums((lengths - np.repeat(mean, w.counts)) ** 2, w.at) / words
    keys = T.in_doc(w.hashes(), w.doc)
    order = np.argsort(keys, kind="stable")
    fresh = np.ones(len(keys), bool)
    fresh[order[1:]] = keys[order[1:]] != keys[order[:-1]]
    lines = T.sums(w.buf == 10, w.offsets) + 1

    def share(mask: np.ndarray) -> np.ndarray:
        return T.sums(mask, w.offsets) / size

    cased = np.maximum(m["upper"] + m["lower"], 1)
    ends_stop = T.sums(np.isin(w.buf, [46, 33, 63]), w.offsets)
    columns = [
        np.log1p(m["n_words"]), np.log1p(m["word_chars"]), mean, spread, T.sums(lengths > 12, w.at) / words, T.sums(lengths == 1, w.at) / words,
        m["n_symbols"] / words, m["n_symbols"] / chars, m["upper"] / cased, share(_DIGIT[w.buf]), share(_PUNCT[w.buf]), share(w.buf >= 128), share(_VOWEL[w.buf]),
        m["n_dup_lines"] / lines, m["dup_line_chars"], m["n_repeat_words"] / words, m["dup_2gram_chars"], m["dup_3gram_chars"], m["dup_5gram_chars"],
        T.sums(fresh, w.at) / words, np.log1p(lines), m["n_words"] / lines, ends_stop / words, share(w.buf == 33), share(w.buf == 44), share(w.buf == 34), share((w.buf == 123) | (w.buf == 125)),
    ]
    return np.stack([np.asarray(c, np.float64) for c in columns], 1).astype(np.float32) if n else np.zeros((0, len(columns)), np.float32)


@dataclass
class Forest:
    """Complete binary trees as arrays: inner nodes first, then values of leaves."""

    feature: np.ndarray  # tree x inner
    threshold: np.ndarray
    leaf: np.ndarray  # tree x leaves
    base: float

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.base)
        rows = np.arange(len(x))
        inner = self.feature.shape[1] if len(self.feature) else 0
        depth = (inner + 1).bit_length() - 1
        for feature, threshold, leaf in zip(self.feature, self.threshold, self.leaf, strict=True):
            node = np.zeros(len(x), np.int64)
            for _ in range(depth):
                node = 2 * node + 1 + (x[rows, feature[node]] > threshold[node])
            total += leaf[node - inner]
        return 1 / (1 + np.exp(-total))


def boost(x: np.ndarray, y: np.ndarray, trees: int = 60, depth: int = 4, rate: float = 0.15, bins: int = 64, l2: float = 2.0, least: float = 3.0) -> Forest:
    """Logistic boosting; every level of a tree is split from bin histograms."""
    n, f = x.shape
    if not n or y.min() == y.max():
        prior = 0.5 if not n else float(np.clip(y.mean(), 0.01, 0.99))
        return Forest(np.zeros((0, 1), int), np.zeros((0, 1)), np.zeros((0, 2)), float(np.log(prior / (1 - prior))))
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(f)]
    binned = np.stack([np.searchsorted(edges[j], x[:, j], "left") for j in range(f)], 1)
    prior = y.mean()
    base = float(np.log(prior / (1 - prior)))
    margin = np.full(n, base)
    inner, rows = 2**depth - 1, np.arange(n)
    out_f, out_t, out_l = [], [], []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        g, h = p - y, p * (1 - p)
        feature, threshold = np.zeros(inner, np.int64), np.full(inner, np.inf)
        node = np.zeros(n, np.int64)
        for level in range(depth):
            width, first = 2**level, 2**level - 1
            here = node - first
            best, choice = np.full(width, 1e-6), np.zeros((width, 2), np.int64) - 1
            for j in range(f):
                key = here * bins + binned[:, j]
                hg = np.bincount(key, g, width * bins).reshape(width, bins).cumsum(1)
                hh = np.bincount(key, h, width * bins).reshape(width, bins).cumsum(1)
                tg, th = hg[:, -1:], hh[:, -1:]
                gain = hg**2 / (hh + l2) + (tg - hg) ** 2 / (th - hh + l2) - tg**2 / (th + l2)
                gain[(hh < least * 0.25) | (th - hh < least * 0.25)] = 0
                gain[:, len(edges[j]) :] = 0
                at = gain.argmax(1)
                top = gain[np.arange(width), at]
                better = top > best
                best[better] = top[better]
                choice[better] = np.stack([np.full(width, j), at], 1)[better]
            for k in np.flatnonzero(choice[:, 0] >= 0):
                j, at = choice[k]
                feature[first + k], threshold[first + k] = j, edges[j][at]
            node = 2 * node + 1 + (x[rows, feature[node]] > threshold[node])
        leaf = node - inner
        value = -rate * np.bincount(leaf, g, inner + 1) / (np.bincount(leaf, h, inner + 1) + l2)
        margin += value[leaf]
        out_f.append(feature)
        out_t.append(threshold)
        out_l.append(value)
    return Forest(np.stack(out_f), np.stack(out_t), np.stack(out_l), base)


def _features(batch: pa.RecordBatch) -> np.ndarray:
    return features(batch.column("text"))


def train(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_TRAINING_ROWS) -> Forest:
    """Fit on labelled documents; labels has (doc_id, quality), null labels are left out.

    The fit is on a bounded sample: above `max_rows` labelled ids, ids are taken
    by hash so that about `max_rows` remain. Only their statistics come to the
    driver (27 floats a row).
    """
    labels = labels.select("doc_id", F.col("quality").cast("int").alias("y")).where("doc_id is not null and y is not null").groupBy("doc_id").agg(F.max("y").alias("y"))
    total = labels.count()
    if total > max_rows:
        labels = labels.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < int(max_rows / total * (1 << 20)))
    picked = docs.select("doc_id", "text").join(F.broadcast(labels), "doc_id")

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in T.batched(it, "text"):
            x = _features(batch)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("y"), pa.array([r.tobytes() for r in x], pa.binary())], names=["doc_id", "y", "x"])

    rows = picked.mapInArrow(run, "doc_id long, y int, x binary").toArrow().sort_by([("doc_id", "ascending"), ("x", "ascending")])
    x = np.frombuffer(b"".join(rows.column("x").to_pylist()), np.float32)
    y = rows.column("y").to_numpy().astype(np.float64)
    return boost(x.reshape(len(y), -1) if len(y) else np.zeros((0, 1), np.float32), y)


def classify(docs: DataFrame, forest: Forest, threshold: float = 0.3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score, predicted for every row.

    Null counts as the empty text, which gets a score like any other; repeated
    rows give equal rows; a null id is carried along; no other column is read.
    """

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in T.batched(it, "text"):
            score = forest.score(_features(batch))
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(score), pa.array(score >= threshold).cast(pa.int32())], names=["doc_id", "score", "predicted"])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id long, score double, predicted int")
