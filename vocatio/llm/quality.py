"""Operator 10: document quality, by histogram gradient-boosted trees over document statistics.

The statistics come from a text's bytes in a few numpy passes. The trees are fitted on histograms
of binned statistics of a bounded sample of labelled rows, and flattened into arrays in which the
children of node i are 2 i + 1 and 2 i + 2, so all rows go down all trees a level at a time.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .learn import FIT_ROWS, held_out, labelled
from .storage import helper, table
from .textbytes import Words, buffers, list_array, slices, spaced_table

#: Kinds of bytes whose share of the text is a statistic.
SHARES = {
    "upper": range(65, 91),
    "lower": range(97, 123),
    "digit": range(48, 58),
    "space": (32, 9),
    "line": (10, 13),
    "beyond_ascii": range(128, 256),
    "stop": b".?",
    "comma": b",;:",
    "shout": b"!",
    "bar": b"|",
    "symbol": b"#$%&*=<>{}[]\\^~_@+",
    "quote": b"\"'`()-/",
}
STATISTICS = (*SHARES, "log_bytes", "log_words", "word_length", "word_spread", "distinct_words", "repeated_next", "top_word", "log_lines", "distinct_lines", "words_per_line", "short_words", "long_words", "top_line")


def _share_table() -> np.ndarray:
    t = np.full(256, len(SHARES), np.int64)
    for i, members in enumerate(SHARES.values()):
        t[list(members)] = i
    return t


def _top(row: np.ndarray, key: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """By row: distinct keys, and occurrences of the commonest."""
    order = np.lexsort((key, row))
    r, k = row[order], key[order]
    new = np.ones(len(r), bool)
    new[1:] = (k[1:] != k[:-1]) | (r[1:] != r[:-1])
    head = np.flatnonzero(new)
    size = np.diff(np.append(head, len(r)))
    most = np.zeros(rows)
    np.maximum.at(most, r[head], size)
    return np.bincount(r[head], minlength=rows), most


def statistics(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Rows by STATISTICS. A text without words has zeros throughout."""
    n, size = len(offsets) - 1, np.diff(offsets)
    row = np.repeat(np.arange(n), size)
    kinds = len(SHARES) + 1
    shares = np.bincount(row * kinds + _share_table()[data], minlength=n * kinds).reshape(n, kinds)[:, :-1] / np.maximum(size, 1)[:, None]
    w = Words(data, offsets, spaced_table())
    at, words = w.row_of_word(), np.diff(w.first)
    length = (w.end - w.start).astype(float)
    some = np.maximum(words, 1)
    mean = np.bincount(at, length, minlength=n) / some
    spread = np.sqrt(np.maximum(np.bincount(at, length**2, minlength=n) / some - mean**2, 0))
    distinct, top = _top(at, w.hash, n)
    again = np.flatnonzero((w.hash[1:] == w.hash[:-1]) & (at[1:] == at[:-1]))
    no_line = np.ones(256, bool)
    no_line[10] = False
    lines = Words(data, offsets, no_line)
    line_at = lines.row_of_word()
    n_lines = np.diff(lines.first)
    distinct_lines, top_line = _top(line_at, lines.hash, n)
    cols = [
        np.log1p(size), np.log1p(words), mean, spread, distinct / some, np.bincount(at[again], minlength=n) / some, top / some, np.log1p(n_lines), distinct_lines / np.maximum(n_lines, 1), words / np.maximum(n_lines, 1),
        np.bincount(at[length <= 3], minlength=n) / some, np.bincount(at[length >= 12], minlength=n) / some, top_line / np.maximum(n_lines, 1),
    ]
    return np.concatenate([shares, np.stack(cols, axis=1)], axis=1)


@dataclass
class Trees:
    """Trees of one depth, flattened: trees by nodes (inner nodes first), trees by leaves."""

    feature: np.ndarray
    threshold: np.ndarray
    value: np.ndarray
    bias: float

    def logit(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.bias)
        rows = np.arange(len(x))
        for feature, threshold, value in zip(self.feature, self.threshold, self.value, strict=True):
            node = np.zeros(len(x), np.int64)
            while len(feature) and len(rows):
                node = 2 * node + 1 + (x[rows, feature[node]] > threshold[node])
                if node[0] >= len(feature):
                    break
            out += value[node - len(feature)]
        return out


def boost(x: np.ndarray, label: np.ndarray, trees: int = 120, depth: int = 4, rate: float = 0.1, bins: int = 64, ridge: float = 5.0, least: float = 2.0) -> Trees:
    """Fits by second-order boosting of the logistic loss. All nodes of a level are split at once,
    from one histogram by node, statistic and bin. A node with no gain sends all rows left."""
    n, f = x.shape
    inner = (1 << depth) - 1
    p = (label.sum() + 1) / (n + 2)
    bias = float(np.log(p / (1 - p)))
    if not n or label.min() == label.max():
        return Trees(np.zeros((0, inner), np.int64), np.zeros((0, inner)), np.zeros((0, inner + 1)), bias)
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(f)]
    binned = np.stack([np.searchsorted(edges[j], x[:, j], side="left") for j in range(f)], axis=1)
    width = bins
    flat = binned + np.arange(f) * width
    z = np.full(n, bias)
    feature, threshold, value = np.zeros((trees, inner), np.int64), np.full((trees, inner), np.inf), np.zeros((trees, inner + 1))
    for t in range(trees):
        prob = 1 / (1 + np.exp(-z))
        g, h = prob - label, prob * (1 - prob)
        node = np.zeros(n, np.int64)
        for level in range(depth):
            m = 1 << level
            local = node - (m - 1)
            key = (local[:, None] * (f * width) + flat).ravel()
            hg = np.bincount(key, np.repeat(g, f), minlength=m * f * width).reshape(m, f, width)
            hh = np.bincount(key, np.repeat(h, f), minlength=m * f * width).reshape(m, f, width)
            gl, hl = hg.cumsum(axis=2)[:, :, :-1], hh.cumsum(axis=2)[:, :, :-1]
            gt, ht = hg.sum(axis=2)[:, :, None], hh.sum(axis=2)[:, :, None]
            gain = gl**2 / (hl + ridge) + (gt - gl) ** 2 / (ht - hl + ridge) - gt**2 / (ht + ridge)
            gain[(hl < least) | (ht - hl < least)] = -1
            best = gain.reshape(m, -1).argmax(axis=1)
            top = gain.reshape(m, -1).max(axis=1)
            for i in np.flatnonzero(top > 1e-6):
                j, b = divmod(int(best[i]), width - 1)
                if b < len(edges[j]):
                    feature[t, m - 1 + i], threshold[t, m - 1 + i] = j, edges[j][b]
            node = 2 * node + 1 + (x[np.arange(n), feature[t, node]] > threshold[t, node])
        leaf = node - inner
        value[t] = -rate * np.bincount(leaf, g, minlength=inner + 1) / (np.bincount(leaf, h, minlength=inner + 1) + ridge)
        z += value[t, leaf]
    return Trees(feature, threshold, value, bias)


def measurer():
    @F.arrow_udf("array<double>")
    def measure(it: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for col in it:
            data, offsets = buffers(col)
            parts = [np.zeros((0, len(STATISTICS)))]
            for i, j in slices(offsets):
                parts.append(statistics(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]))
            x = np.concatenate(parts)
            yield list_array(pa.array(x.ravel()), np.full(len(x), x.shape[1]))

    return measure.asNondeterministic()


def train(docs: DataFrame, labels: DataFrame, mod: int = 3, rest: int = 1, limit: int = FIT_ROWS) -> Trees:
    """Fits on at most ``limit`` labelled rows outside the held-out part. Without any, every text
    scores one half."""
    t = labelled(docs, labels, "quality", mod, rest, limit).select("label", measurer()("text").alias("x")).toArrow()
    x = t.column("x").combine_chunks().flatten().to_numpy().reshape(-1, len(STATISTICS))
    return boost(x, t.column("label").to_numpy())


def scorer(spark: SparkSession, model: Trees):
    sent = spark.sparkContext.broadcast(model)  # of fixed size: trees by nodes

    @F.arrow_udf("double")
    def score(it: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for col in it:
            data, offsets = buffers(col)
            parts = [np.zeros(0)]
            for i, j in slices(offsets):
                parts.append(sent.value.logit(statistics(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])))
            yield pa.array(1 / (1 + np.exp(-np.concatenate(parts))))

    return score.asNondeterministic()


def score_quality(docs: DataFrame, model: Trees, text_col: str = "text", result: str = "quality_score") -> DataFrame:
    """The documents with the column ``result``: the score, 0 to 1, higher for good ones.

    A null text counts as empty; texts without words score by zero statistics. Texts of any length are
    scored whole. All rows stay, repeated ones too, and equal texts score alike; an empty table gives
    an empty result. A column of the name of ``result`` is replaced, no other one is touched.
    """
    made = helper(docs, result)
    return docs.withColumn(made, scorer(docs.sparkSession, model)(F.col(text_col))).select(*[c for c in docs.columns if c != result], F.col(made).alias(result))


def op10_boosted_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = train(docs, table(spark, sf_dir, "labels"))
    return score_quality(docs, model, result="score").select("doc_id", held_out(F.col("doc_id"), 3, 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
