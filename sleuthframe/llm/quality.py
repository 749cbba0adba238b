"""Quality classifier: histogram gradient-boosted trees over document statistics."""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sleuthframe.llm.html import STOPS

#: Labelled rows that the trees are fitted on, at most: the ones with the least hash of doc_id.
MAX_ROWS = 20_000
#: Trees, their depth, step size, histogram bins, least hessian of a leaf and L2 penalty.
TREES, DEPTH, STEP, HISTOGRAM, LEAST, PENALTY = 80, 4, 0.15, 48, 3.0, 1.0
#: Documents score at least this much to be kept.
KEEP = 0.5

FEATURES = (
    "log_chars log_words word_length unique_words top_word repeated_words stop_words upper lower digits spaces other_bytes punctuation exclaims symbols bars stops commas "
    "capital_words log_lines line_length unique_lines lines_ended compressed"
).split()

# Bytes by kind.
_KINDS = (b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz", b"0123456789", b" \t\r\n", bytes(range(128, 256)), b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~", b"!", b"#$%&*@^~<>{}\\", b"|", b".", b",")
_KIND_OF = np.array([[b in kind for b in range(256)] for kind in _KINDS], float)


def statistics(text: str | None) -> list[float]:
    """FEATURES of one whole text; zeros if it is null or empty."""
    data = (text or "").encode("utf-8", "surrogatepass")
    words = text.split() if text else []
    n, size = len(words), len(data)
    if not n:
        return [np.log1p(size), *[0.0] * (len(FEATURES) - 1)]
    kinds = _KIND_OF @ np.bincount(np.frombuffer(data, np.uint8), minlength=256) / size
    seen = Counter(words)
    lines = [x for x in text.split("\n") if x.strip()]
    return [
        np.log1p(size), np.log1p(n), (size - n) / n, len(seen) / n, max(seen.values()) / n, sum(map(eq, words, words[1:])) / n, sum(c for w, c in seen.items() if w in STOPS) / n,
        *kinds, sum(c for w, c in seen.items() if w[0].isupper()) / n, np.log1p(len(lines)), np.log1p(size / len(lines)), len(set(lines)) / len(lines), sum(x.rstrip()[-1] in ".!?" for x in lines) / len(lines),
        len(zlib.compress(data, 1)) / size,
    ]


@dataclass
class Trees:
    """Flat arrays (tree, node) of complete binary trees: feature, threshold; and (tree, leaf) values."""

    feature: np.ndarray
    threshold: np.ndarray
    value: np.ndarray
    base: float

    def predict(self, x: np.ndarray) -> np.ndarray:
        """Probabilities of rows: all trees go down a level at a time."""
        rows, trees = np.arange(len(x))[:, None], np.arange(len(self.feature))[None, :]
        node = np.zeros((len(x), len(self.feature)), np.int64)
        for _ in range(self.feature.shape[1].bit_length()):
            node = 2 * node + 1 + (x[rows, self.feature[trees, node]] > self.threshold[trees, node])
        leaf = node - self.feature.shape[1]
        return 1 / (1 + np.exp(-(self.base + self.value[trees, leaf].sum(1))))


def boost(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH) -> Trees:
    """Fit trees by Newton steps of the logistic loss over histograms of the features.

    Without rows of both classes there are no trees, and the base rate is all.
    """
    nodes, rate = (1 << depth) - 1, (y.sum() + 0.5) / (len(y) + 1)
    base = float(np.log(rate / (1 - rate)))
    found = Trees(np.zeros((0, nodes), np.int64), np.zeros((0, nodes)), np.zeros((0, nodes + 1)), base)
    if len(np.unique(y)) < 2:
        return found
    edges = [np.unique(np.quantile(column, np.linspace(0, 1, HISTOGRAM + 1)[1:-1])) for column in x.T]
    cells = np.stack([np.searchsorted(e, column) for e, column in zip(edges, x.T, strict=True)], 1)
    width, features = HISTOGRAM, x.shape[1]
    flat = cells + width * np.arange(features)
    score = np.full(len(y), base)
    made = []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-score))
        g, h = p - y, p * (1 - p)
        node = np.zeros(len(y), np.int64)
        feature, threshold = np.zeros(nodes, np.int64), np.full(nodes, np.inf)
        for level in range(depth):
            first, n = (1 << level) - 1, 1 << level
            at = ((node - first)[:, None] * (features * width) + flat).ravel()
            sums = [np.bincount(at, np.repeat(w, features), n * features * width).reshape(n, features, width).cumsum(2) for w in (g, h)]
            gl, hl = sums
            gt, ht = gl[:, :1, -1:], hl[:, :1, -1:]
            gain = gl**2 / (hl + PENALTY) + (gt - gl) ** 2 / (ht - hl + PENALTY) - gt**2 / (ht + PENALTY)
            gain[(hl < LEAST) | (ht - hl < LEAST)] = 0
            best = gain.reshape(n, -1).argmax(1)
            for k, b in enumerate(best.tolist()):
                f, cell = divmod(b, width)
                if gain[k, f, cell] > 1e-9 and cell < len(edges[f]):
                    feature[first + k], threshold[first + k] = f, edges[f][cell]
            node = 2 * node + 1 + (x[np.arange(len(y)), feature[node]] > threshold[node])
        leaf = node - nodes
        value = -STEP * np.bincount(leaf, g, nodes + 1) / (np.bincount(leaf, h, nodes + 1) + PENALTY)
        score += value[leaf]
        made.append((feature, threshold, value))
    return Trees(*(np.stack(part) for part in zip(*made, strict=True)), base)


def hash_bound(most: int, n: int) -> int:
    """The 64-bit hashes up to this one are ``most`` of every ``n``, however large n is."""
    return -(1 << 63) + (min(most, n) << 64) // max(1, n) - (most >= n)


def bounded_sample(labelled: DataFrame, key: str, most: int = MAX_ROWS) -> DataFrame:
    """Rows with at most about ``most`` different values of ``key``, those with the least hashes; the share is set from the count of all."""
    n = labelled.agg(F.approx_count_distinct(key)).first()[0]
    return labelled if n <= most else labelled.where(F.xxhash64(key) <= F.lit(hash_bound(most, n)))


def labelled_texts(docs: DataFrame, labels: DataFrame, label: str, learns: Column, most: int = MAX_ROWS) -> DataFrame:
    """``text, y`` of a bounded sample of the labelled documents for which ``learns`` holds.

    The sample of ids has at most about ``most`` rows of 12 bytes, so it is broadcast.
    """
    known = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull()).groupBy("doc_id").agg(F.max(F.col(label).cast("int")).alias("y"))
    return docs.select("doc_id", "text").join(F.broadcast(bounded_sample(known.where(learns), "doc_id", most)), "doc_id")


def _statistics(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        yield pd.DataFrame({"x": [statistics(t if isinstance(t, str) else None) for t in frame["text"]], "y": frame["y"]})


def fit(sample: DataFrame) -> Trees:
    """Trees fitted on a bounded sample (``text``, ``y``), whose statistics are taken by tasks."""
    got = sample.select("text", "y").mapInPandas(_statistics, "x array<double>, y int").toPandas()
    x = np.stack(got["x"].tolist()) if len(got) else np.zeros((0, len(FEATURES)))
    return boost(x, got["y"].to_numpy(float))


def score(docs: DataFrame, trees: Trees, name: str = "score") -> DataFrame:
    """``docs`` with a column of scores of their whole ``text``, 0 to 1.

    Null and empty texts are scored as texts without words. Other columns pass
    through; repeated rows get equal scores; an empty table stays empty.
    """
    shared = docs.sparkSession.sparkContext.broadcast(trees)

    @F.pandas_udf("double")
    def rate(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = shared.value
        for batch in batches:
            x = np.array([statistics(t if isinstance(t, str) else None) for t in batch], float).reshape(-1, len(FEATURES))
            yield pd.Series(model.predict(x))

    return docs.withColumn(name, rate("text"))
