"""Quality classifier: histogram gradient-boosted trees over document statistics.

A text becomes ``FEATURES`` numbers in one pass over its bytes and words. Their
values are cut at quantiles into at most 255 bins. Trees grow depth by depth:
per node and feature one histogram of gradients and curvatures decides the best
split. A finished ensemble is flat arrays (feature, cut, children, value), and a
batch of rows walks down all of a tree's levels at once by array indexing.

The model is fitted on the driver from at most ``SAMPLE`` labelled rows, chosen
by the smallest hash of their ids, so the sample does not depend on how the
table is stored; scoring covers every whole text.

Defined cases: null and empty texts have all statistics zero and a score like
any other text. Rows with null ids are scored, never learned from. Null labels
are not learned from. With no labels, or labels of one kind, the score is their
share (a half without any).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitalgrid.llm import common

FOLDS, HELD_OUT = 4, 2
THRESHOLD = 0.7
#: Most labelled texts that the model is fitted on.
SAMPLE = 20_000
TREES, DEPTH, RATE, BINS = 120, 4, 0.1, 64
LEAST_HESSIAN, RIDGE = 1.0, 1.0

FEATURES = (
    "words", "bytes", "word_bytes", "long_words", "one_letter_words", "distinct_words", "top_word", "distinct_ends",
    "lines", "repeated_lines", "short_lines", "line_words", "upper", "digits", "beyond_ascii", "marks", "stops", "commas",
    "exclamations", "pipes", "quotes", "brackets", "capital_words", "upper_words", "repeated_windows", "marked_words", "same_next",
)

_UPPER = bytes(range(65, 91))
_DIGITS = bytes(range(48, 58))
_HIGH = bytes(range(128, 256))


def statistics(text: bytes) -> list[float]:
    """The features of one text, in the order of ``FEATURES``."""
    words = text.split()
    n, size = len(words), len(text)
    if not n:
        return [0.0] * len(FEATURES)
    lines = [line for line in text.split(b"\n") if line]
    m = max(1, len(lines))
    kinds: dict[bytes, int] = {}
    for word in words:
        kinds[word] = kinds.get(word, 0) + 1
    lengths = np.fromiter(map(len, words), np.int64, n)
    share = lambda chars: (size - len(text.translate(None, chars))) / size
    ends = [w[-1] for w in words]
    windows = common.windows(common.word_hashes(words), 3)
    return [
        np.log1p(n), np.log1p(size), size / n, float((lengths > 12).mean()), float((lengths == 1).mean()),
        len(kinds) / n, max(kinds.values()) / n, len(set(ends)) / min(n, 64),
        np.log1p(len(lines)), 1 - len(set(lines)) / m, sum(len(line) < 30 for line in lines) / m, n / m,
        share(_UPPER), share(_DIGITS), share(_HIGH), share(b"#*$%&<>"), share(b"."), share(b","),
        share(b"!"), share(b"|"), share(b"\"'"), share(b"()[]{}="),
        sum(w[0] in _UPPER for w in words) / n, sum(w.isupper() for w in words) / n,
        1 - len(np.unique(windows)) / len(windows) if len(windows) else 0.0,
        sum(e < 48 and e != 46 and e != 44 for e in ends) / n,
        sum(a == b for a, b in zip(words, words[1:])) / n,
    ]


class Trees:
    """A fitted ensemble as flat arrays; node k of a tree has children 2k + 1 and 2k + 2."""

    def __init__(self, base: float, feature: np.ndarray, cut: np.ndarray, value: np.ndarray):
        self.base, self.feature, self.cut, self.value = base, feature, cut, value

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for feature, cut, value in zip(self.feature, self.cut, self.value):
            node = np.zeros(len(x), np.int64)
            for _ in range(DEPTH):
                node = 2 * node + 1 + (x[rows, feature[node]] > cut[node])
            out += value[node - (2**DEPTH - 1)]
        return out

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.margin(x)))


def fit(x: np.ndarray, y: np.ndarray) -> Trees:
    """Boosting on the log loss. Splits that gain nothing send every row left."""
    inner = 2**DEPTH - 1
    if not len(y) or y.min() == y.max():
        share = np.clip(y.mean() if len(y) else 0.5, 1e-3, 1 - 1e-3)
        return Trees(float(np.log(share / (1 - share))), np.zeros((0, inner), np.int64), np.zeros((0, inner)), np.zeros((0, inner + 1)))
    features = x.shape[1]
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1])) for f in range(features)]
    binned = np.stack([np.searchsorted(e, x[:, f], side="left") for f, e in enumerate(edges)], axis=1)
    offset = np.arange(features) * BINS
    share = y.mean()
    base = float(np.log(share / (1 - share)))
    margin = np.full(len(y), base)
    held: list[tuple] = []
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-margin))
        g, h = y - p, np.maximum(p * (1 - p), 1e-6)
        feature, cut = np.zeros(inner, np.int64), np.full(inner, np.inf)
        node = np.zeros(len(y), np.int64)
        for depth in range(DEPTH):
            first, width = 2**depth - 1, 2**depth
            slot = ((node - first)[:, None] * features * BINS + offset + binned).ravel()
            total = width * features * BINS
            sums = [
                np.bincount(slot, weights=np.repeat(w, features), minlength=total).reshape(width, features, BINS).cumsum(axis=2)
                for w in (g, h)
            ]
            (gl, hl), (ga, ha) = sums, [s[:, :, -1:] for s in sums]
            gr, hr = ga - gl, ha - hl
            gain = gl**2 / (hl + RIDGE) + gr**2 / (hr + RIDGE) - ga**2 / (ha + RIDGE)
            gain[(hl < LEAST_HESSIAN) | (hr < LEAST_HESSIAN)] = 0
            best = gain.reshape(width, -1).argmax(axis=1)
            chosen, at = best // BINS, best % BINS
            split = (gain.reshape(width, -1)[np.arange(width), best] > 1e-9) & np.array([b < len(edges[f]) for f, b in zip(chosen, at)])
            feature[first : first + width] = chosen
            cut[first : first + width] = [edges[f][b] if s else np.inf for f, b, s in zip(chosen, at, split)]
            here = node - first
            right = split[here] & (binned[np.arange(len(y)), chosen[here]] > at[here])
            node = 2 * node + 1 + right
        leaf = node - inner
        value = RATE * np.bincount(leaf, weights=g, minlength=inner + 1) / (np.bincount(leaf, weights=h, minlength=inner + 1) + RIDGE)
        margin += value[leaf]
        held.append((feature, cut, value))
    return Trees(base, *(np.stack(c) for c in zip(*held)))


def featured(docs: DataFrame, *columns: str) -> DataFrame:
    """``doc_id``, ``columns`` and the statistics of every row as ``features``."""

    def work(batch: list[bytes], _) -> dict:
        return {"features": pa.array([statistics(t) for t in batch], pa.list_(pa.float64()))}

    return common.over_texts(common.texts(docs, *columns), work, "features array<double>", keep=("doc_id", *columns))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Trees:
    """Fit on up to ``sample`` labelled rows outside the held-out fold."""
    known = labels.filter("quality IN (0, 1) AND doc_id IS NOT NULL").filter(~common.in_fold(F.col("doc_id"), FOLDS, HELD_OUT))
    one = known.groupBy("doc_id").agg(F.max("quality").cast("int").alias("quality"))
    chosen = one.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    # at most ``sample`` rows of two numbers, far below any broadcast limit
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").join(F.broadcast(chosen), "doc_id")
    found = featured(rows, "quality").toArrow()
    if not found.num_rows:
        return fit(np.zeros((0, len(FEATURES))), np.zeros(0))
    order = np.argsort(found["doc_id"].to_numpy(), kind="stable")
    x = np.array(found["features"].to_pylist())[order]
    return fit(x, found["quality"].to_numpy().astype(float)[order])


def scored(docs: DataFrame, model: Trees) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every row of ``docs``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def work(batch: list[bytes], _) -> dict:
        x = np.array([statistics(t) for t in batch]).reshape(len(batch), -1)
        score = shared.value.probability(x)
        return {"score": score, "predicted": (score >= THRESHOLD).astype(np.int32)}

    rows = common.over_texts(common.texts(docs), work, "score double, predicted int")
    return rows.select("doc_id", common.in_fold(F.col("doc_id"), FOLDS, HELD_OUT).alias("held_out"), "score", "predicted")
