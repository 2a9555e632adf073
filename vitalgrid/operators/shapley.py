"""Exact path-dependent Shapley contributions of forest predictions.

Spark partitions the rows and appends one array column; only the features the
forest uses travel to Python, as Arrow batches. Inside a batch, rows that fall
between the same split points get the same answer, so each distinct
combination is computed once.

For a leaf with value ``v`` and distinct path features D (m of them), a row
satisfies (o=1) or misses (o=0) the interval of each feature, and z is the share
of training cover that follows the path on that feature:

    phi_i += v * (o_i - z_i) * integral over t in (0, 1) of
             the product over j != i of (z_j * (1 - t) + o_j * t)

(Lundberg et al., tree explanations; the Shapley weights are the integrals of
t^k (1-t)^(m-1-k).) The integrand has degree m - 1, so (m + 1) // 2 points of
Gauss and Legendre give it exactly. A leaf's answers for all 2^m patterns of o
are worked out once per batch by outer products; rows only look theirs up.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vitalgrid.codebook import FEATURES
from vitalgrid.operators.forest import Forest

# The batch helpers below travel with the task, so workers need no installed copy.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


class LeafArrays:
    """Leaves of a forest as flat arrays; split points are replaced by their positions.

    ``offset[k]:offset[k + 1]`` are the path features of leaf k in ``where``,
    ``first``, ``last`` (the positions its interval holds) and ``share``.
    """

    def __init__(self, forest: Forest) -> None:
        leaves = [leaf for leaf in forest.leaves() if leaf.share]
        cuts: dict[str, set[float]] = {}
        for leaf in leaves:
            for name in leaf.share:
                edges = {leaf.low[name], leaf.high[name]} - {float("-inf"), float("inf")}
                cuts.setdefault(name, set()).update(edges)
        self.used = [f for f in FEATURES if f in cuts]
        self.cuts = [np.array(sorted(cuts[f])) for f in self.used]
        column = {f: i for i, f in enumerate(self.used)}
        where, first, last, share, sizes = [], [], [], [], []
        for leaf in leaves:
            names = sorted(leaf.share, key=column.get)
            sizes.append(len(names))
            where += [column[n] for n in names]
            # a value's position is the number of cuts below it, so the interval
            # (low, high] holds positions first..last
            first += [self._position(column[n], leaf.low[n], 1, 0) for n in names]
            last += [self._position(column[n], leaf.high[n], 0, len(self.cuts[column[n]])) for n in names]
            share += [leaf.share[n] for n in names]
        self.offset = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
        self.where, self.first, self.last = (np.array(x, np.int16) for x in (where, first, last))
        self.share = np.array(share)
        self.value = np.array([leaf.value for leaf in leaves]).reshape(-1, 3)

    def _position(self, column: int, edge: float, step: int, open_end: int) -> int:
        if np.isinf(edge):
            return open_end
        return int(np.searchsorted(self.cuts[column], edge)) + step

    def positions(self, values: list[np.ndarray]) -> np.ndarray:
        return np.stack(
            [np.searchsorted(c, v, side="left") for c, v in zip(self.cuts, values)], axis=1
        )


def pattern_weights(share: np.ndarray) -> np.ndarray:
    """Contribution factor per path feature and pattern; bit j of a pattern says whether feature j is met."""
    m = len(share)
    points, weights = np.polynomial.legendre.leggauss((m + 1) // 2)
    t = (points + 1) / 2
    missed, met = np.outer(share, 1 - t), np.outer(share, 1 - t) + t
    products = np.ones((1, len(t)))
    for j in range(m):
        products = np.concatenate([products * missed[j], products * met[j]])
    products *= weights / 2
    out = np.empty((m, 1 << m))
    for i in range(m):
        # patterns without and with bit i, seen as the middle axis
        parts = products.reshape(1 << (m - 1 - i), 2, 1 << i, len(t))
        into = out[i].reshape(1 << (m - 1 - i), 2, 1 << i)
        into[:, 0] = parts[:, 0] @ (1 / missed[i]) * -share[i]
        into[:, 1] = parts[:, 1] @ (1 / met[i]) * (1 - share[i])
    return out


def contributions(arrays: LeafArrays, positions: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """Contributions (rows x used features) to the given class of each row."""
    # one line of memory per feature: every step below runs along it
    held = np.ascontiguousarray(positions.T.astype(np.uint16))
    n = held.shape[1]
    phi = np.zeros(held.shape)
    code, moved = np.empty(n, np.uint16), np.empty(n, np.uint16)
    found, inside = np.empty(n), np.empty(n, bool)
    # an empty interval is put where no position reaches
    empty = arrays.last < arrays.first
    first = np.where(empty, 65535, arrays.first).astype(np.uint16)
    width = np.where(empty, 0, arrays.last - arrays.first).astype(np.uint16)
    line = classes.astype(np.int64)
    for k, (begin, end) in enumerate(zip(arrays.offset[:-1].tolist(), arrays.offset[1:].tolist())):
        code[:] = 0
        for j in range(begin, end):
            # positions below the interval wrap around to the far end
            np.subtract(held[arrays.where[j]], first[j], out=moved)
            np.less_equal(moved, width[j], out=inside)
            moved[:] = inside
            moved <<= j - begin
            code |= moved
        patterns = 1 << (end - begin)
        at = line * patterns + code
        tables = pattern_weights(arrays.share[begin:end])[:, None, :] * arrays.value[k][:, None]
        for i, table in enumerate(tables.reshape(end - begin, -1)):
            np.take(table, at, out=found, mode="clip")
            row = phi[arrays.where[begin + i]]
            np.add(row, found, out=row)
    return phi.T


def shap_column(forest: Forest, class_index: Column) -> Column:
    """``array<double>`` of 21 contributions to the chosen class, in feature order."""
    arrays = LeafArrays(forest)
    used = arrays.used
    # sent once per executor, not with every task
    shared = SparkSession.active().sparkContext.broadcast(arrays)
    place = [FEATURES.index(f) for f in used]

    @F.arrow_udf("array<double>")
    def explain(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        arrays = shared.value
        for columns in batches:
            rows = len(columns[0])
            full = np.zeros((rows, len(FEATURES)))
            if used and rows:
                *values, classes = [c.to_numpy(zero_copy_only=False) for c in columns]
                cells = np.column_stack([arrays.positions(values), classes])
                distinct, back = np.unique(cells, axis=0, return_inverse=True)
                phi = contributions(arrays, distinct[:, :-1], distinct[:, -1].astype(int))
                full[:, place] = phi[back.reshape(-1)]
            offsets = pa.array(np.arange(0, full.size + 1, len(FEATURES), dtype=np.int32))
            yield pa.ListArray.from_arrays(offsets, pa.array(full.reshape(-1)))

    return explain(*[F.col(f) for f in used], class_index.cast("int"))


def with_shap(df: DataFrame, forest: Forest, class_index: Column | None = None) -> DataFrame:
    """Add ``shap`` for the predicted class (or another one). Rows stay where they are."""
    chosen = F.col("predicted_class") if class_index is None else class_index
    return df.withColumn("shap", shap_column(forest, chosen))
