"""Language of a text: a bidirectional gated recurrent network over its bytes.

Texts are read in windows of ``CORE`` bytes with ``MARGIN`` bytes of context on
either side; two layers run over all windows of a block at once, one from each
end, and every byte of every core gets a probability per language. A document's
probabilities are the means over its letters' positions.

The network is trained on the driver by backpropagation through time, on at most
``SAMPLE`` documents (smallest hash of the id) and ``WINDOWS`` random windows of
each. Scoring reads every byte of every text.

Defined cases: texts that are null or have no letter are ``und`` with score 0,
and so is everything if nothing could be learned. Null languages are not learned
from; rows with null ids are labelled, never learned from.
"""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitalgrid.llm import common
from vitalgrid.llm.recurrent import Adam, Layer, added_rows

FOLDS, HELD_OUT = 3, 1
UNKNOWN = "und"
SAMPLE, WINDOWS, PASSES = 3_000, 3, 4
CORE, MARGIN = 176, 8
UNITS, LANES, BATCH = 8, 1024, 96
RATE = 0.03

_LETTER = re.compile(r"[^\W\d_]")
#: Positions that count: ASCII letters and all bytes of other characters.
_COUNTED = np.array([chr(b).isalpha() or b >= 128 for b in range(128)] + [True] * 128)


class Network:
    """Weights and passes; bytes of padding are 0."""

    def __init__(self, languages: list[str], seed: int = 7):
        rng = np.random.default_rng(seed)
        h, k = UNITS, len(languages)
        self.languages = languages
        small = lambda *shape, scale: (rng.standard_normal(shape) * scale).astype(np.float32)
        self.x = [small(256, 2 * h, scale=0.3) for _ in range(2)]
        for x in self.x:
            x[:, :h] -= 1.0  # gates start rather closed, so that states reach back
        self.u = [small(h, 2 * h, scale=0.3) for _ in range(2)]
        self.out = small(2 * h, k, scale=0.3)
        self.bias = np.zeros(k, np.float32)

    def arrays(self) -> list[np.ndarray]:
        return [*self.x, *self.u, self.out, self.bias]

    def states(self, windows: np.ndarray) -> tuple[np.ndarray, list]:
        """States at every byte, [time, window, 2 units]: what both layers know once they have read it."""
        both, cache = [], []
        for side, sequence in enumerate((windows, windows[::-1])):
            before, gates, last = Layer.forward(
                self.x[side][sequence], self.u[side], np.zeros((windows.shape[1], UNITS), np.float32)
            )
            after = np.concatenate([before[1:], last[None]])
            both.append(after if side == 0 else after[::-1])
            cache.append((sequence, before, gates))
        return np.concatenate(both, axis=2), cache

    def labelled(self, states: np.ndarray) -> np.ndarray:
        """Probability of each language at each byte, [language, time, window]."""
        p = self.out.T @ states.reshape(-1, 2 * UNITS).T + self.bias[:, None]
        p -= p.max(axis=0)
        np.exp(p, out=p)
        p /= p.sum(axis=0)
        return p.reshape(-1, *states.shape[:2])

    def gradients(self, windows: np.ndarray, truth: np.ndarray, counted: np.ndarray) -> list[np.ndarray]:
        states, cache = self.states(windows)
        d = self.labelled(states)
        d[truth, :, np.arange(windows.shape[1])] -= 1
        d *= (counted / max(1, counted.sum())).astype(np.float32)
        flat = np.ascontiguousarray(d.reshape(len(d), -1).T)
        dout = states.reshape(-1, 2 * UNITS).T @ flat
        dstates = (flat @ self.out.T).reshape(states.shape)
        dx, du = [], []
        for side, (sequence, before, gates) in enumerate(cache):
            own = dstates[:, :, side * UNITS : (side + 1) * UNITS]
            own = own if side == 0 else own[::-1]
            # the state after step t is the one before step t + 1
            shifted = np.concatenate([np.zeros_like(own[:1]), own[:-1]])
            a, b = Layer.backward(before, gates, self.u[side], shifted, own[-1])
            dx.append(added_rows(sequence.ravel(), a.reshape(-1, 2 * UNITS), 256))
            du.append(b)
        return [*dx, *du, dout, flat.sum(axis=0)]


def cut(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows of all texts as [byte, window], the text of each, and the bytes of each window's core."""
    span = CORE + 2 * MARGIN
    sizes = np.array([len(t) for t in texts], np.int64)
    # margins of zeros around every text, and room for the last window
    gap = bytes(span)
    flat = np.frombuffer(gap + gap.join(texts) + gap, np.uint8)
    begins = np.cumsum(sizes + span) - sizes
    counts = -(-sizes // CORE)
    owner = np.repeat(np.arange(len(texts)), counts)
    nth = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
    starts = begins[owner] + nth * CORE - MARGIN
    return flat[starts[None, :] + np.arange(span)[:, None]], owner, np.minimum(CORE, sizes[owner] - nth * CORE)


def fit(texts: list[bytes], languages: list[str], seed: int = 11) -> Network:
    names = sorted(set(languages))
    net = Network(names)
    if len(names) < 2:
        return net
    rng = np.random.default_rng(seed)
    windows, owner, core = cut(texts)
    truth = np.array([names.index(x) for x in languages])
    chosen = np.zeros(0, np.int64)
    if len(owner):
        order = np.lexsort((rng.random(len(owner)), owner))
        rank = np.arange(len(order)) - np.searchsorted(owner[order], owner[order])
        chosen = np.sort(order[rank < WINDOWS])
    at = np.arange(CORE + 2 * MARGIN)[:, None]
    adam = Adam(net.arrays(), RATE)
    steps = PASSES * -(-len(chosen) // BATCH)
    for step, part in enumerate(p for _ in range(PASSES) for p in np.array_split(rng.permutation(chosen), max(1, -(-len(chosen) // BATCH)))):
        sequence = windows[:, part]
        counted = _COUNTED[sequence] & (at >= MARGIN) & (at < MARGIN + core[part])
        adam.step(net.gradients(sequence, truth[owner[part]], counted), 1 - 0.9 * step / steps)
    return net


def pooled(net: Network, texts: list[bytes]) -> np.ndarray:
    """Mean probability of each language over each text's letter positions; zeros without any."""
    windows, owner, core = cut(texts)
    sums, n = np.zeros((len(texts), len(net.languages))), np.zeros(len(texts))
    at = np.arange(CORE)[:, None]
    for k in range(0, len(owner), LANES):
        part = windows[:, k : k + LANES]
        p = net.labelled(net.states(part)[0][MARGIN : MARGIN + CORE])
        counted = _COUNTED[part[MARGIN : MARGIN + CORE]] & (at < core[k : k + LANES])
        own = owner[k : k + LANES]
        np.add.at(sums, own, (p * counted).sum(axis=1).T)
        np.add.at(n, own, counted.sum(axis=0))
    return sums / np.maximum(n, 1)[:, None]


def train(docs: DataFrame, sample: int = SAMPLE) -> Network:
    """Fit on up to ``sample`` documents with a language, outside the held-out fold."""
    known = docs.filter("lang IS NOT NULL AND text IS NOT NULL AND doc_id IS NOT NULL").filter(
        ~common.in_fold(F.col("doc_id"), FOLDS, HELD_OUT)
    )
    # the sample is chosen by its ids alone; texts are read for the chosen only
    ids = known.select(F.col("doc_id")).distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    rows = known.join(F.broadcast(ids), "doc_id").select("doc_id", "lang", "text").dropDuplicates(["doc_id"])
    found = sorted(((r["doc_id"], r["lang"], (r["text"] or "").encode()) for r in rows.toLocalIterator()), key=lambda r: r[0])
    return fit([t for _, _, t in found], [lang for _, lang, _ in found])


def predicted(docs: DataFrame, net: Network) -> DataFrame:
    """``doc_id, held_out, lang_pred, score`` of every row of ``docs``."""
    shared = docs.sparkSession.sparkContext.broadcast(net)

    def work(batch: list[bytes], _) -> dict:
        net = shared.value
        letters = [bool(_LETTER.search(t.decode(errors="replace"))) for t in batch]
        if not net.languages:
            return {"lang_pred": [UNKNOWN] * len(batch), "score": [0.0] * len(batch)}
        p = pooled(net, [t if a else b"" for t, a in zip(batch, letters)])
        best = p.argmax(axis=1)
        return {
            "lang_pred": [net.languages[b] if a else UNKNOWN for a, b in zip(letters, best.tolist())],
            "score": np.clip(np.where(letters, p[np.arange(len(p)), best], 0.0), 0, 1),
        }

    rows = common.over_texts(common.texts(docs), work, "lang_pred string, score double")
    return rows.select("doc_id", common.in_fold(F.col("doc_id"), FOLDS, HELD_OUT).alias("held_out"), "lang_pred", "score")
