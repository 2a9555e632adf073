"""A gated recurrent layer in numpy: one update gate, trained by backpropagation through time.

h[t] = s + z * (c - s) with s = keep[t] * h[t-1], (a, b) = x[t] + s U, c = b / (1 +
|b|) and z = (1 + a / (1 + |a|)) / 2. Without a reset gate both halves need one
matrix product; the rational squashing costs a tenth of the hyperbolic tangent
here. Arrays are [time, lane, unit], so that a step is a few operations on all
lanes.
"""

from __future__ import annotations

import numpy as np


class Layer:
    """Forward and backward passes over a window; the weights live with the caller."""

    @staticmethod
    def forward(x: np.ndarray, u: np.ndarray, h: np.ndarray, keep: np.ndarray | None = None) -> tuple[np.ndarray, ...]:
        """States before each step (after ``keep``), gates, candidates and the last state."""
        steps, lanes, units = x.shape[0], x.shape[1], u.shape[0]
        before = np.empty((steps, lanes, units), np.float32)
        gates = np.empty((steps, lanes, 2 * units), np.float32)
        move = np.empty((lanes, units), np.float32)
        room = np.empty((lanes, 2 * units), np.float32)
        # gates take the first half: (1 + a) / 2, whole rows at a time
        scale, shift = np.ones((lanes, 2 * units), np.float32), np.zeros((lanes, 2 * units), np.float32)
        scale[:, :units], shift[:, :units] = 0.5, 0.5
        h = h.copy()
        for t in range(steps):
            if keep is not None:
                h *= keep[t][:, None]
            before[t] = h
            a = gates[t]
            np.matmul(h, u, out=a)
            a += x[t]
            np.abs(a, out=room)
            room += 1.0
            a /= room
            a *= scale
            a += shift
            np.subtract(a[:, units:], h, out=move)
            move *= a[:, :units]
            h += move
        return before, gates, h

    @staticmethod
    def backward(before: np.ndarray, gates: np.ndarray, u: np.ndarray, dbefore: np.ndarray, dlast: np.ndarray | None = None, keep: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Gradients of the inputs and of ``u``, given those of the states before each step and of the last."""
        units = u.shape[0]
        z, c = gates[..., :units], gates[..., units:]
        # what does not depend on later steps is worked out for all of them at once
        to_gate = (c - before) * 0.5 * (1 - np.abs(2 * z - 1)) ** 2
        to_candidate = z * (1 - np.abs(c)) ** 2
        stays, turned = 1 - z, np.ascontiguousarray(u.T)
        dx = np.empty_like(gates)
        dh = np.zeros_like(before[0]) if dlast is None else dlast.copy()
        for t in range(len(before) - 1, -1, -1):
            da = dx[t]
            np.multiply(dh, to_gate[t], out=da[:, :units])
            np.multiply(dh, to_candidate[t], out=da[:, units:])
            dh *= stays[t]
            dh += da @ turned
            dh += dbefore[t]
            if keep is not None:
                dh *= keep[t][:, None]
        return dx, before.reshape(-1, units).T @ dx.reshape(-1, 2 * units)


class Adam:
    """Steps for a list of arrays, changed in place."""

    def __init__(self, arrays: list[np.ndarray], rate: float):
        self.arrays, self.rate, self.steps = arrays, rate, 0
        self.first = [np.zeros_like(a) for a in arrays]
        self.second = [np.zeros_like(a) for a in arrays]

    def step(self, gradients: list[np.ndarray], scale: float = 1.0) -> None:
        self.steps += 1
        rate = float(self.rate * scale * np.sqrt(1 - 0.99**self.steps) / (1 - 0.9**self.steps))
        for a, g, m, v in zip(self.arrays, gradients, self.first, self.second):
            room = g - m
            room *= 0.1
            m += room
            np.multiply(g, g, out=room)
            room -= v
            room *= 0.01
            v += room
            np.sqrt(v, out=room)
            room += 1e-8
            np.divide(m, room, out=room)
            room *= rate
            a -= room


def added_rows(index: np.ndarray, rows: np.ndarray, count: int) -> np.ndarray:
    """Sum of ``rows`` by ``index`` into ``count`` rows."""
    order = np.argsort(index, kind="stable")
    sorted_ = index[order]
    starts = np.flatnonzero(np.concatenate([[True], sorted_[1:] != sorted_[:-1]])) if len(sorted_) else np.zeros(0, int)
    out = np.zeros((count, rows.shape[1]), rows.dtype)
    if len(starts):
        out[sorted_[starts]] = np.add.reduceat(rows[order], starts, axis=0)
    return out
