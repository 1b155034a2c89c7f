"""Linear-chain conditional random field in numpy.

A sequence of items has emission scores (one per label, from binary or real
features) and label-to-label transitions. ``fit`` maximises the conditional
log-likelihood with full-batch Adam over padded arrays; ``viterbi`` decodes
many sequences of any length at once.
"""
from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class CRF:
    weights: np.ndarray  # features x labels
    bias: np.ndarray     # labels
    start: np.ndarray    # labels
    step: np.ndarray     # label before x label

    def emissions(self, x: np.ndarray) -> np.ndarray:
        return x @ self.weights + self.bias

    def decode(self, x: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        return viterbi(self.emissions(x), lengths, self.start, self.step)


def viterbi(scores: np.ndarray, lengths: np.ndarray, start: np.ndarray, step: np.ndarray) -> np.ndarray:
    """Best labels of sequences that lie one after another in ``scores`` (items x
    labels). Of equal paths the one with the smaller labels wins."""
    lengths = np.asarray(lengths, dtype=np.int64)
    out = np.zeros(len(scores), dtype=np.int8)
    if not len(scores):
        return out
    first = np.cumsum(lengths) - lengths
    order = np.argsort(-lengths, kind="stable")
    first, lengths = first[order], lengths[order]
    active = int((lengths > 0).sum())
    back = np.zeros((len(scores), len(start)), dtype=np.int8)
    best = scores[first[:active]] + start
    # sequences still running at place t are a prefix of the order by length
    running = np.searchsorted(-lengths, -np.arange(1, lengths[0] + 1), side="right")
    for t in range(1, int(lengths[0])):
        n = int(running[t])
        at = first[:n] + t
        paths = best[:n, :, None] + step
        back[at] = paths.argmax(axis=1)
        best[:n] = paths.max(axis=1) + scores[at]
    label = best.argmax(axis=1).astype(np.int8)
    for t in range(int(lengths[0]) - 1, -1, -1):
        n = int(running[t])
        at = first[:n] + t
        out[at] = label[:n]
        if t:
            label[:n] = back[at, label[:n]]
    return out


def _logsumexp(a: np.ndarray, axis: int) -> np.ndarray:
    m = a.max(axis=axis, keepdims=True)
    return np.squeeze(m, axis) + np.log(np.exp(a - m).sum(axis=axis))


def fit(x: np.ndarray, y: np.ndarray, lengths: np.ndarray, labels: int, rounds: int = 150, rate: float = 0.1,
        l2: float = 1e-3, item_weight: np.ndarray | None = None) -> CRF:
    """Train on sequences that lie one after another in ``x`` (items x features)."""
    lengths = np.asarray(lengths)
    keep = lengths > 0
    first, lengths = (np.cumsum(lengths) - lengths)[keep], lengths[keep]
    features = x.shape[1]
    if not len(lengths):
        return CRF(np.zeros((features, labels)), np.zeros(labels), np.zeros(labels), np.zeros((labels, labels)))
    most = int(lengths.max())
    at = first[:, None] + np.minimum(np.arange(most), lengths[:, None] - 1)
    live = np.arange(most) < lengths[:, None]
    gold = y[at]
    target = np.eye(labels)[gold] * live[:, :, None]
    pairs = np.zeros((labels, labels))
    np.add.at(pairs, (gold[:, :-1][live[:, 1:]], gold[:, 1:][live[:, 1:]]), 1)
    n = float(len(lengths))
    state = [np.zeros((features, labels)), np.zeros(labels), np.zeros(labels), np.zeros((labels, labels))]
    mean, square = [np.zeros_like(s) for s in state], [np.zeros_like(s) for s in state]
    for r in range(1, rounds + 1):
        w, b, s, t = state
        e = (x @ w + b)[at]
        forward, backward = np.empty_like(e), np.zeros_like(e)
        forward[:, 0] = e[:, 0] + s
        for k in range(1, most):
            new = _logsumexp(forward[:, k - 1, :, None] + t, 1) + e[:, k]
            forward[:, k] = np.where(live[:, k, None], new, forward[:, k - 1])
        total = _logsumexp(forward[:, -1], 1)
        for k in range(most - 2, -1, -1):
            new = _logsumexp(t + (e[:, k + 1] + backward[:, k + 1])[:, None, :], 2)
            backward[:, k] = np.where(live[:, k + 1, None], new, 0.0)
        share = np.exp(forward + backward - total[:, None, None]) * live[:, :, None]
        expected = np.zeros((labels, labels))
        for k in range(1, most):
            both = np.exp(forward[:, k - 1, :, None] + t + (e[:, k] + backward[:, k])[:, None, :] - total[:, None, None])
            expected += (both * live[:, k, None, None]).sum(axis=0)
        gap = target - share
        flat = np.zeros((len(x), labels))
        np.add.at(flat, at[live], gap[live])
        grads = [x.T @ flat / n - l2 * w, flat.sum(axis=0) / n - l2 * b, gap[:, 0].sum(axis=0) / n - l2 * s,
                 (pairs - expected) / n - l2 * t]
        for i, g in enumerate(grads):
            mean[i] = 0.9 * mean[i] + 0.1 * g
            square[i] = 0.999 * square[i] + 0.001 * g * g
            state[i] = state[i] + rate * (mean[i] / (1 - 0.9**r)) / (np.sqrt(square[i] / (1 - 0.999**r)) + 1e-8)
    return CRF(*state)
