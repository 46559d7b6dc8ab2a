"""Generative label models over the votes of weak labellers, and a linear classifier trained on their posteriors.

The model has a hidden binary label and, for each labeller, a table of P(vote | label), whose diagonal is its
accuracy. With `tree`, each labeller but one also depends on another one: the tree with most conditional mutual
information given the label (Chow and Liu), chosen again as the posterior changes, stands for their correlations.
Input is counts of vote patterns, so its size is bounded by the patterns and not by the documents.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class LabelModel:
    prior: np.ndarray  # P(label), 2
    parent: list[int]  # -1: none
    tables: list[np.ndarray]  # [label, vote of parent (0 without one), vote]

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        """P(label 1) for each row of votes."""
        log = np.tile(np.log(self.prior), (len(votes), 1))
        for j, (p, t) in enumerate(zip(self.parent, self.tables, strict=True)):
            above = votes[:, p] if p >= 0 else np.zeros(len(votes), dtype=int)
            log += np.log(t[:, above, votes[:, j]]).T
        log -= log.max(axis=1, keepdims=True)
        e = np.exp(log)
        return e[:, 1] / e.sum(axis=1)


def _tree(votes: np.ndarray, weight: np.ndarray, kinds: int) -> list[int]:
    v = votes.shape[1]
    gain = np.zeros((v, v))
    for y in (0, 1):
        w = weight[:, y]
        total = max(w.sum(), 1e-9)
        for a in range(v):
            for b in range(a):
                joint = np.bincount(votes[:, a] * kinds + votes[:, b], w, kinds * kinds).reshape(kinds, kinds) / total + 1e-12
                alone = joint.sum(1, keepdims=True) * joint.sum(0, keepdims=True)
                gain[a, b] = gain[b, a] = gain[a, b] + total * float((joint * np.log(joint / alone)).sum())
    parent, inside = [-1] * v, [0]
    while len(inside) < v:
        _, a, b = max((gain[a, b], -a, -b) for a in inside for b in range(v) if b not in inside)
        parent[-b] = -a
        inside.append(-b)
    return parent


def fit(votes: np.ndarray, counts: np.ndarray, first: np.ndarray, kinds: int, tree: bool = False, rounds: int = 50) -> LabelModel:
    """Expectation-maximisation from the posterior `first` of each pattern."""
    q = np.stack([1 - first, first], axis=1)
    parent = [-1] * votes.shape[1]
    model = None
    for k in range(rounds):
        w = q * counts[:, None]
        if tree and k % 5 == 0 and votes.shape[1] > 1 and k <= 20:
            parent = _tree(votes, w, kinds)
        tables = []
        for j, p in enumerate(parent):
            above = votes[:, p] if p >= 0 else np.zeros(len(votes), dtype=int)
            t = np.stack([np.bincount(above * kinds + votes[:, j], w[:, y], kinds * kinds).reshape(kinds, kinds) for y in (0, 1)])
            t += 0.05
            tables.append(t / t.sum(axis=2, keepdims=True))
        prior = w.sum(axis=0) + 1
        model = LabelModel(prior / prior.sum(), parent, tables)
        now = model.posterior(votes)
        if np.abs(now - q[:, 1]).max() < 1e-7:
            break
        q = np.stack([1 - now, now], axis=1)
    return model


def linear(rows: list[np.ndarray], values: list[np.ndarray], target: np.ndarray, size: int, l2: float = 1e-4, steps: int = 400, rate: float = 0.1) -> tuple[np.ndarray, float]:
    """Weights and bias of a logistic classifier with soft targets over sparse rows, by full-batch Adam."""
    n = len(rows)
    if not n:
        return np.zeros(size), 0.0
    at, ix, x = np.repeat(np.arange(n), [len(r) for r in rows]), np.concatenate(rows).astype(np.int64), np.concatenate(values)
    w, bias = np.zeros(size), 0.0
    m, v = np.zeros(size + 1), np.zeros(size + 1)
    for t in range(1, steps + 1):
        p = 1 / (1 + np.exp(-np.clip(np.bincount(at, w[ix] * x, n) + bias, -30, 30)))
        d = (p - target) / n
        g = np.append(np.bincount(ix, d[at] * x, size) + l2 * w, d.sum())
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        step = rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        w, bias = w - step[:-1], bias - step[-1]
    return w, float(bias)
