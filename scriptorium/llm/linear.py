"""Logistic regression over sparse binary rows, fitted on the driver from a bounded sample."""

from __future__ import annotations

from collections.abc import Iterable
from itertools import islice

import numpy as np

#: Rows worked on at once.
ROWS = 500


def fit_logistic(rows: Iterable[np.ndarray], labels: np.ndarray, scale: np.ndarray, l2: float = 1.0, rounds: int = 60, memory: int = 8) -> tuple[np.ndarray, float]:
    """(weights, intercept) that minimise the log-loss with an L2 penalty over x_j = scale_j for each j in a row.

    Limited-memory BFGS with a backtracking line search; the intercept isn't penalised. Deterministic for given rows.
    """
    n, d = len(labels), len(scale)
    # a few rows at a time, so that beside the columns themselves only a bounded step is held
    left, steps_of = iter(rows), []
    for at in range(0, n, ROWS):
        some = list(islice(left, ROWS))
        steps_of.append((np.concatenate(some), np.array([len(r) for r in some]), labels[at : at + ROWS]))

    def loss(w: np.ndarray) -> tuple[float, np.ndarray]:
        value, grad = l2 / 2 * float((w[:d] ** 2).sum()), np.append(l2 * w[:d], 0.0)
        for columns, sizes, truth in steps_of:
            owner = np.repeat(np.arange(len(sizes)), sizes)
            margin = np.bincount(owner, weights=(scale * w[:d])[columns], minlength=len(sizes)) + w[d]
            error = 1 / (1 + np.exp(-np.clip(margin, -50, 50))) - truth
            grad[:d] += np.bincount(columns, weights=error[owner], minlength=d) * scale
            grad[d] += error.sum()
            value += float(np.logaddexp(0, margin).sum() - (truth * margin).sum())
        return value, grad

    w = np.zeros(d + 1)
    rate = np.clip(labels.mean() if n else 0.5, 1e-3, 1 - 1e-3)
    w[d] = np.log(rate / (1 - rate))
    value, grad = loss(w)
    steps: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(rounds):
        direction, saved = -grad.copy(), []
        for s, y in reversed(steps):
            a = s @ direction / (y @ s)
            saved.append(a)
            direction -= a * y
        if steps:
            s, y = steps[-1]
            direction *= s @ y / (y @ y)
        else:
            direction /= max(1.0, float(np.linalg.norm(grad)))
        for (s, y), a in zip(steps, reversed(saved)):
            direction += s * (a - y @ direction / (y @ s))
        slope, size = float(grad @ direction), 1.0
        if slope >= 0:
            break
        while True:
            after, grad_after = loss(w + size * direction)
            if after <= value + 1e-4 * size * slope or size < 1e-8:
                break
            size /= 2
        s, y = size * direction, grad_after - grad
        if s @ y > 1e-10:
            steps = [*steps, (s, y)][-memory:]
        done = value - after < 1e-5 * max(1.0, abs(value))
        w, value, grad = w + s, after, grad_after
        if done:
            break
    return w[:d], float(w[d])
