"""Minimising smooth functions, and logistic regression over sparse rows."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np


def minimise(fun: Callable[[np.ndarray], tuple[float, np.ndarray]], x: np.ndarray, steps: int = 100, memory: int = 8) -> np.ndarray:
    """L-BFGS with backtracking; fun gives value and gradient."""
    value, grad = fun(x)
    past: list[tuple[np.ndarray, np.ndarray, float]] = []
    for _ in range(steps):
        q, alphas = grad.copy(), []
        for s, y, rho in reversed(past):
            alphas.append(a := rho * (s @ q))
            q -= a * y
        if past:
            q *= (past[-1][0] @ past[-1][1]) / (past[-1][1] @ past[-1][1])
        else:
            q /= max(1.0, np.linalg.norm(q))
        for (s, y, rho), a in zip(past, reversed(alphas), strict=True):
            q += s * (a - rho * (y @ q))
        slope, rate = -(grad @ q), 1.0
        if slope > -1e-12:
            break
        while True:
            new, new_grad = fun(x - rate * q)
            if new <= value + 1e-4 * rate * slope or rate < 1e-10:
                break
            rate /= 2
        s, y = -rate * q, new_grad - grad
        if s @ y > 1e-12:
            past = [*past, (s, y, 1 / (s @ y))][-memory:]
        done = value - new < 1e-7 * max(1.0, abs(value))
        x, value, grad = x + s, new, new_grad
        if done:
            break
    return x


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -35, 35)))


def fit_logistic(forward: Callable[[np.ndarray], np.ndarray], backward: Callable[[np.ndarray], np.ndarray], y: np.ndarray, width: int, l2: float, weight: np.ndarray | None = None, steps: int = 100) -> tuple[np.ndarray, float]:
    """Weights and intercept. forward(w): the examples times w; backward(e): e times the examples. The intercept isn't penalised."""
    weight = np.ones(len(y)) if weight is None else weight

    def loss(x: np.ndarray) -> tuple[float, np.ndarray]:
        z = forward(x[:-1]) + x[-1]
        err = weight * (sigmoid(z) - y)
        value = (weight * (np.logaddexp(0, z) - y * z)).sum() + l2 / 2 * (x[:-1] @ x[:-1])
        return value, np.append(backward(err) + l2 * x[:-1], err.sum())

    x = minimise(loss, np.zeros(width + 1), steps)
    return x[:-1], float(x[-1])


class SparseRows:
    """Rows that each hold some columns once, all of a column's entries having the same value. Two bytes an entry; products are taken by blocks of rows."""

    def __init__(self, cols: np.ndarray, lengths: np.ndarray, values: np.ndarray, rows_a_block: int = 256):
        self.values, self.blocks = values, []
        ends = np.cumsum(lengths)
        for a in range(0, len(lengths), rows_a_block):
            own = lengths[a : a + rows_a_block]
            self.blocks.append((own, cols[ends[a] - own[0] : ends[a + len(own) - 1]]))

    def forward(self, w: np.ndarray) -> np.ndarray:
        scaled = self.values * w
        return np.concatenate([np.bincount(np.repeat(np.arange(len(n)), n), scaled[cols], len(n)) for n, cols in self.blocks])

    def backward(self, err: np.ndarray) -> np.ndarray:
        out, at = np.zeros(len(self.values)), 0
        for n, cols in self.blocks:
            out += np.bincount(cols, np.repeat(err[at : at + len(n)], n), len(out))
            at += len(n)
        return out * self.values
