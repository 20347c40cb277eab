"""E8 lattice points: decoding and the cells next to a point."""

from __future__ import annotations

import itertools

import numpy as np


def _d8(x: np.ndarray) -> np.ndarray:
    """Nearest points with integer coordinates of even sum: round, and where the sum is odd, round the coordinate of the largest error the other way."""
    r = np.rint(x)
    err = x - r
    worst = np.argmax(np.abs(err), axis=1)
    at = np.arange(len(x)), worst
    flip = np.where(err[at] >= 0, 1.0, -1.0)
    r[at] += np.where(r.sum(axis=1) % 2 != 0, flip, 0.0)
    return r


def decode(x: np.ndarray) -> np.ndarray:
    """Nearest E8 points to rows of 8 coordinates: the nearer of the nearest of D8 and of D8 + 1/2."""
    a, b = _d8(x), _d8(x - 0.5) + 0.5
    nearer = ((x - a) ** 2).sum(axis=1) <= ((x - b) ** 2).sum(axis=1)
    return np.where(nearer[:, None], a, b)


def roots() -> np.ndarray:
    """The 240 shortest vectors, of squared length 2: steps to the neighbouring cells."""
    out = []
    for i, j in itertools.combinations(range(8), 2):
        for s, t in itertools.product((1, -1), repeat=2):
            v = np.zeros(8)
            v[i], v[j] = s, t
            out.append(v)
    out += [np.array(v) for v in itertools.product((0.5, -0.5), repeat=8) if sum(x < 0 for x in v) % 2 == 0]
    return np.array(out)


ROOTS = roots()


#: Neighbours of either block that are tried together: the i-th nearest of one with the j-th nearest of the other.
TOGETHER = tuple((i, j) for i in range(4) for j in range(4) if (i + 1) * (j + 1) <= 4)


def cells(x: np.ndarray, n: int) -> np.ndarray:
    """Rows of 16 coordinates, two blocks of 8 -> shape (rows, 1 + n + len(TOGETHER), 16): the own cell of each row, the n next to it in one
    block that are nearest, and some next to it in both."""
    blocks = [x[:, :8], x[:, 8:]]
    own = [decode(b) for b in blocks]
    near = [(b - p) @ ROOTS.T for b, p in zip(blocks, own, strict=True)]
    both = np.concatenate(near, axis=1)
    best = np.argpartition(-both, n - 1, axis=1)[:, :n]
    out = np.repeat(np.concatenate(own, axis=1)[:, None, :], 1 + n + len(TOGETHER), axis=1)
    for k in (0, 1):
        i, j = np.nonzero(best // len(ROOTS) == k)
        out[i, 1 + j, 8 * k : 8 * k + 8] += ROOTS[best[i, j] % len(ROOTS)]
        first = np.argpartition(-near[k], 4, axis=1)[:, :4]
        first = np.take_along_axis(first, np.argsort(-np.take_along_axis(near[k], first, axis=1), axis=1), axis=1)
        for place, pair in enumerate(TOGETHER):
            out[:, 1 + n + place, 8 * k : 8 * k + 8] += ROOTS[first[:, pair[k]]]
    return out
