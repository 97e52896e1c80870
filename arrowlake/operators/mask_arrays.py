"""Boundaries and overlaps of many masks at once by array arithmetic, on flat column runs: owner (a number from 0 on), x, y1, y2."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np


def swept(owner: np.ndarray, x: np.ndarray, y1: np.ndarray, y2: np.ndarray, weights: list[np.ndarray], chosen: Callable[..., np.ndarray]) -> tuple[np.ndarray, ...]:
    """(owner, x, y1, y2): the stretches of each column of an owner where ``chosen`` holds of the sums of ``weights`` over the runs there."""
    owner, x, y = np.concatenate([owner, owner]), np.concatenate([x, x]), np.concatenate([y1, y2])
    steps = [np.concatenate([w, -w]) for w in weights]
    order = np.lexsort((y, x, owner))
    owner, x, y = owner[order], x[order], y[order]
    sums = [np.cumsum(w[order]) for w in steps]  # what begins in a column ends there, so each column starts at 0
    follows = (owner[1:] == owner[:-1]) & (x[1:] == x[:-1]) & (y[1:] > y[:-1])
    keep = np.flatnonzero(follows & chosen(*[c[:-1] for c in sums])) if len(y) else np.zeros(0, int)
    return owner[keep], x[keep], y[keep], y[keep + 1]


def boundaries(owner: np.ndarray, x: np.ndarray, y1: np.ndarray, y2: np.ndarray, h: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, ...]:
    """(owner, x, y1, y2): pixels that differ from their right, lower or lower right neighbour, as runs; ``h`` and ``w`` by owner.

    Beyond the last row and column an image goes on as it ends. A pixel is one of these where the square of the four
    holds some of the mask, but not only.
    """
    low = np.where(y2 == h[owner], y2, y2 - 1)
    whole = low > y1
    both = [np.concatenate([a, b[whole]]) for a, b in ((owner, owner), (x, x), (np.maximum(y1 - 1, 0), y1), (y2, low))]
    some = np.concatenate([np.ones(len(x), np.int64), np.zeros(int(whole.sum()), np.int64)])
    edge = np.flatnonzero(both[1] == w[both[0]] - 1)  # the last column is its own neighbour
    at = np.concatenate([np.arange(len(some)), np.arange(len(some)), edge])
    columns = np.concatenate([both[1], both[1] - 1, both[1][edge]])
    at, columns = at[columns >= 0], columns[columns >= 0]
    return swept(both[0][at], columns, both[2][at], both[3][at], [some[at], 1 - some[at]], lambda a, b: (a > 0) & (b < 2))


def surroundings(owner: np.ndarray, x: np.ndarray, y1: np.ndarray, y2: np.ndarray, h: np.ndarray, w: np.ndarray, radius: np.ndarray) -> tuple[np.ndarray, ...]:
    """Runs grown by ``radius`` pixels each way (a square), clipped to the image; runs of a column may overlap."""
    r = radius[owner]
    first, last = np.maximum(x - r, 0), np.minimum(x + r, w[owner] - 1)
    n = last - first + 1
    at = np.repeat(np.arange(len(x)), n)
    columns = first[at] + np.arange(len(at)) - np.repeat(np.cumsum(n) - n, n)
    return owner[at], columns, np.maximum(y1 - r, 0)[at], np.minimum(y2 + r, h[owner])[at]


def covered(one: tuple[np.ndarray, ...], two: tuple[np.ndarray, ...], owners: int) -> np.ndarray:
    """By owner, the pixels that lie in runs of both."""
    own = np.concatenate([np.ones(len(one[0]), np.int64), np.zeros(len(two[0]), np.int64)])
    met = swept(*[np.concatenate([a, b]) for a, b in zip(one, two, strict=True)], [own, 1 - own], lambda a, b: (a > 0) & (b > 0))
    return sized(met, owners)


def sized(runs: tuple[np.ndarray, ...], owners: int) -> np.ndarray:
    return np.bincount(runs[0], runs[3] - runs[2], owners).astype(np.int64)
