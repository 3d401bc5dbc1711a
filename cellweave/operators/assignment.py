"""One-to-one assignment of small score matrices: optimal (Hungarian, by shortest augmenting paths) or greedy."""

from __future__ import annotations

import numpy as np


def optimal(scores: np.ndarray) -> list[tuple[int, int]]:
    """Pairs (row, column) of the assignment with the largest total score."""
    if not scores.size:
        return []
    flipped = scores.shape[0] > scores.shape[1]
    cost = -(scores.T if flipped else scores).astype(float)
    n, m = cost.shape
    u, v, owner, way = np.zeros(n + 1), np.zeros(m + 1), np.zeros(m + 1, int), np.zeros(m + 1, int)
    for i in range(1, n + 1):
        owner[0], j0 = i, 0
        least, used = np.full(m + 1, np.inf), np.zeros(m + 1, bool)
        while True:
            used[j0] = True
            i0 = owner[j0]
            slack = cost[i0 - 1] - u[i0] - v[1:]
            better = ~used[1:] & (slack < least[1:])
            least[1:][better], way[1:][better] = slack[better], j0
            free = np.where(used[1:], np.inf, least[1:])
            j1 = int(free.argmin()) + 1
            delta = free[j1 - 1]
            u[owner[used]] += delta
            v[used] -= delta
            least[1:][~used[1:]] -= delta
            j0 = j1
            if not owner[j0]:
                break
        while j0:
            owner[j0], j0 = owner[way[j0]], way[j0]
    pairs = [(int(owner[j]) - 1, j - 1) for j in range(1, m + 1) if owner[j]]
    return sorted((c, r) if flipped else (r, c) for r, c in pairs)


def greedy(scores: np.ndarray) -> list[tuple[int, int]]:
    """Largest scores first, ties by row and column."""
    order = sorted(((-s, r, c) for (r, c), s in np.ndenumerate(scores)))
    rows, cols, out = set(), set(), []
    for _, r, c in order:
        if r not in rows and c not in cols:
            rows.add(r)
            cols.add(c)
            out.append((r, c))
    return sorted(out)
