"""Spanning forests of links, found inside a task so that groups never leave it as all their pairs."""

from __future__ import annotations

import numpy as np


def components(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids in the links a-b, and the smallest id of each one's component."""
    ids, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    ia, ib = at[: len(a)], at[len(a) :]
    up = np.arange(len(ids))
    while True:
        pa, pb = up[ia], up[ib]
        apart = pa != pb
        if not apart.any():
            return ids, ids[up]
        ia, ib, least = ia[apart], ib[apart], np.minimum(pa, pb)[apart]
        np.minimum.at(up, pa[apart], least)
        np.minimum.at(up, pb[apart], least)
        while (further := up[up]).tobytes() != up.tobytes():
            up = further


class Forest:
    """Links gathered as a forest: memory follows the number of ids, not of links."""

    def __init__(self, most: int = 1 << 18) -> None:
        self._a: list[np.ndarray] = []
        self._b: list[np.ndarray] = []
        self._n, self._most, self._next = 0, most, most

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        if len(a):
            self._a.append(a)
            self._b.append(b)
            self._n += len(a)
            if self._n >= self._next:
                self.shrink()
                self._next = max(self._most, 2 * self._n)

    def shrink(self) -> None:
        if self._n:
            ids, roots = components(np.concatenate(self._a), np.concatenate(self._b))
            other = ids != roots
            self._a, self._b, self._n = [roots[other]], [ids[other]], int(other.sum())

    def links(self) -> tuple[np.ndarray, np.ndarray]:
        """Root and id, for each id that isn't a root."""
        self.shrink()
        empty = np.empty(0, dtype=np.int64)
        return (self._a[0], self._b[0]) if self._n else (empty, empty)
