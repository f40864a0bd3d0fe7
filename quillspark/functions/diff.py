"""Shortest edit scripts between two lists of lines, in linear space.

The furthest points that d edits reach, forwards from the begin and backwards
from the end, are kept for all diagonals as one array each, so a step is a few
array operations. Where the two fronts meet, the run of equal lines there lies
on a shortest path; what is left of it on either side is solved in the same way.
Common begins and ends go first. Lines are compared by number.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

_FAR = -(1 << 40)


def _advance(front: np.ndarray, off: int, d: int, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One more edit on every diagonal within the grid: diagonals, where their runs of equal lines begin, and end."""
    n, m = len(a), len(b)
    k = np.arange(-d + 2 * max(0, d - m), d - 2 * max(0, d - n) + 1, 2)
    down, right = front[off + k + 1], front[off + k - 1] + 1
    if d == 0:
        x = np.zeros(1, np.int64)
    else:
        x = np.maximum(np.where(down - k > m, _FAR, down), np.where(right > n, _FAR, right))
    begin = x.copy()
    live = np.flatnonzero(x >= 0)
    while len(live):
        at = x[live]
        live = live[(at < n) & (at - k[live] < m)]
        at = x[live]
        live = live[a[at] == b[at - k[live]]]
        x[live] += 1
    front[off + k] = x
    return k, begin, x


def _middle(a: np.ndarray, b: np.ndarray) -> tuple[int, int, int, int]:
    """Begin and end of a run on a shortest path, half the edits before it and half behind."""
    n, m = len(a), len(b)
    delta, off = n - m, n + m + 2
    ahead, back = np.full(2 * off + 1, _FAR, np.int64), np.full(2 * off + 1, _FAR, np.int64)
    ra, rb = a[::-1], b[::-1]
    for d in range((n + m + 1) // 2 + 1):
        k, begin, x = _advance(ahead, off, d, a, b)
        if delta % 2:
            other = delta - k
            met = np.flatnonzero((np.abs(other) < d) & (x + back[off + np.clip(other, -off, off)] >= n))
            if len(met):
                i = met[0]
                return int(begin[i]), int(begin[i] - k[i]), int(x[i]), int(x[i] - k[i])
        k, begin, x = _advance(back, off, d, ra, rb)
        if delta % 2 == 0:
            other = delta - k
            met = np.flatnonzero((np.abs(other) <= d) & (x + ahead[off + np.clip(other, -off, off)] >= n))
            if len(met):
                i = met[0]
                return n - int(x[i]), m - int(x[i] - k[i]), n - int(begin[i]), m - int(begin[i] - k[i])
    raise AssertionError("the fronts meet within half the lines")


def kept_lines(old: list[str], new: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Which lines of either side a shortest script keeps. Lines that only one side has are none of them, and are left out first."""
    numbers: dict[str, int] = {}
    one, two = (np.array([numbers.setdefault(v, len(numbers)) for v in side], np.int64) for side in (old, new))
    sides = np.zeros((2, len(numbers)), bool)
    sides[0, one] = sides[1, two] = True
    both = sides.all(axis=0)
    at_a, at_b = np.flatnonzero(both[one]), np.flatnonzero(both[two])
    a, b = one[at_a], two[at_b]
    in_a, in_b = np.zeros(len(a), bool), np.zeros(len(b), bool)
    work = [(0, len(a), 0, len(b))]
    while work:
        i, j, p, q = work.pop()
        n = min(j - i, q - p)
        unlike = np.flatnonzero(a[i : i + n] != b[p : p + n])
        same = int(unlike[0]) if len(unlike) else n
        in_a[i : i + same] = in_b[p : p + same] = True
        i, p, n = i + same, p + same, n - same
        unlike = np.flatnonzero(a[j - n : j][::-1] != b[q - n : q][::-1])
        same = int(unlike[0]) if len(unlike) else n
        in_a[j - same : j] = in_b[q - same : q] = True
        j, q = j - same, q - same
        if i < j and p < q:
            x, y, u, v = _middle(a[i:j], b[p:q])
            in_a[i + x : i + u] = in_b[p + y : p + v] = True
            work += [(i, i + x, p, p + y), (i + u, j, p + v, q)]
    kept_a, kept_b = np.zeros(len(one), bool), np.zeros(len(two), bool)
    kept_a[at_a[in_a]] = kept_b[at_b[in_b]] = True
    return kept_a, kept_b


def hunks(old: list[str], new: list[str]) -> Iterator[tuple[int, int, int, int]]:
    """Begin and end in old, begin and end in new of every changed stretch, in order."""
    in_a, in_b = kept_lines(old, new)
    ends = zip([*np.flatnonzero(in_a).tolist(), len(old)], [*np.flatnonzero(in_b).tolist(), len(new)], strict=True)
    i = p = 0
    for j, q in ends:
        if i < j or p < q:
            yield i, j, p, q
        i, p = j + 1, q + 1


def changes(old: str | None, new: str | None) -> Iterator[tuple[int, str, str | None, str | None]]:
    """line_num, diff_type (added, removed, modified), old and new; lines that stand opposite each other in a stretch are modified, null texts are empty."""
    a, b = (old or "").split("\n"), (new or "").split("\n")
    for i, j, p, q in hunks(a, b):
        for k in range(max(j - i, q - p)):
            x, y = (a[i + k] if i + k < j else None), (b[p + k] if p + k < q else None)
            yield (p if y is not None else i) + k + 1, "modified" if x is not None and y is not None else "added" if x is None else "removed", x, y
