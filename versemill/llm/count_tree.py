"""An R-tree over count vectors, joined with itself under a bound on the overlap of sets.

A set's point has one coordinate per group of hashed members: how many fall into the group.
Two sets share at most the sum of the smaller counts, and the members below two nodes at
most the sum of the smaller upper corners; a pair of nodes whose bound is below what the
sizes demand is left out with all points below it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

FANOUT = 8

# Numbers compared in one step of the join.
_STEP = 1 << 21


def least_common(total: np.ndarray, percent: int) -> np.ndarray:
    """Fewest common members of two sets of ``total`` members together at the least similarity."""
    return -(-percent * total // (100 + percent))


class CountTree:
    """Points, their set sizes and a label each; pairs of equal labels are not looked for."""

    def __init__(self, points: np.ndarray, sizes: np.ndarray, labels: np.ndarray):
        self.order = self._packed(points)
        kind = np.int16 if points.max(initial=0) <= np.iinfo(np.int16).max else np.int64
        upper, low, high = points[self.order].astype(kind), sizes[self.order], sizes[self.order]
        first, last = labels[self.order], labels[self.order]
        self._levels = [(upper, low, high, first, last)]
        while len(upper) > FANOUT:
            at = np.arange(0, len(upper), FANOUT)
            upper = np.maximum.reduceat(upper, at, axis=0)
            low, high = np.minimum.reduceat(low, at), np.maximum.reduceat(high, at)
            first, last = np.minimum.reduceat(first, at), np.maximum.reduceat(last, at)
            self._levels.append((upper, low, high, first, last))

    @staticmethod
    def _packed(points: np.ndarray) -> np.ndarray:
        """Order of the points in which neighbours lie close: halved along the widest coordinate."""
        out, stack = [], [np.arange(len(points))]
        while stack:
            part = stack.pop()
            if len(part) <= FANOUT:
                out.append(part)
                continue
            some = points[part].astype(np.float32)
            along = int(some.var(axis=0).argmax())
            # a multiple of the fanout on the left keeps nodes full
            half = FANOUT * max(1, len(part) // (2 * FANOUT))
            split = np.argsort(some[:, along], kind="stable")
            stack += (part[split[half:]], part[split[:half]])
        return np.concatenate(out) if out else np.empty(0, np.int64)

    def _plausible(self, level: int, one: np.ndarray, other: np.ndarray, percent: int) -> np.ndarray:
        upper, low, high, first, last = self._levels[level]
        need = least_common(low[one] + low[other], percent)
        mixed = (first[one] != last[other]) | (last[one] != first[other]) | (first[one] != last[one])
        fits = np.flatnonzero(mixed & (np.minimum(high[one], high[other]) >= need))
        keep = np.zeros(len(one), bool)
        step = max(1, _STEP // max(1, upper.shape[1]))
        for k in range(0, len(fits), step):
            part = fits[k : k + step]
            bound = np.minimum(upper[one[part]], upper[other[part]]).sum(axis=1, dtype=np.int64)
            keep[part] = bound >= need[part]
        return keep

    def pairs(self, percent: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Places of the points whose sets may reach the similarity, each pair once, in blocks."""
        top = len(self._levels) - 1
        one, other = np.triu_indices(len(self._levels[top][0]))
        stack = [(top, one, other)]
        children = np.arange(FANOUT)
        while stack:
            level, one, other = stack.pop()
            if not level:
                one, other = one[one != other], other[one != other]
            keep = self._plausible(level, one, other, percent)
            one, other = one[keep], other[keep]
            if not level:
                if len(one):
                    yield self.order[one], self.order[other]
                continue
            below = len(self._levels[level - 1][0])
            step = max(1, _STEP // (FANOUT * FANOUT * 16))
            for k in range(0, len(one), step):
                a = (one[k : k + step, None, None] * FANOUT + children[None, :, None]).repeat(FANOUT, axis=2).ravel()
                b = (other[k : k + step, None, None] * FANOUT + children[None, None, :]).repeat(FANOUT, axis=1).ravel()
                there = (a <= b) & (b < below)
                stack.append((level - 1, a[there], b[there]))
