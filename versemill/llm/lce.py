"""Longest common extensions in a sequence of symbols, by suffix tree and Euler tour.

A tree of the sequence answers how far two suffixes agree; a tree of its reversal, how far
two prefixes agree backwards. Both are built in linear time and asked in blocks of numpy
arrays, in constant time per question.
"""

from __future__ import annotations

import numpy as np

_BLOCK = 32
_QUESTIONS = 1 << 16


def _ukkonen(symbols: list[int], width: int) -> tuple[dict[int, int], list[int], list[int]]:
    """Ukkonen's tree of ``symbols``, whose last one occurs once.

    Returns the edges (``node * width + first symbol`` to child), and per node its depth in
    symbols and the place of its suffix (-1 for inner nodes). Node 0 is the root.
    """
    end = len(symbols)
    left, right, link, depth, place = [0], [0], [0], [0], [-1]
    edges: dict[int, int] = {}
    node = edge = length = waiting = 0
    for at in range(end):
        symbol = symbols[at]
        waiting += 1
        made = 0
        while waiting:
            if not length:
                edge = at
            key = node * width + symbols[edge]
            child = edges.get(key)
            if child is None:
                edges[key] = len(left)
                left.append(at)
                right.append(end)
                link.append(0)
                depth.append(end - at + waiting - 1)
                place.append(at - waiting + 1)
                if made:
                    link[made] = node
                    made = 0
            else:
                start = left[child]
                span = right[child] - start
                if length >= span:
                    edge += span
                    length -= span
                    node = child
                    continue
                if symbols[start + length] == symbol:
                    if made:
                        link[made] = node
                    length += 1
                    break
                split = len(left)
                edges[key] = split
                left += (start, at)
                right += (start + length, end)
                link += (0, 0)
                depth += (depth[node] + length, end - at + waiting - 1)
                place += (-1, at - waiting + 1)
                left[child] = start + length
                edges[split * width + symbols[start + length]] = child
                edges[split * width + symbol] = split + 1
                if made:
                    link[made] = split
                made = split
            waiting -= 1
            if node:
                node = link[node]
            elif length:
                length -= 1
                edge = at - waiting + 1
    return edges, depth, place


class Extensions:
    """Common extensions of the suffixes of a sequence, and the order of its suffixes."""

    def __init__(self, symbols: np.ndarray):
        """``symbols`` are numbers from 1 on; 0 ends the sequence and is below all others."""
        self.length = len(symbols)
        width = int(symbols.max(initial=0)) + 1
        edges, depth, place = _ukkonen([*symbols.tolist(), 0], width)
        keys = np.fromiter(edges.keys(), np.int64, len(edges))
        ends = np.fromiter(edges.values(), np.int64, len(edges))
        order = np.argsort(keys)
        parents, self._first, self._children = keys[order] // width, keys[order] % width, ends[order]
        self._starts = np.searchsorted(parents, np.arange(len(depth) + 1)).tolist()
        self._place = place
        self._walk(depth)

    def _walk(self, depth: list[int]) -> None:
        """Euler tour: the depths met on the way, and when each suffix is met."""
        children, starts, place = self._children.tolist(), self._starts, self._place
        tour, met = [], [0] * (self.length + 1)
        stack = [0]
        while stack:
            node = stack.pop()
            if node < 0:
                tour.append(depth[~node])
                continue
            if place[node] >= 0:
                met[place[node]] = len(tour)
            tour.append(depth[node])
            for child in children[starts[node] : starts[node + 1]][::-1]:
                stack.append(~node)
                stack.append(child)
        self._met = np.array(met, np.int64)
        count = -(-len(tour) // _BLOCK)
        padded = np.full(count * _BLOCK, np.iinfo(np.int32).max, np.int32)
        padded[: len(tour)] = tour
        self._tour = padded
        blocks = padded.reshape(count, _BLOCK)
        self._from_start = np.minimum.accumulate(blocks, axis=1).ravel()
        self._to_end = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
        self._levels = [blocks.min(axis=1)]
        step = 1
        while 2 * step <= count:
            last = self._levels[-1]
            self._levels.append(np.minimum(last[:-step], last[step:]))
            step *= 2

    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many symbols the suffixes at ``a`` and ``b`` (up to the length) have in common."""
        out = np.empty(len(a), np.int64)
        for k in range(0, len(a), _QUESTIONS):
            out[k : k + _QUESTIONS] = self._lowest(self._met[a[k : k + _QUESTIONS]], self._met[b[k : k + _QUESTIONS]])
        return out

    def _lowest(self, one: np.ndarray, other: np.ndarray) -> np.ndarray:
        """Least depth between two times of the tour: that of the lowest common ancestor."""
        low, high = np.minimum(one, other), np.maximum(one, other)
        first, last = low // _BLOCK, high // _BLOCK
        out = np.minimum(self._to_end[low], self._from_start[high])
        between = last - first - 1
        for level, table in enumerate(self._levels):
            here = np.flatnonzero((between >= 1 << level) & (between < 2 << level))
            if len(here):
                begin, end = first[here] + 1, last[here] - (1 << level)
                out[here] = np.minimum(out[here], np.minimum(table[begin], table[end]))
        inside = np.flatnonzero(first == last)
        if len(inside):
            span = low[inside, None] + np.arange(_BLOCK)
            values = self._tour[np.minimum(span, len(self._tour) - 1)]
            values[span > high[inside, None]] = np.iinfo(np.int32).max
            out[inside] = values.min(axis=1)
        return out

    def ranks(self, falling: bool = False) -> list[int]:
        """Rank of each suffix, the empty one last in the list and least; ``falling`` turns the order of symbols."""
        children, starts, place = self._children, self._starts, self._place
        if falling:
            # the end of the sequence stays the least symbol
            parents = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
            children = children[np.lexsort((-self._first, self._first != 0, parents))]
        children = children.tolist()
        rank, found, stack = [0] * (self.length + 1), 0, [0]
        while stack:
            node = stack.pop()
            if place[node] >= 0:
                rank[place[node]] = found
                found += 1
            else:
                stack += children[starts[node] : starts[node + 1]][::-1]
        return rank


def longest_lyndon(ranks: list[int]) -> np.ndarray:
    """Length of the longest Lyndon word at each place: up to the next smaller suffix."""
    size = len(ranks) - 1
    lengths, stack = np.empty(size, np.int64), [size]
    for at in range(size - 1, -1, -1):
        rank = ranks[at]
        while ranks[stack[-1]] > rank:
            stack.pop()
        lengths[at] = stack[-1] - at
        stack.append(at)
    return lengths
