"""Suffix sorting by hash-compared mergesort, in numpy.

Strings are stretches of one buffer around a spot: ``right`` bytes from it and
``left`` bytes before it. Prefix polynomial hashes make any two stretches comparable
at once, a binary search over lengths finds how far two strings agree, and the byte
after that decides their order. Groups are sorted side by side: each merge finds all
elements' ranks in their sibling runs by binary search.

Equal hashes are verified: of neighbours in a sorted group the agreement is compared byte
by byte, which with the byte after it proves the order. Where a collision is found, the
strings are sorted by their bytes instead and agreements are cut to what bytes show.
"""

from __future__ import annotations

import numpy as np

from . import words as W


class Strings:
    def __init__(self, data: np.ndarray, spot: np.ndarray, left: np.ndarray, right: np.ndarray):
        self.data, self.spot, self.left, self.right = data, spot, left, right
        self.prefix = W.prefix_hashes(data)
        _, self.down = W.POWERS.get(len(data) + 1)

    def _same(self, a: np.ndarray, b: np.ndarray, size: np.ndarray) -> np.ndarray:
        p, d = self.prefix, self.down
        return (p[a + size] - p[a]) * d[a] == (p[b + size] - p[b]) * d[b]

    def agree(self, a: np.ndarray, b: np.ndarray, forward: bool = True) -> np.ndarray:
        """How many bytes strings a and b share from their spots on, or up to their spots."""
        own = self.right if forward else self.left
        low, high = np.zeros(len(a), np.int64), np.minimum(own[a], own[b])
        x, y = self.spot[a], self.spot[b]
        while (live := np.flatnonzero(low < high)).size:
            mid = (low[live] + high[live] + 1) >> 1
            s, t = (x[live], y[live]) if forward else (x[live] - mid, y[live] - mid)
            same = self._same(s, t, mid)
            low[live] = np.where(same, mid, low[live])
            high[live] = np.where(same, high[live], mid - 1)
        return low

    def order(self, a: np.ndarray, b: np.ndarray, forward: bool = True) -> np.ndarray:
        """-1, 0 or 1 as string a comes before, equals or comes after b."""
        own = self.right if forward else self.left
        n = self.agree(a, b, forward)
        ended = (n == own[a]) | (n == own[b])
        last = len(self.data) - 1
        if forward:
            i, j = np.minimum(self.spot[a] + n, last), np.minimum(self.spot[b] + n, last)
        else:
            i, j = np.maximum(self.spot[a] - n - 1, 0), np.maximum(self.spot[b] - n - 1, 0)
        return np.where(ended, np.sign(own[a] - own[b]), np.sign(self.data[i].astype(np.int64) - self.data[j]))

    def really_agree(self, a: np.ndarray, b: np.ndarray, forward: bool = True) -> tuple[np.ndarray, bool]:
        """``agree`` with bytes compared, and whether any hashes were equal where bytes weren't."""
        found, collided = self.agree(a, b, forward), False
        for k in range(0, len(a), 4_000):
            size = found[k : k + 4_000]
            x, y = self.spot[a[k : k + 4_000]], self.spot[b[k : k + 4_000]]
            begin = np.cumsum(size) - size
            shift = np.arange(int(size.sum())) - np.repeat(begin, size)
            if not forward:
                shift = -1 - shift
            other = np.flatnonzero(self.data[np.repeat(x, size) + shift] != self.data[np.repeat(y, size) + shift])
            if len(other):
                collided = True
                pair = np.searchsorted(begin, other, side="right") - 1
                pair, first = np.unique(pair, return_index=True)
                size[pair] = other[first] - begin[pair]
        return found, collided

    def by_bytes(self, start: np.ndarray, forward: bool = True) -> np.ndarray:
        """What ``merge_sort`` gives, by comparing bytes alone."""
        text = self.data.tobytes()
        own = lambda i: text[self.spot[i] : self.spot[i] + self.right[i]] if forward else text[self.spot[i] - self.left[i] : self.spot[i]][::-1]
        return np.array(sorted(range(len(start)), key=lambda i: (start[i], own(i))), np.int64)


def merge_sort(strings: Strings, start: np.ndarray, size: np.ndarray, forward: bool = True) -> np.ndarray:
    """Strings in sorted order within their groups.

    start, size: for each string the first index and the size of its group; groups are
    runs of neighbouring indexes.
    """
    now = np.arange(len(start))
    width = 1
    while (spots := np.flatnonzero(size > width)).size:
        first, n = start[spots], size[spots]
        place = spots - first
        run, own = place // width, place % width
        begin = (run ^ 1) * width
        low, high = np.zeros(len(spots), np.int64), np.clip(n - begin, 0, width)
        odd = run & 1 == 1
        while (live := np.flatnonzero(low < high)).size:
            mid = (low[live] + high[live]) >> 1
            c = strings.order(now[first[live] + begin[live] + mid], now[spots[live]], forward)
            before = (c < 0) | ((c == 0) & odd[live])
            low[live] = np.where(before, mid + 1, low[live])
            high[live] = np.where(before, high[live], mid)
        then = now.copy()
        then[first + (run >> 1) * 2 * width + own + low] = now[spots]
        now, width = then, width * 2
    return now


def sorted_groups(strings: Strings, start: np.ndarray, size: np.ndarray, forward: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """(order, shared): strings in sorted order within their groups, and the bytes that each one
    shares with the one before it, -1 for the first of a group; no collision shows in either."""
    inner = np.flatnonzero(start[1:] == start[:-1]) + 1
    order = merge_sort(strings, start, size, forward)
    shared = np.full(len(start), -1, np.int64)
    shared[inner], collided = strings.really_agree(order[inner - 1], order[inner], forward)
    if collided or (np.bincount(order, minlength=len(order)) != 1).any() or (strings.order(order[inner - 1], order[inner], forward) > 0).any():
        order = strings.by_bytes(start, forward)
        shared[inner], _ = strings.really_agree(order[inner - 1], order[inner], forward)
    return order, shared


def repeated_around(strings: Strings, start: np.ndarray, size: np.ndarray, need: int) -> tuple[np.ndarray, np.ndarray]:
    """(left, right) of each string: the reach of the stretches around its spot that it
    shares with another string of its group and that are ``need`` bytes long or more;
    zeros where there is none.

    Groups are sorted forwards and backwards. From the longest agreement down, runs of
    neighbours that agree forwards on r bytes are clusters; in one, backward neighbours
    agree backwards the most, and l + r >= need counts. Only clusters that grew at r are
    looked at.
    """
    count = len(start)
    left, right = np.zeros(count, np.int64), np.zeros(count, np.int64)
    if not count:
        return left, right
    ahead, shared = sorted_groups(strings, start, size, True)
    rank = np.empty(count, np.int64)
    rank[sorted_groups(strings, start, size, False)[0]] = np.arange(count)
    least = need - int(strings.left.max())
    for r in sorted({int(x) for x in np.unique(shared) if x >= max(least, 1)}, reverse=True):
        cluster = np.cumsum(shared < r) - 1
        grew = np.zeros(cluster[-1] + 1, bool)
        grew[cluster[shared == r]] = True
        spots = np.flatnonzero(grew[cluster])
        own, of = ahead[spots], cluster[spots]
        by = np.lexsort((rank[own], of))
        own, of = own[by], of[by]
        pairs = np.flatnonzero(of[1:] == of[:-1])
        a, b = own[pairs], own[pairs + 1]
        back, _ = strings.really_agree(a, b, False)
        ok = back + r >= need
        a, b, back = a[ok], b[ok], back[ok]
        for e in (a, b):
            np.maximum.at(left, e, back)
            right[e] = np.maximum(right[e], r)
    return left, right
