"""A linear-chain conditional random field with two labels, in numpy."""

from __future__ import annotations

import numpy as np


class Rows:
    """A matrix of zeros and ones, by the places of the ones in each row; no row is without."""

    def __init__(self, rows: list[list[int]], width: int):
        sizes = np.fromiter(map(len, rows), np.int64, len(rows))
        self.at, self.first, self.sizes, self.width = np.array([k for row in rows for k in row], np.int64), np.cumsum(sizes) - sizes, sizes, width

    def __matmul__(self, weights: np.ndarray) -> np.ndarray:
        return np.add.reduceat(weights[self.at], self.first)

    def transposed(self, values: np.ndarray) -> np.ndarray:
        """The product of the matrix, transposed, with values."""
        return np.bincount(self.at, np.repeat(values, self.sizes), self.width)


class Chain:
    """Weights: one for each feature (for label 1, against 0), transitions by (kind, from, to), and label 1 at start and end."""

    def __init__(self, features: dict[str, int], kinds: int = 1):
        self.features = features
        self.weights, self.steps, self.ends = np.zeros(len(features)), np.zeros((kinds, 2, 2)), np.zeros(2)

    def loss(self, x: Rows | np.ndarray, y: np.ndarray, sizes: np.ndarray, ridge: float = 0.0, kinds: np.ndarray | None = None) -> tuple[float, list[np.ndarray]]:
        """Negative log-likelihood of sequences and its gradients.

        x: a row of features for each block; y: labels; sizes: blocks of each sequence, all above
        zero; kinds: of the transition to each block, 0 where not given.
        """
        begin = np.cumsum(sizes) - sizes
        longest, every, last = int(sizes.max()), np.arange(len(sizes)), sizes - 1
        spot = np.minimum(begin[None] + np.arange(longest)[:, None], len(y) - 1)  # a row for each place, a column for each sequence
        inside = np.arange(longest)[:, None] < sizes[None]
        one = (x @ self.weights)[spot]
        own = one.copy()
        own[0] += self.ends[0]
        own[last, every] += self.ends[1]
        kind = np.zeros_like(spot) if kinds is None else kinds[spot]
        (zz, zo), (oz, oo) = self.steps[kind].transpose(2, 3, 0, 1)
        plus = np.logaddexp
        ahead, back = np.zeros((2, *one.shape)), np.zeros((2, *one.shape))
        ahead[1, 0] = own[0]
        for t in range(1, longest):
            z, o = ahead[:, t - 1]
            ahead[0, t], ahead[1, t] = plus(z + zz[t], o + oz[t]), plus(z + zo[t], o + oo[t]) + own[t]
        for t in range(longest - 2, -1, -1):
            z, o = back[0, t + 1], back[1, t + 1] + own[t + 1]
            live = inside[t + 1]
            back[0, t], back[1, t] = np.where(live, plus(zz[t + 1] + z, zo[t + 1] + o), 0), np.where(live, plus(oz[t + 1] + z, oo[t + 1] + o), 0)
        total = plus(ahead[0, last, every], ahead[1, last, every])
        label, pairs = np.where(inside, y[spot], 0), inside[1:]
        gold = (one * label * inside).sum() + self.ends[0] * label[0].sum() + self.ends[1] * label[last, every].sum() + self.steps[kind[1:], label[:-1], label[1:]][pairs].sum()
        over = np.exp(ahead[1] + back[1] - total) - label
        excess = over.T[inside.T]
        weights = (x.transposed(excess) if isinstance(x, Rows) else x.T @ excess) + ridge * self.weights
        ends = np.array([over[0].sum(), over[last, every].sum()]) + ridge * self.ends
        then = (back[0, 1:], back[1, 1:] + own[1:])
        steps = ridge * self.steps
        for i, j in ((0, 0), (0, 1), (1, 0), (1, 1)):
            chance = np.exp(ahead[i, :-1] + self.steps[kind[1:], i, j] + then[j] - total)
            steps[:, i, j] += np.bincount(kind[1:][pairs], (chance - ((label[:-1] == i) & (label[1:] == j)))[pairs], len(steps))
        loss = total.sum() - gold + ridge / 2 * ((self.weights**2).sum() + (self.steps**2).sum() + (self.ends**2).sum())
        return float(loss), [weights, steps, ends]

    def fit(self, x: Rows | np.ndarray, y: np.ndarray, sizes: np.ndarray, kinds: np.ndarray | None = None, ridge: float = 0.03, rounds: int = 150, rate: float = 0.25) -> Chain:
        """Adam over all sequences at once."""
        at = [self.weights, self.steps, self.ends]
        first, second = [np.zeros_like(p) for p in at], [np.zeros_like(p) for p in at]
        for k in range(1, rounds + 1):
            _, gradients = self.loss(x, y, sizes, ridge, kinds)
            for p, g, m, v in zip(at, gradients, first, second):
                m += 0.1 * (g - m)
                v += 0.01 * (g * g - v)
                p -= rate * (1 - k / (rounds + 1)) * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.99**k)) + 1e-8)
        return self


def viterbi(scores: list[float], steps: list[list[list[float]]], ends: list[float], kinds: list[int] | None = None) -> list[int]:
    """The best labels for scores of label 1; of equally good ones the other label, 0."""
    if not scores:
        return []
    zero, one = 0.0, scores[0] + ends[0]
    came: list[tuple[int, int]] = []
    for t in range(1, len(scores)):
        (a, b), (c, d) = steps[kinds[t] if kinds else 0]
        to_zero, to_one = int(one + c > zero + a), int(one + d > zero + b)
        zero, one = (one + c if to_zero else zero + a), (one + d if to_one else zero + b) + scores[t]
        came.append((to_zero, to_one))
    label = int(one + ends[1] > zero)
    out = [label]
    for step in reversed(came):
        label = step[label]
        out.append(label)
    return out[::-1]
