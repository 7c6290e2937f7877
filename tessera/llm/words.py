"""Words of many texts at once, as spans and hashes in numpy arrays."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

_BASE = 0x9E3779B97F4A7C15 | 1
_M64 = (1 << 64) - 1
#: A random 64-bit value for each byte.
_VALUE = np.random.Generator(np.random.PCG64(20240229)).integers(0, 1 << 64, 256, np.uint64)

#: Bytes of words that ASCII blanks part.
NOT_BLANK = np.array([b not in b"\t\n\x0b\x0c\r " for b in range(256)])
#: Bytes of words of ASCII letters, digits and all characters beyond ASCII.
ALNUM = np.array([chr(b).isalnum() if b < 128 else True for b in range(256)])


def powers(n: int, base: int = _BASE) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    if n:
        out[0] = 1
    return np.multiply.accumulate(out)


class Powers:
    """Powers of the base and of its inverse modulo 2**64, grown as needed."""

    def __init__(self):
        self.up = self.down = np.zeros(0, np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            n = max(n, 2 * len(self.up))
            self.up, self.down = powers(n), powers(n, pow(_BASE, -1, 1 << 64))
        return self.up, self.down


POWERS = Powers()


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def prefix_hashes(data: np.ndarray) -> np.ndarray:
    """P with P[e] - P[s] = base**s times the polynomial hash of data[s:e]."""
    up, _ = POWERS.get(len(data) + 1)
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_VALUE[data] * up[: len(data)], out=out[1:])
    return out


def span_hashes(prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    _, down = POWERS.get(len(prefix))
    return mix((prefix[ends] - prefix[starts]) * down[starts])


def shingle_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """Hash of each run of ``size`` word hashes."""
    n = len(words) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    total = words[:n].copy()
    for k in range(1, size):
        total = mix(total) + words[k : k + n]
    return mix(total)


class Words:
    """The words of some texts: lower-cased bytes, spans, hashes and the first word of each text."""

    def __init__(self, texts: list[bytes], inside: np.ndarray, lower: bool = True):
        joined = b" ".join(texts)
        self.bytes = joined.lower() if lower else joined
        data = np.frombuffer(self.bytes, np.uint8)
        inner = np.zeros(len(data) + 2, np.int8)
        inner[1:-1] = inside[data]
        turn = np.diff(inner)
        self.starts, self.ends = np.flatnonzero(turn == 1), np.flatnonzero(turn == -1)
        self.data = data
        lens = np.fromiter(map(len, texts), np.int64, len(texts))
        at = np.concatenate([[0], np.cumsum(lens + 1)])
        self.first = np.searchsorted(self.starts, at)

    def hashes(self) -> np.ndarray:
        return span_hashes(prefix_hashes(self.data), self.starts, self.ends)

    def text(self, i: int, j: int) -> bytes:
        """Words i to j, joined by spaces."""
        return b" ".join([self.bytes[s:e] for s, e in zip(self.starts[i:j].tolist(), self.ends[i:j].tolist())])


def some_at_once(texts: list[bytes], limit: int = 1 << 18) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about ``limit`` bytes, one text at least."""
    start, held = 0, 0
    for k, t in enumerate(texts):
        if k > start and held + len(t) > limit:
            yield start, k
            start, held = k, 0
        held += len(t) + 1
    if start < len(texts):
        yield start, len(texts)
