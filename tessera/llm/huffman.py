"""Canonical length-limited Huffman codes over token ids, in numpy.

Lengths come from package-merge, codes from the lengths alone. A block is a bit stream
with checkpoints: the bit offset of every CHECK-th id, so that decoding runs over all
checkpoints of a block at once, one table look-up per id.
"""

from __future__ import annotations

import struct

import numpy as np

LIMIT, CHECK = 16, 128
_MAGIC = b"TKH1"


def code_lengths(counts: np.ndarray, limit: int = LIMIT) -> np.ndarray:
    """Bits of each id, 0 for ids never seen, at most ``limit`` (or what the number of ids needs)."""
    used = np.flatnonzero(counts)
    out, n = np.zeros(len(counts), np.uint8), len(used)
    if n < 2:
        out[used] = 1
        return out
    limit = max(limit, int(n - 1).bit_length())
    order = used[np.argsort(counts[used], kind="stable")]
    leaves = counts[order].astype(np.int64)
    now, is_leaf = leaves, [np.ones(n, bool)]
    for _ in range(limit - 1):
        pairs = now[: len(now) // 2 * 2].reshape(-1, 2).sum(axis=1)
        both = np.concatenate([leaves, pairs])
        rank = np.argsort(both, kind="stable")
        now = both[rank]
        is_leaf.append(rank < n)
    take = 2 * n - 2
    for level in reversed(is_leaf):
        own = int(level[:take].sum())
        out[order[:own]] += 1
        take = 2 * (take - own)
    return out


class Code:
    """Codes and the decoding table of canonical lengths."""

    def __init__(self, lengths: np.ndarray):
        self.lengths = lengths.astype(np.int64)
        used = np.flatnonzero(lengths)
        order = used[np.lexsort((used, lengths[used]))]
        size = self.lengths[order]
        self.top = int(size.max()) if len(order) else 1
        spans = np.left_shift(1, self.top - size)
        at = np.cumsum(spans) - spans
        self.codes = np.zeros(len(lengths), np.uint64)
        self.codes[order] = at >> (self.top - size)
        self.symbol = np.zeros(1 << self.top, np.uint32)
        self.step = np.ones(1 << self.top, np.int64)
        covered = int(spans.sum())
        self.symbol[:covered], self.step[:covered] = np.repeat(order, spans), np.repeat(size, spans)

    def pack(self, ids: np.ndarray) -> bytes:
        """A block: header, checkpoints and bit stream."""
        size = self.lengths[ids]
        ends = np.cumsum(size)
        bits = int(ends[-1]) if len(ids) else 0
        at = ends - size
        word, shift = at >> 6, (at & 63).astype(np.uint64)
        left = self.codes[ids] << (64 - size).astype(np.uint64)
        out = np.zeros(bits // 64 + 2, np.uint64)
        if len(ids):
            first = np.concatenate([[0], np.flatnonzero(np.diff(word)) + 1])
            out[word[first]] = np.bitwise_or.reduceat(left >> shift, first)
            over = np.flatnonzero(shift.astype(np.int64) + size > 64)
            out[word[over] + 1] |= left[over] << (np.uint64(64) - shift[over])
        marks = at[::CHECK].astype("<u8")
        return _MAGIC + struct.pack("<QQ", len(ids), bits) + marks.tobytes() + out.astype(">u8").tobytes()[: (bits + 7) // 8]

    def unpack(self, block: bytes) -> np.ndarray:
        """The ids of a block."""
        if block[:4] != _MAGIC:
            raise ValueError("not a block of token ids")
        n, bits = struct.unpack_from("<QQ", block, 4)
        lanes = -(-n // CHECK)
        at = np.frombuffer(block, "<u8", lanes, 20).astype(np.int64)
        stream = block[20 + 8 * lanes :] + bytes(24)
        if len(stream) - 24 != (bits + 7) // 8:
            raise ValueError("a block of token ids is cut short")
        data = np.frombuffer(stream, ">u8", len(stream) // 8).astype(np.uint64)
        out = np.zeros((CHECK, lanes), np.uint32)
        down, one, most = np.uint64(64 - self.top), np.uint64(1), len(data) - 2
        for k in range(min(CHECK, n)):
            word = np.minimum(at >> 6, most)
            shift = (at & 63).astype(np.uint64)
            window = (data[word] << shift) | ((data[word + 1] >> one) >> (np.uint64(63) - shift))
            key = (window >> down).astype(np.int64)
            out[k] = self.symbol[key]
            at = at + self.step[key]
        return out.T.reshape(-1)[:n]
