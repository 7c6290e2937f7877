"""Operator 3: language-model scores by Katz backoff.

Words lower-cased by A-Z and an end per text are scored by n-grams of ORDER words, which
back off to shorter ones, one order after another:

    P(w | h) = d(r) r / c(h)              if h and w were seen r times in training
             = a(h) P(w | h')             if they weren't, but h was; h' is h less its first word
             = P(w | h')                  if h wasn't either
    P(w)     = D(c) c / N, and for all unseen words together the mass that is left.

d and D are Good-Turing discounts of the order up to REACH counts (Katz), from the counts
of its counts; above it SLIVER of a count is held back, so that no history is without a
backoff weight. a(h) makes the words after each history sum to one exactly.

Texts are turned to word numbers once, in blocks that are a table of the shared folder.
Words, then each order from two up, take one exchange: blocks send their distinct n-grams
with training counts to buckets; buckets store the partitioned tables of counts and answer
with totals, and where an n-gram is unseen with what its history's backoff weight is made
of. n-grams are dealt by the word before the last one, so that all of a history meet in
one bucket. Where that word makes up more than one bucket's share of all tokens (there are
fewer of those than buckets) they are dealt by two words before it, and so on; a whole
history with more than that share has its n-grams dealt one by one, and its sums are added
up by Spark. n-grams are compared word by word, by numbers that the word table gives out,
so no two of them are taken for one.

Defined results: null and empty texts are an end alone; training rows are those whose
crc32(doc_id as text) mod FOLDS is not 0, and rows without an id; repeated rows count
and score like any other; other columns are ignored; an empty table gives none; with
no training rows every word has the probability 1 of the unseen. Very long texts are
scored whole, in a block of their own. Ties don't arise: all n-grams count.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import exchange as X
from . import store
from . import words as W

ORDER, FOLDS, REACH, SLIVER = 3, 10, 5, 0.01
BLOCK_BYTES = 14 << 20
#: Entries of lists that a bucket counts at once, if no word before the last one has more of them.
PART = 1 << 19
START = 0  # its number in a block and in the word table
#: Kinds of rows: answers to blocks have the order they are about, and come before the block itself.
BLOCK, WORDS, TABLE, SUMS, HOT = 100, 101, 102, 103, 104

_SCHEMA = f"{X.BLOCK_SCHEMA}, n array<bigint>, s double"
_ARROW = pa.schema([("block", pa.int64()), ("kind", pa.int32()), ("seq", pa.int32()), ("ids", pa.list_(pa.int64())), ("head", pa.binary()), ("body", pa.binary()), ("n", pa.list_(pa.int64())), ("s", pa.float64())])


def discounts(counts_of: list[int], reach: int = REACH) -> np.ndarray:
    """d(r) for r = 0 .. reach, and the discount of larger counts handled by ``discounted``.

    counts_of[r]: things seen r times, r = 0 .. reach + 1. Where Good-Turing gives no
    proper discount the reach is lowered, and at last a count of n1 / (n1 + 2 n2) is held back.
    """
    n = [float(x) for x in counts_of]
    for k in range(reach, 0, -1):
        if not all(n[1 : k + 1]):
            continue
        tail = (k + 1) * n[k + 1] / n[1]
        d = np.ones(reach + 1)
        if tail < 1:
            for r in range(1, k + 1):
                d[r] = ((r + 1) * n[r + 1] / n[r] / r - tail) / (1 - tail)
            if (d[1 : k + 1] > 0).all() and (d[1 : k + 1] < 1).all():
                above = np.arange(k + 1, reach + 1)
                d[above] = 1 - SLIVER / above
                return d
    hold = min(0.9, max(0.1, n[1] / (n[1] + 2 * n[2]) if n[1] else 0.5))
    r = np.arange(1, reach + 1)
    return np.concatenate([[1.0], 1 - hold / r])


def discounted(r: np.ndarray, d: np.ndarray) -> np.ndarray:
    """d(r) r of counts."""
    r = r.astype(np.float64)
    return np.where(r < len(d), d[np.minimum(r, len(d) - 1).astype(np.int64)] * r, r - SLIVER)


def _narrow(counts: np.ndarray) -> np.ndarray:
    """Counts in half the space where they fit."""
    return counts.astype(np.uint32) if counts.max(initial=0) < 1 << 32 else counts


def _row(block=None, kind=None, seq=None, ids=None, head=None, body=None, n=None, s=None) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip((block, kind, seq, ids, head, body, n, s), _ARROW, strict=True)], schema=_ARROW)


class _Index(dict):
    def __missing__(self, word):
        self[word] = n = len(self)
        return n


def _numbered(batches, buckets: int, limit: int):
    """Two rows a block: ids of documents and body (sizes, word numbers, training flags); and its words, training counts and bucket cuts.

    Numbers follow buckets and, in these, the order of bytes, as do those of the word table. 0 is START.
    """
    for number, ids, texts in X.blocks(batches, limit):
        index, runs = _Index(), []
        for t in texts:
            runs.append(np.fromiter(map(index.__getitem__, [*t.lower().split(), b""]), np.int64))
        dealt = [sorted(ws) for ws in X.deal(list(index), buckets)]
        words = [w for ws in dealt for w in ws]
        place = np.empty(len(index), np.int32)
        place[np.fromiter(map(index.__getitem__, words), np.int64, len(words))] = np.arange(1, len(words) + 1)
        sizes, tokens = np.fromiter(map(len, runs), np.int64, len(runs)), place[np.concatenate(runs)]
        train = np.array([i is None or zlib.crc32(str(i).encode()) % FOLDS != 0 for i in ids])
        counts = np.bincount(tokens[np.repeat(train, sizes)], minlength=len(words) + 1)[1:].astype(np.uint32)
        cut = np.cumsum([0, *map(len, dealt)]).astype(np.int32)
        yield X.block_rows([(number, WORDS, 0, None, None, X.press(X.pack(words), counts, cut)), (number, BLOCK, 0, ids, None, X.press(sizes, tokens, np.packbits(train).tobytes()))])


def _listed_words(batches):
    """(bucket, block, blob): a block's words with their training counts."""
    for b in batches:
        for block, body in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            words, counts, cut = X.expand(body, bytes, np.uint32, np.int32)
            words = X.unpack(words)
            for k in np.flatnonzero(np.diff(cut)).tolist():
                own = slice(cut[k], cut[k + 1])
                yield _asked(k, block, X.press(X.pack(words[own]), counts[own]))


def _asked(bucket: int, block: int, blob: bytes) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([bucket], pa.int32()), pa.array([block]), pa.array([blob], pa.binary())], names=["bucket", "block", "blob"])


def _counted_words(batches):
    """Answers of kind 1 (number and count of each word), the table of a bucket's words and its sums."""
    lists, bucket = [], None
    for batch in batches:
        for bucket, block, blob in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            words, counts = X.expand(blob, bytes, np.uint32)
            lists.append((block, X.unpack(words), counts))
    if bucket is None:
        return
    every = sorted(set().union(*(words for _, words, _ in lists)))
    index = dict(zip(every, range(len(every))))
    total = np.zeros(len(every), np.int64)
    at = [np.fromiter(map(index.__getitem__, words), np.int64, len(words)) for _, words, _ in lists]
    for a, (_, _, counts) in zip(at, lists):
        total[a] += counts
    first = (bucket << 40) + 1
    for a, (block, _, _) in zip(at, lists):
        yield _row(block, 1, bucket, body=X.press(X.deltas((a + first).astype(np.uint64)), total[a]))
    yield _row(-1, TABLE, bucket, head=X.pack(every), body=X.press(total))
    yield _row(-1, SUMS, bucket, n=[int(total.sum()), int((total > 0).sum()), *_counts_of(total)])


def _counts_of(total: np.ndarray) -> list[int]:
    """How many things were seen r times, r = 0 .. REACH + 1."""
    return np.bincount(np.minimum(total, REACH + 2), minlength=REACH + 3)[: REACH + 2].tolist()


@dataclass
class Model:
    """What all tasks need of the tables: a few numbers of each order, and the backoff weights of hot histories."""

    tokens: int
    types: int
    starts: int
    limit: float  # histories counted more often are hot
    discounts: dict[int, np.ndarray]
    unseen: float
    hot: dict[int, dict[tuple, tuple[np.ndarray, float]]]

    def word(self, counts: np.ndarray) -> np.ndarray:
        """P(w) by training count."""
        return np.where(counts > 0, discounted(counts, self.discounts[1]) / max(self.tokens, 1), self.unseen)

    def base(self, counts: np.ndarray) -> np.ndarray:
        return np.log10((counts + 0.1) / (self.tokens + 0.1 * (self.types + 1)))

    def weight(self, order: int, n: np.ndarray, below: np.ndarray, history: np.ndarray) -> np.ndarray:
        """log10 a(h) of histories by (n-grams of h that were seen 1, 2 .. and more than REACH times, their sum of P(w | h'), c(h))."""
        r = np.arange(1, REACH + 1)
        held = (n[:, :REACH] * (r * (1 - self.discounts[order][1:]))).sum(axis=1) + SLIVER * n[:, REACH]
        return np.log10(held / history / (1 - below))


class Block:
    """The tokens of a block, and what its answers tell of them. All arrays go by token unless said otherwise."""

    def __init__(self, body: bytes, answers: dict[int, list[bytes]], model: Model, buckets: int):
        self.sizes, self.word, train = X.expand(body, np.int64, np.int32, bytes)
        self.model, self.buckets, self.answers = model, buckets, answers
        self.first = np.cumsum(self.sizes) - self.sizes
        self.train = np.unpackbits(np.frombuffer(train, np.uint8), count=len(self.sizes)).astype(bool)
        got = [X.expand(a, np.uint64, np.int64) for a in answers[1]]
        self.number = np.concatenate([np.zeros(1, np.uint64), *(np.cumsum(g[0], dtype=np.uint64) for g in got)])  # by word
        self.times = np.concatenate([np.array([model.starts]), *(g[1] for g in got)])  # by word
        self.count = {1: _narrow(self.times)[self.word]}
        self.history: dict[int, np.ndarray] = {}

    def before(self, values: np.ndarray, start: int) -> np.ndarray:
        """The values of the tokens before; ``start`` for the first of a text."""
        out = np.empty(len(values), np.promote_types(values.dtype, np.min_scalar_type(start)))
        out[1:] = values[:-1]
        out[self.first] = start
        return out

    def grams(self, order: int) -> Grams:
        """The block's distinct n-grams of an order, and the count of each token's history, from the counts of the order below."""
        words = [self.word]
        for _ in range(order - 1):
            words.append(self.before(words[-1], START))
        self.history[order] = self.before(self.count[order - 1], self.model.starts)
        return Grams(self, order, words)

    def count_grams(self, order: int) -> tuple[Grams, list[tuple[np.ndarray, np.ndarray]]]:
        """Take up the answers about an order: ``count``; and (sums by history, sums of probabilities) where an n-gram is unseen."""
        g = self.grams(order)
        got = [X.expand(a, np.int64, np.uint32, np.float64) for a in self.answers.get(order, [])]
        times = np.empty(len(g.spot), np.int64)
        times[g.by] = np.concatenate([x[0] for x in got])
        self.count[order] = _narrow(times)[g.of]
        return g, [(x[1].reshape(-1, REACH + 1), x[2]) for x in got]

    def scores(self, order: int) -> np.ndarray:
        """log10 P of each token, from single words up."""
        m = self.model
        value = np.log10(m.word(self.count[1]))
        for k in range(2, order + 1):
            g, sums = self.count_grams(k)
            seen = self.count[k][g.spot]
            history, shorter = self.history[k][g.spot], value[g.spot]
            weight = np.zeros(len(g.spot))
            back = g.by[(seen[g.by] == 0) & (history[g.by] > 0)]
            told = back[~g.hot[back]]
            weight[told] = m.weight(k, np.concatenate([n for n, _ in sums]), np.concatenate([s for _, s in sums]), history[told])
            if len(rest := back[g.hot[back]]):
                n, s = zip(*(m.hot[k][h] for h in zip(*(self.number[w[g.spot[rest]]].tolist() for w in g.words[1:]))))
                weight[rest] = m.weight(k, np.array(n), np.array(s), history[rest])
            own = np.where(seen > 0, discounted(seen, m.discounts[k]) / np.maximum(history, 1), 1)
            value = np.where(seen > 0, np.log10(own), weight + shorter)[g.of]
            del g, sums  # before those of the next order are made
        return value


def _paired(code: np.ndarray, word: np.ndarray, n: int) -> np.ndarray:
    """Numbers of pairs (code, word < n) in their order, of which each can be paired with a word once more."""
    if not len(code) or (int(code.max()) + 1) * n * n <= 1 << 63:
        return code * n + word  # no need to sort them to get smaller ones
    return np.unique(code * n + word, return_inverse=True)[1]


class Grams:
    """Distinct n-grams of a block. spot: a token at which each ends; of: the n-gram of each token; by: their order in lists."""

    def __init__(self, b: Block, order: int, words: list[np.ndarray]):
        self.words, n = words, len(b.times)
        code = words[1].astype(np.int64)
        for w in words[2:]:
            code = _paired(code, w, n)
        code = code * n + words[0]
        by = np.argsort(code)
        code = code[by]
        new = np.concatenate([[True], code[1:] > code[:-1]])
        del code
        self.of = np.empty(len(by), np.int32)
        self.of[by] = np.cumsum(new) - 1
        self.spot = by[new]
        del by, new
        self.history = b.history[order][self.spot]
        key, deeper = W.mix(b.number[words[1][self.spot]]), b.history[2][self.spot] > b.model.limit
        self.told = deeper  # whether n-grams with the same shorter one are dealt to several buckets
        for k, w in enumerate(words[2:], 3):
            key, self.told = np.where(deeper, W.mix(key + b.number[w[self.spot]]), key), deeper
            deeper = b.history[k][self.spot] > b.model.limit
        self.hot = deeper
        key = np.where(self.hot, W.mix(key + b.number[words[0][self.spot]]), key)
        bucket = X.hash_buckets(key, b.buckets)
        self.by = np.argsort(bucket.astype(np.uint16) if b.buckets <= 1 << 16 else bucket, kind="stable")
        self.cut = np.searchsorted(bucket[self.by], np.arange(b.buckets + 1))


def _steps(columns: list[np.ndarray]) -> list[np.ndarray]:
    """Sorted rows, by columns: each value less the one above it, where the columns before are the same as above."""
    same, out = np.arange(len(columns[0])) > 0, []
    for c in columns:
        above = np.concatenate([np.zeros(1, c.dtype), c[:-1]])
        out.append((c - np.where(same, above, 0)).astype(np.uint32))
        same = same & (c == above)
    return out


def _unsteps(columns: list[np.ndarray]) -> list[np.ndarray]:
    same, out = np.arange(len(columns[0])) > 0, []
    for c in columns:
        total, first = np.cumsum(c, dtype=np.int64), np.flatnonzero(~same)
        c = total - np.repeat(total[first] - c[first], np.diff(first, append=len(c)))
        out.append(c)
        same = same & (c == np.concatenate([np.zeros(1, np.int64), c[:-1]]))
    return out


_KINDS = (np.uint64, np.int64, np.uint32, np.int64, np.int64, np.uint8)


def _listed(batches, order: int, model: Model, buckets: int):
    """(bucket, block, blob): a block's distinct n-grams of an order with their training counts.

    blob: numbers and, for pairs, counts of the words in it, then by n-gram its training
    count, the counts of its shorter n-gram (without the first word) and of that one's
    history, if its bucket can't add them up (4), whether its history was seen (1) and is
    hot (2); and its words, the one before the last first and the last at the end.
    """
    for block, answers, _, body in _blocks(batches):
        b = Block(body, answers, model, buckets)
        for k in range(2, order):
            b.count_grams(k)
        g = b.grams(order)
        times = np.bincount(g.of[np.repeat(b.train, b.sizes)], minlength=len(g.spot)).astype(np.uint32)
        lower = under = np.zeros(len(times), np.int64)  # for single words the counts tell
        if order > 2:
            lower, under = (np.where((times > 0) & g.told, a[g.spot], 0).astype(np.int64) for a in (b.count[order - 1], b.history[order - 1]))
        columns = times, lower, under, (g.history > 0) + np.uint8(2) * g.hot + np.uint8(4) * g.told
        place = np.zeros(len(b.times), np.int32)
        for k in np.flatnonzero(np.diff(g.cut)).tolist():
            own = g.by[g.cut[k] : g.cut[k + 1]]
            words = [w[g.spot[own]] for w in g.words]
            used = np.zeros(len(b.times), bool)
            for w in words:
                used[w] = True
            at = np.flatnonzero(used)
            place[at] = np.arange(len(at))
            yield _asked(k, block, X.press(X.deltas(b.number[at]), b.times[at] if order == 2 else np.zeros(len(at), np.int64), *(c[own] for c in columns), *_steps([place[w] for w in (*words[1:], words[0])])))


@dataclass
class _List:
    """A block's list in a bucket. words: numbers of its words, as places of them all once the bucket is read; the first by which lists are sorted."""

    block: int
    numbers: np.ndarray
    columns: list[np.ndarray]  # training counts, those of the shorter n-gram and its history, and what is known of the own history
    words: list[np.ndarray]


def _counted(batches, order: int, model: Model, limit: int = PART):
    """Answers of kind ``order``, the table of a bucket's n-grams, its sums, and those of hot histories.

    Lists are sorted by the word before the last one, and all that is added up is of n-grams
    with the same one. So a bucket is counted in parts, each of some of these words.
    """
    lists, of_words, bucket = [], [], None
    for batch in batches:
        for bucket, block, blob in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            numbers, counts, times, lower, under, history, *words = X.expand(blob, *_KINDS, *[np.uint32] * order)
            lists.append(_List(block, np.cumsum(numbers, dtype=np.uint64), [times, _narrow(lower), _narrow(under), history], [w.astype(np.uint32) for w in _unsteps(words)]))
            of_words.append(_narrow(counts) if order == 2 else None)
    if bucket is None:
        return
    every, at = np.unique(np.concatenate([x.numbers for x in lists]), return_index=True)
    of_word = np.concatenate(of_words)[at] if order == 2 else None
    del of_words, at
    for x in lists:
        place = np.searchsorted(every, x.numbers).astype(np.uint32)
        x.words, x.numbers = [place[w] for w in x.words], None
    lead = np.sort(np.concatenate([x.words[0] for x in lists]))
    cuts = np.unique(lead[limit::limit])
    del lead
    bounds = [[0, *np.searchsorted(x.words[0], cuts).tolist(), len(x.words[0])] for x in lists]
    answers = [[] for _ in lists]
    for part in range(len(cuts) + 1):
        own = [slice(b[part], b[part + 1]) for b in bounds]
        columns = [np.concatenate([x.columns[k][o] for x, o in zip(lists, own)]) for k in range(4)]
        *before, last = (np.concatenate([x.words[k][o] for x, o in zip(lists, own)]).astype(np.int64) for k in range(order))
        if len(last):
            yield from _part(order, model, bucket, every, of_word, columns, [last, *before], [o.stop - o.start for o in own], answers)
    for x, got in zip(lists, answers):
        yield _row(x.block, order, bucket, body=X.press(*(np.concatenate(a) for a in zip(*got))))


def _part(order: int, model: Model, bucket: int, every: np.ndarray, of_word: np.ndarray | None, columns: list[np.ndarray], words: list[np.ndarray], sizes: list[int], answers: list[list]):
    """Rows about one part of a bucket; what lists, of some sizes in it, are answered is added to ``answers``."""
    times, lower, under, history = columns
    before = words[1]
    for w in words[2:]:
        before = _paired(before, w, len(every))
    code = before * len(every) + words[0]
    by = np.argsort(code)
    new = np.concatenate([[True], np.diff(code[by]) > 0])
    of = np.empty(len(code), np.int64)
    of[by] = np.cumsum(new) - 1
    spot, counted = by[new], by[times[by] > 0]
    spot[of[counted]] = counted  # of an n-gram in several lists one that has its counts
    total = np.bincount(of, times, minlength=len(spot)).astype(np.int64)
    seen = total > 0
    if order == 2:
        shorter = model.word(of_word[words[0][spot]])
    else:
        rank = words[1][spot]
        for w in words[2:-1]:
            rank = np.unique(rank * len(every) + w[spot], return_inverse=True)[1]
        same = np.unique(rank * len(every) + words[0][spot], return_inverse=True)[1]
        told = history[spot] >= 4
        lower, under = (np.where(told, sent[spot], np.bincount(x, total)[x]) for x, sent in ((same, lower), (rank, under)))
        shorter = discounted(lower, model.discounts[order - 1]) / np.maximum(under, 1)
    group = np.cumsum(np.concatenate([[True], np.diff(before[spot]) != 0])) - 1
    groups = int(group[-1]) + 1
    n = np.stack([np.bincount(group[(total == r) if r <= REACH else (total > REACH)], minlength=groups) for r in range(1, REACH + 2)], axis=1)
    below = np.bincount(group, np.where(seen, shorter, 0), minlength=groups)
    back = (total[of] == 0) & (history & 3 == 1)
    end = 0
    for got, size in zip(answers, sizes):
        own = of[end : end + size]
        told = group[own[back[end : end + size]]]
        got.append((total[own], n[told].astype(np.uint32).ravel(), below[told]))
        end += size
    known = spot[seen]
    used = np.zeros(len(every), bool)
    for w in words:
        used[w[known]] = True
    place = np.cumsum(used) - 1
    yield _row(-1, TABLE, bucket, head=X.press(X.deltas(every[used]), *_steps([place[w[known]] for w in (*words[1:], words[0])])), body=X.press(total[seen]))
    yield _row(-1, SUMS, bucket, n=_counts_of(total))
    lead = np.flatnonzero(np.concatenate([[True], np.diff(group) != 0]))
    for k in np.flatnonzero(history[spot[lead]] & 3 == 3).tolist():
        yield _row(-1, HOT, bucket, ids=[int(every[w[spot[lead[k]]]]) for w in words[1:]], n=n[k].tolist(), s=float(below[k]))


def _blocks(batches) -> Iterator[tuple[int, dict[int, list[bytes]], list, bytes]]:
    """(block, answers by kind, ids, body) of the rows of ``_met``."""
    block, answers = None, {}
    for batch in batches:
        columns = [batch.column(i) for i in (0, 1, 3, 5)]
        for i in range(batch.num_rows):
            number, kind, ids, body = (c[i].as_py() for c in columns)
            if number != block:
                block, answers = number, {}
            if kind == BLOCK:
                yield block, answers, ids, body
            else:
                answers.setdefault(kind, []).append(body)


def _met(blocks: DataFrame, tables: list[DataFrame], n: int) -> DataFrame:
    """Blocks together with the answers to them, these first."""
    plain = ["block", F.col("kind").cast("int").alias("kind"), "seq", "ids", F.lit(None).cast("binary").alias("head"), "body"]
    rows = blocks.select(plain)
    for t in tables:
        rows = rows.unionByName(t.where(F.col("kind") < BLOCK).select(plain))
    return rows.repartitionById(n, F.expr(f"cast(pmod(shiftright(block, 24) * 5 + (block & 16777215), {n}) as int)")).sortWithinPartitions("block", "kind", "seq")


def _sums(table: DataFrame) -> list[int]:
    """The sums of all buckets."""
    found = table.where(F.col("kind") == SUMS).select(F.posexplode("n")).groupBy("pos").agg(F.sum("col").alias("n")).collect()
    return [r.n for r in sorted(found)]


def _hot(table: DataFrame) -> dict[tuple, tuple[np.ndarray, float]]:
    """Sums of the hot histories, fewer than buckets."""
    rows = table.where(F.col("kind") == HOT).groupBy("ids").agg(F.array(*(F.sum(F.get("n", F.lit(k))) for k in range(REACH + 1))).alias("n"), F.sum("s").alias("s")).collect()
    return {tuple(r.ids): (np.array(r.n), r.s) for r in rows}


def score(docs: DataFrame, order: int = ORDER, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of each row of ``docs``."""
    if order < 2:
        raise ValueError("Katz backoff needs an order of two or more")
    docs = X.plain(docs, id_col, text_col)
    n = X.partitions(docs)
    both = store.written(docs.mapInArrow(X.tidy(lambda b: _numbered(b, n, block_bytes)), X.BLOCK_SCHEMA), "blocks", by=["kind"])
    blocks, asked = both.where(F.col("kind") == BLOCK), "bucket int, block bigint, blob binary"
    words = both.where(F.col("kind") == WORDS).select("block", "body").mapInArrow(X.tidy(_listed_words), asked).repartitionById(n, F.col("bucket"))
    tables = [store.written(words.mapInArrow(X.tidy(_counted_words), _SCHEMA), "words", by=["kind"])]
    store.drop(docs.sparkSession, f"{both.stored_at}/kind={WORDS}")
    tokens, types, *times = _sums(tables[0]) or [0] * (REACH + 4)
    train = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % FOLDS != 0, F.lit(True))
    d = discounts(times)
    r = np.arange(1, REACH + 1)
    held = ((1 - d[1:]) * r * times[1 : REACH + 1]).sum() + SLIVER * (types - sum(times[1 : REACH + 1]))
    model = Model(tokens, types, docs.where(train).count(), tokens / n, {1: d}, held / tokens if tokens else 1.0, {})
    for k in range(2, order + 1):
        listed = _met(blocks, tables, n).mapInArrow(X.tidy(lambda b, k=k: _listed(b, k, model, n)), asked).repartitionById(n, F.col("bucket"))
        tables.append(store.written(listed.mapInArrow(X.tidy(lambda b, k=k: _counted(b, k, model)), _SCHEMA), f"grams{k}", by=["kind"]))
        store.release(docs.sparkSession)
        model.discounts[k], model.hot[k] = discounts(_sums(tables[-1]) or [0] * (REACH + 2)), _hot(tables[-1])

    def finish(batches):
        for _, answers, ids, body in _blocks(batches):
            b = Block(body, answers, model, n)
            total = lambda x: np.add.reduceat(x, b.first)
            columns = [pa.array(ids, pa.int64()), pa.array(~b.train), pa.array(b.sizes), pa.array(total((b.count[1] > 0).astype(np.int64))), pa.array(np.full(len(ids), tokens))]
            columns += [pa.array(total(model.base(b.count[1]))), pa.array(total(b.scores(order)))]
            whole = pa.RecordBatch.from_arrays(columns, names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])
            for k in range(0, len(ids), 4096):
                yield whole.slice(k, 4096)

    schema = "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double"
    return _met(blocks, tables, n).mapInArrow(X.tidy(finish), schema)
