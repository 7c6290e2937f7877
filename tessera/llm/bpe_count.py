"""Operator 10: token counts by heap-and-linked-list byte-pair merging.

The vocabulary's own pre-tokenizer cuts words into pieces. In a piece the adjacent pairs
sit in a heap by merge rank, the lowest is popped and its two symbols joined in a linked
list, and the count is the initial symbols minus the merges. No token ids are made.
Texts stay where they are: there is no shuffle, and each worker remembers the counts of
words and pieces it has met.

Defined results: a null or empty text has 0 bytes and 0 tokens; repeated rows each
give a row; a null id stays null; other columns are ignored; an empty table gives
none. A special string inside a text counts as one token, as the library takes it. Of
pairs of equal rank (a tie) the leftmost merges first. Very long texts are counted whole.
"""

from __future__ import annotations

import heapq
import json
import re

import pyarrow as pa
from pyspark.sql import DataFrame

from . import exchange as X

#: Words, and pieces, whose counts a worker remembers; beyond it the memory starts afresh.
REMEMBERED = 500_000


class MergeCounter:
    """Counts tokens of words for a byte-level BPE vocabulary file."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre, model = spec["pre_tokenizer"], spec["model"]
        if spec["normalizer"] or pre["type"] != "ByteLevel" or pre["add_prefix_space"] or not pre["use_regex"] or model["type"] != "BPE" or model.get("ignore_merges"):
            raise ValueError(f"{path}: not a plain byte-level BPE vocabulary")
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.ranks = {(a, b): rank for rank, (a, b) in enumerate(pairs)}
        special = [t["content"] for t in spec["added_tokens"]]
        self.special = re.compile("|".join(map(re.escape, sorted(special, key=len, reverse=True)))) if special else None
        self.pieces = Tokenizer.from_file(path).pre_tokenizer.pre_tokenize_str
        self.of_piece: dict[str, int] = {}
        self.of_word: dict[bytes, int] = {}

    def piece(self, symbols: str) -> int:
        """Tokens of one piece, a character for each of its bytes."""
        n = len(symbols)
        part = list(symbols)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        ranks, merges = self.ranks, 0
        heap = [(r, i, part[i], part[i + 1]) for i in range(n - 1) if (r := ranks.get((part[i], part[i + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, left, right = heapq.heappop(heap)
            j = after[i]
            if part[i] != left or j >= n or part[j] != right:
                continue  # one of the two was joined to another since
            part[i], part[j], merges = left + right, "", merges + 1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (r := ranks.get((part[i], part[k]))) is not None:
                    heapq.heappush(heap, (r, i, part[i], part[k]))
            if (k := before[i]) >= 0 and (r := ranks.get((part[k], part[i]))) is not None:
                heapq.heappush(heap, (r, k, part[k], part[i]))
        return n - merges

    def plain(self, text: str) -> int:
        total, known = 0, self.of_piece
        for p, _ in self.pieces(text):
            if (c := known.get(p)) is None:
                if len(known) >= REMEMBERED:
                    known.clear()
                c = known[p] = self.piece(p)
            total += c
        return total

    def word(self, word: bytes) -> int:
        text = word.decode()
        if self.special is None or not self.special.search(text):
            return self.plain(text)
        return sum(map(self.plain, self.special.split(text))) + len(self.special.findall(text))

    def text(self, text: bytes) -> int:
        """Tokens of a text, each word it is cut into worked out once."""
        known, words = self.of_word, X.glued_words(text)
        counts = list(map(known.get, words))
        if None in counts:
            if len(known) >= REMEMBERED:
                known.clear()
            for k, c in enumerate(counts):
                if c is None:
                    w = words[k]
                    if (c := known.get(w)) is None:
                        c = known[w] = self.word(w)
                    counts[k] = c
        return sum(counts)


#: By vocabulary file, kept between the tasks of a worker.
_COUNTERS: dict[str, MergeCounter] = {}


def token_counts(docs: DataFrame, vocabulary: str, limit: int = 512, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit (n_tokens > limit) of each row of ``docs``."""

    def run(batches):
        counter = _COUNTERS.get(vocabulary) or _COUNTERS.setdefault(vocabulary, MergeCounter(vocabulary))
        for b in batches:
            texts = [t or b"" for t in b.column(1).cast(pa.binary()).to_pylist()]
            n = [counter.text(t) for t in texts]
            columns = [b.column(0), pa.array([len(t) for t in texts], pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return X.spread(X.plain(docs, id_col, text_col)).mapInArrow(run, "doc_id bigint, n_bytes bigint, n_tokens bigint, over_limit boolean")
