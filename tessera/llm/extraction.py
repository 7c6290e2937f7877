"""Operator 13: main text of web pages by a conditional random field over leaf blocks.

A page's leaf blocks, in page order, are a chain. Features are the names of all elements
around a block and the words of their classes, ids and roles, the element it stands in, its
length, share of links, and how its text reads. Transitions between blocks among the same
elements have weights of their own. A two-label linear-chain field trained on
PAGES labelled pages (of ``page_samples``, another set than those held out for tests)
labels them; Viterbi's best path tells what is main text. Pages don't meet: there is no
shuffle but to spread a small table, and the network that tasks get is of a fixed size.

Defined results: a null or empty page, and one without main text, has the empty text;
repeated rows each give a row; a null id stays null; other columns are ignored; an empty
table gives none. Very long or deeply nested pages are read whole, in one pass. Ties between
paths go to leaving out. White space is what Unicode calls so, no-break spaces included.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import exchange as X
from . import page_samples
from .crf import Chain, Rows, viterbi
from .page_blocks import Block, Reader, text_features

PAGES, SEED = 1200, 20240301
#: A word of classes and ids becomes a feature where so many labelled blocks have it.
OFTEN = 5


def labelled(pages: list[str]) -> list[list[tuple[Block, int]]]:
    """Blocks and labels of marked pages."""
    out = []
    for page in pages:
        blocks = Reader().blocks(page)
        out.append([(b._replace(text=t), int(page_samples.MARK in b.text)) for b in blocks if (t := b.text.replace(page_samples.MARK, "").strip())])
    return [b for b in out if b]


def train(pages: list[list[tuple[Block, int]]]) -> Chain:
    counts: dict[str, int] = {}
    rows = [[*b.around, *text_features(b)] for page in pages for b, _ in page]
    for row in rows:
        for f in row:
            counts[f] = counts.get(f, 0) + 1
    chain = Chain({f: k for k, f in enumerate(sorted(f for f, n in counts.items() if n >= OFTEN))}, 2)
    x = Rows([[chain.features[f] for f in row if f in chain.features] for row in rows], len(chain.features))
    y = np.array([label for page in pages for _, label in page])
    return chain.fit(x, y, np.array(list(map(len, pages))), np.array([b.apart for page in pages for b, _ in page]))


@functools.cache
def network() -> Chain:
    return train(labelled(page_samples.pages(PAGES, SEED)))


class Extractor:
    """The main text of pages; holds the weights, and what sets of names around blocks add up to."""

    def __init__(self, chain: Chain):
        self.weight = dict(zip(chain.features, chain.weights.tolist()))
        self.steps, self.ends = chain.steps.tolist(), chain.ends.tolist()
        self.reader = Reader(frozenset(f for f in chain.features if f[0] == "~"))
        self.around: dict[frozenset, float] = {}

    def score(self, b: Block) -> float:
        w = self.weight.get
        of = self.around.get(b.around)
        if of is None:
            if len(self.around) >= 50_000:
                self.around.clear()
            of = self.around[b.around] = sum(w(f, 0.0) for f in sorted(b.around))
        return of + sum(w(f, 0.0) for f in text_features(b))

    def labels(self, blocks: list[Block]) -> list[int]:
        return viterbi([self.score(b) for b in blocks], self.steps, self.ends, [b.apart for b in blocks])

    def text(self, page: str) -> str:
        blocks = self.reader.blocks(page)
        return " ".join(b.text for b, label in zip(blocks, self.labels(blocks)) if label)


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", chain: Chain | None = None) -> DataFrame:
    """page_id, url, text and n_chars of each row of ``pages``."""
    chain = chain or network()

    def run(batches):
        extractor = Extractor(chain)
        for b in batches:
            texts = [extractor.text(page or "") for page in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col(id_col).cast("bigint").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    return X.spread(rows).mapInArrow(run, "page_id bigint, url string, text string, n_chars bigint")
