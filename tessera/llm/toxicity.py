"""Operator 1: toxicity by a convolutional text classifier trained in numpy.

A word's embedding is the sum of hashed rows for the word, its first four and its
first five bytes (two rows each, so one chance collision is not enough). Filters of
several widths slide over the whole text, their maxima over it go through a logistic
layer. Inputs are the words of the text alone; language, source, id and labels are
never inputs of a score. Thresholds for rejecting are calibrated by language on a fold
of ids kept out of the fit, from all its clean rows of every length.

The fit takes a bounded sample: at most SAMPLE labelled ids of each class outside the
folds HELD and ASIDE that the documents have, languages in turn and in the order of a
hash of the ids in each, and one whole text of each. Scoring and calibration cover every
row and whole texts. For a cut, rows of one id and language whose scores share a bin
count once, so that an id with many copies doesn't set it.

Defined results: null, empty and wordless texts get the score of no word; repeated
rows each give a row; a row without an id is scored and not held out; labels that are
null are not used, and of several labels of an id the largest counts; without labels
of both classes every score is 0.5 and the thresholds are 1; other columns are
ignored; an empty table gives none. Very long texts are scored whole, the maxima taken
over all of them. Ties: a score of just a threshold rejects, one of 0.5 is predicted
toxic; of several texts of an id the last in byte order is fitted.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import exchange as X
from . import store
from . import words as W

ROWS, DIM, WIDTHS, FILTERS, PAD = 1 << 18, 8, (1, 2, 3), 8, 3
SAMPLE = 3000
#: Parts of a class and language that are ranked by themselves before the whole is.
RANKED = 64
#: Rows of the table that fewer texts of the sample touch stay zero, as do those of words never seen.
COMMON = 4
#: Calibration: one clean row in so many may be rejected, and no cut is lower than LEAST.
#: A language with fewer clean rows than that, but FEW, has a cut above all of them and not below the cut of all languages.
CLEAN, FEW, LEAST = 200, 50, 0.1
#: Bins of a score's log odds in one unit of them; a cut is the highest score of a bin, so less than a bin too high.
BINS = 128
EPOCHS, BATCH, RATE, SEED = 12, 64, 0.05, 7
#: Of FOLDS folds of ids, HELD measures the accuracy and ASIDE gives the thresholds.
FOLDS, HELD, ASIDE = 5, 0, 1


def features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Embedding rows of each word, (words, 6), and the first word of each text."""
    w = W.Words(texts, W.ALNUM)
    prefix = W.prefix_hashes(w.data)
    mask, out = np.uint64(ROWS - 1), np.empty((len(w.starts), 6), np.int32)
    for k, size in enumerate((None, 4, 5)):
        h = W.span_hashes(prefix, w.starts, w.ends if size is None else np.minimum(w.ends, w.starts + size))
        h = W.mix(h + np.uint64(k + 1))
        out[:, 2 * k] = h & mask
        out[:, 2 * k + 1] = (h >> np.uint64(32)) & mask
    return out, w.first


@dataclass
class Network:
    table: np.ndarray
    filters: list[np.ndarray]
    biases: list[np.ndarray]
    out: np.ndarray
    bias: float
    thresholds: dict[str | None, float] = field(default_factory=dict)

    def pooled(self, rows: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray], np.ndarray]:
        """Maxima (texts, filters), the padded embeddings, the activations and each text's place in them."""
        n = np.diff(first)
        docs = len(n)
        at = first[:-1] + PAD * np.arange(docs)
        x = np.zeros((len(rows) + PAD * docs + PAD, DIM), np.float32)
        spot = np.arange(len(rows)) + PAD * np.repeat(np.arange(docs), n)
        total = self.table[rows[:, 0]]
        for k in range(1, rows.shape[1]):
            total += self.table[rows[:, k]]
        x[spot] = total
        size = len(rows) + PAD * docs
        outside = np.ones(size, bool)
        outside[spot] = False
        outside[at[n == 0]] = False
        maxima, acts = [], []
        for w, f, b in zip(WIDTHS, self.filters, self.biases):
            y = x[:size] @ f[0] + b
            for j in range(1, w):
                y += x[j : size + j] @ f[j]
            y[outside] = -np.inf
            maxima.append(np.maximum.reduceat(y, at, axis=0) if docs else np.zeros((0, FILTERS), np.float32))
            acts.append(y)
        return np.maximum(np.concatenate(maxima, axis=1), 0), x, acts, at

    def scores(self, texts: list[bytes]) -> np.ndarray:
        """Scores of any number of texts, some at once."""
        out = np.zeros(len(texts))
        for i, j in W.some_at_once(texts):
            p, *_ = self.pooled(*features(texts[i:j]))
            out[i:j] = 1 / (1 + np.exp(-np.clip(p @ self.out + self.bias, -30, 30).astype(np.float64)))
        return out


@dataclass
class Gradients:
    """Of the mean log loss; ``table`` has a row for each of the embedding rows ``spots``."""

    filters: list[np.ndarray]
    biases: list[np.ndarray]
    out: np.ndarray
    bias: float
    spots: np.ndarray
    table: np.ndarray


def gradients(net: Network, rows: np.ndarray, first: np.ndarray, labels: np.ndarray) -> Gradients:
    """Of some texts, given by ``features``."""
    p, x, acts, at = net.pooled(rows, first)
    docs = len(labels)
    error = (1 / (1 + np.exp(-np.clip(p @ net.out + net.bias, -30, 30))) - labels) / docs
    dp = np.where(p > 0, error[:, None] * net.out, 0).astype(np.float32)
    where, what = [np.zeros(0, np.int64)], [np.zeros((0, DIM), np.float32)]
    by_filter, by_bias = [np.zeros_like(f) for f in net.filters], [np.zeros_like(b) for b in net.biases]
    ends = np.append(at[1:], len(x) - PAD)
    for d in range(docs):
        for q, w in enumerate(WIDTHS):
            g = dp[d, q * FILTERS : (q + 1) * FILTERS]
            live = np.flatnonzero(g)
            if not len(live):
                continue
            top = at[d] + acts[q][at[d] : ends[d]][:, live].argmax(axis=0)  # a maximum depends on its window alone
            by_bias[q][live] += g[live]
            for j in range(w):
                by_filter[q][j][:, live] += x[top + j].T * g[live]
                where.append(top + j)
                what.append((net.filters[q][j][:, live] * g[live]).T)
    word_of = np.full(len(x), -1)
    word_of[np.arange(len(rows)) + PAD * np.repeat(np.arange(docs), np.diff(first))] = np.arange(len(rows))
    place, by_word = word_of[np.concatenate(where)], np.concatenate(what)
    by_word, place = by_word[place >= 0], place[place >= 0]
    spots, to = np.unique(rows[place].ravel(), return_inverse=True)
    by_row = np.zeros((len(spots), DIM), np.float32)
    np.add.at(by_row, to, np.repeat(by_word, rows.shape[1], axis=0))
    return Gradients(by_filter, by_bias, (p.T @ error).astype(np.float32), float(error.sum()), spots, by_row)


def _fit(texts: list[bytes], labels: np.ndarray) -> Network:
    rng = np.random.default_rng(SEED)
    net = Network(
        rng.normal(0, 0.01, (ROWS, DIM)).astype(np.float32),
        [rng.normal(0, 0.5 / w, (w, DIM, FILTERS)).astype(np.float32) for w in WIDTHS],
        [np.zeros(FILTERS, np.float32) for _ in WIDTHS],
        rng.normal(0, 0.3, FILTERS * len(WIDTHS)).astype(np.float32),
        0.0,
    )
    made = [features([t]) for t in texts]
    held_by = np.zeros((2, ROWS), np.int32)
    for (rows, _), y in zip(made, labels):
        held_by[int(y), np.unique(rows)] += 1
    learned = held_by.sum(axis=0) >= COMMON
    net.table[~learned] = 0
    n = np.bincount(labels.astype(int), minlength=2)
    odds = np.log((held_by[1] + 0.5) / (n[1] + 1)) - np.log((held_by[0] + 0.5) / (n[0] + 1))
    net.table[:, 0] = np.where(learned, np.clip(odds, -2, 4) / 4, 0)  # what a row alone says, as a start
    for f in net.filters:
        f[:, 0, 0] = 0.5
    net.out[::FILTERS] = 1
    seen = [np.zeros_like(a) for a in (*net.filters, *net.biases, net.out)]
    seen_bias, seen_rows = 0.0, np.zeros(ROWS, np.float32)

    def step(value, grad, past):
        past += grad * grad
        value -= RATE * grad / (np.sqrt(past) + 1e-6)

    for _ in range(EPOCHS):
        order = rng.permutation(len(texts))
        for k in range(0, len(order), BATCH):
            some = order[k : k + BATCH]
            rows = np.concatenate([made[i][0] for i in some])
            first = np.concatenate([[0], np.cumsum([len(made[i][0]) for i in some])])
            g = gradients(net, rows, first, labels[some])
            spots, grad = g.spots, g.table
            grad[~learned[spots]] = 0
            seen_rows[spots] += (grad * grad).sum(axis=1)
            net.table[spots] -= RATE * grad / (np.sqrt(seen_rows[spots, None]) + 1e-6)
            for value, grad, past in zip((*net.filters, *net.biases, net.out), (*g.filters, *g.biases, g.out), seen):
                step(value, grad, past)
            seen_bias += g.bias**2
            net.bias -= RATE * g.bias / (seen_bias**0.5 + 1e-6)
    return net


def _threshold(bins: list[tuple[int, int, float]], floor: float) -> float:
    """The least cut, from LEAST up, that at most 1 in CLEAN clean rows reach; ``floor`` at least where few rows tell.

    bins: (bin, rows, highest score) of the clean rows.
    """
    spared = sum(n for _, n, _ in bins) // CLEAN
    cut, above = 0.0, 0
    for _, n, top in sorted(bins, reverse=True):
        above += n
        if above > spared:
            cut = float(np.nextafter(top, 2))
            break
    return max(cut, LEAST if spared else floor)


def calibrate(texts: DataFrame, clean_ids: DataFrame, net: Network) -> dict[str | None, float]:
    """Thresholds by language, and for all rows under None, from the rows of (id, text, lang) in fold ASIDE whose ids are clean."""
    shared = texts.sparkSession.sparkContext.broadcast(net)
    rows = texts.where(fold(F.col("id")) == ASIDE).select(F.lit(0).alias("at"), "text", F.col("id").alias("of"), "lang")
    scored = rows.mapInArrow(X.tidy(_scorer(shared)), "of bigint, lang string, score double")
    least = float(np.log(LEAST / (1 - LEAST)))
    odds = F.log(F.col("score") / (1 - F.col("score")))
    bins = F.when(F.col("score") < LEAST, -1).otherwise(F.floor((odds - least) * BINS)).cast("int")
    once = scored.select("of", "lang", bins.alias("bin"), "score").groupBy("of", "lang", "bin").agg(F.max("score").alias("top"))
    told = once.join(clean_ids.where(fold(F.col("id")) == ASIDE).select(F.col("id").alias("of")), "of").groupBy("lang", "bin").agg(F.count("*").alias("n"), F.max("top").alias("top"))
    every, own = F.lit(None).cast("string"), F.col("lang")
    both = told.select(F.explode(F.when(F.coalesce(own, F.lit("")) == "", F.array(every)).otherwise(F.array(every, own))).alias("lang"), "bin", "n", "top")
    both = both.groupBy("lang", "bin").agg(F.sum("n").alias("n"), F.max("top").alias("top"))
    by = both.groupBy("lang").agg(F.sum("n").alias("all"), F.collect_list(F.struct("bin", "n", "top")).alias("bins")).where((F.col("all") >= FEW) | F.col("lang").isNull())
    found = {r["lang"]: [tuple(x) for x in r["bins"]] for r in by.collect()}
    every = _threshold(found.pop(None, []), 0.5)
    return {None: every} | {lang: _threshold(own, every) for lang, own in found.items()}


def fold(doc_id: Column, folds: int = FOLDS) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % folds


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Network | None:
    """Fit on labelled rows outside the folds HELD and ASIDE, thresholds from fold ASIDE; None without both classes."""
    lang = F.col(lang_col).cast("string") if lang_col in docs.columns else F.lit(None).cast("string")
    texts = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("string").alias("text"), lang.alias("lang"))
    lab = labels.select(F.col("doc_id").cast("bigint").alias("id"), F.col("toxic").cast("int").alias("toxic")).where("id is not null and toxic in (0, 1)")
    lab = lab.where(fold(F.col("id")) != HELD).groupBy("id").agg(F.max("toxic").alias("toxic"))
    lab = store.written(lab.join(texts.groupBy("id").agg(F.min("lang").alias("lang")), "id"), "labelled")  # of what the documents have
    least = [F.xxhash64("id"), F.col("id")]
    turn = lambda *by: F.row_number().over(Window.partitionBy("toxic", "lang", *by).orderBy(*least))
    ranked = lab.where(fold(F.col("id")) != ASIDE)
    for by in ([F.pmod(F.crc32(F.col("id").cast("string").cast("binary")), F.lit(RANKED))], []):  # by parts first, so that no task ranks all ids
        ranked = ranked.withColumn("turn", turn(*by)).where(F.col("turn") <= sample)
    chosen = [ranked.where(F.col("toxic") == c).orderBy("turn", F.xxhash64("id"), "id").limit(sample).select("id", "toxic") for c in (0, 1)]
    rows = texts.join(F.broadcast(chosen[0].unionByName(chosen[1])), "id").groupBy("id", "toxic").agg(F.max("text").alias("text"))
    rows = sorted(rows.select("id", "toxic", F.coalesce("text", F.lit("")).alias("text")).collect(), key=lambda r: r.id)  # 2 * sample at most
    y = np.array([r.toxic for r in rows], np.float32)
    if len(set(y.tolist())) < 2:
        return None
    net = _fit([r.text.encode() for r in rows], y)
    all_of = {r.toxic: r.n for r in lab.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    net.bias += float(np.log(all_of[1] / all_of[0]) - np.log((y == 1).sum() / (y == 0).sum()))  # from the sample's share to that of all labels
    net.thresholds = calibrate(texts, lab.where("toxic = 0"), net)
    return net


def _scorer(shared):
    """Batches of (anything, text, others) as the others and the score."""

    def run(batches):
        net = shared.value
        for b in batches:
            texts = [t or b"" for t in b.column(1).cast(pa.binary()).to_pylist()]
            s = net.scores(texts) if net else np.full(len(texts), 0.5)
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(2, b.num_columns)), pa.array(s)], names=[*b.schema.names[2:], "score"])

    return run


def score(docs: DataFrame, net: Network | None, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """doc_id, score, threshold (of the row's language), rejected for each row of ``docs``. The network's size is fixed by ROWS and DIM."""
    shared = docs.sparkSession.sparkContext.broadcast(net)
    lang = F.col(lang_col).cast("string") if lang_col in docs.columns else F.lit(None).cast("string")
    rows = docs.select(F.lit(0).alias("at"), F.col(text_col).cast("string").alias("text"), F.col(id_col).cast("bigint").alias("doc_id"), lang.alias("lang"))
    scored = rows.mapInArrow(X.tidy(_scorer(shared)), "doc_id bigint, lang string, score double")
    cuts = net.thresholds if net else {None: 1.0}
    threshold = F.lit(cuts[None])
    if own := [F.lit(x) for lang, cut in cuts.items() if lang is not None for x in (lang, cut)]:
        threshold = F.coalesce(F.try_element_at(F.create_map(*own), F.col("lang")), threshold)
    return scored.select("doc_id", "score", threshold.alias("threshold")).withColumn("rejected", F.col("score") >= F.col("threshold"))


def clean(docs: DataFrame, net: Network | None, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """``docs``, all columns, without the rows whose score reaches the threshold of their language."""
    if net is None:
        return docs
    shared = docs.sparkSession.sparkContext.broadcast(net)
    text_at, lang_at = docs.columns.index(text_col), docs.columns.index(lang_col) if lang_col in docs.columns else None

    def run(batches):
        net = shared.value
        for b in batches:
            langs = b.column(lang_at).to_pylist() if lang_at is not None else [None] * b.num_rows
            limits = np.array([net.thresholds.get(x, net.thresholds[None]) for x in langs])
            texts = [t or b"" for t in b.column(text_at).cast(pa.binary()).to_pylist()]
            yield b.filter(pa.array(net.scores(texts) < limits, pa.bool_()))

    return docs.mapInArrow(X.tidy(run), docs.schema)  # as ``rejected`` of ``score`` says


def query(docs: DataFrame, labels: DataFrame) -> DataFrame:
    out = score(docs, train(docs, labels))
    held = F.coalesce(fold(F.col("doc_id")) == HELD, F.lit(False))
    return out.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "threshold", "rejected")
