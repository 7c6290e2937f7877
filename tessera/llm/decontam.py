"""Operator 7: benchmark decontamination by a prefix-filtered set join.

An item's windows (WINDOW consecutive words; a shorter item is one window) are sets of
shingles. Shingles are ordered by rarity in the corpus. Containment of 1 needs every
shingle, so the necessary prefix is the rarest one: only it is joined with the
documents. Its place in the window gives the place in the document (positional bound),
which must hold the whole window (length bound), and the words are then compared.

Windows, their shingles and prefixes are tables, and all steps are joins and sums over
them, however large the benchmark is. What every task gets is a bitmap of FILTER_BITS bits
that passes the hashes of the table's shingles (and some others, which the join drops), so
that of a document only shingles that may match are sent, with the words around them.

Defined results: a null text has no words, is never hit and, as an item, has no
window; an item without words has none either; items with equal windows are all
named; a null item id is left out of items; repeated document rows each give a row;
a null document id stays null; other columns are ignored; an empty benchmark hits
nothing. Of shingles equally rare (a tie) the one of the least hash is the prefix, which
doesn't change a result. Very long texts are searched whole.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import exchange as X
from . import store
from . import words as W

WINDOW, SHINGLE = 10, 3
FILTER_BITS = 1 << 26


def windows(items: DataFrame, size: int = WINDOW, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """Distinct (item_id, window) rows: lower-cased words joined by spaces."""

    def run(batches):
        for b in batches:
            for i, t in zip(b.column(0).to_pylist(), b.column(1).cast(pa.binary()).to_pylist(), strict=True):
                w = W.Words([t or b""], W.ALNUM)
                n = len(w.starts)
                for k in range(0, n - size + 1 if n > size else min(n, 1), 4096):
                    found = sorted({w.text(j, min(j + size, n)) for j in range(k, min(k + 4096, max(n - size + 1, 1)))})
                    yield pa.RecordBatch.from_arrays([pa.array([i] * len(found), pa.string()), pa.array([f.decode() for f in found])], names=["item_id", "window"])

    return items.select(F.col(id_col).cast("string").alias("item_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(X.tidy(run), "item_id string, window string").distinct()


def _keys(words: np.ndarray, size: int) -> np.ndarray:
    """Keys of the shingles of a size in a run of word hashes."""
    return W.mix(W.shingle_hashes(words, size) + np.uint64(size))


def shingles(wins: DataFrame) -> DataFrame:
    """(window, words, size, place, key): the shingles of (window) rows; key is a hash."""
    schema = pa.schema([("window", pa.string()), ("words", pa.int32()), ("size", pa.int32()), ("place", pa.int32()), ("key", pa.int64())])

    def run(batches):
        for b in batches:
            texts = b.column(0).cast(pa.binary()).to_pylist()
            w = W.Words(texts, W.ALNUM)
            h, out = w.hashes(), []
            for t, low, high in zip(b.column(0).to_pylist(), w.first.tolist(), w.first[1:].tolist()):
                size = min(SHINGLE, high - low)
                out += [(t, high - low, size, place, key) for place, key in enumerate(_keys(h[low:high], size).view(np.int64).tolist())]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)] if out else [pa.array([], f.type) for f in schema], schema=schema)

    return wins.mapInArrow(X.tidy(run), "window string, words int, size int, place int, key bigint")


class Filter:
    """Passes the keys of a table and few others; also the sizes of its shingles. Its size is FILTER_BITS at most."""

    def __init__(self, table: DataFrame):
        slot = F.pmod("key", F.lit(FILTER_BITS))
        rows = table.select(F.shiftright(slot, 6).alias("at"), F.expr(f"shiftleft(1L, cast(pmod(key, {FILTER_BITS}L) % 64 AS int))").alias("bit"))
        found = rows.groupBy("at").agg(F.expr("bit_or(bit)").alias("bits")).collect()
        self.bits = np.zeros(FILTER_BITS >> 6, np.uint64)
        self.bits[np.array([r["at"] for r in found], np.int64)] = np.array([r.bits for r in found], np.int64).view(np.uint64)
        self.sizes = sorted(r["size"] for r in table.select("size").distinct().collect())  # of 1 to SHINGLE

    def passed(self, keys: np.ndarray) -> np.ndarray:
        slot = keys & np.uint64(64 * len(self.bits) - 1)
        return np.flatnonzero(self.bits[(slot >> np.uint64(6)).astype(np.int64)] >> (slot & np.uint64(63)) & np.uint64(1))


def rarity(docs: DataFrame, table: DataFrame) -> DataFrame:
    """(key, n): how often each of the table's shingles, and some others, is found in the documents."""
    shared = docs.sparkSession.sparkContext.broadcast(Filter(table))

    def run(batches):
        chosen = shared.value
        for b in batches:
            texts = [t or b"" for t in b.column(1).cast(pa.binary()).to_pylist()]
            for i, j in W.some_at_once(texts):
                h = W.Words(texts[i:j], W.ALNUM).hashes()
                for size in chosen.sizes:
                    keys = _keys(h, size)
                    found, n = np.unique(keys[chosen.passed(keys)], return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), pa.array(n)], names=["key", "n"])

    return docs.mapInArrow(X.tidy(run), "key bigint, n bigint").groupBy("key").agg(F.sum("n").alias("n"))


def prefixes(docs: DataFrame, wins: DataFrame) -> DataFrame:
    """(window, words, size, place, key) of each window's rarest shingle, without windows that have one of no document."""
    table = store.written(shingles(wins), "shingles")
    of = table.join(rarity(docs, table), "key", "left").groupBy("window", "words", "size")
    rarest = of.agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "key", "place")).alias("rarest"))
    return store.written(rarest.where("rarest.n > 0").select("window", "words", "size", "rarest.place", "rarest.key"), "prefixes")


def candidates(docs: DataFrame, prefix: DataFrame, window: int) -> DataFrame:
    """(row, doc_id, tag, n_words, near) of each of (doc_id, text, tag): where prefixes may be, with the words around them.

    row numbers the rows, in the run that writes them.
    """
    shared = docs.sparkSession.sparkContext.broadcast(Filter(prefix))
    near = pa.list_(pa.struct([("key", pa.int64()), ("at", pa.int32()), ("low", pa.int32()), ("text", pa.string())]))
    schema = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("tag", pa.binary()), ("n_words", pa.int64()), ("near", near)])

    def run(batches):
        chosen, row = shared.value, TaskContext.get().partitionId() << 40
        for b in batches:
            texts = [t or b"" for t in b.column(1).cast(pa.binary()).to_pylist()]
            for i, j in W.some_at_once(texts):
                w = W.Words(texts[i:j], W.ALNUM)
                h, found = w.hashes(), [[] for _ in range(j - i)]
                for size in chosen.sizes:
                    keys = _keys(h, size)
                    at = chosen.passed(keys)
                    of = np.searchsorted(w.first, at, side="right") - 1
                    for p, d, key in zip(at.tolist(), of.tolist(), keys[at].view(np.int64).tolist()):
                        first, end = int(w.first[d]), int(w.first[d + 1])
                        if p + size <= end:
                            low = max(first, p - window + 1)
                            found[d].append({"key": key, "at": p - first, "low": low - first, "text": w.text(low, min(end, p + window)).decode()})
                columns = [np.arange(row, row + j - i), b.column(0).slice(i, j - i), b.column(2).slice(i, j - i), np.diff(w.first), found]
                row += j - i
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) if not isinstance(c, pa.Array) else c for c, f in zip(columns, schema)], schema=schema)

    return docs.mapInArrow(X.tidy(run), "row bigint, doc_id bigint, tag binary, n_words bigint, near array<struct<key:bigint,at:int,low:int,text:string>>")


def occurrences(found: DataFrame, prefix: DataFrame) -> DataFrame:
    """(row, start, end, window): where windows occur, words compared."""
    spots = found.select("row", "n_words", F.inline("near")).join(prefix.select("key", "place", "words", "window"), "key")
    start = F.col("at") - F.col("place")
    spots = spots.where((start >= 0) & (start + F.col("words") <= F.col("n_words")))
    same = F.array_join(F.slice(F.split("text", " "), F.greatest(start - F.col("low") + 1, F.lit(1)), F.col("words")), " ") == F.col("window")
    return spots.where(same).select("row", start.alias("start"), (start + F.col("words")).alias("end"), "window").distinct()


def _of_items(items: DataFrame, size: int, id_col: str, text_col: str) -> DataFrame:
    return store.written(windows(items, size, id_col, text_col), "windows")


def clean(docs: DataFrame, items: DataFrame, size: int = WINDOW, text_col: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """``docs``, all columns, without the rows in which any window of the items occurs. Texts are known by their MD5 digests."""
    text = F.col(text_col).cast("string")
    digest = F.unhex(F.md5(F.coalesce(text, F.lit(""))))
    tagged = docs.select(F.lit(None).cast("bigint").alias("doc_id"), text.alias("text"), digest.alias("tag"))
    prefix = prefixes(tagged, _of_items(items, size, item_id, item_text).select("window").distinct())
    found = store.written(candidates(tagged, prefix, size).where("size(near) > 0"), "candidates")
    hit = occurrences(found, prefix).select("row").distinct().join(found, "row").select("tag").distinct()
    rows = docs.select(F.struct("*").alias("row"), digest.alias("tag"))  # no name of docs can clash in there
    return rows.join(hit, "tag", "left_anti").select("row.*")


def contamination(docs: DataFrame, items: DataFrame, size: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items, contaminated of each row of ``docs``.

    n_hit: words inside any occurrence of a window; items: ids of items with one, sorted.
    """
    plain = X.plain(docs, id_col, text_col).withColumn("tag", F.lit(None).cast("binary"))
    named = _of_items(items, size, item_id, item_text)
    prefix = prefixes(plain, named.select("window").distinct())
    found = store.written(candidates(plain, prefix, size), "candidates")
    hits = store.written(occurrences(found.where("size(near) > 0"), prefix), "hits")
    covered = hits.select("row", F.explode(F.sequence(F.col("start"), F.col("end") - 1)).alias("at")).distinct()
    n_hit = covered.groupBy("row").agg(F.count("*").alias("n_hit"))
    of = hits.select("row", "window").distinct().join(named.where("item_id is not null"), "window")
    of = of.groupBy("row").agg(F.sort_array(F.collect_set("item_id")).alias("items"))
    out = found.select("row", "doc_id", "n_words").join(n_hit, "row", "left").join(of, "row", "left")
    out = out.withColumns({"n_hit": F.coalesce("n_hit", F.lit(0).cast("bigint")), "items": F.coalesce("items", F.array().cast("array<string>"))})
    return out.select("doc_id", "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"), "items", (F.col("n_hit") > 0).alias("contaminated"))


def query(docs: DataFrame, items: DataFrame) -> DataFrame:
    return contamination(docs, items).select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


ORACLE_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(lower_ascii, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws
  FROM (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS lower_ascii FROM documents)),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
bw AS (SELECT DISTINCT item_id, list_slice(ws, i, i + 9) AS win FROM (SELECT item_id, ws, unnest(range(1, greatest(len(ws) - 9, 1) + 1)) AS i FROM b WHERE len(ws) > 0)),
n AS (SELECT DISTINCT len(win) AS size FROM bw),
x AS (SELECT r, unnest(ws) AS word, generate_subscripts(ws, 1) AS i FROM d),
l AS (SELECT r, i, list(word) OVER (PARTITION BY r ORDER BY i ROWS BETWEEN CURRENT ROW AND 9 FOLLOWING) AS next FROM x),
dw AS (SELECT r, i, size, list_slice(next, 1, size) AS win FROM l, n WHERE len(next) >= size),
h AS (SELECT r, i, size, item_id FROM dw JOIN bw USING (win)),
c AS (SELECT r, count(DISTINCT pos) AS n_hit FROM (SELECT r, unnest(range(i, i + size)) AS pos FROM (SELECT DISTINCT r, i, size FROM h)) GROUP BY r),
s AS (SELECT r, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS items FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS x FROM h WHERE item_id IS NOT NULL) GROUP BY r)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN c USING (r) LEFT JOIN s USING (r)
"""
