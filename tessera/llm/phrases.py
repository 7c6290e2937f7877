"""Operator 12: collocations from a weighted de Bruijn graph of words.

1. Words. Texts are cut into pieces and words, in blocks of one language that are written
   once. Words found LEAST times or more get numbers; a rarer word is in no candidate, so a
   gram ends before it as it does at the end of its piece.
2. Edges. Each place gives the longest gram of up to four words that starts there. Four
   words are an edge from the node of the first three to that of the last three; a shorter
   gram is a piece-end correction. Blocks add up their own before anything is shuffled.
3. Flow. A three-word node's count is what flows out of it and what ends there; a pair's
   is the flow of its nodes and what ends after it; words were counted in step 1.
4. Paths. An edge that takes the whole flow of both its nodes is unary. Unary chains become
   one path each, their heads found by pointer doubling, so a passage that is repeated word
   for word is one row. Such a chain can't close: its first place in a piece has nothing
   before it.
5. Candidates are edges, nodes that are no part of a longer path, and pairs. A phrase inside
   a longer one is inside one that is a word longer and found as often or more, so edges
   tell which nodes go and nodes which pairs. Counts of parts come by one join.

Scores are decimals where a product may pass 64 bits. All grams of a pair of words meet in
one task, where edges, nodes and pairs are added up one after another without another
shuffle. A pair of which each word makes up more than HOT of all words (there are fewer
than 1 / HOT of them) is dealt by the word after it, and its own sum is added up after that.

Defined results: a null or empty text has no words; a null language is ``und``; repeated
rows count again; ids are not used and may be null or repeated; other columns are ignored;
very long texts are whole, in a block of their own; an empty table gives none. Ties in score
and count go by the phrase's bytes.
"""

from __future__ import annotations

import functools
import itertools
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import exchange as X
from . import store

LEAST, KEEP, TOP = 30, 80, 2000
BLOCK_BYTES = 8 << 20
#: Parts into which a language is dealt for a first cut to TOP.
SALTS = 64
HOT = 1e-3
TOKENS, WORDS = 0, 1

_BLOCKS = "block bigint, kind int, lang string, place bigint, word string, n bigint, body binary"
_ARROW = pa.schema([("block", pa.int64()), ("kind", pa.int32()), ("lang", pa.string()), ("place", pa.int64()), ("word", pa.string()), ("n", pa.int64()), ("body", pa.binary())])
_GRAM = ("w1", "w2", "w3", "w4")
#: Every end of a piece as a full stop, tabs as spaces.
_MARKS = bytes(ord(".") if chr(b) in ".,;:!?\n\x0b\x0c\r" else ord(" ") if b == 9 else b for b in range(256))


def words_and_ends(text: bytes) -> list[bytes]:
    """The words of a text, with ``.`` where a piece ends."""
    return text.lower().translate(_MARKS).replace(b".", b" . ").split()


def _blocks(batches, limit: int):
    """Rows of kind TOKENS, a block's words as numbers of its own (0 ends a piece), and of kind WORDS, what those stand for."""
    home, blocks = TaskContext.get().partitionId() << 24, itertools.count()
    held: dict[str, list[bytes]] = defaultdict(list)
    size: dict[str, int] = defaultdict(int)

    def rows(lang: str):
        block, own = home + next(blocks), defaultdict(itertools.count().__next__)
        own[b"."]
        found = words_and_ends(b".".join(held.pop(lang)))
        size.pop(lang)
        ids = np.fromiter(map(own.__getitem__, found), np.uint32, len(found))
        n = len(own) - 1
        counts = np.bincount(ids, minlength=n + 1)[1:]
        one = [[block], [TOKENS], [lang], [None], [None], [None], [X.press(ids)]]
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(one, _ARROW)], schema=_ARROW)
        if n:
            many = [np.full(n, block), np.full(n, WORDS, np.int32), [lang] * n, np.arange(1, n + 1), [w.decode() for w in itertools.islice(own, 1, None)], counts, [None] * n]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(many, _ARROW)], schema=_ARROW)

    for batch in batches:
        for text, lang in zip(batch.column(0).cast(pa.binary()).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if not text:
                continue
            if held[lang] and size[lang] + len(text) > limit:
                yield from rows(lang)
            held[lang].append(text)
            size[lang] += len(text) + 1
            if sum(size.values()) > 3 * limit and len(size) > 1:
                yield from rows(max(size, key=size.get))
    for lang in list(held):
        if held[lang]:
            yield from rows(lang)


def longest_grams(ids: np.ndarray, numbers: np.ndarray) -> tuple[np.ndarray, ...]:
    """(w1, w2, w3, w4, count) of the longest grams from each place of a block on.

    ids: words of the block, 0 for an end; numbers: what is known of each, 0 for rare words.
    Of a gram of fewer than four words the others are 0.
    """
    n = len(ids)
    at = np.zeros(n + 3, np.uint64)
    at[:n] = np.where(numbers[ids] > 0, ids, 0)
    second = at[1 : n + 1]
    third = np.where(second > 0, at[2 : n + 2], 0)
    fourth = np.where(third > 0, at[3:], 0)
    live = at[:n] > 0
    half = np.uint64(32)
    front, back = ((at[:n] << half) | second)[live], ((third << half) | fourth)[live]
    order = np.lexsort((back, front))
    front, back = front[order], back[order]
    first = np.flatnonzero(np.concatenate([[True], (front[1:] != front[:-1]) | (back[1:] != back[:-1])])) if len(front) else np.zeros(0, np.int64)
    counts = np.diff(np.append(first, len(front)))
    front, back, low = front[first], back[first], np.uint64(0xFFFFFFFF)
    return (*(numbers[x.astype(np.int64)] for x in (front >> half, front & low, back >> half, back & low)), counts)


def _grams(batches, hot: np.ndarray):
    """(w1 .. w4, n, salt) of grams of two words or more; salt is 0 but for pairs of hot words."""
    for batch in batches:
        for body, known in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            (ids,) = X.expand(body, np.uint32)
            numbers = np.zeros(int(ids.max(initial=0)) + 1, np.int64)
            pairs = known.values.flatten() if known.is_valid else ()
            if len(pairs):
                numbers[pairs[0].to_numpy(zero_copy_only=False)] = pairs[1].to_numpy(zero_copy_only=False)
            *words, n = longest_grams(ids, numbers)
            salt = np.where(np.isin(words[0], hot) & np.isin(words[1], hot), 1 + words[2] % SALTS, 0)
            two = words[1] > 0
            yield pa.RecordBatch.from_arrays([pa.array(c[two], pa.int64()) for c in (*words, n, salt)], names=[*_GRAM, "n", "salt"])


def _added(grams: DataFrame, least: int) -> DataFrame:
    """(w1 .. w4, f) of the edges, nodes and pairs found ``least`` times or more, zeros for missing words.

    After each sum a gram passes its count on to the one without its last word, and stays
    itself if it is common; all of it within the partitions of (w1, w2, salt).
    """
    pair, f = ["w1", "w2", "salt"], F.sum("n").alias("n")
    zero, common = F.lit(0).cast("bigint"), F.col("n") >= least
    four = grams.repartition(*pair).groupBy(*pair, "w3", "w4").agg(f)
    to_three = F.when((F.col("w4") > 0) & common, F.array("w4", zero)).otherwise(F.array(zero))
    three = four.select(*pair, "w3", F.explode(to_three).alias("w4"), "n").groupBy(*pair, "w3", "w4").agg(f)
    rest = lambda *ws: F.struct(*[w.cast("bigint").alias(n) for w, n in zip(ws, ("w3", "w4"))])
    to_two = F.when(F.col("w4") > 0, F.array(rest(F.col("w3"), F.col("w4")))).when((F.col("w3") > 0) & common, F.array(rest(F.col("w3"), zero), rest(zero, zero)))
    two = three.select(*pair, F.inline(to_two.otherwise(F.array(rest(zero, zero)))), "n")
    two = two.groupBy(*pair, "w3", "w4").agg(f).where(common | (F.col("salt") > 0) & (F.col("w3") == 0))
    rows = store.written(two, "grams")
    parts = (F.col("salt") > 0) & (F.col("w3") == 0)
    whole = rows.where(parts).groupBy(*_GRAM).agg(f).where(common)
    return rows.where(~parts).select(*_GRAM, F.col("n").alias("f")).unionByName(whole.withColumnRenamed("n", "f"))


def _common_words(listed: DataFrame, least: int) -> DataFrame:
    """(lang, word, f, id) of the words found ``least`` times or more; ids count from one."""
    some = listed.groupBy("lang", "word").agg(F.sum("n").alias("f")).where(F.col("f") >= least)
    some = store.written(some.withColumn("spot", F.monotonically_increasing_id()), "common-words")
    part, place = F.shiftright("spot", 33), F.col("spot").bitwiseAND((1 << 33) - 1)
    sizes = {r["part"]: r["size"] for r in some.groupBy(part.alias("part")).agg(F.count("*").alias("size")).collect()}  # a row a task
    begins, at = {}, 1
    for p in sorted(sizes):
        begins[p], at = at, at + sizes[p]
    offsets = some.sparkSession.createDataFrame(list(begins.items()), "part bigint, begin bigint")
    return some.withColumn("part", part).join(F.broadcast(offsets), "part").select("lang", "word", "f", (F.col("begin") + place).alias("id"))


def _node(*names: str) -> Column:
    return F.struct(*[F.col(n).alias(f"w{k + 1}") for k, n in enumerate(names)])


def paths(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The compacted graph: (words, f) of each path, and the (w1 .. w4, n) that join paths.

    nodes: (w1, w2, w3, f). edges: (w1 .. w4, n, f), f the flow of the first node. A node
    that no unary edge touches is a path of three words.
    """
    ends = nodes.select(_node("w1", "w2", "w3").alias("node"), F.col("f").alias("into"))
    met = edges.withColumn("node", _node("w2", "w3", "w4")).join(ends, "node")
    unary = (F.col("n") == F.col("f")) & (F.col("n") == F.col("into"))
    met = store.written(met.select(*_GRAM, "n", "node", unary.alias("unary")), "edges")
    branches = met.where("not unary").select(*_GRAM, "n")
    behind = store.written(met.where("unary").select("node", _node("w1", "w2", "w3").alias("to"), F.lit(1).cast("bigint").alias("d")), "chains")
    done = []
    while True:  # each round doubles how far ``to`` is behind; rounds are the logarithm of the longest path
        further = behind.select(F.col("node").alias("to"), F.col("to").alias("beyond"), F.col("d").alias("more"))
        moved = behind.join(further, "to", "left")
        moved = moved.select("node", F.coalesce("beyond", "to").alias("to"), (F.col("d") + F.coalesce("more", F.lit(0))).alias("d"), F.col("beyond").isNotNull().alias("moved"))
        moved = store.written(moved, "chains")
        done.append(behind)
        behind = moved.select("node", "to", "d")
        if not moved.where("moved").limit(1).count():
            break
    for old in done:
        store.forget(old) if hasattr(old, "stored_at") else None
    placed = ends.join(behind, "node", "left").select(F.coalesce("to", "node").alias("head"), F.coalesce("d", F.lit(0)).cast("bigint").alias("d"), "node.w3", "into")
    chains = placed.groupBy("head").agg(F.sort_array(F.collect_list(F.struct("d", "w3"))).alias("rest"), F.first("into").alias("f"))
    words = F.concat(F.array("head.w1", "head.w2"), F.transform("rest", lambda x: x["w3"]))
    return chains.select(words.alias("words"), "f"), branches


def _scored(candidates: DataFrame, counts: DataFrame) -> DataFrame:
    """(lang, phrase, a, l, r, score) of (w1 .. w4, a) by their weakest cut.

    counts: (w1, w2, w3, f, lang, word) of all words, pairs and nodes, zeros for what is missing.
    """
    c, none = F.col, F.lit(0).cast("bigint")
    part = lambda name, *ws: F.struct(F.lit(name).alias("part"), *[(c(ws[k]) if k < len(ws) else none).alias(f"p{k + 1}") for k in range(3)])
    alone = [part(w, w) for w in _GRAM]
    parts = (
        F.when(c("w3") == 0, F.array(*alone[:2]))
        .when(c("w4") == 0, F.array(*alone[:3], part("w1w2", "w1", "w2"), part("w2w3", "w2", "w3")))
        .otherwise(F.array(*alone, part("w1w2", "w1", "w2"), part("w3w4", "w3", "w4"), part("w1w2w3", "w1", "w2", "w3"), part("w2w3w4", "w2", "w3", "w4")))
    )
    keys = counts.select(*[c(f"w{k}").alias(f"p{k}") for k in (1, 2, 3)], "f", "lang", "word")
    met = candidates.select(*_GRAM, "a", F.inline(parts)).join(keys, ["p1", "p2", "p3"])
    names = [*_GRAM, "w1w2", "w2w3", "w3w4", "w1w2w3", "w2w3w4"]
    found = [F.max(F.when(c("part") == n, c("f"))).alias(f"f_{n}") for n in names]
    text = [F.max(F.when(c("part") == w, c("word"))).alias(f"t_{w}") for w in _GRAM]
    one = met.groupBy(*_GRAM, "a").agg(*found, *text, F.max("lang").alias("lang"))

    def cut(k: int, left: str, right: str) -> Column:
        sides = c(f"f_{left}").cast("decimal(20,0)") + c(f"f_{right}").cast("decimal(20,0)")
        score = F.expr(f"(cast(a as decimal(20,0)) * 2000000BD) div (cast(f_{left} as decimal(20,0)) + cast(f_{right} as decimal(20,0)))")
        return F.struct(F.when(sides.isNotNull(), score).alias("score"), F.lit(k).alias("k"), c(f"f_{left}").alias("l"), c(f"f_{right}").alias("r"))

    weakest = (
        F.when(c("w3") == 0, cut(1, "w1", "w2"))
        .when(c("w4") == 0, F.least(cut(1, "w1", "w2w3"), cut(2, "w1w2", "w3")))
        .otherwise(F.least(cut(1, "w1", "w2w3w4"), cut(2, "w1w2", "w3w4"), cut(3, "w1w2w3", "w4")))
    )
    return one.withColumn("cut", weakest).select("lang", F.concat_ws(" ", *[f"t_{w}" for w in _GRAM]).alias("phrase"), "a", "cut.l", "cut.r", "cut.score")


def collocations(docs: DataFrame, least: int = LEAST, keep: int = KEEP, top: int | None = TOP, text_col: str = "text", lang_col: str = "lang", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """lang, rank, phrase, a, l, r, n and score of each language's first ``top`` phrases, or of all."""
    texts = docs.select(F.col(text_col).cast("string").alias("text"), F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"))
    blocks = store.written(texts.mapInArrow(lambda b: _blocks(b, block_bytes), _BLOCKS), "word-blocks", by=["kind"])
    listed = blocks.where(F.col("kind") == WORDS)
    totals = listed.groupBy("lang").agg(F.sum("n").alias("total"))
    common = _common_words(listed, least)
    known = listed.join(common, ["lang", "word"]).groupBy("block").agg(F.collect_list(F.struct("place", "id")).alias("known"))
    share = HOT * (listed.agg(F.sum("n")).first()[0] or 0)
    hot = np.array([r["id"] for r in common.where(F.col("f") > share).select("id").collect()], np.int64)  # fewer than 1 / HOT
    joined = blocks.where(F.col("kind") == TOKENS).select("block", "body").join(known, "block").select("body", "known")
    grams = joined.mapInArrow(lambda b: _grams(b, hot), "w1 bigint, w2 bigint, w3 bigint, w4 bigint, n bigint, salt bigint")

    three = ["w1", "w2", "w3"]
    added = store.written(_added(grams, least), "common-grams")
    pairs = added.where("w3 = 0").select("w1", "w2", "f")
    nodes = added.where("w3 > 0 and w4 = 0").select(*three, "f")
    edges = added.where("w4 > 0").withColumnRenamed("f", "n").join(nodes, three)
    chains, branches = paths(nodes, edges.select(*_GRAM, "n", "f"))
    chains = store.written(chains, "paths")

    zero = F.lit(0).cast("bigint")
    inner = F.transform(F.sequence(F.lit(0), F.size("words") - 4), lambda i: F.struct(*[F.get("words", i + k).alias(f"w{k + 1}") for k in range(4)]))
    fours = chains.where(F.size("words") > 3).select(F.inline(inner), F.col("f").alias("a")).unionByName(branches.withColumnRenamed("n", "a"))
    above = lambda rows, size, f: functools.reduce(
        DataFrame.unionByName, [rows.select(*[F.col(_GRAM[k + s]).alias(_GRAM[k]) for k in range(size)], F.col(f).alias("longer")) for s in (0, 1)]
    ).groupBy(*_GRAM[:size]).agg(F.max("longer").alias("longer"))
    stays = (F.coalesce("longer", zero).cast("decimal(20,0)") * 100) < F.col("a").cast("decimal(20,0)") * keep
    lone = chains.where(F.size("words") == 3).select(*[F.col("words")[k].alias(_GRAM[k]) for k in range(3)], F.col("f").alias("a"))
    threes = lone.join(above(branches, 3, "n"), three, "left").where(stays).select(*three, zero.alias("w4"), "a")
    twos = pairs.withColumnRenamed("f", "a").join(above(nodes, 2, "f"), ["w1", "w2"], "left").where(stays).select("w1", "w2", zero.alias("w3"), zero.alias("w4"), "a")

    null = F.lit(None).cast("string")
    counts = common.select(F.col("id").alias("w1"), zero.alias("w2"), zero.alias("w3"), "f", "lang", "word")
    counts = counts.unionByName(pairs.select("w1", "w2", zero.alias("w3"), "f", null.alias("lang"), null.alias("word"))).unionByName(nodes.select(*three, "f", null.alias("lang"), null.alias("word")))
    scored = _scored(fours.unionByName(threes).unionByName(twos), counts)
    best = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    if top is not None:
        part = Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(SALTS))).orderBy(*best)
        scored = scored.withColumn("rank", F.row_number().over(part)).where(F.col("rank") <= top)
    ranked = scored.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*best)).cast("bigint"))
    ranked = ranked if top is None else ranked.where(F.col("rank") <= top)
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", F.col("total").alias("n"), "score")


def _sql(least: int = LEAST, keep: int = KEEP, top: int = TOP) -> str:
    part = lambda i, j: f"list_aggregate(ws[{i}:{j}], 'string_agg', ' ')"
    cuts = " UNION ALL ".join(f"SELECT lang, phrase, size, a, {k} AS k, {part(1, k)} AS x, {part(k + 1, 4)} AS y FROM kept WHERE size > {k}" for k in (1, 2, 3))
    return f"""
WITH pieces AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents),
worded AS (SELECT lang, list_filter(string_split_regex(piece, '[\\x20\\x09]+'), lambda w: w <> '') AS ws FROM pieces),
grams AS (SELECT lang, size, unnest(list_transform(range(1, CAST(len(ws) - size + 2 AS BIGINT)), lambda i: list_aggregate(ws[i:i + size - 1], 'string_agg', ' '))) AS phrase
  FROM worded, (SELECT unnest([1, 2, 3, 4]) AS size) WHERE len(ws) >= size),
f AS MATERIALIZED (SELECT lang, size, phrase, count(*) AS a FROM grams GROUP BY ALL),
total AS (SELECT lang, CAST(sum(a) AS BIGINT) AS n FROM f WHERE size = 1 GROUP BY lang),
c AS MATERIALIZED (SELECT * FROM f WHERE size > 1 AND a >= {least}),
kept AS MATERIALIZED (SELECT *, string_split(phrase, ' ') AS ws FROM c WHERE NOT EXISTS (SELECT 1 FROM c AS d WHERE d.lang = c.lang AND d.size > c.size
  AND contains(' ' || d.phrase || ' ', ' ' || c.phrase || ' ') AND 100 * CAST(d.a AS HUGEINT) >= {keep} * CAST(c.a AS HUGEINT))),
cut AS (SELECT t.lang, t.phrase, t.a, t.k, l.a AS l, r.a AS r, (2000000 * CAST(t.a AS HUGEINT)) // (l.a + r.a) AS score FROM ({cuts}) t
  JOIN f AS l ON l.lang = t.lang AND l.phrase = t.x AND l.size = t.k JOIN f AS r ON r.lang = t.lang AND r.phrase = t.y AND r.size = t.size - t.k),
weakest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) AS nr FROM cut) WHERE nr = 1),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM weakest)
SELECT lang, rank, phrase, a, l, r, n, CAST(score AS BIGINT) AS score FROM ranked JOIN total USING (lang) WHERE rank <= {top}
"""


ORACLE_SQL = _sql()
