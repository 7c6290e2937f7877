"""Operator 8: near-duplicates by SimHash and covering locality-sensitive hashing.

A text's fingerprint has a bit for each of the 64 bits of its shingles' XXH64 values,
set where more than half of them set it. To find all pairs within RADIUS differing
bits, bit i is given the vector m(i) of RADIUS + 1 bits, never zero; table v keeps the
bits with odd <m(i), v>. The vectors of at most RADIUS differing bits leave a v
orthogonal to all of them, so every such pair has the same key in some table.

Copies share a fingerprint and are one node. A bucket gives each of its components as
a star, not as pairs. A bucket over HEAVY fingerprints is dealt again, by four chunks of
the bits that it leaves open, of which at least one agrees for any pair in radius, and
so on: each time a quarter of the open bits is settled, and as fingerprints are distinct
12 open bits hold HEAVY at most, so no task compares more than that with each other.

Defined results: a null or blank text has fingerprint zero and is linked like any
other; fewer words than a shingle make one shingle of what there is; very long texts are
worked on whole, their shingles summed up in slices; a bit that half of the shingles set
(a tie) is zero; repeated rows each give a row; a null id stays null and is never the
smallest id unless all are null; other columns are ignored; an empty table gives none.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import exchange as X
from . import store
from .components import components

BITS, RADIUS, SHINGLE = 64, 3, 3
SEED = 42
HEAVY = 4096


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def masks() -> list[int]:
    """Bits kept by each covering table."""
    vector = [i % 15 + 1 for i in range(BITS)]
    return [sum(1 << i for i in range(BITS) if (vector[i] & v).bit_count() % 2) for v in range(1, 1 << (RADIUS + 1))]


def free_chunks(mask: int) -> list[int]:
    """The bits that are not in a mask, in RADIUS + 1 chunks."""
    free = [i for i in range(BITS) if not mask >> i & 1]
    return [sum(1 << i for i in free[c :: RADIUS + 1]) for c in range(RADIUS + 1)]


def fingerprint(text: bytes, size: int = SHINGLE) -> int:
    words = text.lower().split()
    n = len(words)
    if not n:
        return 0
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    if n <= size:
        return digest(joined, SEED)
    ends = np.fromiter(map(len, words), np.int64, n)
    starts = ends.copy()
    ends = np.cumsum(ends + 1) - 1
    starts = ends - starts
    hashes = np.array([digest(joined[s:e], SEED) for s, e in zip(starts[: n - size + 1].tolist(), ends[size - 1 :].tolist())], "<u8")
    total = np.zeros(BITS, np.int64)
    for k in range(0, len(hashes), 16384):
        total += np.unpackbits(hashes[k : k + 16384].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(total * 2 > len(hashes), bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, size: int = SHINGLE) -> DataFrame:
    """(doc_id, others, fp), fp as a signed long, for (doc_id, text, others) rows."""
    others = docs.schema.fields[2:]

    def run(batches):
        for b in batches:
            fps = np.array([fingerprint(t or b"", size) for t in b.column(1).cast(pa.binary()).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0), *b.columns[2:], pa.array(fps.view(np.int64))], names=["doc_id", *b.schema.names[2:], "fp"])

    return docs.mapInArrow(X.tidy(run), ", ".join(["doc_id bigint", *(f"{f.name} {f.dataType.simpleString()}" for f in others), "fp bigint"]))


def _stars(fps: np.ndarray, block: int = 1024) -> list[tuple[int, int]]:
    """Edges that join the components of fingerprints within RADIUS of each other."""
    root = np.arange(len(fps))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    bits = fps.view(np.uint64)
    for k in range(0, len(bits), block):
        near = np.bitwise_count(bits[k : k + block, None] ^ bits[None, :]) <= RADIUS
        for i, j in zip(*np.nonzero(near)):
            if (i := i + k) < j:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [(int(fps[i]), int(fps[r])) for i in range(len(fps)) if (r := find(i)) != i]


def _bucket_edges(batches):
    """Edges of buckets that come as sorted (mask, key, fp) rows."""
    schema = pa.schema([("u", pa.int64()), ("v", pa.int64())])

    def edges(a: np.ndarray):
        cut = np.flatnonzero(np.any(a[1:, :2] != a[:-1, :2], axis=1)) + 1
        starts, ends = np.concatenate([[0], cut]), np.concatenate([cut, [len(a)]])
        two = starts[ends - starts == 2]
        x, y = a[two, 2], a[two + 1, 2]
        near = np.bitwise_count(x.view(np.uint64) ^ y.view(np.uint64)) <= RADIUS
        out = [*zip(x[near].tolist(), y[near].tolist())]
        for s, e in zip(starts[ends - starts > 2], ends[ends - starts > 2]):
            out += _stars(np.ascontiguousarray(a[s:e, 2]))
        return pa.RecordBatch.from_arrays([pa.array([u for u, _ in out], pa.int64()), pa.array([v for _, v in out], pa.int64())], schema=schema)

    held = np.zeros((0, 3), np.int64)
    for b in batches:
        held = np.concatenate([held, np.stack([b.column(i).to_numpy(zero_copy_only=False) for i in range(3)], axis=1)])
        others = np.flatnonzero(np.any(held[:, :2] != held[-1:, :2], axis=1))
        if len(others):
            yield edges(held[: others[-1] + 1])
            held = held[others[-1] + 1 :]
    if len(held):
        yield edges(held)


def _compared(keyed: DataFrame) -> DataFrame:
    """Edges within the buckets of (mask, key, fp)."""
    dealt = keyed.repartition("mask", "key").sortWithinPartitions("mask", "key")
    return dealt.mapInArrow(X.tidy(_bucket_edges), "u bigint, v bigint")


def links(distinct: DataFrame) -> DataFrame:
    """(u, v): edges that join all fingerprints of (fp) within RADIUS, directly or through others."""
    spots = lambda kinds: F.array(*[F.struct(F.lit(_signed(m)).alias("mask"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("key")) for m in kinds])
    kinds, found = masks(), []
    keyed = distinct.select(F.inline(spots(kinds)), "fp")
    while True:
        heavy = store.written(keyed.groupBy("mask", "key").agg(F.count("*").alias("n")).where(F.col("n") > HEAVY).select("mask", "key"), "heavy")
        again = {r["mask"] for r in heavy.select("mask").distinct().collect()}  # one of ``kinds`` each
        if not again:
            break
        found.append(_compared(keyed.join(heavy, ["mask", "key"], "left_anti")))
        open_ones = {m: [m | c for c in free_chunks(m)] for m in kinds if _signed(m) in again}
        deeper = F.when(F.lit(False), spots([0]))
        for m, own in open_ones.items():
            deeper = deeper.when(F.col("mask") == _signed(m), spots(own))
        keyed = store.written(keyed.join(heavy, ["mask", "key"], "left_semi").select(F.inline(deeper), "fp").distinct(), "dealt-again")
        kinds = sorted({m for own in open_ones.values() for m in own})
    return functools.reduce(DataFrame.unionByName, [*found, _compared(keyed)])


def _rooted(nodes: DataFrame) -> DataFrame:
    """(fp, first, root) of (fp, first): root names the group of a fingerprint."""
    roots = components(links(nodes.select("fp")))
    return nodes.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))


def simhash_components(docs: DataFrame, size: int = SHINGLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fingerprint (hex), component_id: the smallest id linked to the row, itself included."""
    fps = store.written(fingerprints(X.plain(docs, id_col, text_col), size), "fingerprints")
    rooted = _rooted(fps.groupBy("fp").agg(F.min("doc_id").alias("first")))
    least = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    of_fp = rooted.join(least, "root").select("fp", "component_id")
    return fps.join(of_fp, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def _key(doc_id: Column, text: Column) -> Column:
    """A digest of the id and the text of a row, which is never null."""
    own = F.coalesce(doc_id.cast("bigint").cast("string"), F.lit(""))
    return F.unhex(F.md5(F.concat(own, F.lit(":"), F.coalesce(text.cast("string"), F.lit("")))))


def one_of_each(docs: DataFrame, size: int = SHINGLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs``, all columns, with one row of each group: that of the smallest id, a null one last.

    Of rows of one id in a group that with the smallest digest of its text stays, and of
    rows equal in both any one. An id whose texts are in several groups can stay for each.
    """
    plain = X.plain(docs, id_col, text_col)
    fps = store.written(fingerprints(plain.select("doc_id", "text", _key(F.col("doc_id"), F.col("text")).alias("key")), size), "fingerprints")
    spot = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "key")
    least = _rooted(fps.groupBy("fp").agg(F.min(spot).alias("first"))).groupBy("root").agg(F.min("first").alias("first"))
    kept = least.select("first.key")
    rows = docs.select(F.struct("*").alias("row"), _key(docs[id_col], docs[text_col]).alias("key"))  # no name of docs can clash in there
    return rows.join(kept, "key", "left_semi").dropDuplicates(["key"]).select("row.*")
