"""Operator 11: centroid clustering over a VA-file (vector approximations).

1. Vectors of DIMS finite components become integers, floor(1024 * x), and are written once
   in buckets of their row keys. The first centroids, and quantiles for the edges of the
   cells, come from the SAMPLE vectors with the least hashes.
2. The VA-file holds a row's key, a cell of BITS bits for each component, and its cluster.
   It is all that a round reads of most rows: tables of the least and greatest distance
   from each cell to each centroid add up to an interval for each centroid, and one whose
   lower end is above another's upper end is out. Measured on isotropic vectors of 64
   components, whose centroids are close, 8 bits leave a quarter open and 6 bits two thirds.
3. Full vectors are fetched, by a join with the bucketed table to which keys alone are
   shuffled, only where intervals of several centroids overlap, or where a row is known to
   have changed its cluster and is to be moved from one sum to another.
4. A round adds what moved to the clusters' sums and takes exact floors of the means.

The outer cells end at the least and greatest component of all vectors. Sums travel in
limbs of 32 bits and are added up as decimals, and components that make a squared distance
pass 53 bits are handled as Python's integers, so every step is exact at any size. What
the driver holds are the sample, the centroids and their sums.

Defined results: rows with a null vector, another number of components or a null or
non-finite one are left out; a null id stays and its hash comes last; repeated rows each
count and give a row; of equal hashes the vector that is less by components comes first;
with fewer vectors than centroids there are as many centroids as vectors; a distance or
inertia beyond a long is null, its cluster is exact all the same; other columns are
ignored; an empty table gives none. Of equally near centroids the smaller number wins.
"""

from __future__ import annotations

import hashlib
import uuid
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import exchange as X
from . import store

DIMS, CENTROIDS, ROUNDS, SCALE, SEED = 64, 8, 10, 1024, 3
BITS, SAMPLE = 8, 2048
#: Components below this in size keep a distance within 53 bits, which both kinds of number hold exactly.
SMALL = 1 << 22
LIMB = 32
LONG = 1 << 63


def integers(rows: list) -> np.ndarray:
    """Components as integers: an array of longs, or of Python's integers where one is large."""
    x = np.array(rows, np.float64).reshape(len(rows), -1)
    if not x.size or np.abs(x).max() < SMALL / SCALE:
        return np.floor(SCALE * x).astype(np.int64)
    return np.array([[int(np.floor(v)) if abs(v) < LONG else int(v) for v in row] for row in (SCALE * x).tolist()], object)


def distances(vectors: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Squared distances, a row for each vector and a column for each centroid."""
    if vectors.dtype == object or centroids.dtype == object:
        return np.stack([((vectors.astype(object) - c) ** 2).sum(axis=1) for c in centroids.astype(object)], axis=1)
    return np.stack([((vectors - c) ** 2).sum(axis=1) for c in centroids], axis=1)


def _whole(rows: list[list[int]]) -> np.ndarray:
    small = all(abs(x) < SMALL for row in rows for x in row)
    return np.array(rows, np.int64 if small else object)


class Cells:
    """The cells of each component, and bounds of distances from them."""

    def __init__(self, sample: np.ndarray, least: list[float], greatest: list[float], bits: int = BITS):
        inner = np.quantile(np.floor(SCALE * sample), np.arange(1, 1 << bits) / (1 << bits), axis=0).T
        low, high = (np.floor(SCALE * np.array(x, np.float64)) for x in (least, greatest))
        self.inner = np.floor(inner)
        self.low = np.concatenate([low[:, None], self.inner], axis=1)
        self.high = np.concatenate([self.inner, high[:, None]], axis=1)
        self.bits = bits

    def of(self, vectors: np.ndarray) -> np.ndarray:
        """The cells of integer vectors, packed to rows of bytes."""
        x = vectors.astype(np.float64)
        found = np.stack([np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(self.inner)], axis=1).astype(np.uint8)
        return np.packbits(np.unpackbits(found[:, :, None], axis=2, bitorder="little")[:, :, : self.bits].reshape(len(x), -1), axis=1, bitorder="little")

    def unpack(self, cells: list[bytes]) -> np.ndarray:
        flat = np.frombuffer(b"".join(cells), np.uint8).reshape(len(cells), -1)
        bits = np.unpackbits(flat, axis=1, bitorder="little")[:, : len(self.inner) * self.bits].reshape(len(cells), -1, self.bits)
        return np.packbits(bits, axis=2, bitorder="little")[:, :, 0]

    def tables(self, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Least and greatest part of the squared distance, by centroid, component and cell, rounded outwards.

        Taken off are the squares of vectors' differences from the centroids' middle, which
        are the same for all centroids and would only widen the intervals.
        """
        c = centroids.astype(np.float64)
        middle = c.mean(axis=0)
        off = (c - middle)[:, :, None]
        one, other = (off**2 - 2 * off * (ends - middle[:, None])[None] for ends in (self.low, self.high))
        near, far = np.minimum(one, other), np.maximum(one, other)
        return near - 1e-9 * np.abs(near), far + 1e-9 * np.abs(far)

    def possible(self, cells: list[bytes], centroids: np.ndarray) -> np.ndarray:
        """Which centroids can be the nearest: a row for each vector, a column for each centroid."""
        at = self.unpack(cells)
        near, far = self.tables(centroids)
        j = np.arange(at.shape[1])
        lower = np.stack([t[j, at].sum(axis=1) for t in near], axis=1)
        upper = np.stack([t[j, at].sum(axis=1) for t in far], axis=1).min(axis=1)
        return lower <= upper[:, None]


def _nearest(vectors: np.ndarray, possible: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(cluster, distance) among the centroids that are possible; ties go to the smaller number."""
    cluster = possible.argmax(axis=1)
    distance = np.zeros(len(vectors), object)
    only = possible.sum(axis=1) == 1
    for c in range(len(centroids)):
        own = np.flatnonzero(only & (cluster == c))
        if len(own):
            distance[own] = distances(vectors[own], centroids[c : c + 1])[:, 0]
    open_ones = np.flatnonzero(~only)
    if len(open_ones):
        d = distances(vectors[open_ones], centroids)
        if d.dtype == object:
            best = np.array([min(np.flatnonzero(p), key=lambda c: (row[c], c)) for row, p in zip(d, possible[open_ones])])
        else:
            best = np.where(possible[open_ones], d, LONG - 1).argmin(axis=1)
        cluster[open_ones], distance[open_ones] = best, d[np.arange(len(best)), best]
    return cluster, distance


def _limbs(total: list[int]) -> list[list[int]]:
    """Signed limbs of integers, the lowest first; as many as the largest needs."""
    out = []
    while any(total) or not out:
        out.append([x & ((1 << LIMB) - 1) if x > 0 else -(-x & ((1 << LIMB) - 1)) for x in total])
        total = [x >> LIMB if x > 0 else -(-x >> LIMB) for x in total]
    return out


_ROUND = "kind int, key bigint, cells binary, cluster int, limb int, n bigint, sums array<bigint>"
_ROUND_ARROW = pa.schema([("kind", pa.int32()), ("key", pa.int64()), ("cells", pa.binary()), ("cluster", pa.int32()), ("limb", pa.int32()), ("n", pa.int64()), ("sums", pa.list_(pa.int64()))])
ROWS, SUMS = 0, 1


def _rows(size: int, kind: int, **columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([kind] * size if f.name == "kind" else columns.get(f.name, [None] * size), f.type) for f in _ROUND_ARROW], schema=_ROUND_ARROW)


def _settled(batches, cells: Cells, centroids: np.ndarray):
    """(key, cells, cluster, next, fetch): next is null where several centroids are possible."""
    for batch in batches:
        before = batch.column(2).to_numpy(zero_copy_only=False).astype(np.float64)
        possible = cells.possible(batch.column(1).to_pylist(), centroids)
        decided = possible.sum(axis=1) == 1
        new = possible.argmax(axis=1)
        yield pa.RecordBatch.from_arrays(
            [*(batch.column(k) for k in range(3)), pa.array(new, pa.int32(), mask=~decided), pa.array(~decided | (new != before))], names=["key", "cells", "cluster", "next", "fetch"]
        )


def _moved(batches, cells: Cells, centroids: np.ndarray):
    """Rows of the next VA-file for fetched (key, cells, cluster, next, vector), and the task's sums of what moved."""
    n = np.zeros(len(centroids), np.int64)
    sums = np.zeros((len(centroids), DIMS), object)
    for batch in batches:
        if not batch.num_rows:
            continue
        vectors = integers(batch.column(4).to_pylist())
        packed = batch.column(1).to_pylist()
        possible = cells.possible(packed, centroids)
        cluster, _ = _nearest(vectors, possible, centroids)
        before = np.array([-1 if c is None else c for c in batch.column(2).to_pylist()])
        for sign, of in ((1, cluster), (-1, before)):
            for c in range(len(centroids)):
                own = np.flatnonzero((of == c) & (cluster != before))
                n[c] += sign * len(own)
                sums[c] += sign * vectors[own].sum(axis=0).astype(object)
        yield _rows(len(cluster), ROWS, key=batch.column(0), cells=packed, cluster=cluster.astype(np.int32))
    for c in range(len(centroids)):
        for k, limb in enumerate(_limbs(sums[c].tolist())):
            yield _rows(1, SUMS, cluster=[c], limb=[k], n=[int(n[c]) if k == 0 else 0], sums=[limb])


def _added(sums: DataFrame, n: list[int], totals: list[list[int]]) -> None:
    """Adds the moves of a round to the clusters' sizes and sums."""
    each = [F.sum(F.col("sums")[j].cast("decimal(38,0)")).alias(f"s{j}") for j in range(DIMS)]
    for r in sums.groupBy("cluster", "limb").agg(F.sum("n").alias("n"), *each).collect():  # a row for each centroid and limb
        n[r["cluster"]] += r["n"]
        own = totals[r["cluster"]]
        for j in range(DIMS):
            own[j] += int(r[f"s{j}"]) << (LIMB * r["limb"])


def _valid(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    v = F.col(vector_col)
    fine = v.isNotNull() & (F.size(v) == DIMS)
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    kept = vectors.where(fine).select(F.col(id_col).cast("bigint").alias("vec_id"), v.cast("array<double>").alias("vector"))
    return kept.where(F.coalesce(finite, F.lit(False)))


def _exact_long(x: int) -> int | None:
    return int(x) if -LONG <= x < LONG else None


def cluster(vectors: DataFrame, centroids: int = CENTROIDS, rounds: int = ROUNDS, seed: int = SEED, id_col: str = "vec_id", vector_col: str = "embedding", bits: int = BITS, fetched: list | None = None) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia and centroid_sha256 of each vector.

    fetched: a list that gets, for each round, how many rows were looked at and how many fetched.
    """
    spark = vectors.sparkSession
    kept = store.written(_valid(vectors, id_col, vector_col).withColumn("key", F.monotonically_increasing_id()), "vectors")
    try:
        return _clustered(spark, kept, centroids, rounds, seed, bits, fetched)
    finally:
        store.forget(kept)


def _clustered(spark, kept: DataFrame, k: int, rounds: int, seed: int, bits: int, fetched: list | None) -> DataFrame:
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    first = kept.select(digest.alias("hash"), "vector").orderBy(F.asc_nulls_last("hash"), "vector").limit(k).collect()
    if not first:
        return _named(spark.createDataFrame([], "vec_id bigint, cluster int, distance bigint"), [], [], [])
    centers = _whole(integers([r["vector"] for r in first]).tolist())
    ends = kept.select(*[f(F.col("vector")[j]).alias(f"{n}{j}") for n, f in (("l", F.min), ("g", F.max)) for j in range(DIMS)], F.count("*").alias("n")).first()
    some = kept.where(F.pmod(F.xxhash64("key"), F.lit(1 << 40)) <= (2 * SAMPLE << 40) // ends["n"]).select("vector").limit(SAMPLE).collect()
    sample = np.array([r["vector"] for r in some or first])
    cells = Cells(sample, list(ends[:DIMS]), list(ends[DIMS : 2 * DIMS]), bits)

    buckets = X.partitions(kept)
    bucketed, name = store.new_path(spark, "vector-buckets"), f"vectors_{uuid.uuid4().hex}"
    kept.repartition(buckets, "key").write.bucketBy(buckets, "key").sortBy("key").option("path", bucketed).saveAsTable(name)
    full = spark.table(name).select("key", "vector")

    def approximated(batches):
        for b in batches:
            packed = cells.of(integers(b.column(1).to_pylist())) if b.num_rows else []
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([x.tobytes() for x in packed], pa.binary())], names=["key", "cells"])

    file = store.written(kept.select("key", "vector").mapInArrow(approximated, "key bigint, cells binary").withColumn("cluster", F.lit(None).cast("int")), "approximations")
    rows = file
    n, totals = [0] * len(centers), [[0] * DIMS for _ in centers]
    for _ in range(rounds):
        now = centers
        settled = rows.mapInArrow(lambda b, now=now: _settled(b, cells, now), "key bigint, cells binary, cluster int, next int, fetch boolean")
        wanted = settled.where("fetch").select("key", "cells", "cluster", "next")
        moved = wanted.join(full, "key").select("key", "cells", "cluster", "next", "vector").mapInArrow(lambda b, now=now: _moved(b, cells, now), _ROUND)
        stay = settled.where("not fetch").select(F.lit(ROWS).alias("kind"), "key", "cells", F.col("next").alias("cluster"), F.lit(None).cast("int").alias("limb"), F.lit(None).cast("bigint").alias("n"), F.lit(None).cast("array<bigint>").alias("sums"))
        after = store.written(moved.unionByName(stay), "approximations", by=["kind"])
        if fetched is not None:
            fetched.append((settled.count(), wanted.count()))
        store.forget(file)
        file, rows = after, after.where(F.col("kind") == ROWS).select("key", "cells", "cluster")
        _added(after.where(F.col("kind") == SUMS), n, totals)
        centers = _whole([[s // n[c] for s in totals[c]] if n[c] else list(map(int, centers[c])) for c in range(len(centers))])
    store.forget(file)

    def assigned(batches):
        for b in batches:
            if b.num_rows:
                whole = integers(b.column(1).to_pylist())
                own, d = _nearest(whole, cells.possible([x.tobytes() for x in cells.of(whole)], centers), centers)
                yield pa.RecordBatch.from_arrays(
                    [b.column(0), pa.array(own, pa.int32()), pa.array([_exact_long(x) for x in d], pa.int64()), pa.array([Decimal(int(x)) if x < 10**38 else None for x in d], pa.decimal128(38, 0))],
                    names=["vec_id", "cluster", "distance", "exact"],
                )

    done = store.written(kept.select("vec_id", "vector").mapInArrow(assigned, "vec_id bigint, cluster int, distance bigint, exact decimal(38,0)"), "assigned")
    spark.sql(f"DROP TABLE {name}")
    store.drop(spark, bucketed)
    whole = F.when(F.count("exact") == F.count("*"), F.try_sum("exact")).alias("inertia")
    inertia = {r["cluster"]: r["inertia"] for r in done.groupBy("cluster").agg(whole).collect()}  # a row for each centroid
    by_cluster = [inertia.get(c, 0) for c in range(len(centers))]
    shas = [hashlib.sha256(",".join(map(str, map(int, c))).encode()).hexdigest() for c in centers]
    total = None if None in by_cluster else sum(map(int, by_cluster))
    return _named(done.drop("exact"), [None if x is None else _exact_long(x) for x in by_cluster], [None if total is None else _exact_long(total)], shas)


def _named(rows: DataFrame, by_cluster: list, total: list, shas: list) -> DataFrame:
    def of(values: list, kind: str) -> Column:
        return F.get(F.array(*[F.lit(v).cast(kind) for v in values]).cast(f"array<{kind}>"), F.col("cluster"))

    whole = F.lit(total[0] if total else None).cast("bigint")
    return rows.select("vec_id", "cluster", "distance", of(by_cluster, "bigint").alias("cluster_inertia"), whole.alias("inertia"), of(shas, "string").alias("centroid_sha256"))


def _sql() -> str:
    near = lambda c: f"SELECT rid, v, arg_min(c, (d, c)) AS c, min(d) AS d FROM (SELECT t.rid, any_value(t.v) AS v, m.c, CAST(sum((x - y) * (x - y)) AS BIGINT) AS d FROM (SELECT rid, v, unnest(v) AS x, generate_subscripts(v, 1) AS j FROM kept) t JOIN (SELECT c, unnest(m) AS y, generate_subscripts(m, 1) AS j FROM {c}) m USING (j) GROUP BY t.rid, m.c) GROUP BY rid, v"
    steps = []
    for r in range(ROUNDS + 1):
        steps.append(f"a{r} AS MATERIALIZED ({near(f'c{r}')})")
        if r < ROUNDS:
            means = f"SELECT c, list(CAST(floor_mean AS BIGINT) ORDER BY j) AS m FROM (SELECT c, j, (s - ((s % n) + n) % n) // n AS floor_mean FROM (SELECT c, j, sum(x) AS s, count(*) AS n FROM (SELECT c, unnest(v) AS x, generate_subscripts(v, 1) AS j FROM a{r}) GROUP BY c, j)) GROUP BY c"
            steps.append(f"c{r + 1} AS MATERIALIZED (SELECT c, coalesce(n.m, o.m) AS m FROM c{r} o LEFT JOIN ({means}) n USING (c))")
    return f"""
WITH kept AS MATERIALIZED (SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE len(embedding) = {DIMS} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {DIMS}),
c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h, v) - 1 AS c, v AS m FROM (SELECT v, sha256('{SEED}:' || vec_id) AS h FROM kept) QUALIFY c < {CENTROIDS}),
{", ".join(steps)}
SELECT vec_id, CAST(c AS INTEGER) AS cluster, d AS distance, CAST(sum(d) OVER (PARTITION BY c) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(m, ',')) AS centroid_sha256
FROM kept JOIN a{ROUNDS} USING (rid) JOIN c{ROUNDS} USING (c)"""


ORACLE_SQL = _sql()
