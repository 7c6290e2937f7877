"""Operator 9: line deduplication by overlapping three-line windows.

Each run of three consecutive lines is hashed (128 bits). A window is repeated when
its hash is found again anywhere, in the same text too. Its first occurrence, by
document id, then text digest, then line, stays; the lines of every later occurrence
go, where occurrences that overlap are merged into one covered range. All of it is
DataFrame work: a hot window is summed up before the shuffle and joined by a join
that can be split.

Defined results: lines are parted by \\n alone and compared as they are; texts of
fewer than three lines, null and empty texts stay as they are; rows equal in id and
text are one occurrence and treated alike; a null id comes after all others; other
columns pass through untouched; an empty table gives none. A text that loses all its
lines becomes empty. Very long texts are cut whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LINES = 3


def _md5(c: Column) -> Column:
    return F.unhex(F.md5(c))


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.col(text_col).cast("string")
    return docs.select(F.col(id_col).alias("id"), _md5(F.coalesce(text, F.lit(""))).alias("digest"), F.split(text, "\n").alias("lines"))


def later_lines(docs: DataFrame, size: int = LINES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, digest, removed): sorted numbers (from 0) of the lines that later occurrences cover."""
    hashes = F.transform(F.sequence(F.lit(0), F.size("lines") - size), lambda i: _md5(F.array_join(F.slice("lines", i + 1, size), "\n")))
    spots = (
        _keyed(docs, id_col, text_col)
        .where(F.size("lines") >= size)
        .select("id", "digest", F.posexplode(hashes).alias("line", "window"))
        .select("window", F.struct(F.col("id").isNull().alias("last"), "id", "digest", "line").alias("spot"))
    )
    first = spots.groupBy("window").agg(F.min("spot").alias("first"), F.count("*").alias("n")).where("n > 1").select("window", "first")
    later = spots.join(first, "window").where(F.col("spot") != F.col("first"))
    covered = later.select("spot.id", "spot.digest", F.explode(F.sequence(F.col("spot.line"), F.col("spot.line") + (size - 1))).alias("at"))
    return covered.groupBy("id", "digest").agg(F.array_sort(F.collect_set("at")).alias("removed"))


def _with_removed(docs: DataFrame, size: int, id_col: str, text_col: str) -> DataFrame:
    """``docs`` as columns id, digest, lines, row (all its own columns) and removed."""
    gone = later_lines(docs, size, id_col, text_col).select(F.col("id").alias("__id"), F.col("digest").alias("__digest"), "removed")
    text = F.col(text_col).cast("string")
    rows = docs.select(F.struct("*").alias("row"), F.col(id_col).alias("id"), _md5(F.coalesce(text, F.lit(""))).alias("digest"))
    return rows.join(gone, (F.col("digest") == F.col("__digest")) & F.col("id").eqNullSafe(F.col("__id")), "left").select("row", "id", "removed")


def _kept(text: Column, removed: Column) -> Column:
    lines = F.split(text, "\n")
    left = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), removed)
    return F.when(removed.isNull(), text).otherwise(F.array_join(F.transform(left, lambda k: F.get(lines, k)), "\n"))


def dedup_lines(docs: DataFrame, size: int = LINES, id_col: str = "doc_id", text_col: str = "text", length_col: str | None = None) -> DataFrame:
    """``docs`` with later occurrences cut from the text; length_col, if given, becomes the text's new length."""
    found = _with_removed(docs, size, id_col, text_col)
    new = _kept(F.col(f"row.`{text_col}`").cast("string"), F.col("removed"))
    changed = {text_col: new} | ({length_col: F.when(F.col("removed").isNull(), F.col(f"row.`{length_col}`")).otherwise(F.length(new).cast(docs.schema[length_col].dataType))} if length_col else {})
    return found.select(*[changed.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns])


def query(docs: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_removed, kept_sha256 (of the text that stays; a null text as empty)."""
    found = _with_removed(docs.select("doc_id", "text"), LINES, "doc_id", "text")
    text = F.coalesce(F.col("row.text"), F.lit(""))
    return found.select(
        F.col("id").alias("doc_id"),
        F.size(F.split(text, "\n")).cast("bigint").alias("n_lines"),
        F.coalesce(F.size("removed"), F.lit(0)).cast("bigint").alias("n_removed"),
        F.sha2(_kept(text, F.col("removed")), 256).alias("kept_sha256"),
    )


ORACLE_SQL = """
WITH d AS (SELECT row_number() OVER () AS r, doc_id, md5(coalesce(text, '')) AS digest, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
u AS (SELECT DISTINCT ON (doc_id, digest) doc_id, digest, ls FROM d),
w AS (SELECT doc_id, digest, i, ls[i] || chr(10) || ls[i + 1] || chr(10) || ls[i + 2] AS win
  FROM (SELECT doc_id, digest, ls, unnest(range(1, len(ls) - 1)) AS i FROM u WHERE len(ls) > 2)),
o AS (SELECT doc_id, digest, i, row_number() OVER (PARTITION BY win ORDER BY doc_id NULLS LAST, digest, i) AS k FROM w),
c AS (SELECT doc_id, digest, list(DISTINCT pos) AS gone FROM (SELECT doc_id, digest, unnest(range(i, i + 3)) AS pos FROM o WHERE k > 1) GROUP BY ALL),
j AS (SELECT d.doc_id, ls, coalesce(gone, []) AS gone FROM d LEFT JOIN c ON d.digest = c.digest AND d.doc_id IS NOT DISTINCT FROM c.doc_id)
SELECT doc_id, CAST(len(ls) AS BIGINT) AS n_lines, CAST(len(gone) AS BIGINT) AS n_removed,
  sha256(array_to_string(list_filter(ls, lambda x, k: NOT list_contains(gone, k)), chr(10))) AS kept_sha256
FROM j
"""
