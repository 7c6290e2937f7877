"""Operator 6: quality rules kept in a bitmask ledger.

Every rule is evaluated once for each text; the ledger, a table of the shared folder,
stores the measurements, one bit per failed rule and the version of the rules that gave
the bits. Policies are versioned sets of rules, applied to stored bits, and ablations
(what would be kept without a rule, what a rule alone rejects) are bitwise aggregates
over the stored ledger, without touching texts again.

Defined results: a null or empty text has no words and fails the word count; repeated
rows each give a row; a null id stays null; other columns are ignored; an empty table
gives none (and zero counts in ablations). Very long texts are measured whole. A text
that just meets a limit (a tie) passes its rule.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import exchange as X
from . import store

MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_distinct_words", "n_letter_words", "n_letters", "n_capitals")

#: Rule by bit: name and the SQL condition, over the measurements, under which a text fails.
RULES: list[tuple[str, str]] = [
    ("few_words", "n_words < 50"),
    ("repeated_windows", "100 * n_repeat_words > 50 * n_words"),
    ("symbols", "10 * n_symbols > n_words"),
    ("repeated_lines", "10 * n_dup_lines > 4 * n_lines"),
    ("few_distinct_words", "10 * n_distinct_words < 2 * n_words"),
    ("few_letter_words", "10 * n_letter_words < 7 * n_words"),
    ("capitals", "10 * n_capitals > 4 * n_letters"),
    ("short_words", "2 * word_chars < 5 * n_words"),
    ("long_words", "word_chars > 12 * n_words"),
]
BIT = {name: 1 << k for k, (name, _) in enumerate(RULES)}
BASE = BIT["few_words"] | BIT["repeated_windows"]

#: Changes with RULES or MEASURES; stored bits of another version can't be told by BIT.
RULES_VERSION = 1

#: Rules that reject, by version.
POLICIES: dict[str, int] = {
    "base": BASE,
    "v1": BASE | BIT["symbols"] | BIT["repeated_lines"] | BIT["few_distinct_words"],
    "v2": sum(BIT.values()),
}

_BLANKS = b"\t\n\x0b\x0c\r "
_CONTINUED = bytes(range(0x80, 0xC0))
_SYMBOLS = b"#*$%&|<>"
_CAPITALS = bytes(range(ord("A"), ord("Z") + 1))
_LETTERS = _CAPITALS + _CAPITALS.lower()
_NO_LETTER = bytes(b for b in range(128) if b not in _LETTERS and b not in _BLANKS)


def repeat_words(ids: np.ndarray, distinct: int) -> int:
    """Words inside 3-word windows that are found twice or more."""
    if len(ids) < 4:
        return 0
    if distinct < 1 << 21:
        key = (ids[:-2] * distinct + ids[1:-1]) * distinct + ids[2:]
    else:
        _, pair = np.unique(ids[:-2] * distinct + ids[1:-1], return_inverse=True)
        key = pair * distinct + ids[2:]
    _, at, counts = np.unique(key, return_inverse=True, return_counts=True)
    twice = np.flatnonzero(counts[at] > 1)
    covered = np.zeros(len(ids), bool)
    for k in range(3):
        covered[twice + k] = True
    return int(covered.sum())


def measure(text: bytes) -> tuple[int, ...]:
    """The measurements of a text, in the order of MEASURES."""
    words = text.split()
    number: dict[bytes, int] = {}
    ids = np.fromiter([number.setdefault(w, len(number)) for w in words], np.int64, len(words))
    seen, dup, lines = set(), 0, 0
    for line in text.split(b"\n"):
        if line.strip():
            lines += 1
            dup += line in seen
            seen.add(line)
    without = lambda drop: len(text.translate(None, drop))
    return (
        len(words),
        without(_CONTINUED + _BLANKS),
        len(text) - without(_SYMBOLS),
        dup,
        repeat_words(ids, len(number)),
        lines,
        len(number),
        len(text.translate(None, _NO_LETTER).split()),
        len(text) - without(_LETTERS),
        len(text) - without(_CAPITALS),
    )


def ledger(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, the measurements and failed (a bit for each rule that the text fails)."""

    def run(batches):
        for b in batches:
            rows = [measure(t or b"") for t in b.column(1).cast(pa.binary()).to_pylist()]
            columns = np.array(rows, np.int64).reshape(-1, len(MEASURES)).T
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c) for c in columns)], names=["doc_id", *MEASURES])

    measured = X.plain(docs, id_col, text_col).mapInArrow(run, "doc_id bigint, " + ", ".join(f"{m} bigint" for m in MEASURES))
    bits = " + ".join(f"if({condition}, {1 << k}L, 0L)" for k, (_, condition) in enumerate(RULES))
    return measured.withColumns({"failed": F.expr(bits), "rules": F.lit(RULES_VERSION)})


def stored_ledger(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The ledger as a table of the shared folder, from which policies and ablations are computed."""
    return store.written(ledger(docs, id_col, text_col), "ledger")


def keeps(failed: Column, policy: str) -> Column:
    return failed.bitwiseAND(F.lit(POLICIES[policy])) == 0


def apply_policy(table: DataFrame, policy: str = "v2") -> DataFrame:
    """The ledger with policy, kept under it, and sole_failure: the bit of the rule that alone rejects, else 0."""
    own = F.col("failed").bitwiseAND(F.lit(POLICIES[policy]))
    sole = F.when((own != 0) & (own.bitwiseAND(own - 1) == 0), own).otherwise(F.lit(0).cast("bigint"))
    return table.withColumns({"policy": F.lit(policy), "kept": keeps(F.col("failed"), policy), "sole_failure": sole})


def ablations(table: DataFrame, policy: str = "v2") -> DataFrame:
    """For each rule of a policy: rows it fails, rows it alone rejects, rows kept without it."""
    mask, failed = POLICIES[policy], F.col("failed")
    rules = [(name, bit) for name, bit in BIT.items() if bit & mask]
    sums = []
    for name, bit in rules:
        hit = lambda m: F.coalesce(F.sum(m.cast("bigint")), F.lit(0))
        sums += [hit(failed.bitwiseAND(F.lit(bit)) != 0).alias(f"{name}_f"), hit(failed.bitwiseAND(F.lit(mask)) == bit).alias(f"{name}_o"), hit(failed.bitwiseAND(F.lit(mask & ~bit)) == 0).alias(f"{name}_k")]
    one = table.agg(*sums)
    rows = F.array(*[F.struct(F.lit(n).alias("rule"), F.col(f"{n}_f").alias("n_failed"), F.col(f"{n}_o").alias("n_only"), F.col(f"{n}_k").alias("n_kept_without")) for n, _ in rules])
    return one.select(F.inline(rows))


def kept_without(failed: Column, policy: str) -> Column:
    """The bits of a policy's rules of which any one left out would keep the row: all, one or none."""
    own = failed.bitwiseAND(F.lit(POLICIES[policy]))
    return F.when(own == 0, F.lit(POLICIES[policy])).when(own.bitwiseAND(own - 1) == 0, own).otherwise(F.lit(0)).cast("bigint")


def query(docs: DataFrame) -> DataFrame:
    """The ledger's rows with the verdict of the newest policy, of each policy, and what leaving out one rule would do."""
    failed = F.col("failed")
    out = apply_policy(stored_ledger(docs), "v2")
    by_policy = [keeps(failed, p).alias(f"kept_{p}") for p in POLICIES]
    base = (failed.bitwiseAND(F.lit(BASE)) != 0).alias("base_failed")
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base, "kept", "failed", "policy", "sole_failure", *by_policy, kept_without(failed, "v2").alias("kept_without"))


def ablation_query(docs: DataFrame) -> DataFrame:
    """(policy, rule, n_failed, n_only, n_kept_without) of all policies and their rules, from one stored ledger."""
    table = stored_ledger(docs)
    return functools.reduce(DataFrame.unionByName, [ablations(table, p).select(F.lit(p).alias("policy"), "*") for p in POLICIES])


ORACLE_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT r, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws FROM d),
x AS (SELECT r, unnest(ws) AS w1, generate_subscripts(ws, 1) AS i FROM w),
p AS (SELECT r, i, w1, lead(w1) OVER o AS w2, lead(w1, 2) OVER o AS w3 FROM x WINDOW o AS (PARTITION BY r ORDER BY i)),
g AS (SELECT r, i, count(*) OVER (PARTITION BY r, w1, w2, w3) AS n FROM p WHERE w3 IS NOT NULL),
c AS (SELECT r, count(DISTINCT i + k) AS n_repeat_words FROM g, (SELECT unnest([0, 1, 2]) AS k) WHERE n > 1 GROUP BY r),
m AS (
  SELECT d.r, doc_id, len(ws) AS n_words,
    length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS word_chars,
    length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
    list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls,
    coalesce(n_repeat_words, 0) AS n_repeat_words,
    len(list_distinct(ws)) AS n_distinct_words,
    len(list_filter(ws, lambda x: regexp_matches(x, '[A-Za-z]|[^\x00-\x7F]'))) AS n_letter_words,
    length(regexp_replace(t, '[^A-Za-z]', '', 'g')) AS n_letters,
    length(regexp_replace(t, '[^A-Z]', '', 'g')) AS n_capitals
  FROM d JOIN w USING (r) LEFT JOIN c USING (r)),
n AS (SELECT *, len(ls) AS n_lines, len(ls) - len(list_distinct(ls)) AS n_dup_lines FROM m),
f AS (SELECT *, """ + " + ".join(f"CASE WHEN {condition} THEN {1 << k} ELSE 0 END" for k, (_, condition) in enumerate(RULES)) + f""" AS failed FROM n)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols,
  CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words,
  (failed & {BASE}) <> 0 AS base_failed, (failed & {POLICIES["v2"]}) = 0 AS kept, CAST(failed AS BIGINT) AS failed, 'v2' AS policy,
  CAST(CASE WHEN bit_count(failed & {POLICIES["v2"]}) = 1 THEN failed & {POLICIES["v2"]} ELSE 0 END AS BIGINT) AS sole_failure,
  """ + ", ".join(f"(failed & {mask}) = 0 AS kept_{p}" for p, mask in POLICIES.items()) + f""",
  CAST(CASE bit_count(failed & {POLICIES["v2"]}) WHEN 0 THEN {POLICIES["v2"]} WHEN 1 THEN failed & {POLICIES["v2"]} ELSE 0 END AS BIGINT) AS kept_without
FROM f
"""
#: The same rules; what each rule of a policy fails, alone rejects, and what is kept without it.
ABLATIONS_SQL = ORACLE_SQL.rpartition("SELECT doc_id")[0] + " UNION ALL ".join(
    f"""SELECT '{p}' AS policy, '{rule}' AS rule, CAST(count(*) FILTER ((failed & {bit}) <> 0) AS BIGINT) AS n_failed, CAST(count(*) FILTER ((failed & {mask}) = {bit}) AS BIGINT) AS n_only,
  CAST(count(*) FILTER ((failed & {mask & ~bit}) = 0) AS BIGINT) AS n_kept_without FROM f"""
    for p, mask in POLICIES.items()
    for rule, bit in BIT.items()
    if bit & mask
)
