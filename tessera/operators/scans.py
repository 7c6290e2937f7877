"""Running values over ordered events, with no key held by one task.

``last_so_far`` and ``count_so_far`` are what a window from the first event of a key to the
current one would give. A key of more than ``hot`` events is cut by quantiles of its times
into SEGMENTS; a window runs within each segment, what a segment carries over is aggregated
beside it, and the at most SEGMENTS carries of a key are added up in front of each other and
joined back. Events of one time stay in one segment, so that segments follow each other.
Whether there are hot keys is counted first; where there are none one window is all.
"""

from __future__ import annotations

import functools
import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.lineage import cut

HOT, SEGMENTS = 1_000_000, 256


def _own(rows: DataFrame, name: str) -> str:
    """A column name that ``rows`` doesn't have."""
    return name if name not in rows.columns else f"{name}_{uuid.uuid4().hex[:8]}"


def segmented(events: DataFrame, key: str, time: str, hot: int = HOT, segments: int = SEGMENTS) -> tuple[DataFrame, DataFrame, str] | None:
    """``events`` with a segment number, which grows with time within a key and is 0 for keys that
    aren't hot, the hot keys, and the number's name; None without hot keys.

    time is a number. Quantiles are approximate, so they are stored before they are used twice.
    """
    counts = events.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("n")).where(F.col("n") > hot).select(key)
    if not counts.limit(1).count():
        return None
    name, marks = _own(events, "segment"), _own(events, "marks")
    cuts = F.percentile_approx(time, [k / segments for k in range(1, segments)], 10 * segments).alias(marks)
    found = cut(events.join(counts, key, "left_semi").groupBy(key).agg(cuts))
    at = F.coalesce(F.size(F.filter(marks, lambda m: m < F.col(time))), F.lit(0))
    return events.join(found, key, "left").withColumn(name, at).drop(marks), found.select(key), name


def _scan(events: DataFrame, key: str, order: list[str], into: str, inner: Column, carried: Column, joined, hot: int, segments: int) -> DataFrame:
    """``events`` with ``into``: ``joined(carry, own)`` of what earlier segments carry and the value within the segment.

    carried aggregates a segment; ``joined.fold`` puts the carries of several together.
    """
    so_far = lambda *by: Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    if not (found := segmented(events, key, order[0], hot, segments)):
        return events.withColumn(into, inner.over(so_far(key)))
    rows, many, segment = found
    own, carry = _own(rows, "own"), _own(rows, "carry")
    local = rows.withColumn(own, inner.over(so_far(key, segment)))
    before = Window.partitionBy(key).orderBy(segment).rowsBetween(Window.unboundedPreceding, -1)
    carries = rows.join(many, key, "left_semi").groupBy(key, segment).agg(carried.alias(carry))
    carries = carries.select(key, segment, joined.fold(F.col(carry)).over(before).alias(carry))
    return local.join(carries, [key, segment], "left").withColumn(into, joined(F.col(carry), F.col(own))).drop(segment, own, carry)


class _Last:
    def __call__(self, carry: Column, own: Column) -> Column:
        return F.coalesce(own, carry)

    def fold(self, carry: Column) -> Column:
        return F.last(carry, ignorenulls=True)


class _Count:
    def __call__(self, carry: Column, own: Column) -> Column:
        return F.coalesce(carry, F.lit(0)) + own

    def fold(self, carry: Column) -> Column:
        return F.sum(carry)


def last_so_far(events: DataFrame, key: str, order: list[str], value: Column, into: str, hot: int = HOT, segments: int = SEGMENTS) -> DataFrame:
    """``events`` with the last value that isn't null up to each event, itself included.

    order: columns whose first is a number and which together tell a key's events apart.
    Events without a key share the null key and are kept in one window, as SQL has it.
    """
    name = _own(events, "value_here")
    rows = events.withColumn(name, value)
    carried = F.max_by(F.col(name), F.when(F.col(name).isNotNull(), F.struct(*order)))
    return _scan(rows, key, order, into, F.last(F.col(name), ignorenulls=True), carried, _Last(), hot, segments).drop(name)


def count_so_far(events: DataFrame, key: str, order: list[str], into: str, hot: int = HOT, segments: int = SEGMENTS) -> DataFrame:
    """``events`` with the number of a key's events up to each one, itself included."""
    return _scan(events, key, order, into, F.count(F.lit(1)), F.count(F.lit(1)), _Count(), hot, segments)


def as_of(rows: DataFrame, history: DataFrame, key: str, time: str, values: list[str], hot: int = HOT, segments: int = SEGMENTS) -> DataFrame:
    """``rows`` with the values that the history's last row of the same key had at or before their time.

    A join by carrying: rows and history, with times as numbers, are one ordered run of
    events. Of history rows of one time the greatest values count. Rows without an earlier
    history row, a key or a time get nulls.
    """
    here, there, which = F.struct(*[F.col(f"`{c}`") for c in rows.columns]), F.struct(*[F.col(v) for v in values]), "is_row"
    found = history.where(F.col(key).isNotNull() & F.col(time).isNotNull())
    kinds = [
        found.select(F.col(key).alias("k"), F.col(time).alias("t"), F.lit(False).alias(which), there.alias("set"), F.lit(None).cast(rows.select(here).schema[0].dataType).alias("row")),
        rows.select(F.col(key).alias("k"), F.col(time).alias("t"), F.lit(True).alias(which), F.lit(None).cast(found.select(there).schema[0].dataType).alias("set"), here.alias("row")),
    ]
    run = last_so_far(functools.reduce(DataFrame.unionByName, kinds), "k", ["t", which, "set"], F.col("set"), "got", hot, segments).where(which)
    known = F.col("k").isNotNull() & F.col("t").isNotNull()
    return run.select("row.*", *[F.when(known, F.col("got")[v]).alias(v) for v in values])
