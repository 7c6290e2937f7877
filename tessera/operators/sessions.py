"""Per-session state over ordered events.

No task has to hold a session: running values come from segmented scans, and the chain of a
hot user's submits from pointer doubling. Times are numbers, and with the events' numbers
they order the events of a key.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import is_blank, js_trim
from tessera.operators import scans
from tessera.operators.lineage import cut
from tessera.operators.outcome import truthy
from tessera.operators.validate import login_email_error, validate_login

#: Submits of a key from which on its chain is found by pointer doubling.
HOT_SUBMITS = 1_000_000


def input_error(value: Column, error=login_email_error, skip=is_blank) -> Column:
    """What an input event changes the shown error to: null where it is skipped, empty where it clears it.

    An email is skipped where it is blank, a password only where it is empty (``is_empty``).
    """
    return F.when(~skip(value), F.coalesce(error(value), F.lit("")))


def current_errors(events: DataFrame, key: str, time: str, event: str, value: str, error=login_email_error, skip=is_blank, hot: int = scans.HOT) -> DataFrame:
    """``events`` with current_error, the error shown after each input event; a skipped input leaves the one before."""
    shown = scans.last_so_far(events, key, [time, event], input_error(F.col(value), error, skip), "current_error", hot)
    return shown.withColumn("current_error", F.nullif("current_error", F.lit("")))


def visibility(clicks: DataFrame, key: str, time: str, event: str, hot: int = scans.HOT) -> DataFrame:
    """``clicks`` with visible: whether the password shows after each click on its switch."""
    return scans.count_so_far(clicks, key, [time, event], "visible", hot).withColumn("visible", F.col("visible") % 2 == 1)


def _walked(submits: DataFrame, key: str, micros: str, event: str, delay: int) -> DataFrame:
    """Chains by one walk over each key's sorted submits, from taken submit to taken submit; what is held is one time."""

    def walk(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        of, until = None, None
        for part in parts:
            keys, times = part[key].to_numpy(), part[micros].to_numpy(np.int64)
            starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else []
            taken: list[int] = []
            for start, end in zip(starts, [*starts[1:], len(keys)]):
                own = times[start:end]
                i = int(np.searchsorted(own, until)) if keys[start] == of else 0
                while i < len(own):
                    taken.append(start + i)
                    until = int(own[i]) + delay
                    i = max(i + 1, int(np.searchsorted(own, until)))
                of = keys[start]
            yield part.iloc[taken]

    return submits.repartition(key).sortWithinPartitions(key, micros, event).mapInPandas(walk, submits.schema)


def _doubled(submits: DataFrame, key: str, micros: str, event: str, delay: int) -> DataFrame:
    """Chains by pointer doubling: each submit points to the first one at or after the end of its delay.

    Pointers reach twice as far in each round, and what the first submits of keys reach is
    taken: rounds are the logarithm of the longest chain, and no step groups by key.
    """
    nodes = cut(submits.groupBy(key, micros).agg(F.min(event).alias(event)))  # of submits at one time the first
    ahead = nodes.select(key, F.col(micros).alias("t"), (-(F.col(micros) + delay)).alias("at"))
    later = nodes.select(key, (-F.col(micros)).alias("at"), F.col(micros).alias("then"))
    jumps = cut(scans.as_of(ahead, later, key, "at", ["then"], hot=HOT_SUBMITS).where("then is not null").select(key, "t", "then"))
    reached = cut(nodes.groupBy(key).agg(F.min(micros).alias("t")))
    while jumps.limit(1).count():
        reached = cut(reached.unionByName(reached.join(jumps, [key, "t"]).select(key, F.col("then").alias("t"))).distinct())
        jumps = cut(jumps.join(jumps.select(key, F.col("t").alias("then"), F.col("then").alias("beyond")), [key, "then"]).select(key, "t", F.col("beyond").alias("then")))
    return nodes.join(reached.withColumnRenamed("t", micros), [key, micros], "left_semi").select(submits.columns)


def accepted_submits(submits: DataFrame, key: str, micros: str, event: str, delay: int, hot: int = HOT_SUBMITS) -> DataFrame:
    """(key, micros, event) of the submits that are taken: none within ``delay`` of the last one taken.

    A chain from taken submit to taken submit, so not a comparison of neighbours. Keys of
    more than ``hot`` submits are worked out apart, by pointer doubling.
    """
    rows = submits.select(key, micros, event).where(F.col(key).isNotNull() & F.col(micros).isNotNull())
    if delay <= 0:
        return rows
    many = rows.groupBy(key).agg(F.count("*").alias("n")).where(F.col("n") > hot).select(key)
    if not many.limit(1).count():
        return _walked(rows, key, micros, event, delay)
    many = cut(many)
    few = _walked(rows.join(many, key, "left_anti"), key, micros, event, delay)
    return few.unionByName(_doubled(rows.join(many, key, "left_semi"), key, micros, event, delay))


def stored_history(events: DataFrame, key: str, micros: str, event: str, is_submit: str, delay: int, hot: int = HOT_SUBMITS) -> DataFrame:
    """(key, since, until, email): what each key's store held and when; no email where a login removed it.

    events: rows with the form as it is after each event (email, password, remember);
    those with is_submit also send it. A submit counts if both login rules pass and no
    other is under way. ``delay`` after it the page stores the trimmed email, or removes
    what is stored, by the form of that moment: the key's last event before then. Until
    is null for what is still stored, or still removed. Rows without a key or a time are
    left out.
    """
    events = events.where(F.col(key).isNotNull() & F.col(micros).isNotNull())
    submits = validate_login(events.where(is_submit)).where("is_valid")
    taken = cut(accepted_submits(submits, key, micros, event, delay, hot).select(key, (F.col(micros) + delay).alias("since"), (F.col(micros) + (delay - 1)).alias("at")))
    forms = events.select(key, F.col(micros).alias("at"), F.col(event).alias("event"), F.coalesce("remember", F.lit(False)).alias("remember"), js_trim(F.col("email")).alias("email"))
    stored = cut(scans.as_of(taken, forms, key, "at", ["event", "remember", "email"]).select(key, "since", F.when(F.col("remember"), F.col("email")).alias("email")))
    ahead = stored.withColumn("at", -(F.col("since") + 1))
    later = stored.select(key, (-F.col("since")).alias("at"), F.col("since").alias("until"))
    return scans.as_of(ahead, later, key, "at", ["until"]).select(key, "since", "until", "email")


def remembered(events: DataFrame, key: str, micros: str, event: str, is_submit: str, delay: int, hot: int = HOT_SUBMITS) -> DataFrame:
    """(key, email): the trimmed email that each key's last login left stored."""
    history = stored_history(events, key, micros, event, is_submit, delay, hot)
    return history.where("until is null and email is not null").select(key, "email")


def restored(loads: DataFrame, history: DataFrame, key: str, micros: str) -> DataFrame:
    """Page loads with the email and the checkbox as the store of that moment fills them in.

    history: (key, since, email) of ``stored_history``; a load at the very time of a change sees it.
    """
    out = scans.as_of(loads, history.withColumnRenamed("since", micros), key, micros, ["email"])
    return out.withColumns({"remember": truthy(F.col("email")), "email": F.when(truthy(F.col("email")), F.col("email"))})
