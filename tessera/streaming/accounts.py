"""The account operators over streams.

The stateful ones take an event time and how late events may come (``late``). A key's
events wait in a list until the watermark has passed them, when a timer takes them in
order of time, so that the result is that of the batch form; later ones than that are left
out, like those without a key or a time. What a key is in beyond its waiting events is one
typed value, which goes as soon as nothing that may still come depends on it. ``initial``
gives keys a value to start from.

They need the state store that ``transformWithState`` does: ``STATE_STORE`` as
``spark.sql.streaming.stateStore.providerClass``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType, _parse_datatype_string

from tessera.functions.text import is_blank, js_trim
from tessera.operators.intake import bind
from tessera.operators.outcome import UNREACHABLE, signup_outcome
from tessera.operators.sessions import input_error
from tessera.operators.validate import login_email_error, validate_login, validate_signup

#: Stands for an event without a number, which comes before others of its time.
NO_EVENT = -(1 << 63)
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def bound_requests(bodies: DataFrame) -> DataFrame:
    """Stateless: bodies of a stream that bind, with their fields."""
    return bind(bodies)


def validated_signups(forms: DataFrame) -> DataFrame:
    """Stateless: the batch validator, on a stream."""
    return validate_signup(forms)


def live_outcomes(requests: DataFrame, answers: DataFrame, key: str, time: str, wait: str, late: str = "1 minute") -> DataFrame:
    """``requests`` with the outcome that the form shows: of the answer that came within ``wait``, else unreachable.

    requests: key and a timestamp of each sign-up that was sent; answers: key, a timestamp,
    status and body. An outer interval join of two streams: a request without an answer
    comes out when the watermark shows that none can come any more.
    """
    asked = requests.withWatermark(time, late)
    come = answers.select(F.col(key).alias("of"), F.col(time).alias("came"), "status", "body").withWatermark("came", late)
    within = (F.col(key) == F.col("of")) & (F.col("came") >= F.col(time)) & (F.col("came") <= F.col(time) + F.expr(f"INTERVAL {wait}"))
    met = asked.join(come, within, "leftOuter")
    shown = F.when(F.col("of").isNull(), UNREACHABLE).otherwise(signup_outcome(F.col("status"), F.col("body")))
    return met.select(*[F.col(f"`{c}`") for c in requests.columns], shown.alias("outcome"))


class _InOrder(StatefulProcessor):
    """Takes each key's events in order of time and number, once the watermark has passed them.

    step(own, events, now) gives the new own value (a tuple, or None), rows of the result
    after the key, and the micros at which it wants to be called again, or None.
    """

    def __init__(self, names: list[str], event: StructType, own: StructType, out: StructType, step: Callable):
        self.names, self.event, self.own_type, self.out, self.step = names, event, own, out, step

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getListState("held", self.event)
        self.own = handle.getValueState("own", self.own_type)

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        now, found = timerValues.getCurrentWatermarkInMs() * 1000, []
        for part in rows:
            found += [tuple(None if x is None or x != x else x.item() if hasattr(x, "item") else x for x in r) for r in part[self.names].itertuples(index=False)]
        found = [r for r in found if r[0] > now]
        if found:
            self.held.appendList(found)
            self._wake(min(r[0] for r in found))
        return iter(())

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs() * 1000
        waiting = [tuple(r) for r in self.held.get()]
        ready = sorted((r for r in waiting if r[0] <= now), key=lambda r: r[:2])
        rest = [r for r in waiting if r[0] > now]
        before = tuple(self.own.get()) if self.own.exists() else None
        own, out, until = self.step(before, [dict(zip(self.names, r)) | {"event": None if r[1] == NO_EVENT else r[1]} for r in ready], now)
        if ready:
            self.held.put(rest) if rest else self.held.clear()
        if own is None:
            self.own.clear()
        elif own != before:
            self.own.update(own)
        if soonest := [r[0] for r in rest] + ([until] if until is not None else []):
            self._wake(min(soonest))
        if out:
            yield pd.DataFrame([(*key, *r) for r in out], columns=self.out.names)

    def handleInitialState(self, key: Any, initialState: pd.DataFrame, timerValues: Any) -> None:
        row = initialState.iloc[0]
        own = tuple(row[n].item() if hasattr(row[n], "item") else row[n] for n in self.own_type.names)
        self.own.update(own)
        _, _, until = self.step(own, [], -1)
        if until is not None:
            self._wake(until)

    def _wake(self, micros: int) -> None:
        self.handle.registerTimer(-(-micros // 1000))

    def close(self) -> None:
        pass


def _in_order(rows: DataFrame, key: str, late: str, own: str, step: Callable, schema: str, initial: DataFrame | None) -> DataFrame:
    """``rows`` (key, a timestamp ``at``, micros, event and others) through ``step``, with own values of a schema."""
    spark = rows.sparkSession
    if spark.conf.get("spark.sql.streaming.stateStore.providerClass") != STATE_STORE:
        raise ValueError(f"spark.sql.streaming.stateStore.providerClass must be {STATE_STORE}")
    names = [c for c in rows.columns if c not in (key, "at")]
    event = StructType([rows.schema[n] for n in names])
    out = _parse_datatype_string(f"{key} {rows.schema[key].dataType.simpleString()}, {schema}")
    rows = rows.where(F.col(key).isNotNull() & F.col("micros").isNotNull()).withWatermark("at", late)
    kept = _parse_datatype_string(own)
    start = None if initial is None else initial.select(key, *[F.col(f.name).cast(f.dataType) for f in kept]).groupBy(key)
    return rows.groupBy(key).transformWithStateInPandas(_InOrder(names, event, kept, out, step), out, "Append", "EventTime", start)


def _timed(events: DataFrame, key: str, time: str, event: str, *others: str) -> DataFrame:
    number = F.coalesce(F.col(event).cast("bigint"), F.lit(NO_EVENT)).alias("event")  # a null would make floats of a batch's numbers
    return events.select(key, F.col(time).alias("at"), F.unix_micros(time).alias("micros"), number, *others)


def accepted_submits(submits: DataFrame, key: str, time: str, event: str, delay: int, late: str = "1 minute", initial: DataFrame | None = None) -> DataFrame:
    """(key, micros, event) of the submits that are taken; the value kept is the end of the current delay (until, long)."""

    def step(own, events, now):
        until, taken = own[0] if own else None, []
        for e in events:
            if until is None or e["micros"] >= until:
                taken.append((e["micros"], e["event"]))
                until = e["micros"] + delay
        return (None, taken, None) if until is None or until <= now else ((until,), taken, until)

    return _in_order(_timed(submits, key, time, event), key, late, "until bigint", step, "micros bigint, event bigint", initial)


def current_errors(events: DataFrame, key: str, time: str, event: str, value: str, error: Callable[[Column], Column] = login_email_error, skip: Callable[[Column], Column] = is_blank, late: str = "1 minute", initial: DataFrame | None = None) -> DataFrame:
    """(key, micros, event, current_error) after each input event; the value kept is the error that shows (shown, string)."""

    def step(own, events, now):
        shown, out = own[0] if own else None, []
        for e in events:
            shown = e["error"] if e["error"] is not None else shown
            out.append((e["micros"], e["event"], shown or None))
        return (shown,) if shown else None, out, None

    new = events.withColumn("error", input_error(F.col(value), error, skip))
    return _in_order(_timed(new, key, time, event, "error"), key, late, "shown string", step, "micros bigint, event bigint, current_error string", initial)


def visibility(clicks: DataFrame, key: str, time: str, event: str, late: str = "1 minute", initial: DataFrame | None = None) -> DataFrame:
    """(key, micros, event, visible) after each click on the switch; the value kept is there while the password shows (visible, boolean)."""

    def step(own, events, now):
        shows, out = bool(own and own[0]), []
        for e in events:
            shows = not shows
            out.append((e["micros"], e["event"], shows))
        return (True,) if shows else None, out, None

    return _in_order(_timed(clicks, key, time, event), key, late, "visible boolean", step, "micros bigint, event bigint, visible boolean", initial)


def remembered_emails(events: DataFrame, key: str, time: str, event: str, is_submit: str, delay: int, late: str = "1 minute", initial: DataFrame | None = None) -> DataFrame:
    """(key, micros, email): what each login stores when its delay ends, null where it removes what is stored.

    The value kept is the login under way and its form (until long, email string, remember
    boolean). The last row of a key is what its store holds: the email, trimmed, or nothing.
    """

    def step(pending, events, now):
        out = []
        stored = lambda p: (p[0], p[1] if p[2] else None)
        for e in events:
            if pending and e["micros"] >= pending[0]:
                out.append(stored(pending))
                pending = None
            if pending or e["submits"]:
                pending = (pending[0] if pending else e["micros"] + delay, e["email"], bool(e["remember"]))
        if pending and pending[0] <= now:
            out.append(stored(pending))
            pending = None
        return pending, out, pending and pending[0]

    forms = validate_login(events).withColumns({"submits": F.coalesce(F.col(is_submit) & F.col("is_valid"), F.lit(False)), "email": js_trim(F.col("email")), "remember": F.coalesce("remember", F.lit(False))})
    return _in_order(_timed(forms, key, time, event, "submits", "email", "remember"), key, late, "until bigint, email string, remember boolean", step, "micros bigint, email string", initial)
