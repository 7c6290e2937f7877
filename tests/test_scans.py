"""Segmented scans, as-of joins and pointer doubling against plain loops, with one key that holds a third of the rows."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from tessera.operators import scans, sessions


@pytest.fixture(scope="module")
def events(spark):
    """(k, t, e, v): one hot key, many small ones, the null key; ties in time; values with nulls."""
    r = random.Random(3)
    rows = [("hot" if i % 3 == 0 else r.choice(["a", "b", "c", "d", None]), r.randrange(400), i, r.choice([None, None, "x", "y", "z"])) for i in range(3000)]
    df = spark.createDataFrame(rows, "k string, t long, e long, v string").repartition(5).cache()
    return rows, df


def _running(rows, step):
    out, state = {}, {}
    for k, t, e, v in sorted(rows, key=lambda x: (x[1], x[2])):
        state[k] = step(state.get(k), v)
        out[e] = state[k]
    return out


@pytest.mark.parametrize(("hot", "segments"), [(10**9, 8), (500, 8), (0, 3), (0, 64)])
def test_running_values(events, hot, segments):
    rows, df = events
    df = df.selectExpr("*", "1 AS segment", "'own' AS own", "2 AS carry", "3 AS marks")
    last = scans.last_so_far(df, "k", ["t", "e"], F.col("v"), "got", hot, segments)
    assert last.columns == [*df.columns, "got"] and last.where("segment <> 1 or own <> 'own' or carry <> 2").count() == 0
    assert {r.e: r.got for r in last.collect()} == _running(rows, lambda s, v: v if v is not None else s)
    assert {r.e: r.got for r in scans.count_so_far(df, "k", ["t", "e"], "got", hot, segments).collect()} == _running(rows, lambda s, _: (s or 0) + 1)


def test_segments_of_a_hot_key_stay_small(events):
    rows, df = events
    found, many, name = scans.segmented(df, "k", "t", 700, 16)
    sizes = {(r.k, r[name]): r["count"] for r in found.groupBy("k", name).count().collect()}
    assert [r.k for r in many.collect()] == ["hot"] and {s for k, s in sizes if k != "hot"} == {0}
    assert max(n for (k, _), n in sizes.items() if k == "hot") < 2.5 * 1000 / 16 and len([1 for k, _ in sizes if k == "hot"]) == 16
    by_segment = {}
    for r in found.where("k = 'hot'").collect():
        by_segment.setdefault(r[name], []).append(r.t)
    ends = [(min(by_segment[s]), max(by_segment[s])) for s in sorted(by_segment)]
    assert all(a[1] < b[0] for a, b in zip(ends, ends[1:]))


@pytest.mark.parametrize("hot", [10**9, 400])
def test_as_of(spark, events, hot):
    rows, df = events
    r = random.Random(4)
    history = [(r.choice(["hot", "hot", "a", "b", None]), r.choice([r.randrange(400), None]), n, r.choice([None, "p", "q"])) for n in range(900)]
    got = scans.as_of(df, spark.createDataFrame(history, "k string, t long, n long, w string"), "k", "t", ["n", "w"], hot, 8)
    assert got.columns == ["k", "t", "e", "v", "n", "w"]

    def best(k, t):
        own = [(ht, n, w) for hk, ht, n, w in history if hk == k and k is not None and ht is not None and ht <= t]
        return max(own, key=lambda x: x[:2])[1:] if own else (None, None)

    want = {e: best(k, t) for k, t, e, _ in rows}
    assert {x.e: (x.n, x.w) for x in got.collect()} == want


def _chain(rows, delay):
    out, until = [], {}
    for k, t, e in sorted(rows, key=lambda x: (x[1], x[2])):
        if k is not None and t >= until.get(k, t):
            out.append((k, t, e))
            until[k] = t + delay
    return sorted(out)


@pytest.mark.parametrize("delay", [0, 1, 7, 60, 10_000])
@pytest.mark.parametrize("hot", [10**9, 500, 0])
def test_taken_submits(events, delay, hot):
    rows, df = events
    got = sessions.accepted_submits(df.drop("v"), "k", "t", "e", delay, hot)
    want = sorted(r[:3] for r in rows if r[0] is not None) if delay == 0 else _chain([r[:3] for r in rows], delay)
    assert sorted(map(tuple, got.collect())) == want


def test_a_hot_users_chain_is_in_no_task(spark):
    """Of one user's 20,000 submits, a third of all, no task of the doubling reads more than a few segments hold."""
    submits = spark.range(60_000).selectExpr("CASE WHEN id % 3 = 0 THEN 0 ELSE id END AS k", "id * 10 AS t", "id AS e")
    got = sessions.accepted_submits(submits, "k", "t", "e", 100, 1000)
    assert got.where("k = 0").count() == 5000 and got.where("k <> 0").count() == 40_000
    plan = sessions._doubled(submits, "k", "t", "e", 100)._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "Python" not in plan and "MapIn" not in plan


def test_history_of_a_hot_user(spark):
    """The same history whichever way the chain is found."""
    r = random.Random(6)
    rows = [(r.choice("aab"), r.randrange(900), i, r.choice(["a@b.c", " x@y.z ", "no"]), r.choice(["long enough", "short"]), r.random() < 0.7, r.random() < 0.5) for i in range(700)]
    df = spark.createDataFrame(rows, "s string, t long, e long, email string, password string, remember boolean, is_submit boolean")
    one, other = (sorted(map(tuple, sessions.stored_history(df, "s", "t", "e", "is_submit", 20, hot).collect()), key=repr) for hot in (10**9, 0))
    assert one == other and len(one) > 20
    still = sessions.remembered(df, "s", "t", "e", "is_submit", 20)
    assert sorted(map(tuple, still.collect())) == sorted((s, email) for s, _, until, email in one if until is None and email is not None)
