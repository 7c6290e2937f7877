"""Streams against the batch forms, the join of requests with answers, and the stored table of last values."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from tessera.operators import outcome, sessions
from tessera.sources.keyed_store import KeyedStore
from tessera.streaming import accounts as live
from tests.test_accounts import _streamed

END = [[("z", 50_000, 1, *[None] * 5)], [("z", 90_000, 1, *[None] * 5)]]
FORMS = "s string, t long, e long, email string, password string, remember boolean, is_submit boolean, more string"


@pytest.fixture(scope="module")
def forms():
    r = random.Random(8)
    rows = [(r.choice("aab"), r.randrange(600), i, r.choice(["a@b.c", " x@y.z ", "no", ""]), r.choice(["long enough", "short"]), r.random() < 0.7, r.random() < 0.5, None) for i in range(150)]
    return sorted(rows, key=lambda x: x[1])


def _batches(rows, n=3):
    """Neighbours in time come in any order, but no row comes after the watermark passed it."""
    out = [rows[k * len(rows) // n : (k + 1) * len(rows) // n] for k in range(n)]
    return [random.Random(1).sample(b, len(b)) for b in out] + END


def _got(rows):
    return sorted(((k, m // 1_000_000 - 1000, *rest) for k, m, *rest in rows if k != "z"), key=repr)


def test_taken_submits_equal_the_batch_form(spark, tmp_path, forms):
    got, kept = _streamed(spark, tmp_path, _batches(forms), lambda s: live.accepted_submits(s, "s", "ts", "e", 20_000_000), FORMS)
    want = sessions.accepted_submits(spark.createDataFrame(forms, FORMS), "s", "t", "e", 20)
    assert _got(got) == sorted(map(tuple, want.collect()), key=repr)


def test_errors_and_switches_equal_the_batch_form(spark, tmp_path, forms):
    (tmp_path / "a").mkdir(), (tmp_path / "b").mkdir()
    got, kept = _streamed(spark, tmp_path / "a", _batches(forms), lambda s: live.current_errors(s, "s", "ts", "e", "email"), FORMS)
    df = spark.createDataFrame(forms, FORMS)
    want = sessions.current_errors(df, "s", "t", "e", "email").select("s", "t", "e", "current_error")
    assert _got(got) == sorted(map(tuple, want.collect()), key=repr)
    got, _ = _streamed(spark, tmp_path / "b", _batches(forms), lambda s: live.visibility(s, "s", "ts", "e"), FORMS)
    assert _got(got) == sorted(map(tuple, sessions.visibility(df, "s", "t", "e").select("s", "t", "e", "visible").collect()), key=repr)


def test_what_is_kept_for_a_key_is_bounded(spark, tmp_path):
    """A key's many past events leave one value behind, or none."""
    rows = [[("a", 10 * k + i, 10 * k + i, f"{i}@x") for i in range(10)] for k in range(5)] + [[("z", 50_000, 1, "")], [("z", 90_000, 1, "")]]
    got, kept = _streamed(spark, tmp_path, rows, lambda s: live.current_errors(s, "s", "ts", "e", "value"), "s string, t long, e long, value string")
    assert len(got) >= 50 and kept <= 3  # the error of a, and what waits of z


def test_streams_start_from_a_given_value(spark, tmp_path):
    schema = "s string, t long, e long"
    (tmp_path / "a").mkdir(), (tmp_path / "b").mkdir()
    until = spark.createDataFrame([("a", 1_005_000_000)], "s string, until long")
    batches = [[("a", 3, 1), ("a", 7, 2), ("b", 3, None), ("b", 3, 3)], [("z", 50_000, 1)], [("z", 90_000, 1)]]
    got, _ = _streamed(spark, tmp_path / "a", batches, lambda s: live.accepted_submits(s, "s", "ts", "e", 10_000_000, initial=until), schema)
    assert _got(got) == [("a", 7, 2), ("b", 3, None)]  # of equal times a null event comes first
    shows = spark.createDataFrame([("a", True)], "s string, visible boolean")
    got, _ = _streamed(spark, tmp_path / "b", batches, lambda s: live.visibility(s, "s", "ts", "e", initial=shows), schema)
    assert _got(got) == sorted([("a", 3, 1, False), ("a", 7, 2, True), ("b", 3, None, True), ("b", 3, 3, False)], key=repr)


def test_streams_ask_for_their_state_store(spark):
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    stream = spark.readStream.format("rate").load().selectExpr("'a' AS s", "timestamp AS ts", "value AS e")
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.HDFSBackedStateStoreProvider")
    try:
        with pytest.raises(ValueError, match="RocksDB"):
            live.visibility(stream, "s", "ts", "e")
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)


def test_outcomes_of_a_stream(spark, tmp_path):
    """In time, late, never answered, unreadable; two rows move the watermarks on."""
    asked = [("r1", 0), ("r2", 0), ("r3", 0), ("r4", 5), ("r5", 5), (None, 5)]
    answered = [("r1", 1, 200, '{"message":"hi"}'), ("r2", 40, 200, '{"message":"late"}'), ("r4", 6, 500, "{}"), ("r5", 35, 200, "{}x"), (None, 5, 200, "{}")]
    end = [[("y1", 5_000)], [("y2", 9_000)]], [[("y1", 5_001, 200, "{}")], [("y2", 9_001, 200, "{}")]]
    streams = []
    for name, schema, batches in (("q", "id string, t long", [asked, *end[0]]), ("a", "id string, t long, status int, body string", [answered, *end[1]])):
        (tmp_path / name).mkdir()
        for k, rows in enumerate(batches):
            spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / f"{name}{k}"))
        streams.append(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / name)).withColumn("ts", F.timestamp_seconds(F.col("t") + 1000)))
    query = live.live_outcomes(*streams, "id", "ts", "30 seconds").writeStream.format("memory").queryName("outcomes").start()
    for k in range(3):
        for name in ("q", "a"):
            for f in (tmp_path / f"{name}{k}").glob("part-*.parquet"):
                f.rename(tmp_path / name / f"{k}.parquet")
        query.processAllAvailable()
    query.stop()
    got = spark.table("outcomes").where("id is null or id < 's'").collect()
    assert sorted(((r.id, r.t, r.outcome) for r in got), key=repr) == sorted(
        [("r1", 0, "hi"), ("r2", 0, outcome.UNREACHABLE), ("r3", 0, outcome.UNREACHABLE), ("r4", 5, outcome.FAILED), ("r5", 5, outcome.UNREACHABLE), (None, 5, outcome.UNREACHABLE)], key=repr
    )


# the stored table


def _held(store, keys=None):
    return sorted(map(tuple, store.get(keys).collect()))


def test_set_remove_get(spark, tmp_path):
    store = KeyedStore(spark, f"{tmp_path}/s")
    rows = lambda *r: spark.createDataFrame(r, "user_id long, email string")
    assert _held(store) == []
    store.set(rows((1, "a"), (2, "b"), (None, "x")), 10)
    store.set(rows((1, "c")), 20)
    store.set(rows((1, "old")), 15)
    store.remove(spark.createDataFrame([(2,)], "user_id long"), 20)
    assert _held(store) == [(1, "c", 20)] and _held(store, spark.createDataFrame([(2,), (1,)], "user_id long")) == [(1, "c", 20)]
    store.set(rows((2, "")), 30)
    assert _held(store, spark.createDataFrame([(2,), (3,)], "user_id long")) == [(2, "", 30)]


def test_a_batch_that_comes_again_changes_nothing(spark, tmp_path):
    store = KeyedStore(spark, f"{tmp_path}/s")
    batch = lambda *r: spark.createDataFrame(r, "user_id long, at long, email string")
    assert store.apply(batch((1, 5, "a"), (1, 7, "b"), (2, 5, "x")), 0)
    assert store.apply(batch((2, 9, None)), 1) and not store.apply(batch((1, 99, "again")), 0)
    assert _held(store) == [(1, "b", 7)]
    store.compact()
    assert _held(store) == [(1, "b", 7)] and not store.apply(batch((1, 99, "again")), 1) and store._names("batches") == []
    assert store.apply(batch((2, 8, "before it was removed"), (3, 1, "c")), 2) and _held(store) == [(1, "b", 7), (3, "c", 1)]
    store.compact()
    store.compact()
    assert _held(store) == [(1, "b", 7), (3, "c", 1)] and len(store._names("snapshots")) == 1
    assert store.apply(batch((3, 1, None)), 0, "other") and [k for k, *_ in _held(store)] == [1, 3]  # of one time the later writer's name counts


def test_logins_are_kept_by_a_stream(spark, tmp_path, forms):
    """What the stream's sink holds, a repeated batch included, is what the batch form remembers."""
    store = KeyedStore(spark, f"{tmp_path}/store", "s string")
    (tmp_path / "in").mkdir()
    stream = spark.readStream.schema(FORMS).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")).withColumn("ts", F.timestamp_seconds(F.col("t") + 1000))
    changes = live.remembered_emails(stream, "s", "ts", "e", "is_submit", 20_000_000).withColumnRenamed("micros", "at")

    def twice(batch, number):
        store.sink()(batch, number)
        store.sink()(batch, number)

    query = changes.writeStream.foreachBatch(twice).start()
    for k, rows in enumerate(_batches(forms)):
        spark.createDataFrame(rows, FORMS).coalesce(1).write.parquet(str(tmp_path / f"b{k}"))
        for f in (tmp_path / f"b{k}").glob("part-*.parquet"):
            f.rename(tmp_path / "in" / f"{k}.parquet")
        query.processAllAvailable()
    query.stop()
    want = sessions.remembered(spark.createDataFrame(forms, FORMS), "s", "t", "e", "is_submit", 20)
    assert sorted((s, email) for s, email, _ in _held(store) if s != "z") == sorted(map(tuple, want.collect()))
