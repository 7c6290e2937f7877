"""A stored table of last values by key: set, remove and get, and a sink for streams.

Each batch of changes is a folder of Parquet files that appears whole, by a rename, under
the name of who wrote it and the batch's number. A batch that is there already, as when a
stream repeats its last one after a failure, changes nothing. What a key holds is its latest
change by time; of one time by writer and batch. ``compact`` folds the batches into a
snapshot, which has one row a key, removed ones included, as older changes may still come.
"""

from __future__ import annotations

import functools
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class KeyedStore:
    """Values of a type by keys of a type, both as Spark writes types, in a folder that executors share."""

    def __init__(self, spark: SparkSession, path: str, key: str = "user_id bigint", value: str = "email string"):
        self.spark, self.path = spark, path.rstrip("/")
        self.key, self.value = key.split()[0], value.split()[0]
        self.schema = f"{key}, {value}, at bigint, removed boolean, writer string, batch bigint"

    # files

    def _fs(self, path: str):
        jvm = self.spark.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), at

    def _names(self, kind: str) -> list[str]:
        fs, at = self._fs(f"{self.path}/{kind}")
        return sorted(s.getPath().getName() for s in fs.listStatus(at)) if fs.exists(at) else []

    def _place(self, rows: DataFrame, name: str) -> bool:
        """Writes rows aside and puts them in place at once; False if the place is taken."""
        fs, to = self._fs(f"{self.path}/{name}")
        if fs.exists(to):
            return False
        aside = f"{self.path}/aside/{uuid.uuid4().hex}"
        rows.write.parquet(aside)
        fs.mkdirs(to.getParent())
        _, made = self._fs(aside)
        if fs.exists(to) or not fs.rename(made, to):
            fs.delete(made, True)
            return False
        return True

    def _snapshot(self) -> tuple[str | None, dict[str, int]]:
        """The newest snapshot and the last batch of each writer that is in it."""
        if not (found := self._names("snapshots")):
            return None, {}
        marks = self.spark.read.parquet(f"{self.path}/snapshots/{found[-1]}").groupBy("writer").agg(F.max("upto").alias("upto"))
        return found[-1], {r["writer"]: r["upto"] for r in marks.where("writer is not null").collect()}  # a row a writer

    def _later(self, upto: dict[str, int]) -> list[str]:
        """The batches that no snapshot holds."""
        split = lambda name: (name.rpartition("-")[0], int(name.rpartition("-")[2]))
        return [n for n in self._names("batches") if split(n)[1] > upto.get(split(n)[0], -1)]

    # changes

    def apply(self, changes: DataFrame, batch: int, writer: str = "stream") -> bool:
        """A batch of (key, at, value): the latest change of each key counts, and a null value removes it.

        False, and nothing done, for a batch that was applied before.
        """
        if "-" in writer or "/" in writer:
            raise ValueError("a writer's name has no dash and no slash")
        if batch <= self._snapshot()[1].get(writer, -1):
            return False
        rows = changes.where(F.col(self.key).isNotNull()).groupBy(self.key).agg(F.max_by(F.struct(self.value, "at"), F.struct(F.col("at"), F.col(self.value))).alias("last"))
        rows = rows.select(self.key, f"last.{self.value}", "last.at", F.col(f"last.{self.value}").isNull().alias("removed"), F.lit(writer).alias("writer"), F.lit(batch).cast("bigint").alias("batch"))
        return self._place(rows, f"batches/{writer}-{batch:020d}")

    def sink(self, writer: str = "stream") -> Callable[[DataFrame, int], None]:
        """For ``foreachBatch`` of a stream of (key, at, value)."""
        return lambda changes, batch: self.apply(changes, batch, writer) and None

    def set(self, rows: DataFrame, at: int) -> None:
        """Sets the values of (key, value) as of a time."""
        self._next(rows.select(self.key, self.value, F.lit(at).alias("at")))

    def remove(self, keys: DataFrame, at: int) -> None:
        """Removes the values of (key) as of a time."""
        value = self.schema.split(", ")[1].split()[1]
        self._next(keys.select(self.key, F.lit(None).cast(value).alias(self.value), F.lit(at).alias("at")))

    def _next(self, changes: DataFrame) -> None:
        while True:
            own = [int(n.rpartition("-")[2]) for n in self._names("batches") if n.startswith("call-")]
            if self.apply(changes, max([*own, self._snapshot()[1].get("call", -1)]) + 1, "call"):
                return

    # values

    def _latest(self, keys: DataFrame | None = None) -> DataFrame:
        snapshot, upto = self._snapshot()
        parts = [f"{self.path}/batches/{n}" for n in self._later(upto)]
        rows = [self.spark.read.schema(self.schema).parquet(*parts)] if parts else []
        if snapshot:
            rows.append(self.spark.read.schema(self.schema).parquet(f"{self.path}/snapshots/{snapshot}").where(F.col(self.key).isNotNull()))
        every = functools.reduce(DataFrame.unionByName, rows) if rows else self.spark.createDataFrame([], self.schema)
        every = every if keys is None else every.join(keys.select(self.key).distinct(), self.key, "left_semi")
        last = F.max_by(F.struct(self.value, "removed", "writer", "batch"), F.struct("at", "writer", "batch")).alias("last")
        return every.groupBy(self.key).agg(last, F.max("at").alias("at")).select(self.key, f"last.{self.value}", "at", "last.removed", "last.writer", "last.batch")

    def get(self, keys: DataFrame | None = None) -> DataFrame:
        """(key, value, at) of the keys that hold a value, or of those asked for."""
        return self._latest(keys).where("not removed").select(self.key, self.value, "at")

    def compact(self) -> None:
        """Folds all batches into a new snapshot and drops those and older snapshots."""
        old, upto = self._snapshot()
        later, older = self._later(upto), self._names("snapshots")
        for n in later:
            writer, _, batch = n.rpartition("-")
            upto[writer] = max(upto.get(writer, -1), int(batch))
        if not later:
            return
        marks = self.spark.createDataFrame([(w, n) for w, n in upto.items()], "writer string, upto bigint")
        number = int(old) + 1 if old else 0
        if self._place(self._latest().unionByName(marks, allowMissingColumns=True), f"snapshots/{number:020d}"):
            for name in [*(f"batches/{n}" for n in self._names("batches") if n in later), *(f"snapshots/{n}" for n in older)]:
                fs, at = self._fs(f"{self.path}/{name}")
                fs.delete(at, True)
