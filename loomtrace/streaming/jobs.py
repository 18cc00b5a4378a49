"""Structured Streaming forms of the checkpoint, the ledger and the per-group state.

A checkpoint takes the lowest keys that are there when its threshold is reached, and a late row goes into the next one. Keys seen
before and the first rows of a group are state of the query, kept by Spark in its state store next to the query's progress: if that
state is lost, a restart fails instead of starting anew. What a micro-batch adds lies in folders named by its number, so a batch
that runs twice writes the same thing again.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator, Sequence
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from ..operators import stats
from ..plans import checkpoint as cp
from ..sources.listing import THRESHOLDS, following_threshold, ladder, lowest

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
PARTS = ("cells", "seconds", "keys")


class StateLost(RuntimeError):
    """What an earlier micro-batch has written is not there any more."""


def path_exists(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def _written(spark: SparkSession, path: str) -> bool:
    return path_exists(spark, f"{path}/_SUCCESS")


def _state_on_disk(spark: SparkSession) -> None:
    """Unless another store is set, keep state in RocksDB, where it may outgrow an executor's memory and is stored as changes."""
    if "HDFSBacked" in spark.conf.get(PROVIDER, "HDFSBacked"):
        spark.conf.set(PROVIDER, ROCKSDB)


class CheckpointStream:
    """Threshold-triggered checkpoints over a stream of feature rows.

    Keys seen before are dropped by the state store, a lookup per row of the batch. A batch then writes its rows and one line of
    the ledger (rows so far, last threshold, where the pending rows lie) and reads nothing but the line before. Only a batch that
    reaches a threshold reads the pending rows: those are the rows since the last threshold and what that one left over, so each
    row is read once per threshold. Checkpoints are merged, never recounted.
    """

    def __init__(self, folder: str, thresholds: Sequence[int] = THRESHOLDS):
        self.folder = folder
        self.thresholds = tuple(thresholds)

    def _place(self, threshold: int, part: str) -> str:
        return f"{self.folder}/checkpoints/{threshold}/{part}"

    def _batch(self, name: str, batch_id: int) -> str:
        return f"{self.folder}/{name}/{batch_id}"

    def reached(self, spark: SparkSession) -> list[int]:
        """Thresholds whose checkpoint is complete; its keys are written last."""
        return [t for t in ladder(self.thresholds) if _written(spark, self._place(t, "keys"))]

    def read(self, spark: SparkSession, threshold: int) -> cp.Checkpoint:
        return cp.Checkpoint(*[spark.read.parquet(self._place(threshold, part)) for part in PARTS[:2]])

    def rows(self, spark: SparkSession) -> DataFrame:
        """All rows stored so far."""
        return spark.read.parquet(f"{self.folder}/rows/*")

    def processed(self, spark: SparkSession) -> DataFrame | None:
        found = [spark.read.parquet(self._place(t, "keys")) for t in self.reached(spark)]
        out = None
        for keys in found:
            out = keys if out is None else out.unionByName(keys)
        return out

    def _line_before(self, spark: SparkSession, batch_id: int) -> dict[str, int]:
        """The ledger's line of the batch before; a line that is missing is an error, as is a line of a batch to come."""
        if _written(spark, self._batch("ledger", batch_id + 1)):
            raise StateLost(f"batch {batch_id} runs again, but the one after it has run in {self.folder}")
        if batch_id == 0:
            return {"stored": 0, "reached": 0, "left_by": -1}
        if not _written(spark, self._batch("ledger", batch_id - 1)):
            raise StateLost(f"batch {batch_id} follows a batch that is not in {self.folder}/ledger")
        return spark.read.parquet(self._batch("ledger", batch_id - 1)).first().asDict()

    def _pending(self, spark: SparkSession, left_by: int, batch_id: int) -> DataFrame:
        """What the batch `left_by` left over, and the rows of the batches after it."""
        places = [self._batch("rows", k) for k in range(left_by + 1, batch_id + 1)]
        if left_by >= 0:
            places.append(self._batch("left", left_by))
        return spark.read.parquet(*places)

    def on_batch(self, batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        line = self._line_before(spark, batch_id)
        batch.write.mode("overwrite").parquet(self._batch("rows", batch_id))
        stored = line["stored"] + spark.read.parquet(self._batch("rows", batch_id)).count()
        reached, left_by = line["reached"], line["left_by"]
        if stored >= following_threshold(reached, self.thresholds):
            reached = self._advance(spark, self._pending(spark, left_by, batch_id), batch_id, stored, reached)
            left_by = batch_id
        after = [(stored, reached, left_by)]
        spark.createDataFrame(after, "stored long, reached long, left_by long").coalesce(1).write.mode("overwrite").parquet(self._batch("ledger", batch_id))

    def _advance(self, spark: SparkSession, pending: DataFrame, batch_id: int, stored: int, reached: int) -> int:
        """Write every checkpoint whose threshold the stored rows reach, then the pending rows that none of them took."""
        while stored >= (following := following_threshold(reached, self.thresholds)):
            # The chosen keys are fixed in a table first; everything else is derived from it.
            chosen = f"{self.folder}/chosen/{following}"
            lowest(pending.select("key"), following - reached).write.mode("overwrite").parquet(chosen)
            keys = spark.read.parquet(chosen)
            # The chosen keys are the lowest, so the highest of them parts the pending rows; a row without a key stays.
            taken = F.coalesce(F.col("key") <= F.lit(keys.agg(F.max("key")).first()[0]), F.lit(False))
            delta = cp.Checkpoint.of(pending.where(taken))
            place = f"{self.folder}/checkpoints/{following}"
            if reached:
                self.read(spark, reached).merged_into(delta.stored(f"{self.folder}/deltas/{following}"), place)
            else:
                delta.stored(place)
            keys.write.mode("overwrite").parquet(self._place(following, "keys"))
            pending, reached = pending.where(~taken), following
        pending.write.mode("overwrite").parquet(self._batch("left", batch_id))
        return reached

    def start(self, stream: DataFrame) -> StreamingQuery:
        """Run over what is there. Rows with a key that came before are dropped."""
        _state_on_disk(stream.sparkSession)
        return (
            stream.dropDuplicates(["key"])
            .writeStream.foreachBatch(self.on_batch)
            .option("checkpointLocation", f"{self.folder}/progress")
            .trigger(availableNow=True)
            .start()
        )


def running_distributions(stream: DataFrame) -> DataFrame:
    """Running value counts; write in `update` or `complete` mode."""
    return stats.distributions(stream)


def running_series(stream: DataFrame, names: Sequence[str] = stats.SERIES) -> DataFrame:
    """Running series accumulators in long form."""
    return stats.series_buckets(stream, names)


def deduplicate(stream: DataFrame, digest: str = "input_sha256", event_time: str | None = None, delay: str | None = None) -> DataFrame:
    """First row of every digest. State grows with the number of digests unless an event time bounds it."""
    if event_time and delay:
        return stream.withWatermark(event_time, delay).dropDuplicatesWithinWatermark([digest])
    return stream.dropDuplicates([digest])


def latest_per_group(stream: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Running representative of every source group, as an aggregate that folds inside tasks before the shuffle.

    A trajectory keeps its latest row, then the lowest content; a request group keeps the lowest content.
    """
    flipped = F.translate("content_sha256", "0123456789abcdef", "fedcba9876543210")
    time = F.when(F.col("source_group_kind") == "trajectory", F.col("completed_at")).otherwise("")
    best = F.max_by(F.struct(*columns), F.struct(time.alias("t"), flipped.alias("c")))
    return stream.groupBy("source_group_kind", "source_group_sha256").agg(best.alias("row")).select(
        "source_group_kind", "source_group_sha256", "row.*"
    )


class _FirstRows(StatefulProcessor):
    """State of a group: its first k rows, how often they changed, and whether it is closed."""

    def __init__(self, group: str, order: list[str], k: int, row: T.StructType, idle_ms: int | None):
        self.group, self.order, self.k, self.row, self.idle_ms = group, order, k, row, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.kept = handle.getListState("kept", self.row)
        self.changes = handle.getValueState("changes", T.StructType([T.StructField("n", T.LongType()), T.StructField("closed", T.BooleanType())]))

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        n, closed = self.changes.get() if self.changes.exists() else (0, False)
        if closed:
            for row in rows:
                yield self._out(key, tuple(row[name] for name in self.row.names), n, None, "late")
            return
        before = [tuple(row) for row in self.kept.get()] if self.kept.exists() else []
        held = list(before)
        for row in rows:
            new = tuple(row[name] for name in self.row.names)
            place = bisect_left(held, self._place(new), key=self._place)
            if place < self.k and not (place < len(held) and self._place(held[place]) == self._place(new)):
                held.insert(place, new)
                del held[self.k :]
        if held != before:
            self.kept.put(held)
            self.changes.update((n + 1, False))
            for rank, row in enumerate(held, 1):
                yield self._out(key, row, n + 1, rank, "first")
        if self.idle_ms is not None:
            for due in list(self.handle.listTimers()):
                self.handle.deleteTimer(due)
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.idle_ms)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:
        """The group has been quiet: its rows are final and leave the state; only the mark that it is closed stays."""
        n, _ = self.changes.get()
        held = [tuple(row) for row in self.kept.get()]
        self.kept.clear()
        self.changes.update((n + 1, True))
        for rank, row in enumerate(held, 1):
            yield self._out(key, row, n + 1, rank, "closed")

    def _place(self, row: tuple) -> tuple:
        """What rows are ordered by, nulls first."""
        return tuple((x is not None, x) if x is not None else (False,) for x in row[: len(self.order)])

    def _out(self, key: Any, row: tuple, change: int, rank: int | None, status: str) -> Row:
        return Row(**{self.group: key[0]}, **dict(zip(self.row.names, row, strict=True)), change=change, rank=rank, status=status)


def _first_of_batch(batch: pa.RecordBatch, group: str, order: list[str], k: int) -> pa.RecordBatch:
    """The first k different rows of each group in a batch, by the order columns with nulls first."""
    names = [group, *order]
    batch = batch.take(pc.sort_indices(batch, sort_keys=[(name, "ascending") for name in names], null_placement="at_start"))
    codes = np.stack([pc.rank(batch.column(name), tiebreaker="dense").to_numpy() for name in names])
    differs = np.ones((len(names), batch.num_rows), dtype=bool)
    differs[:, 1:] = codes[:, 1:] != codes[:, :-1]
    once = np.flatnonzero(differs.any(axis=0))
    opens = differs[0][once]
    number = np.arange(len(once)) - np.flatnonzero(opens)[np.cumsum(opens) - 1]
    return batch.take(pa.array(once[number < k]))


class FirstKStream:
    """The first k supported rows per group in the order of `order`, whatever the order of arrival.

    A group's state is a list of k rows in the state store. Each change of the list is written as a new version of the group
    (`change` counts them, `rank` from 1); `read` returns the last versions. Rows that arrive twice count once. With `idle_ms` a
    timer closes a group that had no row for so long: its rows are written once more with status `closed` and leave the state,
    and rows that still come are written with status `late` instead of being lost.

    Tasks cut each batch of rows to k per group before the shuffle, so a hot group sends few rows to its one task.
    """

    def __init__(self, folder: str, group: str, order: Sequence[str], k: int, columns: Sequence[str] = (), idle_ms: int | None = None):
        self.folder, self.group, self.order, self.k, self.idle_ms = folder, group, list(order), k, idle_ms
        self.columns = [*self.order, *[c for c in columns if c not in self.order and c != group]]

    def rows(self, stream: DataFrame, supported: Column) -> DataFrame:
        """The versions as a streaming DataFrame, in append mode."""
        chosen = stream.where(supported).select(self.group, *self.columns)
        # State holds times as microseconds: they keep their order and need no time zone.
        times = [f.name for f in chosen.schema if isinstance(f.dataType, T.TimestampType)]
        picked = chosen.withColumns({name: F.unix_micros(name) for name in times})
        group, order, k = self.group, self.order, self.k

        def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    yield _first_of_batch(batch, group, order, k)

        row = T.StructType([picked.schema[c] for c in self.columns])
        out = T.StructType([picked.schema[group], *row.fields]).add("change", T.LongType()).add("rank", T.LongType()).add("status", T.StringType())
        versions = (
            picked.mapInArrow(cut, picked.schema)
            .groupBy(group)
            .transformWithState(_FirstRows(group, order, k, row, self.idle_ms), out, "Append", "None" if self.idle_ms is None else "ProcessingTime")
        )
        return versions.withColumns({name: F.timestamp_micros(name) for name in times})

    def start(self, stream: DataFrame, supported: Column) -> StreamingQuery:
        """Run over what is there; with `idle_ms` go on until stopped, as timers need a query that runs."""
        _state_on_disk(stream.sparkSession)
        writer = (
            self.rows(stream, supported)
            .writeStream.format("parquet")
            .option("path", f"{self.folder}/versions")
            .option("checkpointLocation", f"{self.folder}/progress")
        )
        return (writer.trigger(availableNow=True) if self.idle_ms is None else writer.trigger(processingTime=f"{max(100, self.idle_ms)} milliseconds")).start()

    def versions(self, spark: SparkSession) -> DataFrame:
        return spark.read.parquet(f"{self.folder}/versions")

    def read(self, spark: SparkSession) -> DataFrame:
        """The rows of each group's last version."""
        known = self.versions(spark).where("status <> 'late'")
        last = known.groupBy(F.col(self.group).alias("__group")).agg(F.max("change").alias("__change"))
        newest = F.col(self.group).eqNullSafe(F.col("__group")) & (F.col("change") == F.col("__change"))
        return known.join(last, newest).drop("change", "__group", "__change")
