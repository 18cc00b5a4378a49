"""The mergeable checkpoint: one long table of cells and the peaks per second that concurrency needs."""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import mergeable, stats
from ..session import ensure_checkpoint_dir


def _written(table: DataFrame, path: str) -> DataFrame:
    table.write.mode("overwrite").parquet(path)
    return table.sparkSession.read.schema(table.schema).parquet(path)


@dataclass
class Checkpoint:
    """`cells` as in `mergeable.cells`; `seconds` as in `mergeable.seconds`. Everything else is read from these two."""

    cells: DataFrame
    seconds: DataFrame

    @classmethod
    def of(cls, rows: DataFrame) -> Checkpoint:
        cells = mergeable.cells(rows)
        return cls(cells, mergeable.seconds(cells))

    def merge(self, delta: Checkpoint) -> Checkpoint:
        """The checkpoint of both; the rows are not read again."""
        cells = mergeable.add_cells(self.cells.unionByName(delta.cells))
        return Checkpoint(cells, mergeable.add_seconds(self.seconds, delta.seconds, cells))

    def stored(self, folder: str) -> Checkpoint:
        """The same, written to the folder. Cells are written once, and the seconds are worked out from what was written."""
        cells = _written(self.cells, f"{folder}/cells")
        return Checkpoint(cells, _written(mergeable.seconds(cells), f"{folder}/seconds"))

    def stored_once(self) -> Checkpoint:
        """The same, written to the checkpoint folder, so that its parts can be read without working it out again."""
        return self.stored(f"{ensure_checkpoint_dir(self.cells.sparkSession).rstrip('/')}/cells-{uuid.uuid4().hex}")

    def merged_into(self, delta: Checkpoint, folder: str) -> Checkpoint:
        """The checkpoint of both, written to the folder; cells are added up once."""
        cells = _written(self.merge(delta).cells, f"{folder}/cells")
        return Checkpoint(cells, _written(mergeable.add_seconds(self.seconds, delta.seconds, cells), f"{folder}/seconds"))

    @property
    def counters(self) -> DataFrame:
        return self.cells.where("part = 'counter'").select(F.col("name").alias("counter"), "n")

    @property
    def distributions(self) -> DataFrame:
        return self.cells.where("part = 'distribution'").select(F.col("name").alias("dim"), "value", "n")

    @property
    def series(self) -> DataFrame:
        return self.cells.where("part = 'series'").select(
            F.col("name").alias("series"), F.col("value").cast("bigint").alias("bucket"), F.col("n").alias("freq"), "sum", "sum_squares", "min", "max"
        )

    def recounted(self) -> DataFrame:
        """Counters of distinct contents, source groups and concurrency."""
        return mergeable.distinct_counters(self.cells).unionByName(mergeable.concurrency_counter(self.seconds))

    def long(self) -> DataFrame:
        """The whole checkpoint as (part, name, value, n), ready to be written or compared."""
        plain = self.cells.where(F.col("part").isin("counter", "distribution", "series")).select("part", "name", "value", "n")
        again = self.recounted().select(F.lit("counter").alias("part"), F.col("counter").alias("name"), F.lit("").alias("value"), "n")
        return plain.unionByName(again)


def quality(counters: DataFrame) -> DataFrame:
    """Parse, success and duplicate rates with their Wilson bounds, from the long counters."""
    wide = counters.agg(
        *[
            F.coalesce(F.max(F.when(F.col("counter") == name, F.col("n"))), F.lit(0)).alias(name)
            for name in ("captures", "parsed", "successful", "duplicates")
        ]
    )
    for source, name in (("parsed", "parse"), ("successful", "success"), ("duplicates", "duplicate")):
        wide = stats.rates(wide, source, "captures", name)
    return wide
