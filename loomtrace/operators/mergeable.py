"""Parts of a checkpoint that two checkpoints can add up without the rows they came from.

One long table of cells holds everything: counters, value counts, size classes, the digests that distinct counts need, and the
changes in the number of open calls per instant. Cells of two checkpoints are added like the cells of two rows. Distinct counts
also exist as sketches of fixed size, for readers who can live with an estimate.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalar as sf
from . import stats

CELL = ("part", "name", "value")
#: log2 of a sketch's registers; the standard error of an estimate is 1.04 / sqrt(2^SKETCH_BITS) or better.
SKETCH_BITS = 14
SKETCH_ERROR = 1.04 / 2 ** (SKETCH_BITS / 2)


def _cell(part: str, name: str | Column, value: Column, n: Column, amount: Column | None = None) -> Column:
    """One cell of a row; cells without a count are left out."""
    named = F.lit(name) if isinstance(name, str) else name
    number = F.lit(None) if amount is None else amount
    return F.struct(F.lit(part).alias("part"), named.alias("name"), value.cast("string").alias("value"), n.cast("bigint").alias("n"), number.cast("bigint").alias("amount"))


def cells(rows: DataFrame) -> DataFrame:
    """The cells of feature rows: (part, name, value, n, sum, sum_squares, min, max).

    Parts: `counter` (value is empty), `distribution` (value), `series` (value is the size class; the sums belong to it), `digest`
    (name is `content` or the kind of a source group, value the digest) and `instant` (name is the second, value the microsecond, n
    the change in open calls). Digests and instants are nearly as many as the rows: they are counted apart from the cells that many
    rows share, so that those always fit a task's memory, and without the sums that only series have.
    """
    one, none = F.lit(1), F.lit(None)
    empty = F.lit("")
    found = [_cell("counter", name, empty, one) for name in ("captures", "complete")]
    found += [_cell("counter", name, empty, F.coalesce(F.col(flag).cast("int"), F.lit(0))) for name, flag in stats.COUNTED_FLAGS.items()]
    found += [_cell("counter", name, empty, F.coalesce(F.col(name), F.lit(0))) for name in stats.SUMMED]
    found += [_cell("distribution", name, value, one) for name, value in stats.dimensions().items()]
    for name in stats.SERIES:
        value = F.col(name).cast("bigint")
        found.append(_cell("series", name, sf.power_of_two_bucket(name), F.when(value >= 0, one).otherwise(none), value))
    several = F.transform("modalities", lambda m: _cell("distribution", "modalities", m, F.lit(1)))
    unfolded = rows.select(F.inline(F.concat(F.array(*found), F.coalesce(several, F.array().cast(f"array<{_CELL_TYPE}>"))))).where("n IS NOT NULL")
    exact = F.col("amount").cast("decimal(19,0)")
    shared = unfolded.groupBy(*CELL).agg(
        F.sum("n").alias("n"),
        F.sum(F.col("amount").cast("decimal(38,0)")).cast("decimal(38,0)").alias("sum"),
        F.sum(exact * exact).cast("decimal(38,0)").alias("sum_squares"),
        F.min("amount").alias("min"),
        F.max("amount").alias("max"),
    )
    digests = [
        _cell("digest", "content", F.col("content_sha256"), F.when(F.col("content_sha256").isNotNull(), one)),
        _cell("digest", F.col("source_group_kind"), F.col("source_group_sha256"), one),
    ]
    instants = []
    for moment, change in (("started_at", 1), ("completed_at", -1)):
        at = F.unix_micros(F.col(moment).cast("timestamp"))
        instants.append(_cell("instant", stats.second_of(at).cast("string"), at, F.when(at.isNotNull(), F.lit(change))))
    return shared.unionByName(_counted(rows, "digest", digests, shared)).unionByName(_counted(rows, "instant", instants, shared))


def _counted(rows: DataFrame, part: str, found: Sequence[Column], like: DataFrame) -> DataFrame:
    """Cells of one part that have a count and nothing else, with the columns of `like`."""
    counted = rows.select(F.inline(F.array(*found))).where("n IS NOT NULL").groupBy("name", "value").agg(F.sum("n").alias("n"))
    return counted.select(
        F.lit(part).alias("part"), "name", "value", "n", *[F.lit(None).cast(like.schema[c].dataType).alias(c) for c in ("sum", "sum_squares", "min", "max")]
    )


_CELL_TYPE = "struct<part:string,name:string,value:string,n:bigint,amount:bigint>"


def add_cells(cells_of_all: DataFrame) -> DataFrame:
    """Add up the cells of several checkpoints, given as one union."""
    return cells_of_all.groupBy(*CELL).agg(
        F.sum("n").alias("n"), *[F.sum(c).cast("decimal(38,0)").alias(c) for c in ("sum", "sum_squares")], F.min("min").alias("min"), F.max("max").alias("max")
    )


def seconds(all_cells: DataFrame) -> DataFrame:
    """(second, change, peak): what each second adds to the open calls, and the most that were open in it beyond those before."""
    instants = all_cells.where("part = 'instant'").select(F.col("name").cast("bigint").alias("second"), F.col("value").cast("bigint").alias("at"), F.col("n").alias("change"))
    return stats.second_peaks(instants)


def add_seconds(previous: DataFrame, delta: DataFrame, merged_cells: DataFrame) -> DataFrame:
    """Seconds of two checkpoints: only those that both hold are worked out again, from the merged instants."""
    both = previous.select("second").join(delta.select("second"), "second")
    instants = merged_cells.where("part = 'instant'").withColumn("second", F.col("name").cast("bigint"))
    again = seconds(instants.join(both, "second", "left_semi"))
    apart = previous.unionByName(delta).join(both, "second", "left_anti")
    return apart.unionByName(again)


def distinct_counters(all_cells: DataFrame) -> DataFrame:
    """(counter, n): distinct contents, their repeats, and source groups by kind, exact, from the digests."""
    digests = all_cells.where("part = 'digest'")
    kind = F.col("name")
    counted = digests.agg(
        F.count_if(kind == "content").alias("unique_contents"),
        F.coalesce(F.sum(F.when(kind == "content", F.col("n") - 1)), F.lit(0)).alias("duplicates"),
        F.count_if(kind != "content").alias("source_groups"),
        F.count_if(kind == "trajectory").alias("trajectory_groups"),
        F.count_if(kind == "request").alias("untagged_request_groups"),
    )
    return _unpivot(counted)


def concurrency_counter(peaks: DataFrame) -> DataFrame:
    return _unpivot(stats.peak_of_seconds(peaks))


def _unpivot(wide: DataFrame) -> DataFrame:
    return wide.select(F.inline(F.array(*[F.struct(F.lit(name).alias("counter"), F.col(name).cast("bigint").alias("n")) for name in wide.columns])))


def distinct_sketches(rows: DataFrame, columns: dict[str, str], keys: Sequence[str] = ()) -> DataFrame:
    """(counter, sketch) per key: a sketch of the distinct values of each named column; nulls do not count.

    A sketch takes at most 2^SKETCH_BITS bytes whatever the number of rows, so sketches of a checkpoint are cheap to keep.
    """
    wide = rows.groupBy(*keys).agg(*[F.hll_sketch_agg(F.col(column), F.lit(SKETCH_BITS)).alias(name) for name, column in columns.items()])
    return wide.select(*keys, F.inline(F.array(*[F.struct(F.lit(name).alias("counter"), F.col(name).alias("sketch")) for name in columns])))


def add_sketches(sketches: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """The union of sketches: that of the union's rows, in whatever order they are put together."""
    return sketches.groupBy(*keys, "counter").agg(F.hll_union_agg("sketch").alias("sketch"))


def estimates(sketches: DataFrame) -> DataFrame:
    """Adds the estimate and the bounds of two standard errors around it."""
    guess = F.hll_sketch_estimate("sketch")
    margin = F.ceil(guess * (2 * SKETCH_ERROR)).cast("bigint")
    return sketches.select(*[c for c in sketches.columns if c != "sketch"], guess.alias("estimate"), F.greatest(guess - margin, F.lit(0)).alias("low"), (guess + margin).alias("high"))
