"""Key listings: what is left to process, pages, pinned lists and cached rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Row counts at which a checkpoint is due.
THRESHOLDS = (100, 1000, 10_000, 100_000)


def ladder(thresholds: Sequence[int] = THRESHOLDS) -> list[int]:
    """The thresholds, going on tenfold from the last one as far as counts can go."""
    out = list(thresholds)
    while out[-1] < 10**17:
        out.append(out[-1] * 10)
    return out


def following_threshold(done: int, thresholds: Sequence[int] = THRESHOLDS) -> int:
    return next(value for value in ladder(thresholds) if value > done)


def next_threshold(processed_count, thresholds: Sequence[int] = THRESHOLDS):
    """Column: the first threshold above a count."""
    limits = F.array(*[F.lit(value).cast("bigint") for value in ladder(thresholds)])
    return F.try_element_at(F.filter(limits, lambda value: value > processed_count), F.lit(1))


def unprocessed(keys: DataFrame, processed: DataFrame) -> DataFrame:
    """Keys not processed yet. A late key simply turns up here the next time; no finished batch is rewritten."""
    return keys.join(processed.select("key"), "key", "left_anti")


def lowest(rows: DataFrame, needed: int, key: str = "key", few: int = 10_000) -> DataFrame:
    """The `needed` rows with the lowest keys (keys are unique), however many that are.

    Counts per pair of leading characters say in which range of keys the last one lies; the range is narrowed two characters
    at a time until a few rows are left. The driver sees one count per pair, a task at most `few` keys.
    """
    prefix, rest = "", needed
    while True:
        inside = rows.where(F.col(key).startswith(prefix)) if prefix else rows
        counts = inside.groupBy(F.substring(key, len(prefix) + 1, 2).alias("next")).count().orderBy("next").collect()
        for row in counts:
            if row["count"] >= rest:
                break
            rest -= row["count"]
        else:
            return rows
        if row["count"] <= few or not row["next"]:
            break
        prefix += row["next"]
    last = inside.where(F.substring(key, len(prefix) + 1, 2) == row["next"]).select(key).orderBy(key).limit(rest).agg(F.max(key)).first()[0]
    return rows.where(F.col(key) <= F.lit(last))


def next_batch(keys: DataFrame, processed: DataFrame, thresholds: Sequence[int] = THRESHOLDS) -> DataFrame:
    """The unprocessed rows, lowest keys first, that bring the total to the next threshold; empty if too few.

    Only counts come to the driver. Past the last threshold the ladder goes on tenfold, so that no row is left for ever.
    """
    done = processed.select("key").distinct().count()
    needed = following_threshold(done, thresholds) - done
    left = unprocessed(keys, processed)
    return lowest(left, needed) if left.count() >= needed else left.limit(0)


def threshold_probe(keys: DataFrame, processed: DataFrame, thresholds: Sequence[int] = THRESHOLDS) -> DataFrame:
    """Whether the stored rows reach the next threshold: two counts with partial sums."""
    counted = processed.select("key").distinct().agg(F.count("*").alias("processed_count"))
    state = counted.withColumn("next_threshold", next_threshold(F.col("processed_count"), thresholds))
    found = keys.agg(F.count("*").alias("n"))
    return state.withColumn("crossed", F.coalesce(found.scalar() >= F.col("next_threshold"), F.lit(False)))


def keyset_page(rows: DataFrame, cursor: str | None, size: int, key: str = "key") -> DataFrame:
    """One page in key order after the cursor."""
    after = rows if cursor is None else rows.where(F.col(key) > F.lit(cursor))
    return after.orderBy(key).limit(size)


def pinned_inputs(pinned: DataFrame, stored: DataFrame) -> DataFrame:
    """Compare a pinned list (key, sha256) with the stored rows: repeated, missing, differs or ok."""
    once = pinned.groupBy("key").agg(F.count("*").alias("n"), F.min("sha256").alias("sha256"))
    joined = once.join(stored.select("key", F.col("sha256").alias("stored_sha256")), "key", "left")
    status = (
        F.when(F.col("n") > 1, "repeated")
        .when(F.col("stored_sha256").isNull(), "missing")
        .when(F.col("sha256") != F.col("stored_sha256"), "differs")
        .otherwise("ok")
    )
    return joined.select("key", status.alias("status"))


def label_cache_split(sample: DataFrame, cache: DataFrame, config_digest: str) -> tuple[DataFrame, DataFrame]:
    """Split a sample, one row per content, into labels found in the cache and rows still to be labelled."""
    wanted = sample.dropDuplicates(["content_sha256"])
    mine = cache.where(F.col("config_digest") == config_digest).drop("config_digest").dropDuplicates(["content_sha256"])
    return wanted.join(mine, "content_sha256"), wanted.join(mine, "content_sha256", "left_anti")
