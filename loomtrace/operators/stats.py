"""Mergeable traffic statistics in long form."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalar as sf

COUNTED_FLAGS = {
    "request_parsed": "request_parse",
    "response_parsed": "response_parse",
    "parsed": "parse",
    "successful": "success",
    "model_completed": "model_completed",
    "refusals": "refusal",
}
SUMMED = ("tool_argument_total", "tool_argument_valid")
SERIES = (
    "request_bytes", "response_bytes", "message_count", "input_item_count", "tool_definitions", "tool_calls",
    "ttft_ms", "total_ms", "tps_milli", "input_tokens", "output_tokens", "cached_tokens", "reasoning_tokens",
)
PERCENTS = {"p50": 50, "p95": 95, "p99": 99}


def long_total(column: Column) -> Column:
    return F.coalesce(F.sum(column), F.lit(0)).cast("bigint")


def structural_counters(rows: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Ten counters in one pass."""
    flags = [F.count_if(F.col(source)).alias(name) for name, source in COUNTED_FLAGS.items()]
    sums = [long_total(F.col(name)).alias(name) for name in SUMMED]
    return rows.groupBy(*keys).agg(F.count("*").alias("captures"), F.count("*").alias("complete"), *flags, *sums)


def counters_long(rows: DataFrame) -> DataFrame:
    wide = structural_counters(rows)
    pairs = [F.struct(F.lit(name).alias("counter"), F.col(name).cast("bigint").alias("n")) for name in wide.columns]
    return wide.select(F.inline(F.array(*pairs)))


def dimensions() -> dict[str, Column]:
    """The eleven dimensions with one value per row; modalities have several."""
    as_text = lambda name: F.lower(F.col(name).cast("string"))
    return {
        "endpoint": F.col("endpoint"),
        "model": F.col("model"),
        "status": F.col("status").cast("string"),
        "status_class": F.col("status_class"),
        "streaming": as_text("streaming"),
        "route_target": F.col("route_target"),
        "fallback_reason": F.col("fallback_reason"),
        "structured_output": as_text("structured_output"),
        "reasoning_effort": F.col("reasoning_effort"),
        "outcome": F.col("outcome"),
        "hour_utc": F.lpad(F.hour("started_at").cast("string"), 2, "0"),
    }


def distributions(rows: DataFrame) -> DataFrame:
    """Value counts of twelve dimensions as (dim, value, n); tasks fold the unfolded values before the shuffle."""
    single = [F.struct(F.lit(name).alias("dim"), value.alias("value")) for name, value in dimensions().items()]
    several = F.transform("modalities", lambda m: F.struct(F.lit("modalities").alias("dim"), m.alias("value")))
    return (
        rows.select(F.inline(F.concat(F.array(*single), several)))
        .groupBy("dim", "value")
        .agg(F.count("*").alias("n"))
    )


def series_buckets(rows: DataFrame, names: Sequence[str] = SERIES, keys: Sequence[str] = ()) -> DataFrame:
    """Accumulator in long form: one row per (series, power-of-two bucket) with mergeable sums."""
    pairs = [F.struct(F.lit(name).alias("series"), F.col(name).cast("bigint").alias("value")) for name in names]
    values = rows.select(*keys, F.inline(F.array(*pairs))).where(F.col("value") >= 0)
    return merge_buckets(
        values.select(
            *keys,
            "series",
            sf.power_of_two_bucket("value").alias("bucket"),
            F.lit(1).cast("bigint").alias("freq"),
            F.col("value").cast("decimal(38,0)").alias("sum"),
            (F.col("value").cast("decimal(19,0)") * F.col("value").cast("decimal(19,0)")).alias("sum_squares"),
            F.col("value").alias("min"),
            F.col("value").alias("max"),
        ),
        keys,
    )


def merge_buckets(buckets: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Merge accumulators in long form; the union of two is folded the same way as raw rows."""
    return buckets.groupBy(*keys, "series", "bucket").agg(
        F.sum("freq").alias("freq"),
        F.sum("sum").cast("decimal(38,0)").alias("sum"),
        F.sum("sum_squares").cast("decimal(38,0)").alias("sum_squares"),
        F.min("min").alias("min"),
        F.max("max").alias("max"),
    )


def series_accumulators(buckets: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """One row per series with the histogram as a map (at most 65 buckets)."""
    entries = F.array_sort(F.collect_list(F.struct("bucket", "freq")))
    return buckets.groupBy(*keys, "series").agg(
        F.sum("freq").cast("bigint").alias("count"),
        F.sum("sum").cast("decimal(38,0)").alias("sum"),
        F.sum("sum_squares").cast("decimal(38,0)").alias("sum_squares"),
        F.min("min").alias("min"),
        F.max("max").alias("max"),
        F.map_from_entries(entries).alias("histogram"),
    )


def merge_accumulators(left: DataFrame, right: DataFrame) -> DataFrame:
    """Merge two tables of finished accumulators on the series name."""
    add = lambda name: (F.coalesce(F.col("l." + name), F.lit(0)) + F.coalesce(F.col("r." + name), F.lit(0)))
    empty = F.create_map().cast("map<bigint,bigint>")
    histogram = F.map_zip_with(
        F.coalesce("l.histogram", empty),
        F.coalesce("r.histogram", empty),
        lambda _, a, b: F.coalesce(a, F.lit(0).cast("bigint")) + F.coalesce(b, F.lit(0).cast("bigint")),
    )
    joined = left.alias("l").join(right.alias("r"), F.col("l.series") == F.col("r.series"), "full")
    return joined.select(
        F.coalesce("l.series", "r.series").alias("series"),
        add("count").cast("bigint").alias("count"),
        add("sum").cast("decimal(38,0)").alias("sum"),
        add("sum_squares").cast("decimal(38,0)").alias("sum_squares"),
        F.least("l.min", "r.min").alias("min"),
        F.greatest("l.max", "r.max").alias("max"),
        F.map_from_entries(F.array_sort(F.map_entries(histogram))).alias("histogram"),
    )


def finish_series(accumulators: DataFrame) -> DataFrame:
    """Half-up mean in thousandths, variance, and quantiles as upper bucket bounds."""
    n = F.col("count").cast("decimal(38,0)")
    mean = F.call_function("div", F.col("sum") * 1000 + F.call_function("div", n, F.lit(2)), n)
    spread = F.call_function("div", F.col("sum_squares").cast("decimal(38,0)") * F.lit(1_000_000), n)
    with_mean = accumulators.where(F.col("count") > 0).withColumn("mean_milli", mean)
    entries = F.map_entries("histogram")
    seen = lambda key: F.aggregate(
        F.filter(entries, lambda e: e["key"] <= key), F.lit(0).cast("bigint"), lambda total, e: total + e["value"]
    )

    def quantile(percent: int) -> Column:
        target = F.call_function("div", F.col("count") * percent + 99, F.lit(100))
        reached = F.filter(F.array_sort(F.map_keys("histogram")), lambda key: seen(key) >= target)
        return F.element_at(reached, 1)

    return with_mean.withColumn(
        "variance_milli2",
        F.greatest(F.lit(0).cast("decimal(38,0)"), spread - F.col("mean_milli").cast("decimal(19,0)") * F.col("mean_milli").cast("decimal(19,0)")),
    ).select("*", *[quantile(percent).alias(name) for name, percent in PERCENTS.items()])


def histogram_text(column: str = "histogram") -> Column:
    """The histogram as `bucket:count` pairs in bucket order."""
    pairs = F.array_sort(F.map_entries(column))
    return F.array_join(F.transform(pairs, lambda e: F.concat_ws(":", e["key"].cast("string"), e["value"].cast("string"))), ",")


def duplicate_counts(rows: DataFrame, keys: Sequence[str] = (), content: str = "content_sha256", approximate: bool = False) -> DataFrame:
    """Distinct contents and duplicates; exact unless the approximate option is asked for."""
    distinct = F.approx_count_distinct(content) if approximate else F.count_distinct(F.col(content))
    counted = rows.groupBy(*keys).agg(F.count(content).alias("contents"), distinct.alias("unique_contents"))
    return counted.withColumn("duplicates", F.col("contents") - F.col("unique_contents"))


def group_counts(rows: DataFrame) -> DataFrame:
    """Number of source groups, in all and by kind."""
    groups = rows.select("source_group_kind", "source_group_sha256").distinct()
    return groups.agg(
        F.count("*").alias("source_groups"),
        F.count_if(F.col("source_group_kind") == "trajectory").alias("trajectory_groups"),
        F.count_if(F.col("source_group_kind") == "request").alias("untagged_request_groups"),
    )


def max_concurrency(rows: DataFrame, start: str = "started_at", end: str = "completed_at") -> DataFrame:
    """Largest number of calls open at once; at equal times ends count before starts.

    Changes are folded per instant, summed inside seconds, then seconds inside hours, then over the hours.
    """
    at = lambda name: F.unix_micros(F.col(name).cast("timestamp"))
    changes = F.array(
        F.struct(at(start).alias("at"), F.lit(1).alias("change")),
        F.struct(at(end).alias("at"), F.lit(-1).alias("change")),
    )
    instants = rows.select(F.inline(changes)).where("at IS NOT NULL").groupBy("at").agg(F.sum("change").alias("change"))
    return peak_of_seconds(second_peaks(instants.withColumn("second", second_of(F.col("at")))))


def second_of(micros: Column) -> Column:
    """The whole second of a number of microseconds, downwards before 1970 too."""
    return F.call_function("div", micros - F.pmod(micros, F.lit(1_000_000)), F.lit(1_000_000))


def second_peaks(instants: DataFrame) -> DataFrame:
    """(second, change, peak) of changes per instant (second, at, change).

    Within one instant the running value after all its changes is the highest that counts. Times are whole microseconds, so a
    second has at most a million instants.
    """
    inside = Window.partitionBy("second").orderBy("at")
    return instants.withColumn("open", F.sum("change").over(inside)).groupBy("second").agg(F.sum("change").alias("change"), F.max("open").alias("peak"))


def peak_of_seconds(seconds: DataFrame) -> DataFrame:
    """The highest running value over all seconds, 0 without any."""
    earlier = Window.unboundedPreceding
    inside = Window.partitionBy("hour").orderBy("second").rowsBetween(earlier, -1)
    hours = (
        seconds.withColumn("hour", F.call_function("div", F.col("second") - F.pmod("second", F.lit(3600)), F.lit(3600)))
        .withColumn("before", F.coalesce(F.sum("change").over(inside), F.lit(0)))
        .groupBy("hour")
        .agg(F.sum("change").alias("change"), F.max(F.col("before") + F.col("peak")).alias("peak"))
    )
    # One row per hour is left, so this last window stays small whatever the traffic.
    before_hour = F.coalesce(F.sum("change").over(Window.orderBy("hour").rowsBetween(earlier, -1)), F.lit(0))
    return hours.select((before_hour + F.col("peak")).alias("peak")).agg(
        F.greatest(F.coalesce(F.max("peak"), F.lit(0)), F.lit(0)).cast("bigint").alias("max_concurrency")
    )


def rates(counted: DataFrame, successes: str, total: str, name: str) -> DataFrame:
    """Rate in basis points with its 95 % Wilson interval."""
    return counted.select(
        "*",
        sf.rate_bps(successes, total).alias(f"{name}_bps"),
        sf.wilson_lower_bps(successes, total).alias(f"{name}_wilson_low_bps"),
        sf.wilson_upper_bps(successes, total).alias(f"{name}_wilson_high_bps"),
    )


def label_counts(labels: DataFrame, dims: Sequence[str], listed: Sequence[str] = ()) -> DataFrame:
    """Counts per label dimension and value, with `classified` and `abstained` totals, in one pass."""
    single = [F.struct(F.lit(name).alias("dim"), F.col(name).alias("value")) for name in dims]
    totals = [
        F.struct(F.lit("classified").alias("dim"), F.lit("all").alias("value")),
        F.struct(F.when(F.col("abstain"), "abstained").alias("dim"), F.lit("all").alias("value")),
    ]
    parts = [F.array(*single, *totals)]
    parts += [_listed_values(source) for source in listed]
    return labels.select(F.inline(F.concat(*parts))).where("dim IS NOT NULL").groupBy("dim", "value").agg(F.count("*").alias("n"))


def _listed_values(name: str) -> Column:
    return F.transform(name, lambda value: F.struct(F.lit(name).alias("dim"), value.alias("value")))


def label_counts_delta(current: DataFrame, previous: DataFrame) -> DataFrame:
    """Cumulative counts next to the non-zero change against the previous checkpoint."""
    joined = current.alias("c").join(previous.alias("p"), ["dim", "value"], "full")
    now, then = F.coalesce("c.n", F.lit(0)), F.coalesce("p.n", F.lit(0))
    return joined.select("dim", "value", now.alias("n"), F.when(now != then, now - then).alias("delta"))


def readiness(facts: DataFrame, minimum_captures: int, minimum_unique: int, minimum_parse: int, maximum_abstain: int) -> DataFrame:
    """Five named checks on a one-row table of facts; ready only if all hold."""
    checks = {
        "minimum_complete_captures": F.col("captures") >= minimum_captures,
        "parse_wilson_lower": F.col("parse_wilson_low_bps") >= minimum_parse,
        "abstain_wilson_upper": F.col("abstain_wilson_high_bps") <= maximum_abstain,
        "minimum_unique_sources": F.col("sources") >= minimum_unique,
        "split_quotas": F.col("quotas_filled"),
    }
    everything = None
    for test in checks.values():
        everything = test if everything is None else everything & test
    return facts.select(*[test.alias(name) for name, test in checks.items()], everything.alias("ready"))


def split_counts(rows: DataFrame, split: str = "split") -> DataFrame:
    """Row count of each of the four splits, zeros included, and whether every split has rows."""
    names = F.array(*[F.lit(name) for name in sf.SPLITS])
    counted = rows.groupBy(F.col(split).alias("split")).agg(F.count("*").alias("n"))
    found = counted.agg(F.map_from_entries(F.collect_list(F.struct("split", "n"))).alias("found"))
    return found.select("found", F.explode(names).alias("split")).select(
        "split",
        F.coalesce(F.col("found")[F.col("split")], F.lit(0)).alias("n"),
        F.forall(names, lambda name: F.coalesce(F.element_at("found", name), F.lit(0)) > 0).alias("training_ready"),
    )


def checkpoint_facts(rows: DataFrame, eligible: Column) -> DataFrame:
    """Facts of a checkpoint: exchanges, groups, tool-bearing and text-eligible rows, latest completion and highest key.

    Rows are folded per source group first, with numbers only, so that it stays a hash aggregate; the group counts
    then need no second pass. The highest key is a scalar of its own.
    """
    highest = rows.agg(F.max("key").alias("key")).scalar()
    tools = (F.col("tool_definitions") > 0) | (F.col("tool_calls") > 0)
    groups = rows.groupBy("source_group_kind", "source_group_sha256").agg(
        F.count("*").alias("n"),
        F.count_if(tools).alias("tools"),
        F.count_if(eligible).alias("eligible"),
        F.max("completed_at").alias("completed_at"),
    )
    return groups.agg(
        long_total(F.col("n")).alias("exchanges"),
        F.count("*").alias("source_groups"),
        F.count_if(F.col("source_group_kind") == "trajectory").alias("trajectory_groups"),
        F.count_if(F.col("source_group_kind") == "request").alias("request_groups"),
        long_total(F.col("tools")).alias("tool_bearing_exchanges"),
        long_total(F.col("eligible")).alias("text_eval_eligible_exchanges"),
        F.max("completed_at").alias("created_at"),
    ).withColumn("high_water_key", highest)


def top_values(rows: DataFrame, column: str, top: int = 5) -> DataFrame:
    """Ranked value counts, ties by name; values after the top are flagged as the remainder."""
    counted = rows.groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n"))
    leading = counted.orderBy(F.desc("n"), "value").limit(top)
    ranked = leading.withColumn("place", F.row_number().over(Window.orderBy(F.desc("n"), "value")))
    rest = counted.join(F.broadcast(leading.select("value")), "value", "left_anti").agg(
        F.lit("(others)").alias("value"), F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.lit(top + 1).alias("place")
    )
    return ranked.unionByName(rest)
