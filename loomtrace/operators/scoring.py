"""Scores of answers, metrics of runs, and ranking."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalar as sf
from ..functions.editdistance import token_distance
from ..functions.jsonrules import schema_match
from .ordered import nearest_rank_quantiles

# Order of metrics that decides between runs.
SCORE_ORDER = (("mean_score_bps", "desc"), ("errors", "asc"), ("p95_latency_ms", "asc"), ("tokens_per_second", "desc"))


def token_similarity_bps(left: Column, right: Column) -> Column:
    """One minus token edit distance over the longer length, in truncated basis points, for lists of any length."""
    longest = F.greatest(F.size(left), F.size(right), F.lit(1))
    return F.floor(F.greatest(F.lit(0.0), F.lit(1.0) - token_distance(left, right).cast("double") / longest.cast("double")) * 10_000)


def score_cases(
    rows: DataFrame, oracle: str = "oracle", expected: str = "expected", candidate: str = "candidate", parts: int | None = None
) -> DataFrame:
    """Score every answer: exact text, token similarity or JSON schema.

    Only rows of the schema and reference kinds carry text into the Python worker. Edit distance is heavy for its bytes: `parts`
    spreads rows by number where partitions cut by size would be too few.
    """
    rows = rows if parts is None else rows.repartition(parts)
    kind, want, got = F.col(oracle), F.col(expected), F.col(candidate)
    tokens = rows.withColumn("__left", F.when(kind == "reference", sf.unicode_tokens(want))).withColumn(
        "__right", F.when(kind == "reference", sf.unicode_tokens(got))
    )
    fits = schema_match(F.when(kind == "schema", want), F.when(kind == "schema", got))
    score = (
        F.when(want.isNull() & (kind != "schema"), F.lit(0).cast("bigint"))
        .when(kind == "exact", F.when(sf.strip(want) == sf.strip(got), 10_000).otherwise(0))
        .when(kind == "reference", token_similarity_bps(F.col("__left"), F.col("__right")))
        .when(kind == "schema", F.when(F.coalesce(fits, F.lit(False)), 10_000).otherwise(0))
    )
    scored = tokens.withColumn("score_bps", score.cast("bigint"))
    problem = F.when(F.col("score_bps").isNull(), "unknown_oracle")
    return scored.withColumn("score_problem", problem).drop("__left", "__right")


def eval_metrics(results: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Floor mean of the scored cases, unscored cases as errors, nearest-rank p95, totals and tokens per second of every run."""
    totals = results.groupBy(*keys).agg(
        F.count("*").alias("case_count"),
        F.call_function("div", F.sum("score_bps"), F.count("score_bps")).alias("mean_score_bps"),
        F.count_if(F.col("score_bps").isNull()).cast("int").alias("errors"),
        F.sum("latency_ms").alias("total_latency_ms"),
        F.sum("output_tokens").alias("output_tokens"),
    )
    p95 = nearest_rank_quantiles(results, keys, "latency_ms", {"p95_latency_ms": 95})
    speed = F.round(F.col("output_tokens") * 1000 / F.col("total_latency_ms"), 3)
    return totals.join(p95, list(keys)).withColumn("tokens_per_second", F.when(F.col("total_latency_ms") > 0, speed))


def rank_runs(runs: DataFrame, branch: str, tie_break: Sequence[str], within: Sequence[str] = ()) -> DataFrame:
    """Runs in policy order (one row per run), and whether all of them saw the same cases."""
    named = F.array(*[F.lit(name) for name in tie_break])
    order = [F.desc(metric) if way == "desc" else F.asc(metric) for metric, way in SCORE_ORDER]
    place = F.nullif(F.array_position(named, F.col(branch)), F.lit(0))
    window = Window.partitionBy(*within).orderBy(*order, place.asc_nulls_last())
    cases = Window.partitionBy(*within)
    return runs.withColumn("place", F.row_number().over(window)).withColumn(
        "same_cases", F.min("case_count").over(cases) == F.max("case_count").over(cases)
    )


def winner(runs: DataFrame, branch: str, tie_break: Sequence[str], within: Sequence[str] = ()) -> DataFrame:
    return rank_runs(runs, branch, tie_break, within).where(F.col("place") == 1).drop("place")


def best_under_targets(runs: DataFrame, name: str, minimum_rate: float, maximum_p95: float) -> DataFrame:
    """The fastest run among those that meet both targets with every answer correct; NULL when none does."""
    met = F.col("all_correct") & (F.col("rate") >= minimum_rate) & (F.col("p95") <= maximum_p95)
    return runs.agg(
        F.max_by(F.when(met, F.col(name)), F.when(met, F.struct("rate", name))).alias("selected"),
        F.count_if(met).alias("eligible"),
    )


def apportion_latency(rows: DataFrame, batch: str, elapsed: str, order: str) -> DataFrame:
    """Share the time of a batch among its rows; the first rows take the remainder. Batches are small by design."""
    batch_rows = Window.partitionBy(batch)
    count = F.count("*").over(batch_rows)
    total = F.greatest(count, F.ceil(F.col(elapsed)).cast("bigint"))
    place = F.row_number().over(batch_rows.orderBy(order)) - 1
    share = F.call_function("div", total, count) + F.when(place < total % count, 1).otherwise(0)
    return rows.withColumn("latency_ms", share)


def load_test_summary(requests: DataFrame, keys: Sequence[str], hourly_rate: float | None = None) -> DataFrame:
    """Aggregate of a load test per profile.

    Expects latency_ms, ttft_ms, output_tokens, ok, correct (NULL = not checked), started_at and completed_at.
    """
    good = F.col("ok")
    wall = (F.unix_micros(F.max("completed_at")) - F.unix_micros(F.min("started_at"))) / 1_000_000
    totals = requests.groupBy(*keys).agg(
        F.count_if(good).alias("succeeded"),
        F.count_if(~good).alias("failed"),
        F.when(F.count("correct") > 0, F.count_if(good & F.col("correct"))).alias("correct"),
        F.sum("latency_ms").alias("total_elapsed_ms"),
        F.round(F.greatest(wall, F.lit(0.000001)), 6).alias("elapsed_wall_seconds"),
        F.coalesce(F.sum(F.when(good, F.col("output_tokens"))), F.lit(0)).alias("output_tokens"),
    )
    latency = nearest_rank_quantiles(requests, keys, "latency_ms", {"latency_ms_p50": 50, "latency_ms_p95": 95})
    first = nearest_rank_quantiles(requests.where(good), keys, "ttft_ms", {"ttft_ms_p50": 50, "ttft_ms_p95": 95})
    joined = totals.join(latency, list(keys), "left").join(first, list(keys), "left")
    seconds, wall_seconds = F.col("total_elapsed_ms") / 1000, F.col("elapsed_wall_seconds")
    out = joined.select(
        "*",
        F.when(seconds > 0, F.round(F.col("output_tokens") / seconds, 3)).alias("tokens_per_request_second"),
        F.round(F.col("output_tokens") / wall_seconds, 3).alias("tokens_per_wall_second"),
        F.round(F.col("succeeded") / wall_seconds, 3).alias("completed_per_second"),
    )
    if hourly_rate is not None:
        out = out.withColumn("estimated_cost", F.round(F.lit(hourly_rate) * wall_seconds / 3600, 6))
    return out


def percent_change(before: Column, after: Column, matched: Column) -> Column:
    """Change in percent for matched runs; NULL when unmatched, unknown or without a positive base."""
    return F.when(matched & (before > 0) & (after >= 0), F.round((after / before - 1) * 100, 3))


def usage_coverage(replies: DataFrame, keys: Sequence[str], fields: Sequence[str]) -> DataFrame:
    """Per field: how many replies report it, and the total only if all of them do."""
    parts = []
    for name in fields:
        known = F.when(F.col(name) >= 0, F.col(name))
        parts += [
            F.count(known).alias(f"{name}_replies"),
            F.when((F.count(known) == F.count("*")) & (F.count("*") > 0), F.sum(known)).alias(name),
        ]
    return replies.groupBy(*keys).agg(F.count("*").alias("replies"), *parts)


def reward_advantage(rollouts: DataFrame, prompt: str, reward: str = "reward_bps") -> DataFrame:
    """Centred reward over the population deviation of its prompt; NULL with a reason when all rewards are equal.

    Group sums come from an aggregate and are joined back, so a prompt with very many rollouts stays spread out.
    """
    value = F.col(reward).cast("decimal(19,0)")
    groups = rollouts.groupBy(prompt).agg(
        F.count("*").alias("rollout_count"), F.sum(F.col(reward).cast("decimal(19,0)")).alias("__sum"), F.sum((value * value).cast("decimal(28,0)")).alias("__squares")
    )
    n = F.col("rollout_count")
    # Products of whole numbers stay exact in decimals; bigint would overflow for a prompt with very many rollouts.
    wide = lambda column: column.cast("decimal(38,0)")
    spread = (wide(n) * wide(F.col("__squares")) - wide(F.col("__sum")) * wide(F.col("__sum"))).cast("double")
    deviation = F.sqrt(spread) / n.cast("double")
    mean = F.col("__sum").cast("double") / n.cast("double")
    joined = rollouts.join(groups, prompt)
    flat = spread == 0
    return joined.select(
        *rollouts.columns,
        "rollout_count",
        F.round(mean, 3).alias("reward_mean_bps"),
        F.round(deviation, 3).alias("reward_std_bps"),
        F.when(~flat, F.round((F.col(reward).cast("double") - mean) / deviation, 6)).alias("advantage"),
        F.when(flat, "zero_reward_variance").alias("skip_reason"),
    )


def token_weighted_loss(batches: DataFrame, loss: str = "loss", tokens: str = "target_tokens") -> DataFrame:
    """Mean loss weighted by target tokens; NULL without any token."""
    total = F.sum(tokens)
    return batches.agg(
        F.count("*").alias("examples"),
        F.coalesce(total, F.lit(0)).alias("target_tokens"),
        F.when(total > 0, F.sum(F.col(loss) * F.col(tokens)) / total).alias("mean_target_loss"),
    )


def reconcile_results(cases: DataFrame, results: DataFrame, max_tokens: int) -> DataFrame:
    """First difference between every case and its result row, NULL when they agree.

    Cases carry `score_bps` as scored again from the case. Both sides are matched on (split, order).
    """
    c, r = cases.alias("c"), results.alias("r")
    joined = c.join(r, (F.col("c.split") == F.col("r.split")) & (F.col("c.order") == F.col("r.order")), "full")
    reason = (
        F.when(F.col("r.order").isNull(), "missing_result")
        .when(F.col("c.order").isNull(), "missing_case")
        .when(~F.col("c.case_id").eqNullSafe(F.col("r.case_id")), "case_differs")
        .when(~F.coalesce(F.col("r.score_bps").between(0, 10_000), F.lit(False)), "score_out_of_range")
        .when(~F.col("c.score_bps").eqNullSafe(F.col("r.score_bps")), "score_differs")
        .when(~F.coalesce(F.col("r.latency_ms") >= 1, F.lit(False)), "latency_invalid")
        .when(~F.coalesce(F.col("r.output_tokens").between(0, max_tokens), F.lit(False)), "tokens_invalid")
    )
    return joined.select(F.coalesce("c.split", "r.split").alias("split"), F.coalesce("c.order", "r.order").alias("order"), reason.alias("reason"))


def setting_differences(baseline: DataFrame, candidate: DataFrame, ignored: Sequence[str] = ()) -> DataFrame:
    """Settings (run, settings map) that differ between two runs, NULL-safe, as (run, setting, before, after)."""
    entries = lambda frame: frame.select("run", F.explode("settings").alias("setting", "value")).where(~F.col("setting").isin(*ignored))
    a, b = entries(baseline), entries(candidate)
    joined = a.withColumnRenamed("value", "before").join(b.withColumnRenamed("value", "after"), ["run", "setting"], "full")
    return joined.where(~F.col("before").eqNullSafe(F.col("after"))).select("run", "setting", "before", "after")


def parent_comparison(parent: DataFrame, child: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Child against parent on the same cases: score delta and which one is kept. The child must be strictly better."""
    p = parent.select(*keys, F.col("case_count").alias("parent_cases"), F.col("mean_score_bps").alias("parent_mean_score_bps"))
    c = child.select(*keys, F.col("case_count").alias("child_cases"), F.col("mean_score_bps").alias("child_mean_score_bps"))
    delta = F.col("child_mean_score_bps") - F.col("parent_mean_score_bps")
    return p.join(c, list(keys)).select(
        *keys,
        (F.col("parent_cases") == F.col("child_cases")).alias("comparable"),
        "parent_mean_score_bps",
        "child_mean_score_bps",
        delta.alias("delta_mean_score_bps"),
        F.when(delta > 0, "child").otherwise("parent").alias("selected"),
    )


def preference_tally(judged: DataFrame, pair_digest: str, verdict: str, keys: Sequence[str] = ()) -> DataFrame:
    """Preferences per side. The first two hex digits of the pair digest say which side was shown as A."""
    even = sf.hex_prefix_number(pair_digest, 2) % 2 == 0
    side = (
        F.when(~F.col(verdict).isin("A", "B"), F.col(verdict))
        .when((F.col(verdict) == "A") == even, "baseline")
        .otherwise("candidate")
    )
    return judged.groupBy(*keys, side.alias("preference")).agg(F.count("*").alias("n"))


def outcome_matrix(baseline: DataFrame, candidate: DataFrame, task: str, correct: str = "task_correct") -> DataFrame:
    """Both, neither, one side only or unknown, counted over the tasks of two runs."""
    a = baseline.select(task, F.col(correct).alias("before"))
    b = candidate.select(task, F.col(correct).alias("after"))
    cell = (
        F.when(F.col("before").isNull() | F.col("after").isNull(), "unknown")
        .when(F.col("before") & F.col("after"), "both_passed")
        .when(F.col("before"), "baseline_passed_only")
        .when(F.col("after"), "candidate_passed_only")
        .otherwise("neither_passed")
    )
    return a.join(b, task, "full").groupBy(cell.alias("outcome")).agg(F.count("*").alias("n"))
