"""Labels: contract checks, fan-out to duplicates, outcomes and reason counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .sampling import OPERATIONS

# The closed label lists.
DOMAINS = ("general", "software", "math_science", "business", "legal", "finance", "health", "creative", "other")
CAPABILITIES = ("knowledge", "reasoning", "instruction_following", "structured_output", "tool_use", "multimodal")
ORACLES = ("exact", "schema", "executable", "reference", "pairwise_judge", "human")
SENTIMENTS = ("positive", "neutral", "negative", "mixed", "unknown")
OUTCOMES = ("success", "refusal", "partial", "upstream_failure", "malformed", "unknown")
COMPLEXITIES = ("low", "medium", "high", "unknown")
SAFETY = ("benign", "sensitive", "unsafe", "unknown")
CLOSED = {
    "operation": OPERATIONS, "domain": DOMAINS, "oracle": ORACLES, "sentiment": SENTIMENTS, "outcome": OUTCOMES,
    "complexity": COMPLEXITIES, "safety": SAFETY,
}


def label_violations(labels: DataFrame, expected: DataFrame) -> DataFrame:
    """Broken rules of a label set as (row_id, reason): unknown, missing or repeated rows and values out of range."""
    inside = lambda name: F.coalesce(F.col(name).isin(*CLOSED[name]), F.lit(False))
    known = None
    for name in CLOSED:
        known = inside(name) if known is None else known & inside(name)
    listed = F.col("capabilities")
    capable = F.coalesce(
        (F.size(listed) == F.size(F.array_distinct(listed))) & F.forall(listed, lambda c: c.isin(*CAPABILITIES)), F.lit(False)
    )
    ranged = F.coalesce(
        F.length("language").between(1, 32) & F.col("confidence_basis_points").between(0, 10_000), F.lit(False)
    ) & F.col("answerable").isNotNull() & F.col("abstain").isNotNull()
    broken = F.array_compact(
        F.array(F.when(~known, "unknown_taxonomy_value"), F.when(~capable, "invalid_capabilities"), F.when(~ranged, "invalid_values"))
    )
    checked = labels.select("row_id", broken.alias("broken")).groupBy("row_id").agg(
        F.count("*").alias("n"), F.array_distinct(F.flatten(F.collect_set("broken"))).alias("broken")
    )
    wanted = expected.select("row_id").distinct().withColumn("wanted", F.lit(True))
    joined = checked.join(wanted, "row_id", "full")
    reasons = F.array_compact(
        F.array(
            F.when(F.col("n").isNull(), "missing_row"), F.when(F.col("wanted").isNull(), "unknown_row"), F.when(F.col("n") > 1, "duplicate_row")
        )
    )
    everything = F.concat(reasons, F.coalesce("broken", F.array().cast("array<string>")))
    return joined.select("row_id", F.explode(everything).alias("reason"))


def fan_out(rows: DataFrame, labels: DataFrame, key: str, label: str) -> DataFrame:
    """Give every row the label of its content; rows without one are flagged. `labels` has one row per content."""
    return rows.join(labels, key, "left").withColumn("missing", F.col(label).isNull())


def label_references(references: DataFrame, labels: DataFrame) -> DataFrame:
    """Check that every referenced label (label_key, label_sha256, content_sha256) is the stored one."""
    joined = references.alias("r").join(labels.alias("l"), F.col("r.label_key") == F.col("l.label_key"), "left")
    problem = (
        F.when(F.col("l.label_key").isNull(), "missing")
        .when(F.col("r.label_sha256") != F.col("l.label_sha256"), "digest_differs")
        .when(~F.col("r.content_sha256").eqNullSafe(F.col("l.content_sha256")), "content_differs")
    )
    return joined.select(F.col("r.label_key").alias("label_key"), problem.alias("problem"))


def outcome_filter(rows: DataFrame, outcomes: DataFrame, group: str, split: str = "split") -> DataFrame:
    """Train rows stay only with a true outcome; failed and unknown ones are told apart. Other splits are untouched."""
    known = outcomes.groupBy(group).agg(F.max("task_correct").alias("__correct"), F.count("*").alias("__n"))
    joined = rows.join(known, group, "left")
    result = (
        F.when(F.col(split) != "train", "kept")
        .when(F.col("__n") > 1, "duplicate_outcome")
        .when(F.col("__correct"), "kept")
        .when(~F.col("__correct"), "task_failed")
        .otherwise("task_outcome_unknown")
    )
    return joined.withColumn("result", result).drop("__correct", "__n")


def valid_outcome(correct: Column, verdict: Column, exit_code: Column, error: Column) -> Column:
    """A verdict counts only if its checker finished cleanly and agrees; NULL stays unknown."""
    agrees = error.isNull() & exit_code.eqNullSafe(F.lit(0)) & verdict.eqNullSafe(correct)
    return F.when(correct.isNotNull() & agrees, correct)


def reason_counts(rows: DataFrame, reason: str, none: str | None = None) -> DataFrame:
    """Rows per reason; rows without a reason are counted under `none`, or dropped."""
    named = rows.where(F.col(reason).isNotNull()) if none is None else rows
    value = F.coalesce(F.col(reason), F.lit(none)) if none else F.col(reason)
    return named.groupBy(value.alias("reason")).agg(F.count("*").alias("n"))
