"""The evaluation plan: which held-out rows become cases, in which order."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalar as sf
from ..operators import evaldata, sampling

POLICY = "eval-plan.v1"
MOST_CASES = 1024


def held_out_sources(labels: DataFrame) -> DataFrame:
    """One row per held-out source group, then one group per identical request."""
    held = labels.where(F.col("split") != "train")
    usable = F.when(F.col("oracle").isin("exact", "reference", "schema"), F.col("oracle")).otherwise("reference")
    return sampling.dedupe_by_request(sampling.one_per_group(held.withColumn("oracle", usable)))


def choose(labels: DataFrame, representative: int, tail: int) -> DataFrame:
    """Representatives by turns over operations, then unusual rows by turns over their reasons."""
    sources = held_out_sources(labels).withColumn("tail_reasons", sampling.tail_reasons())
    digest = lambda kind: sf.sha256_text(
        F.concat(F.lit(kind + ":"), F.col("split"), F.lit(":"), F.col("source_group_sha256"), F.col("content_sha256"))
    )
    ready = sources.where(F.array_contains("selection_reasons", "representative")).withColumn("pick_sha256", digest("representative"))
    first = sampling.round_robin(
        ready, sampling.allocation(representative), sampling.OPERATIONS, "operation", "pick_sha256"
    ).withColumn("selection", F.lit("representative")).withColumn("tail_reason", F.lit(None).cast("string"))
    # At most `representative` rows, so the exclusion side is broadcast.
    rest = sources.join(F.broadcast(first.select("source_group_sha256")), "source_group_sha256", "left_anti")
    unusual = rest.where(F.size("tail_reasons") > 0).withColumn("pick_sha256", digest("tail"))
    second = sampling.greedy_turns(
        unusual, sampling.allocation(tail), "tail_reasons", "pick_sha256", "source_group_sha256"
    ).withColumn("selection", F.lit("tail")).withColumn("tail_reason", F.element_at("tail_reasons", 1))
    return first.unionByName(second)


def plan_cases(labels: DataFrame, representative: int, tail: int) -> DataFrame:
    """The chosen rows in their final order with their case ids."""
    if not 1 <= representative <= MOST_CASES or not 0 <= tail <= MOST_CASES:
        raise ValueError("case counts are out of range")
    chosen = choose(labels, representative, tail)
    rank = sf.split_rank("split") * 2 + F.when(F.col("selection") == "tail", 1).otherwise(0)
    order = sf.order_digest("", "source_group_sha256", "content_sha256")
    # The policy bounds the rows here (2048 at most), so one window over all of them is small.
    numbered = chosen.withColumn("order", F.row_number().over(Window.orderBy(rank, order)) - 1)
    identity = F.concat_ws("\0", F.lit(POLICY), "split", "selection", "source_group_sha256", "content_sha256")
    return numbered.withColumn("case_id", sf.sha256_text(identity))


def shortfall(cases: DataFrame, representative: int, tail: int) -> DataFrame:
    quotas = {"representative": sampling.allocation(representative), "tail": sampling.allocation(tail)}
    return evaldata.short_quotas(cases, quotas)
