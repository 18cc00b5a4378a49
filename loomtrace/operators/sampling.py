"""Deterministic samples and per-group selection."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalar as sf
from ..session import ensure_checkpoint_dir
from .ordered import first_rows, nearest_rank_quantiles

# Closed lists that fix the order of strata.
OPERATIONS = (
    "answer", "summarize", "extract", "classify", "transform", "generate", "code", "plan_or_tool_use", "conversation", "other",
)
TAIL_REASONS = ("long_context", "rare", "error", "tool_use", "multimodal", "low_confidence")
CELL = ("endpoint", "model", "status_class", "modalities")
REPRESENTATIVE_LIMIT, TAIL_LIMIT = 2048, 512
LONG_CONTEXT_FLOOR = 8192
LOW_CONFIDENCE_BPS = 7000


def hash_sample(rows: DataFrame, size: int, salt: str, key: str = "key") -> DataFrame:
    """The rows with the lowest salted key digests. Each task keeps `size` rows; nothing is fully sorted."""
    digest = sf.order_digest(salt, key)
    return rows.withColumn("__digest", digest).orderBy("__digest").limit(size).drop("__digest")


def long_context_threshold(rows: DataFrame) -> DataFrame:
    """95th percentile of request bytes, never under the floor."""
    p95 = nearest_rank_quantiles(rows, [], "request_bytes", {"p95": 95})
    return p95.select(F.greatest(F.lit(LONG_CONTEXT_FLOOR), F.coalesce("p95", F.lit(0))).alias("threshold"))


def tail_sample(rows: DataFrame, representative: int = 256, tail: int = 64) -> DataFrame:
    """Hash sample plus a sample of unusual rows, each with the reasons it was taken for.

    A row is rare when it is alone in its cell of endpoint, model, status class and modalities. All choosing happens on
    narrow rows: every task keeps a bounded number of keys, rare keys come from counts of the cells, and only the
    chosen keys (2560 at most, so they are broadcast) fetch whole rows.
    """
    if not 1 <= representative <= REPRESENTATIVE_LIMIT or not 0 <= tail <= TAIL_LIMIT:
        raise ValueError("sample sizes are out of range")
    ensure_checkpoint_dir(rows.sparkSession)
    # A few values that every later step needs; without the cut each step would scan the rows for them again.
    threshold = long_context_threshold(rows).checkpoint().scalar()
    unusual = F.array_compact(
        F.array(
            F.when(~F.col("success") | ~F.col("parse"), "error"),
            F.when((F.col("tool_definitions") > 0) | (F.col("tool_calls") > 0), "tool_use"),
            F.when(F.exists("modalities", lambda m: ~m.isin("text", "unknown")), "multimodal"),
            F.when(F.col("request_bytes") >= threshold, "long_context"),
        )
    )
    # Counts alone keep this a hash aggregate; the keys of lone cells are looked up afterwards.
    lone_cells = rows.groupBy(*CELL).agg(F.count("*").alias("__n")).where(F.col("__n") == 1)
    alone = rows.join(lone_cells, list(CELL), "left_semi").select("key")
    representatives = hash_sample(rows.select("key"), representative, "representative:").checkpoint()
    reserve = representative + tail
    candidates = (
        hash_sample(rows.where(F.size(unusual) > 0).select("key"), reserve, "tail:")
        .unionByName(hash_sample(alone, reserve, "tail:"))
        .dropDuplicates(["key"])
        .join(F.broadcast(representatives), "key", "left_anti")
    )
    chosen = (
        representatives.withColumn("__chosen", F.lit(True))
        .unionByName(hash_sample(candidates, tail, "tail:").withColumn("__chosen", F.lit(False)))
        .checkpoint()
    )
    rare = alone.join(F.broadcast(chosen.select("key")), "key", "left_semi").withColumn("__rare", F.lit(True))
    flags = chosen.join(F.broadcast(rare), "key", "left")
    none = F.array().cast("array<string>")
    reasons = F.concat(
        F.when(F.col("__chosen"), F.array(F.lit("representative"))).otherwise(none), unusual, F.when(F.col("__rare"), F.array(F.lit("rare"))).otherwise(none)
    )
    return rows.join(F.broadcast(flags), "key").select(*rows.columns, reasons.alias("selection_reasons"))


def one_per_group(rows: DataFrame, ties: Sequence[str] = ("key",)) -> DataFrame:
    """One row per source group: the lowest content of a request group, the latest then lowest of a trajectory.

    Times are compared as text. Spark cuts each group to one row per task before the shuffle.
    """
    latest = F.when(F.col("source_group_kind") == "trajectory", F.col("completed_at"))
    order = [latest.desc_nulls_last(), F.col("content_sha256").asc(), *[F.col(name).asc() for name in ties]]
    return _first(rows, ["source_group_kind", "source_group_sha256"], order)


def dedupe_by_request(rows: DataFrame) -> DataFrame:
    """One source group per identical request."""
    order = [F.col("source_group_sha256").asc(), F.col("content_sha256").asc()]
    return _first(rows, ["request_sha256"], order)


def _first(rows: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    window = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("__place", F.row_number().over(window)).where(F.col("__place") == 1).drop("__place")


def allocation(total: int) -> dict[str, int]:
    """Half of a total for dev, half of the rest for calibration, what is left for sealed; odd rows go first."""
    dev = total - total // 2
    calibration = (total - dev) - (total - dev) // 2
    return {"dev": dev, "calibration": calibration, "sealed": total - dev - calibration}


def quota_column(quotas: dict[str, int], split: str = "split") -> Column:
    pairs = [part for name, quota in quotas.items() for part in (F.lit(name), F.lit(quota))]
    return F.coalesce(F.create_map(*pairs)[F.col(split)], F.lit(0))


def round_robin(rows: DataFrame, quotas: dict[str, int], strata: Sequence[str], stratum: str, digest: str) -> DataFrame:
    """Per split, take turns over the named strata in digest order, then fill up from unnamed ones.

    With one stratum per row this is the order (rank in stratum, stratum). No stratum needs more rows than the quota.
    """
    names = F.array(*[F.lit(name) for name in strata])
    index = F.nullif(F.array_position(names, F.col(stratum)), F.lit(0))
    most = max(quotas.values())
    placed = rows.withColumn("__stratum", F.coalesce(index, F.lit(len(strata) + 1)))
    inside = Window.partitionBy("split", "__stratum").orderBy(digest)
    placed = placed.withColumn("__turn", F.row_number().over(inside)).where(F.col("__turn") <= most)
    unnamed = F.when(F.col("__stratum") > len(strata), 1).otherwise(0)
    whole = Window.partitionBy("split").orderBy(unnamed, "__turn", "__stratum")
    ranked = placed.withColumn("pick", F.row_number().over(whole)).where(F.col("pick") <= quota_column(quotas))
    return ranked.drop("__stratum", "__turn")


def greedy_turns(rows: DataFrame, quotas: dict[str, int], reasons: str, digest: str, row_id: str) -> DataFrame:
    """Per split, take turns over the reasons when a row may have several; a taken row is gone for its other reasons.

    A reason can only ever take one of its first `quota` rows, so each split is cut to
    reasons x quota rows before the turns are played out.
    """
    most = max(max(quotas.values()), 1)
    exploded = rows.select("split", row_id, digest, F.explode(reasons).alias("__reason"))
    window = Window.partitionBy("split", "__reason").orderBy(digest)
    near = exploded.withColumn("__n", F.row_number().over(window)).where(F.col("__n") <= most)
    slim = near.groupBy("split", row_id, digest).agg(F.collect_set("__reason").alias("__reasons"))
    order = list(TAIL_REASONS)

    def play(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        quota = quotas.get(key[0], 0)
        frame = frame.sort_values(digest)
        waiting = dict(zip(frame[row_id], frame["__reasons"]))
        taken: list = []
        moved = True
        while moved and len(taken) < quota:
            moved = False
            for reason in order:
                row = next((r for r, has in waiting.items() if reason in has), None)
                if row is None or len(taken) == quota:
                    continue
                taken.append(row)
                del waiting[row]
                moved = True
        return pd.DataFrame({"split": key[0], row_id: taken, "pick": range(1, len(taken) + 1)})

    id_type = dict(rows.dtypes)[row_id]
    picks = slim.groupBy("split").applyInPandas(play, f"split string, {row_id} {id_type}, pick int")
    return rows.join(picks, ["split", row_id])


def tail_reasons(selection_reasons: str = "selection_reasons", confidence: str = "confidence_basis_points") -> Column:
    """The tail reasons of a row in its own order, with low confidence at the end."""
    known = F.filter(selection_reasons, lambda reason: reason.isin(*TAIL_REASONS))
    low = F.when(F.col(confidence) < LOW_CONFIDENCE_BPS, F.array(F.lit("low_confidence"))).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.concat(known, low))


def quota_select(sources: DataFrame, total: int) -> tuple[DataFrame, DataFrame]:
    """Exactly allocated sources per split in hash order, and the splits that cannot fill their share."""
    quotas = allocation(total)
    digest = sf.order_digest("generation-selection:", "source_group_sha256", "content_sha256")
    window = Window.partitionBy("split").orderBy("__digest")
    # The quota itself is a literal, so the cut happens before the shuffle as well.
    ranked = sources.withColumn("__digest", digest).withColumn("__n", F.row_number().over(window)).where(F.col("__n") <= max(quotas.values()))
    chosen = ranked.where(F.col("__n") <= quota_column(quotas)).drop("__n", "__digest")
    wanted = F.array(*[F.struct(F.lit(name).alias("split"), F.lit(quota).alias("required")) for name, quota in quotas.items()])
    found = chosen.groupBy("split").agg(F.count("*").alias("n"))
    counts = found.agg(F.map_from_entries(F.collect_list(F.struct("split", "n"))).alias("found"))
    shortfall = counts.select("found", F.inline(wanted)).select(
        "split", "required", F.coalesce(F.col("found")[F.col("split")], F.lit(0)).alias("available")
    )
    return chosen, shortfall.where(F.col("available") < F.col("required"))


def first_k_per_group(
    rows: DataFrame,
    group: str,
    order: Sequence[str],
    k: int,
    excluded: Column,
    unsupported: Column,
) -> DataFrame:
    """Mark every row with why it was left out (`reason`, NULL = selected).

    `excluded` names a reason that comes before the cap, `unsupported` one that comes after. Only supported rows use
    up the cap, so the cap of a group is the position of its k-th supported row.
    """
    marked = rows.withColumn("__excluded", excluded).withColumn("__unsupported", unsupported)
    supported = marked.where(F.col("__excluded").isNull() & F.col("__unsupported").isNull()).select(group, *order)
    position = F.struct(*[F.col(name) for name in order])
    last = first_rows(supported, [group], [F.col(name) for name in order], k, rank="__n", salt_by=order)
    caps = last.where(F.col("__n") == k).select(group, position.alias("__cap"))
    reason = (
        F.when(F.col("__excluded").isNotNull(), F.col("__excluded"))
        .when(position > F.col("__cap"), "per_group_limit")
        .otherwise(F.col("__unsupported"))
    )
    return marked.join(caps, group, "left").select(*rows.columns, reason.alias("reason"))


def exclude_held_out(rows: DataFrame, held_out: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Drop rows that share any of the given hashes with a held-out row: one anti join per hash, never one OR join."""
    for name in columns:
        rows = rows.join(held_out.select(name).distinct(), name, "left_anti")
    return rows


def train_selection(rows: DataFrame, held_out: DataFrame, size: int, hashes: Sequence[str], eligible: Column | None = None) -> DataFrame:
    """Eligible train rows, held-out texts excluded, one row per group, lowest kind-salted digests first.

    `eligible` says which rows may be trained on, for exchanges `features.eligible_for_training`; a NULL means no.
    """
    wanted = F.col("split") == "train"
    if eligible is not None:
        wanted = wanted & F.coalesce(eligible, F.lit(False))
    kept = exclude_held_out(rows.where(wanted), held_out, hashes)
    single = one_per_group(kept)
    salt = F.when(F.col("source_group_kind") == "request", "train.request.v1:").otherwise("train.trajectory.v1:")
    digest = sf.sha256_text(F.concat(salt, "source_group_sha256", "content_sha256"))
    return single.withColumn("__digest", digest).orderBy("__digest").limit(size).drop("__digest")


def split_leakage(rows: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Values of the named identity columns that occur in train and in a held-out split."""
    pairs = [F.struct(F.lit(name).alias("identity"), F.col(column).alias("value")) for name, column in columns.items()]
    return (
        rows.select("split", F.inline(F.array(*pairs)))
        .groupBy("identity", "value")
        .agg(
            F.max(F.when(F.col("split") == "train", 1).otherwise(0)).alias("in_train"),
            F.max(F.when(F.col("split") != "train", 1).otherwise(0)).alias("held_out"),
            F.count("*").alias("n"),
        )
        .where((F.col("in_train") == 1) & (F.col("held_out") == 1))
        .select("identity", "value", "n")
    )
