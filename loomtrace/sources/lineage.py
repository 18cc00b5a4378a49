"""Lineage: walk parent pointers of checkpoints and look at the rows they list."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ordered import running_sum, with_neighbour
from ..session import ensure_checkpoint_dir

#: Depths per piece of a running total.
PIECE = 4096


def chain_by_order(checkpoints: DataFrame, piece: Column) -> DataFrame:
    """Edges of a chain in which every checkpoint follows the one before it. One row per checkpoint.

    `piece` cuts the order into parts, for example a prefix of the name; only one row per piece meets the other pieces.
    """
    return with_neighbour(checkpoints.select("checkpoint"), [], "checkpoint", {"parent": "checkpoint"}, piece, back=True)


def ancestry(spark: SparkSession, edges: DataFrame, start: str | None = None) -> DataFrame:
    """Ancestors of a checkpoint (the latest by default) with their depth, however deep the chain is.

    Edges are one row per checkpoint. Pointers are doubled: with the jumps over 2^k parents the known ancestors of the first
    2^k depths give those of the next 2^k, so a chain of n checkpoints takes log2(n) rounds of joins. A pointer back into
    the chain ends the walk and is marked as a cycle.
    """
    ensure_checkpoint_dir(spark)
    edges = edges.select("checkpoint", "parent").checkpoint()
    first = F.lit(start) if start is not None else edges.agg(F.max("checkpoint")).scalar()
    found = edges.where(F.col("checkpoint") == first).select("checkpoint", F.lit(0).cast("bigint").alias("depth")).checkpoint()
    jumps = edges.where("parent IS NOT NULL").select("checkpoint", F.col("parent").alias("to"))
    reach = 1
    while True:
        further = found.join(jumps, "checkpoint").select(F.col("to").alias("checkpoint"), (F.col("depth") + reach).alias("depth"))
        further = further.join(edges.select("checkpoint"), "checkpoint", "left_semi").join(found.select("checkpoint"), "checkpoint", "left_anti")
        further = further.groupBy("checkpoint").agg(F.min("depth").alias("depth")).checkpoint()
        if further.isEmpty():
            break
        found = found.unionByName(further).checkpoint()
        onward = jumps.select(F.col("checkpoint").alias("to"), F.col("to").alias("beyond"))
        jumps = jumps.join(onward, "to").select("checkpoint", F.col("beyond").alias("to")).checkpoint()
        reach *= 2
    placed = found.join(edges, "checkpoint")
    parents = found.select(F.col("checkpoint").alias("parent"), F.col("depth").alias("parent_depth"))
    cycle = F.coalesce(F.col("parent_depth") <= F.col("depth"), F.lit(False))
    return placed.join(parents, "parent", "left").select("checkpoint", "parent", F.col("depth").cast("int").alias("depth"), cycle.alias("cycle"))


def ancestry_rows(spark: SparkSession, edges: DataFrame, rows: DataFrame, start: str | None = None) -> DataFrame:
    """All rows (checkpoint, key, ...) listed by a checkpoint and its ancestors."""
    return rows.join(ancestry(spark, edges, start), "checkpoint")


def repeated_keys(chain_rows: DataFrame) -> DataFrame:
    """Keys that a chain lists more than once."""
    return chain_rows.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > 1)


def broken_chain(chain: DataFrame, chain_rows: DataFrame) -> DataFrame:
    """Why a chain must be refused: keys that it lists more than once, and pointers back into it. No rows for a sound chain."""
    repeats = repeated_keys(chain_rows).select(F.lit("repeated_key").alias("reason"), F.col("key").alias("what"))
    cycles = chain.where("cycle").select(F.lit("cycle").alias("reason"), F.col("checkpoint").alias("what"))
    return repeats.unionByName(cycles)


def ancestry_summary(spark: SparkSession, edges: DataFrame, rows: DataFrame) -> DataFrame:
    """Per checkpoint of the chain: depth, rows, repeats, running total and change against its parent."""
    per_key = rows.groupBy("checkpoint", "key").agg(F.count("*").alias("n"))
    counted = per_key.groupBy("checkpoint").agg(F.sum("n").alias("row_count"), F.sum(F.col("n") - 1).alias("repeated_keys"))
    walked = counted.join(ancestry(spark, edges), "checkpoint").withColumn("age", -F.col("depth"))
    piece = F.floor(F.col("age") / PIECE)
    summed = running_sum(walked, [], ["age"], F.col("row_count"), piece, "total_rows")
    beside = with_neighbour(summed, [], "age", {"parent_rows": "row_count"}, piece, back=True)
    return beside.select("checkpoint", "depth", "row_count", "repeated_keys", "total_rows", (F.col("row_count") - F.col("parent_rows")).alias("change"))
