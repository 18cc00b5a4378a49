"""Sinks: split and shard outputs, manifests, write-once tables, staleness."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.evaldata import SHARD_ROWS, content_fingerprint
from . import shardfiles


class DifferentContent(ValueError):
    """A write-once table already holds something else."""


def split_manifest(rows: DataFrame, split: str, content: Column) -> DataFrame:
    """Row count and order-independent content digest per split."""
    return rows.groupBy(F.col(split).alias("split")).agg(F.count("*").alias("n"), *content_fingerprint(content))


def write_splits(rows: DataFrame, path: str, split: str = "split") -> None:
    """One parquet folder per split."""
    rows.write.partitionBy(split).parquet(path)


def write_shards(cases: DataFrame, path: str, shard_rows: int = SHARD_ROWS) -> None:
    """Shards as row groups of a few range files, and their manifest, in one pass; see `shardfiles`."""
    shardfiles.write(cases, path, shard_rows)


def run_fingerprint(rows: DataFrame) -> str:
    """Digest of the rows of a result, whatever their order; only one row reaches the driver."""
    content = F.to_json(F.struct(*sorted(rows.columns)))
    found = rows.agg(F.count("*").alias("n"), *content_fingerprint(content)).first()
    return f"{found['n']}-{found['content_xor']}-{found['content_sum']}"


def create_same(spark: SparkSession, rows: DataFrame, path: str) -> bool:
    """Write a table once. The same content again is a no-op (False); other content is an error."""
    store = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    files = store.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(store):
        rows.write.mode("errorifexists").parquet(path)
        return True
    if run_fingerprint(spark.read.parquet(path)) != run_fingerprint(rows):
        raise DifferentContent(path)
    return False


def stale_artifacts(artifacts: DataFrame, stages: list[str]) -> DataFrame:
    """Which derived tables still match their parents, and what each scope has to run next.

    `artifacts` holds (scope, stage, digest, parent_stage, parent_digest). A stage is current only when it exists,
    its recorded parent digest equals the parent's present digest, and the parent is current itself.
    """
    mine, parent = artifacts.alias("a"), artifacts.alias("p")
    matched = mine.join(
        parent, (F.col("a.scope") == F.col("p.scope")) & (F.col("a.parent_stage") == F.col("p.stage")), "left"
    ).select(
        F.col("a.scope").alias("scope"),
        F.col("a.stage").alias("stage"),
        (F.col("a.parent_stage").isNull() | F.col("a.parent_digest").eqNullSafe(F.col("p.digest"))).alias("matches"),
    )
    wide = matched.groupBy("scope").agg(
        *[F.coalesce(F.max(F.when(F.col("stage") == name, F.col("matches"))), F.lit(False)).alias(name) for name in stages]
    )
    chained, fine = [], F.lit(True)
    for name in stages:
        fine = fine & F.col(name)
        chained.append(fine.alias(name + "_current"))
    following = None
    for name in stages:
        test = ~F.col(name + "_current")
        following = F.when(test, name) if following is None else following.when(test, name)
    return wide.select("scope", *chained).withColumn("next_stage", following.otherwise("done"))

