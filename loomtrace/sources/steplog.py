"""Step logs: JSON lines of a running task, as a batch or a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.jsonrules import plain_json
from ..operators.features import usage_of_variant


def parse_steps(lines: DataFrame, line: str = "value") -> DataFrame:
    """Keep lines that hold one JSON object; other lines are skipped."""
    parsed = lines.withColumn("step", F.try_parse_json(plain_json(line)))
    objects = parsed.where(F.schema_of_variant("step").startswith("OBJECT"))
    text = lambda path: F.try_variant_get("step", path, "string")
    return objects.select(
        text("$.type").alias("type"),
        text("$.step_id").alias("step_id"),
        text("$.ts").alias("ts"),
        F.coalesce(text("$.content"), F.lit("")).alias("content"),
        text("$.command").alias("command"),
        F.try_variant_get("step", "$.exit", "bigint").alias("exit_code"),
        F.try_variant_get("step", "$.message", "variant").alias("message"),
        usage_of_variant(F.try_variant_get("step", "$.usage", "variant")).alias("usage"),
    )


def read_steps(spark: SparkSession, path: str) -> DataFrame:
    return parse_steps(spark.read.text(path))


def stream_steps(spark: SparkSession, path: str) -> DataFrame:
    return parse_steps(spark.readStream.text(path))
