"""Recorded exchange objects: read, decompress, check, decode."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import scalar as sf
from ..operators.ordered import computed_once

OBJECT_BYTES = 64 * 1024 * 1024
SCHEMA_VERSION = "exchange.v2"
SIDE = "struct<body_base64:string,byte_len:bigint,sha256:string,status:bigint>"
ENVELOPE = (
    "schema_version string, scope_id string, profile string, complete boolean, exchange_id string, trajectory_id string,"
    " started_at string, completed_at string, endpoint string, streaming boolean,"
    f" request {SIDE}, response {SIDE},"
    " route struct<target:string,fallback_reason:string>, timing struct<total_ms:bigint,ttft_ms:bigint>"
)


OPENED = T.StructType([T.StructField("body", T.StringType()), T.StructField("problem", T.StringType())])


def unpack_zstd(content: Column, object_bytes: int = OBJECT_BYTES) -> Column:
    """Text of a zstd object, or why there is none: `oversized`, `broken_object` or `not_utf8`."""

    @F.pandas_udf(OPENED)
    def unpack(bodies: pd.Series) -> pd.DataFrame:
        import zstandard

        def open_(body):
            if body is None:
                return None, "broken_object"
            try:
                with zstandard.ZstdDecompressor().stream_reader(body) as reader:
                    raw = reader.read(object_bytes + 1)
                return (None, "oversized") if len(raw) > object_bytes else (raw.decode("utf-8"), None)
            except zstandard.ZstdError:
                return None, "broken_object"
            except UnicodeDecodeError:
                return None, "not_utf8"

        return pd.DataFrame([open_(body) for body in bodies], columns=OPENED.names, dtype=object)

    return unpack(content)


def _opened(files: DataFrame, object_bytes: int) -> DataFrame:
    """Objects are read and unpacked once, even if later steps filter by what they hold."""
    opened = files.select(F.col("path").alias("key"), F.sha2("content", 256).alias("object_sha256"), unpack_zstd(F.col("content"), object_bytes).alias("o"))
    return opened.select("key", "object_sha256", "o.body", "o.problem")


def read_objects(spark: SparkSession, path: str, object_bytes: int = OBJECT_BYTES) -> DataFrame:
    """(key, object_sha256, body, problem) of all `.json.zst` objects below a folder; texts may take `object_bytes` unpacked."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.json.zst").option("recursiveFileLookup", "true").load(path)
    return _opened(files, object_bytes)


def stream_objects(spark: SparkSession, path: str, object_bytes: int = OBJECT_BYTES, files_per_batch: int = 1000) -> DataFrame:
    """The same rows as a stream: every object once, in batches, as it turns up below the folder, whatever its key."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    reader = spark.readStream.format("binaryFile").schema(schema).option("pathGlobFilter", "*.json.zst").option("recursiveFileLookup", "true")
    return _opened(reader.option("maxFilesPerTrigger", files_per_batch).load(path), object_bytes)


def decoded_body(side: str) -> Column:
    encoded = F.col(f"{side}.body_base64")
    shaped = encoded.rlike(r"\A[A-Za-z0-9+/]*={0,2}\z") & (F.length(encoded) % 4 == 0)
    return F.when(shaped, F.try_to_binary(encoded, F.lit("base64")))


def side_problem(side: str, body: Column) -> Column:
    """NULL when the decoded body has the length and digest that the side states."""
    return (
        F.when(F.col(f"{side}.body_base64").isNull(), f"{side}_missing")
        .when(body.isNull(), f"{side}_not_base64")
        .when(~F.col(f"{side}.byte_len").eqNullSafe(F.octet_length(body).cast("bigint")), f"{side}_identity_differs")
        .when(~F.col(f"{side}.sha256").eqNullSafe(F.sha2(body, 256)), f"{side}_identity_differs")
    )


def _uuid_version_seven(value: Column) -> Column:
    plain = F.regexp_replace(F.regexp_replace(value, "urn:|uuid:|^[{}]+|[{}]+$", ""), "-", "")
    return plain.rlike(r"\A[0-9a-fA-F]{12}7[0-9a-fA-F]{3}[89abAB][0-9a-fA-F]{15}\z")


def _once(rows: DataFrame) -> DataFrame:
    return rows if rows.isStreaming else computed_once(rows)


def scan_envelopes(objects: DataFrame, scope: str, profile: str, schema_version: str = SCHEMA_VERSION) -> DataFrame:
    """Parse and check envelope texts (key, body). Every row stays; `reject_reason` names the first broken rule.

    Key and header rules come before the bodies are decoded. An object too large to be unpacked (`problem`) is told apart from one
    that is no exchange.
    """
    unread = F.when(F.col("__problem") == "oversized", "oversized") if "problem" in objects.columns else F.lit(None).cast("string")
    objects = objects.withColumnRenamed("problem", "__problem")
    # A stream keeps no row ids; it is read once anyway.
    opened = objects.withColumn("e", F.from_json("body", ENVELOPE))
    parsed = _once(opened).select(*[c for c in objects.columns if c != "body"], "e.*")
    sides = parsed.withColumn("request_body", decoded_body("request")).withColumn("response_body", decoded_body("response"))
    timed = _once(sides).withColumn("started", sf.parse_utc("started_at")).withColumn("completed", sf.parse_utc("completed_at"))
    trajectory = F.col("trajectory_id")
    canonical = trajectory.rlike(r"\A[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}\z") & ~trajectory.rlike("^[0-]+$")
    status = F.col("response.status")
    wrong = lambda column, value: ~F.col(column).eqNullSafe(F.lit(value))
    reason = (
        F.when(wrong("schema_version", schema_version), "not_an_exchange")
        .when(wrong("scope_id", scope) | wrong("profile", profile) | wrong("complete", True), "scope_profile_or_completion")
        .when(~F.coalesce(_uuid_version_seven(F.col("exchange_id")), F.lit(False)), "exchange_id_invalid")
        .when(~F.col("key").endswith(F.concat(F.lit("/"), "exchange_id", F.lit(".json.zst"))), "exchange_id_differs_from_key")
        .when(trajectory.isNotNull() & ~canonical, "trajectory_id_invalid")
        .when(F.col("started").isNull() | F.col("completed").isNull(), "timestamp_invalid")
        .when(F.col("completed") < F.col("started"), "completes_before_start")
    )
    reason = F.coalesce(
        unread,
        reason,
        side_problem("request", F.col("request_body")),
        side_problem("response", F.col("response_body")),
        F.when(~F.coalesce(status.between(100, 599), F.lit(False)), "status_invalid"),
        F.when(~F.coalesce(F.col("timing.total_ms") >= 0, F.lit(False)) | F.coalesce(F.col("timing.ttft_ms") < 0, F.lit(False)), "timing_invalid"),
    )
    return _once(timed.withColumn("reject_reason", reason).drop("__problem"))
