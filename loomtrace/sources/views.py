"""Base views: the test tables in the shape of recorded model traffic."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalar as sf
from ..operators.ordered import computed_once, with_neighbour
from .tables import table

TURNS_PER_PIECE = 4096


def id_uuid(number: Column) -> Column:
    return F.format_string("00000000-0000-4000-8000-%012d", number)


def exchanges(spark: SparkSession, folder: str) -> DataFrame:
    """Each user turn with the assistant turn right after it."""
    turns = table(spark, folder, "conversations")
    paired = with_neighbour(
        turns,
        ["conv_id"],
        "turn",
        {"next_role": "role", "next_text": "text"},
        F.call_function("div", F.col("turn"), F.lit(TURNS_PER_PIECE)),
    ).where(F.col("role") == "user")
    answered = F.coalesce(F.col("next_role") == "assistant", F.lit(False))
    trajectory = F.when(F.col("conv_id") % 4 != 0, id_uuid(F.col("conv_id")))
    started = F.timestamp_seconds(F.lit(1704067200) + F.col("conv_id") * 60 + F.col("turn") * 7)
    base = paired.select(
        "conv_id",
        "turn",
        F.format_string("c/%09d/%04d", "conv_id", "turn").alias("key"),
        F.col("text").alias("request_text"),
        F.when(answered, F.col("next_text")).otherwise("").alias("response_text"),
        answered.alias("model_completed"),
        trajectory.alias("trajectory_id"),
        started.alias("started_at"),
    )
    request, response = F.encode("request_text", "utf-8"), F.encode("response_text", "utf-8")
    return (
        base.withColumn("request_sha256", F.sha2(request, 256))
        .withColumn("response_sha256", F.sha2(response, 256))
        .withColumn("content_sha256", sf.content_digest(request, response))
        .withColumn("request_bytes", F.octet_length("request_text"))
        .withColumn("response_bytes", F.octet_length("response_text"))
        .withColumn("source_group_kind", sf.source_group_kind("trajectory_id"))
        .withColumn("source_group_sha256", sf.source_group_digest("request_sha256", "trajectory_id"))
        .withColumn("completed_at", F.date_format(F.timestamp_seconds(F.unix_timestamp("started_at") + F.octet_length("response_text") % 97), "yyyy-MM-dd'T'HH:mm:ss'Z'"))
    )


def timings(spark: SparkSession, folder: str) -> DataFrame:
    """One timed call per event."""
    events = table(spark, folder, "events")
    total_ms = F.round(F.col("value") * 1000).cast("bigint")
    started = F.col("ts").cast("timestamp")
    return events.select(
        "event_id",
        "user_id",
        F.col("event_type").alias("model"),
        F.when(F.col("event_type") == "error", 500).otherwise(200).alias("status"),
        started.alias("started_at"),
        total_ms.alias("total_ms"),
        F.timestamp_micros(F.unix_micros(started) + total_ms * 1000).alias("completed_at"),
        F.get_json_object("props", "$.k").cast("bigint").alias("output_tokens"),
    )


def feature_rows(spark: SparkSession, folder: str) -> DataFrame:
    """Timed calls with the columns of a parsed exchange row that the statistics read."""
    t = timings(spark, folder)
    success = F.col("status") == 200
    k = F.col("output_tokens")
    user = F.col("user_id")
    completed = success & (k % 9 != 0)
    refusal = success & (k % 17 == 0)
    modalities = F.when(k % 31 == 0, F.array(F.lit("image"), F.lit("text"))).otherwise(F.array(F.lit("text")))
    return t.select(
        "event_id",
        F.format_string("e/%09d", "event_id").alias("key"),
        "user_id",
        F.when(user % 2 == 0, "responses").otherwise("chat_completions").alias("endpoint"),
        "model",
        "status",
        sf.status_class("status").alias("status_class"),
        (user % 3 == 0).alias("streaming"),
        success.alias("success"),
        completed.alias("model_completed"),
        (k % 43 != 0).alias("request_parse"),
        (success | (k % 5 != 0)).alias("response_parse"),
        ((k % 43 != 0) & (success | (k % 5 != 0))).alias("parse"),
        refusal.alias("refusal"),
        F.when(k % 7 == 0, "fallback").otherwise("primary").alias("route_target"),
        F.when(k % 7 == 0, "timeout").otherwise("none").alias("fallback_reason"),
        modalities.alias("modalities"),
        (k % 11 == 0).alias("structured_output"),
        F.when(k % 13 == 0, "high").otherwise("none").alias("reasoning_effort"),
        sf.outcome_class(refusal, completed, success, F.when(k % 3 == 0, "length").when(success, "stop").otherwise("")).alias("outcome"),
        (k % 4).alias("tool_definitions"),
        F.when(k % 4 > 1, k % 3).otherwise(0).cast("bigint").alias("tool_calls"),
        F.when(k % 4 > 1, k % 3).otherwise(0).cast("bigint").alias("tool_argument_total"),
        F.when((k % 4 > 1) & (k % 5 != 0), k % 3).otherwise(0).cast("bigint").alias("tool_argument_valid"),
        (F.col("total_ms") * 3 + k).alias("request_bytes"),
        (k * 17).alias("response_bytes"),
        (user % 5).alias("message_count"),
        (user % 2).alias("input_item_count"),
        F.when(user % 3 == 0, F.call_function("div", F.col("total_ms"), F.lit(3))).alias("ttft_ms"),
        "total_ms",
        sf.throughput_milli("output_tokens", "total_ms").alias("tps_milli"),
        (k + user).alias("input_tokens"),
        "output_tokens",
        F.when(k % 2 == 0, k).alias("cached_tokens"),
        F.when(k % 13 == 0, k * 3).alias("reasoning_tokens"),
        "started_at",
        "completed_at",
        sf.sha256_text(F.concat_ws("/", "model", "output_tokens", F.col("user_id") % 20)).alias("request_sha256"),
        sf.sha256_text(F.concat_ws("/", "model", "output_tokens", F.col("user_id") % 20, F.col("total_ms") % 10)).alias("content_sha256"),
        F.when(user % 4 != 0, id_uuid(user)).alias("trajectory_id"),
    ).withColumn("source_group_kind", sf.source_group_kind("trajectory_id")).withColumn(
        "source_group_sha256", sf.source_group_digest("request_sha256", "trajectory_id")
    )


def texts(spark: SparkSession, folder: str) -> DataFrame:
    """Source texts; five documents share a trajectory, so that copies fall in different splits."""
    docs = table(spark, folder, "documents")
    trajectory = id_uuid(F.call_function("div", F.col("doc_id"), F.lit(5)))
    digest = sf.sha256_text("text")
    return (
        docs.withColumn("trajectory_id", trajectory)
        .withColumn("request_sha256", digest)
        .withColumn("norm_sha256", sf.sha256_text(sf.normalise_ascii("text")))
        .withColumn("source_group_kind", F.lit("trajectory"))
        .withColumn("source_group_sha256", sf.source_group_digest("request_sha256", "trajectory_id"))
        .withColumn("split", sf.split_of_group("source_group_sha256", "source_group_kind"))
    )


def outcomes(spark: SparkSession, folder: str) -> DataFrame:
    """Task outcomes per document; NULL is unknown."""
    docs = table(spark, folder, "documents").select("doc_id")
    labels = table(spark, folder, "labels")
    return docs.join(labels, "doc_id", "left").select(
        "doc_id", (F.col("quality") == 1).alias("task_correct"), (F.col("toxic") == 1).alias("unsafe")
    )


def results(spark: SparkSession, folder: str) -> DataFrame:
    """Scored answers of three branches on two splits."""
    return table(spark, folder, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        F.col("l_returnflag").alias("branch"),
        F.col("l_linestatus").alias("split"),
        F.round(F.col("l_discount") * 100_000).cast("bigint").alias("score_bps"),
        F.col("l_quantity").cast("bigint").alias("latency_ms"),
        (F.col("l_linenumber") * 8).cast("bigint").alias("output_tokens"),
    )


def _quoted(text) -> Column:
    """A text as a JSON string."""
    wrapped = F.to_json(F.struct(F.col(text).alias("t")))
    return F.substring(wrapped, F.lit(6), F.length(wrapped) - 6)


def bodies(spark: SparkSession, folder: str) -> DataFrame:
    """Exchanges with request and response bodies in both protocols, streamed or not, some with tool calls."""
    rows = exchanges(spark, folder)
    conv = F.col("conv_id")
    chat, done = conv % 2 == 0, F.col("model_completed")
    streaming = conv % 5 == 1
    tools = ~streaming & (conv % 6).isin(2, 5)
    tokens_in, tokens_out = F.call_function("div", F.col("request_bytes"), F.lit(4)), F.call_function("div", F.col("response_bytes"), F.lit(4))
    text = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])
    said, asked = _quoted("response_text"), _quoted("request_text")
    model = text('"model":"m', conv % 3, '"')
    chat_tools = F.when(tools, ',"tools":[{"type":"function","function":{"name":"search","parameters":{"type":"object"}}}]').otherwise("")
    flat_tools = F.when(tools, ',"tools":[{"type":"function","name":"search","parameters":{"type":"object"}}]').otherwise("")
    request = F.when(chat, text("{", model, ',"messages":[{"role":"user","content":', asked, "}]", chat_tools, "}")).otherwise(
        text("{", model, ',"input":', asked, ',"instructions":"Answer."', flat_tools, "}")
    )
    chat_usage = text('"usage":{"prompt_tokens":', tokens_in, ',"completion_tokens":', tokens_out, ',"prompt_tokens_details":{"cached_tokens":', F.call_function("div", tokens_in, F.lit(2)), "}}")
    flat_usage = text('"usage":{"input_tokens":', tokens_in, ',"output_tokens":', tokens_out, "}")
    call = ',"tool_calls":[{"id":"call_1","type":"function","function":{"name":"search","arguments":"{\\"q\\":1}"}}]'
    chat_message = text('{"role":"assistant","content":', said, F.when(tools, call).otherwise(""), "}")
    chat_plain = text('{"choices":[{"index":0,"message":', chat_message, ',"finish_reason":"', F.when(tools, "tool_calls").otherwise("stop"), '"}],', chat_usage, "}")
    chat_stream = text(
        'data: {"choices":[{"index":0,"delta":{"content":', said, '}}]}\n\ndata: {"choices":[{"index":0,"delta":{},"finish_reason":"stop"}],', chat_usage, "}\n\ndata: [DONE]\n\n"
    )
    part = text('{"type":"message","role":"assistant","content":[{"type":"output_text","text":', said, "}]}")
    flat_call = F.when(tools, '{"type":"function_call","call_id":"call_1","name":"search","arguments":"not json"},').otherwise("")
    flat_plain = text('{"type":"response","status":"completed","output":[', flat_call, part, "],", flat_usage, "}")
    flat_stream = text(
        'data: {"type":"response.output_text.delta","delta":', said, '}\n\ndata: {"type":"response.completed","response":{"status":"completed",', flat_usage, ',"output":[', part, "]}}\n\n"
    )
    response = (
        F.when(chat & streaming & done, chat_stream)
        .when(chat & streaming, 'data: {"choices":[{"index":0,"delta":{"content":""}}]}\n\n')
        .when(chat & done, chat_plain)
        .when(chat, '{"error":{"type":"overloaded"}}')
        .when(streaming & done, flat_stream)
        .when(streaming, 'data: {"type":"response.failed","response":{"status":"failed"}}\n\n')
        .when(done, flat_plain)
        .otherwise('{"type":"response","status":"incomplete","output":[],"usage":{}}')
    )
    identifier = F.concat(F.lit("01900000-0000-7000-8000-"), F.lpad((conv * 10_000 + F.col("turn")).cast("string"), 12, "0"))
    return computed_once(rows).select(
        "conv_id", "turn", "request_text", "response_text", "model_completed", "trajectory_id", "started_at",
        identifier.alias("exchange_id"),
        F.concat(F.lit("c/"), identifier, F.lit(".json.zst")).alias("key"),
        F.when(chat, "chat_completions").otherwise("responses").alias("endpoint"),
        streaming.alias("streaming"),
        F.when(done | (conv % 3 != 0), 200).otherwise(503).cast("bigint").alias("status"),
        (F.col("request_bytes") + F.col("response_bytes") + 100).cast("bigint").alias("total_ms"),
        request.alias("request"),
        response.alias("response"),
        ((conv * 7 + F.col("turn")) % 13).cast("int").alias("fault"),
    )


def envelopes(spark: SparkSession, folder: str) -> DataFrame:
    """(key, body): one envelope text per exchange. The `fault` number of an exchange plants one broken rule."""
    rows = bodies(spark, folder)
    fault = F.col("fault")
    planted = lambda number, wrong, right: F.when(fault == number, wrong).otherwise(right)
    moment = lambda value: F.date_format(value, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    started = F.col("started_at")
    completed = F.timestamp_millis(F.unix_millis(started) + F.when(fault == 4, -1).otherwise(1) * F.col("total_ms"))
    coded = lambda name: F.base64(F.encode(name, "utf-8"))
    # base64() breaks lines after 76 characters; envelopes carry one line.
    single = lambda name: F.regexp_replace(coded(name), r"\s", "")
    digest = lambda name: F.sha2(F.encode(name, "utf-8"), 256)
    request = F.struct(
        planted(3, F.concat(single("request"), F.lit("*")), single("request")).alias("body_base64"),
        F.octet_length("request").alias("byte_len"),
        planted(1, F.lit("0" * 64), digest("request")).alias("sha256"),
    )
    response = F.struct(
        single("response").alias("body_base64"),
        planted(2, F.octet_length("response") + 1, F.octet_length("response")).alias("byte_len"),
        digest("response").alias("sha256"),
        planted(10, F.lit(99).cast("bigint"), F.col("status")).alias("status"),
    )
    body = F.to_json(F.struct(
        planted(5, F.lit("exchange.v1"), F.lit("exchange.v2")).alias("schema_version"),
        F.lit(sf.SCOPE).alias("scope_id"),
        F.lit("production").alias("profile"),
        (fault != 6).alias("complete"),
        planted(9, F.regexp_replace("exchange_id", "-7000-", "-4000-"), F.col("exchange_id")).alias("exchange_id"),
        planted(8, F.lit("00000000-0000-0000-0000-000000000000"), F.col("trajectory_id")).alias("trajectory_id"),
        planted(7, F.concat(F.date_format(started, "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+02:00")), moment(started)).alias("started_at"),
        moment(completed).alias("completed_at"),
        "endpoint",
        "streaming",
        request.alias("request"),
        response.alias("response"),
        F.struct(F.lit("primary").alias("target")).alias("route"),
        F.struct(F.col("total_ms"), F.when(F.col("streaming"), 50).cast("bigint").alias("ttft_ms")).alias("timing"),
    ))
    return computed_once(rows.select("key", body.alias("body")))
