"""Parsed exchange rows: what a request and its response contain, as Spark expressions over JSON nodes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalar as sf
from ..functions.jsonrules import plain_json
from ..functions.jsonwalk import json_nodes

TEXT_KEYS = ("content", "text", "output_text", "refusal")
# Item types that show a modality other than text, and the closing events of a response stream.
MODALITY_TYPES = {"audio": ("audio", "input_audio"), "file": ("file", "input_file"), "image": ("image_url", "input_image")}
CLOSING_EVENTS = ("response.completed", "response.incomplete", "response.failed")


def sse_data(body) -> Column:
    """The JSON texts of the `data:` lines of an event stream, without the closing mark."""
    lines = F.filter(F.split(body, sf.LINE_BREAK), lambda line: line.startswith("data:"))
    texts = F.transform(lines, lambda line: sf.strip(F.substring(line, F.lit(6), F.length(line))))
    return F.filter(texts, lambda text: (text != "") & (text != "[DONE]"))


def sse_events(rows: DataFrame, body: str, *keep: str) -> DataFrame:
    """One row per event of an event stream: its place and its JSON as a VARIANT (NULL when it is not JSON)."""
    placed = rows.select(*keep, F.posexplode(sse_data(F.col(body))).alias("event_index", "data"))
    return placed.withColumn("event", F.try_parse_json(plain_json("data")))


def sse_summary(events: DataFrame, *keys: str) -> DataFrame:
    """Concatenated text, last usage and first text place of every stream, from `sse_events` of chat chunks.

    Chunks are joined per stream, which is one response body and so bounded.
    """
    content = F.try_variant_get("event", "$.choices[0].delta.content", "string")
    usage = F.try_variant_get("event", "$.usage", "string")
    pieces = events.withColumn("__content", F.nullif(content, F.lit(""))).withColumn("__usage", usage)
    ordered = F.array_sort(F.collect_list(F.when(F.col("__content").isNotNull(), F.struct("event_index", "__content"))))
    return pieces.groupBy(*keys).agg(
        F.array_join(F.transform(ordered, lambda p: p["__content"]), "").alias("text"),
        F.max_by("__usage", F.when(F.col("__usage").isNotNull(), F.col("event_index"))).alias("usage"),
        F.min(F.when(F.col("__content").isNotNull(), F.col("event_index"))).alias("first_text_event"),
        F.count("*").alias("events"),
    )


def _member(node: Column, name: str) -> Column:
    return node["strings"][F.lit(name)]


def _nonempty(values: list[Column]) -> Column:
    return F.filter(F.array(*values), lambda text: text.isNotNull() & (text != ""))


def _node_texts(node: Column) -> Column:
    return _nonempty([_member(node, name) for name in TEXT_KEYS])


def _top_texts(nodes: Column) -> Column:
    tops = F.filter(nodes, lambda n: (n["parent"] == -1) & ~n["item"])
    return F.flatten(F.transform(tops, lambda n: _nonempty([_member(n, "instructions"), _member(n, "input")])))


def visible_texts(nodes: Column, top: bool) -> Column:
    """Texts in reading order. `top` adds the instructions and plain input of a request body."""
    inner = F.flatten(F.transform(nodes, _node_texts))
    return F.concat(_top_texts(nodes), inner) if top else inner


def classification_texts(nodes: Column, top: bool, visible: Column | None = None) -> Column:
    """Like `visible_texts` (pass them if at hand), but a body with tool calls or results shows those as compact events and hides their inside."""
    empty = F.array().cast("array<string>")
    piece = lambda n: F.when(n["event"].isNotNull(), F.array(n["event"])).when(n["hidden"], empty).otherwise(_node_texts(n))
    mixed = F.flatten(F.transform(nodes, piece))
    with_tools = F.concat(_top_texts(nodes), mixed) if top else mixed
    return F.when(F.exists(nodes, lambda n: n["event"].isNotNull()), with_tools).otherwise(
        visible_texts(nodes, top) if visible is None else visible
    )


def _child(nodes: Column, parent: Column | int, edge: str) -> Column:
    """The object that hangs from a member of another object, NULL if there is none."""
    return F.try_element_at(F.filter(nodes, lambda n: (n["parent"] == parent) & (n["edge"] == edge) & ~n["item"]), F.lit(1))


def usage_place(nodes: Column) -> Column:
    """Index of the last usage object, by the object that holds it; NULL without one."""
    holds = lambda n: (n["edge"] == "usage") & ~n["item"] & (n["parent"] >= 0)
    pairs = F.transform(nodes, lambda n, i: F.when(holds(n), F.struct(n["parent"].alias("parent"), i.alias("place"))))
    return F.array_max(pairs)["place"]


def usage_counts(nodes: Column, place: Column) -> Column:
    """Token counts of the usage object at a place, under either spelling; only whole non-negative numbers count."""
    usage = F.try_element_at(nodes, place + 1)

    def count(first: str, second: str, details: str | None = None) -> Column:
        owner = _child(nodes, place, details) if details else usage
        other = owner["ints"][F.lit(second)]
        value = F.when(usage["kinds"][F.lit(first)].isNotNull(), usage["ints"][F.lit(first)]).otherwise(other)
        return F.when(value >= 0, value)

    return F.struct(
        count("input_tokens", "prompt_tokens").alias("input_tokens"),
        count("output_tokens", "completion_tokens").alias("output_tokens"),
        count("cached_tokens", "cached_tokens", "prompt_tokens_details").alias("cached_tokens"),
        count("reasoning_tokens", "reasoning_tokens", "completion_tokens_details").alias("reasoning_tokens"),
    )


def usage_of_variant(usage: Column) -> Column:
    """Token counts of one usage object as VARIANT, with the fallbacks of the step log."""

    def whole(path: str) -> Column:
        # Only JSON integers count, not booleans, texts or fractions.
        part = F.try_variant_get(usage, path, "variant")
        value = F.when(F.schema_of_variant(part) == "BIGINT", F.try_variant_get(usage, path, "bigint"))
        return F.when(value >= 0, value)

    pick = lambda *paths: F.coalesce(*[whole(path) for path in paths])
    return F.struct(
        pick("$.input_tokens", "$.prompt_tokens").alias("input_tokens"),
        pick("$.output_tokens", "$.completion_tokens").alias("output_tokens"),
        pick("$.input_tokens_details.cached_tokens", "$.prompt_tokens_details.cached_tokens").alias("cached_tokens"),
        pick("$.output_tokens_details.reasoning_tokens", "$.completion_tokens_details.reasoning_tokens").alias("reasoning_tokens"),
    )


def modalities(request: Column, response: Column, has_text: Column) -> Column:
    """Sorted names of the modalities that item types show, plus text; `unknown` when there is none."""
    kinds = F.array_compact(F.transform(F.concat(request, response), lambda n: _member(n, "type")))
    found = [F.when(F.arrays_overlap(kinds, F.array(*[F.lit(t) for t in types])), name) for name, types in MODALITY_TYPES.items()]
    named = F.array_compact(F.array(*found, F.when(has_text, "text")))
    return F.when(F.size(named) > 0, named).otherwise(F.array(F.lit("unknown")))


def model_completed(endpoint: Column, nodes: Column, docs: Column) -> Column:
    """Whether the model finished its turn: one closing event, or every choice stopped and nothing else."""
    tops = F.filter(nodes, lambda n: (n["parent"] == -1) & ~n["item"])
    closing = lambda n: F.coalesce(_member(n, "type").isin(*CLOSING_EVENTS), F.lit(False))
    ends = F.filter(tops, closing)
    end_place = F.array_position(F.transform(nodes, lambda n: (n["parent"] == -1) & ~n["item"] & closing(n)), F.lit(True)).cast("int") - 1
    single = (F.size(docs) == 1) & (F.size(tops) == 1) & (F.size(ends) == 0)
    streamed = (
        (F.size(ends) == 1)
        & (_member(F.try_element_at(ends, F.lit(1)), "type") == "response.completed")
        & (_member(_child(nodes, end_place, "response"), "status") == "completed")
    )
    response_done = F.when(single, _member(F.try_element_at(tops, F.lit(1)), "status") == "completed").otherwise(streamed)

    choices = F.filter(nodes, lambda n: n["item"] & (n["edge"] == "choices") & n["under_top"])
    listed = F.aggregate(tops, F.lit(0), lambda total, n: total + F.coalesce(n["sizes"][F.lit("choices")], F.lit(0)))
    numbers = F.transform(choices, lambda c: c["ints"][F.lit("index")])
    stopped = F.transform(F.filter(choices, lambda c: _member(c, "finish_reason") == "stop"), lambda c: c["ints"][F.lit("index")])
    chat_done = (
        (F.size(choices) > 0)
        & (F.size(choices) == listed)
        & F.forall(numbers, lambda i: i.isNotNull())
        & F.forall(choices, lambda c: F.coalesce(_member(c, "finish_reason") == "stop", F.lit(True)))
        & (F.size(F.array_except(numbers, stopped)) == 0)
    )
    done = F.when(endpoint == "responses", response_done).when(endpoint == "chat_completions", chat_done)
    return F.coalesce(done, F.lit(False))


def parse_exchanges(scanned: DataFrame, scope: str = sf.SCOPE, group_salt: str = sf.GROUP_SALT) -> DataFrame:
    """The feature row of every accepted envelope.

    Header filters run before the JSON walk; the walk is the only Python step and sees just the two bodies.
    Shared parts are columns of their own, so that no expression is worked out twice.
    """
    rows = scanned.where(F.col("reject_reason").isNull())
    text = lambda body: F.try_validate_utf8(F.col(body).cast("string"))
    rows = rows.withColumn("__streamed", F.when(F.coalesce("streaming", F.lit(False)), sse_data(text("response_body"))))
    docs = F.when(F.coalesce("streaming", F.lit(False)), F.when(F.size("__streamed") > 0, F.col("__streamed"))).otherwise(
        F.when(text("response_body").isNotNull(), F.array(text("response_body")))
    )
    request_docs = F.when(text("request_body").isNotNull(), F.array(text("request_body")))
    walked = rows.withColumn("__docs", docs).withColumn("__request", json_nodes(request_docs)).withColumn("__response", json_nodes("__docs"))
    none = F.array().cast(walked.schema["__request"].dataType)
    walked = walked.withColumn("__req", F.coalesce("__request", none)).withColumn("__resp", F.coalesce("__response", none))
    req, resp = F.col("__req"), F.col("__resp")
    is_top = lambda n: (n["parent"] == -1) & ~n["item"]
    walked = (
        walked.withColumn("__top", F.try_element_at(F.filter(req, is_top), F.lit(1)))
        .withColumn("__usage_place", usage_place(resp))
        .withColumn("__seen_req", visible_texts(req, True))
        .withColumn("__seen_resp", visible_texts(resp, False))
    )
    top = F.col("__top")
    status = F.col("response.status")
    endpoint = F.coalesce("endpoint", F.lit("other"))
    finish = F.array_sort(F.array_distinct(F.array_compact(F.transform(resp, lambda n: _member(n, "finish_reason")))))
    count_if = lambda nodes, test: F.size(F.filter(nodes, test)).cast("bigint")
    calls = count_if(resp, lambda n: F.coalesce(_member(n, "type").isin("function_call", "tool_call"), F.lit(False))) + F.aggregate(
        resp, F.lit(0).cast("bigint"), lambda total, n: total + F.coalesce(n["sizes"][F.lit("tool_calls")], F.lit(0))
    )
    # The body itself is node 0; `text` hangs from it and `format` from that.
    text_places = F.transform(req, lambda n, i: F.when((n["parent"] == 0) & (n["edge"] == "text") & ~n["item"], i))
    formatted = F.exists(req, lambda n: (n["edge"] == "format") & ~n["item"] & F.array_contains(F.array_compact(text_places), n["parent"]))
    structured = top.isNotNull() & (_child(req, 0, "response_format").isNotNull() | F.coalesce(formatted, F.lit(False)))
    reasoning = F.coalesce(_member(top, "reasoning_effort"), F.when(top.isNotNull(), _member(_child(req, 0, "reasoning"), "effort")), F.lit("none"))
    input_kind = top["kinds"][F.lit("input")]
    has_text = (F.size("__seen_req") > 0) | (F.size("__seen_resp") > 0)
    request_digest = F.sha2("request_body", 256)
    facts = walked.select(
        "key",
        *[name for name in ("object_sha256",) if name in rows.columns],
        "exchange_id",
        sf.content_digest("request_body", "response_body").alias("content_sha256"),
        request_digest.alias("request_sha256"),
        F.sha2("response_body", 256).alias("response_sha256"),
        "trajectory_id",
        sf.source_group_kind("trajectory_id").alias("source_group_kind"),
        sf.source_group_digest(request_digest, "trajectory_id", scope, group_salt).alias("source_group_sha256"),
        "started_at",
        "completed_at",
        endpoint.alias("endpoint"),
        F.coalesce("streaming", F.lit(False)).alias("streaming"),
        F.coalesce(_member(top, "model"), F.lit("unknown")).alias("model"),
        status.alias("status"),
        sf.status_class(status).alias("status_class"),
        status.between(200, 299).alias("success"),
        model_completed(endpoint, resp, F.col("__docs")).alias("model_completed"),
        F.col("__request").isNotNull().alias("request_parse"),
        F.col("__response").isNotNull().alias("response_parse"),
        (F.col("__request").isNotNull() & F.col("__response").isNotNull()).alias("parse"),
        F.coalesce("route.target", F.lit("unknown")).alias("route_target"),
        F.coalesce("route.fallback_reason", F.lit("none")).alias("fallback_reason"),
        modalities(req, resp, has_text).alias("modalities"),
        F.coalesce(top["sizes"][F.lit("tools")], F.lit(0)).cast("bigint").alias("tool_definitions"),
        calls.alias("tool_calls"),
        count_if(resp, lambda n: n["arguments_ok"].isNotNull()).alias("tool_argument_total"),
        count_if(resp, lambda n: F.coalesce(n["arguments_ok"], F.lit(False))).alias("tool_argument_valid"),
        structured.alias("structured_output"),
        reasoning.alias("reasoning_effort"),
        F.exists(resp, lambda n: F.coalesce(_member(n, "refusal") != "", F.lit(False))).alias("refusal"),
        F.array_join(finish, "+").alias("__finish"),
        F.octet_length("request_body").cast("bigint").alias("request_bytes"),
        F.octet_length("response_body").cast("bigint").alias("response_bytes"),
        F.coalesce(top["sizes"][F.lit("messages")], F.lit(0)).cast("bigint").alias("message_count"),
        F.when(input_kind == "list", top["sizes"][F.lit("input")]).when(input_kind != "null", 1).otherwise(0).cast("bigint").alias("input_item_count"),
        F.col("timing.ttft_ms").alias("ttft_ms"),
        F.col("timing.total_ms").alias("total_ms"),
        usage_counts(resp, F.col("__usage_place")).alias("usage"),
        F.array_join(classification_texts(req, True, F.col("__seen_req")), "\n").alias("request_text"),
        F.array_join(classification_texts(resp, False, F.col("__seen_resp")), "\n").alias("response_text"),
    )
    both_texts = (sf.strip("request_text") != "") & (sf.strip("response_text") != "")
    return facts.select(
        *[c for c in facts.columns if c != "__finish"],
        sf.outcome_class("refusal", "model_completed", "success", "__finish").alias("outcome"),
        sf.throughput_milli("usage.output_tokens", "total_ms").alias("tps_milli"),
        both_texts.alias("has_request_response_text"),
    )


def eligible_for_eval() -> Column:
    """Plain text both ways, no tools, successful and finished."""
    return (
        (F.col("modalities") == F.array(F.lit("text")))
        & (F.col("tool_definitions") == 0)
        & (F.col("tool_calls") == 0)
        & F.col("success")
        & F.col("model_completed")
        & F.col("has_request_response_text")
    )


def eligible_for_training(group_split: Column) -> Column:
    """Eligible, both bodies parsed, and in the train split."""
    return eligible_for_eval() & F.col("parse") & (group_split == "train")


def classifier_excerpt(text, size: int, tool_exchange: Column) -> Column:
    """At most `size` bytes of text; tool exchanges keep a third from the front and the rest from the end."""
    marker = "\n...[middle omitted]...\n"
    head = (size - len(marker)) // 3
    body = F.col(text) if isinstance(text, str) else text
    middle_cut = F.concat(sf.utf8_prefix(body, head), F.lit(marker), sf.utf8_suffix(body, size - len(marker) - head))
    short = ~tool_exchange | (F.octet_length(body) <= size)
    return F.when(short, sf.utf8_prefix(body, size)).otherwise(middle_cut)
