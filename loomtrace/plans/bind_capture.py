"""Bindings: recorded envelopes, feature rows, event streams and conversations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalar as sf
from ..operators import convo, features, redact, sampling
from ..sources import captures, views
from ..sources.tables import table
from .bind_select import SAMPLING_SQL, eligible_features
from .catalog import query
from .view_sql import EXCHANGES, TIMINGS, group_sha, sha, split_bucket, split_of, with_views

BODIES_SQL = EXCHANGES + f""",
body_base AS (SELECT *, '01900000-0000-7000-8000-' || lpad((conv_id * 10000 + turn)::varchar, 12, '0') AS exchange_id, conv_id % 2 = 0 AS chat, model_completed AS done,
  conv_id % 5 = 1 AS streaming, conv_id % 5 <> 1 AND conv_id % 6 IN (2, 5) AS tools, request_bytes // 4 AS ti, response_bytes // 4 AS tok, to_json(request_text)::varchar AS asked,
  to_json(response_text)::varchar AS said, CASE WHEN model_completed OR conv_id % 3 <> 0 THEN 200 ELSE 503 END AS status, request_bytes + response_bytes + 100 AS total_ms,
  (conv_id * 7 + turn) % 13 AS fault FROM exchanges),
body_parts AS (SELECT *, 'c/' || exchange_id || '.json.zst' AS okey,
  '"usage":{{"prompt_tokens":' || ti || ',"completion_tokens":' || tok || ',"prompt_tokens_details":{{"cached_tokens":' || (ti // 2) || '}}}}' AS cu,
  '"usage":{{"input_tokens":' || ti || ',"output_tokens":' || tok || '}}' AS fu,
  '{{"type":"message","role":"assistant","content":[{{"type":"output_text","text":' || said || '}}]}}' AS part FROM body_base),
bodies AS (SELECT *,
  CASE WHEN chat THEN '{{"model":"m' || (conv_id % 3) || '","messages":[{{"role":"user","content":' || asked || '}}]' ||
      CASE WHEN tools THEN ',"tools":[{{"type":"function","function":{{"name":"search","parameters":{{"type":"object"}}}}}}]' ELSE '' END || '}}'
    ELSE '{{"model":"m' || (conv_id % 3) || '","input":' || asked || ',"instructions":"Answer."' ||
      CASE WHEN tools THEN ',"tools":[{{"type":"function","name":"search","parameters":{{"type":"object"}}}}]' ELSE '' END || '}}' END AS request,
  CASE WHEN chat AND streaming AND done THEN 'data: {{"choices":[{{"index":0,"delta":{{"content":' || said || '}}}}]}}' || chr(10) || chr(10) || 'data: {{"choices":[{{"index":0,"delta":{{}},"finish_reason":"stop"}}],' || cu || '}}' || chr(10) || chr(10) || 'data: [DONE]' || chr(10) || chr(10)
    WHEN chat AND streaming THEN 'data: {{"choices":[{{"index":0,"delta":{{"content":""}}}}]}}' || chr(10) || chr(10)
    WHEN chat AND done THEN '{{"choices":[{{"index":0,"message":{{"role":"assistant","content":' || said || CASE WHEN tools THEN ',"tool_calls":[{{"id":"call_1","type":"function","function":{{"name":"search","arguments":"{{\\"q\\":1}}"}}}}]' ELSE '' END ||
      '}},"finish_reason":"' || CASE WHEN tools THEN 'tool_calls' ELSE 'stop' END || '"}}],' || cu || '}}'
    WHEN chat THEN '{{"error":{{"type":"overloaded"}}}}'
    WHEN streaming AND done THEN 'data: {{"type":"response.output_text.delta","delta":' || said || '}}' || chr(10) || chr(10) || 'data: {{"type":"response.completed","response":{{"status":"completed",' || fu || ',"output":[' || part || ']}}}}' || chr(10) || chr(10)
    WHEN streaming THEN 'data: {{"type":"response.failed","response":{{"status":"failed"}}}}' || chr(10) || chr(10)
    WHEN done THEN '{{"type":"response","status":"completed","output":[' || CASE WHEN tools THEN '{{"type":"function_call","call_id":"call_1","name":"search","arguments":"not json"}},' ELSE '' END || part || '],' || fu || '}}'
    ELSE '{{"type":"response","status":"incomplete","output":[],"usage":{{}}}}' END AS response FROM body_parts)"""
REJECT_SQL = """CASE fault WHEN 1 THEN 'request_identity_differs' WHEN 2 THEN 'response_identity_differs' WHEN 3 THEN 'request_not_base64'
  WHEN 4 THEN 'completes_before_start' WHEN 5 THEN 'not_an_exchange' WHEN 6 THEN 'scope_profile_or_completion' WHEN 7 THEN 'timestamp_invalid'
  WHEN 8 THEN 'trajectory_id_invalid' WHEN 9 THEN 'exchange_id_invalid' WHEN 10 THEN 'status_invalid' END"""


def scanned(spark, folder):
    return captures.scan_envelopes(views.envelopes(spark, folder), sf.SCOPE, "production")


@query("capture_scan", with_views(BODIES_SQL, body=f"SELECT okey AS key, {REJECT_SQL} AS reject_reason FROM bodies"))
def capture_scan(spark, folder):
    return scanned(spark, folder).select("key", "reject_reason")


@query(
    "capture_integrity",
    with_views(BODIES_SQL, body="""SELECT okey AS key, CASE fault WHEN 1 THEN 'request_identity_differs' WHEN 3 THEN 'request_not_base64' END AS request_problem,
  CASE fault WHEN 2 THEN 'response_identity_differs' END AS response_problem, octet_length(encode(response)) AS response_bytes FROM bodies"""),
)
def capture_integrity(spark, folder):
    rows = scanned(spark, folder)
    return rows.select(
        "key",
        captures.side_problem("request", F.col("request_body")).alias("request_problem"),
        captures.side_problem("response", F.col("response_body")).alias("response_problem"),
        F.octet_length("response_body").alias("response_bytes"),
    )


CALL_EVENT = """'{"type":"function_call","name":"search","arguments":"{\\"q\\":1}","call_id":"call_1"}'"""
FLAT_EVENT = """'{"type":"function_call","name":"search","arguments":"not json","call_id":"call_1"}'"""
FEATURE_SQL = BODIES_SQL + f""",
accepted AS (SELECT *, done AND NOT (chat AND tools) AS finished, done AND tools AS called FROM bodies WHERE fault = 0 OR fault > 10),
parsed AS (SELECT okey AS key, exchange_id, sha256(encode(request) || '\\x00'::blob || encode(response)) AS content_sha256, {sha('request')} AS request_sha256,
  {sha('response')} AS response_sha256, trajectory_id, CASE WHEN trajectory_id IS NULL THEN 'request' ELSE 'trajectory' END AS source_group_kind,
  CASE WHEN trajectory_id IS NULL THEN {sha('request')} ELSE {group_sha('trajectory_id')} END AS source_group_sha256,
  CASE WHEN chat THEN 'chat_completions' ELSE 'responses' END AS endpoint, streaming, 'm' || (conv_id % 3) AS model, status, (status // 100) || 'xx' AS status_class,
  status = 200 AS success, finished AS model_completed, true AS request_parse, true AS response_parse, true AS parse, 'primary' AS route_target, 'none' AS fallback_reason,
  'text' AS modalities, tools::int::bigint AS tool_definitions, called::int::bigint AS tool_calls, called::int::bigint AS tool_argument_total, (called AND chat)::int::bigint AS tool_argument_valid,
  false AS structured_output, 'none' AS reasoning_effort, false AS refusal,
  CASE WHEN NOT finished AND status = 200 THEN 'incomplete' WHEN chat AND done THEN 'stop' WHEN status = 200 THEN 'success' ELSE 'upstream_failure' END AS outcome,
  octet_length(encode(request)) AS request_bytes, octet_length(encode(response)) AS response_bytes, chat::int::bigint AS message_count, (NOT chat)::int::bigint AS input_item_count,
  CASE WHEN streaming THEN 50 END AS ttft_ms, total_ms, CASE WHEN done THEN tok * 1000000 // total_ms END AS tps_milli, CASE WHEN done THEN ti END AS input_tokens,
  CASE WHEN done THEN tok END AS output_tokens, CASE WHEN done AND chat THEN ti // 2 END AS cached_tokens,
  concat_ws(chr(10), CASE WHEN NOT chat THEN 'Answer.' END, CASE WHEN request_text <> '' THEN request_text END) AS request_text,
  concat_ws(chr(10), CASE WHEN called AND NOT chat THEN {FLAT_EVENT} END, CASE WHEN done AND response_text <> '' THEN response_text END, CASE WHEN called AND chat THEN {CALL_EVENT} END) AS response_text
  FROM accepted)"""


def feature_rows(spark, folder):
    return features.parse_exchanges(scanned(spark, folder))


@query("exchange_features", with_views(FEATURE_SQL, body="SELECT * FROM parsed"))
def exchange_features(spark, folder):
    rows = feature_rows(spark, folder)
    return rows.select(
        *[c for c in rows.columns if c not in ("usage", "modalities", "started_at", "completed_at", "has_request_response_text")],
        F.array_join("modalities", "+").alias("modalities"), "usage.input_tokens", "usage.output_tokens", "usage.cached_tokens",
    )


@query("modalities", with_views(FEATURE_SQL, body="SELECT modalities AS modality, endpoint, count(*) AS n FROM parsed GROUP BY 1, 2"))
def modalities(spark, folder):
    rows = feature_rows(spark, folder).select("endpoint", F.explode("modalities").alias("modality"))
    return rows.groupBy("modality", "endpoint").agg(F.count("*").alias("n"))


@query("outcome_class", with_views(FEATURE_SQL, body="SELECT key, outcome FROM parsed"))
def outcome_class(spark, folder):
    return feature_rows(spark, folder).select("key", "outcome")


@query(
    "eligible_rows",
    with_views(FEATURE_SQL, body=f"""SELECT key, {split_of(split_bucket('source_group_sha256', 'source_group_kind'))} AS split FROM parsed
WHERE tool_definitions = 0 AND tool_calls = 0 AND success AND model_completed AND trim(response_text) <> ''"""),
)
def eligible_rows(spark, folder):
    split = sf.split_of_group("source_group_sha256", "source_group_kind").alias("split")
    return feature_rows(spark, folder).where(features.eligible_for_eval()).select("key", split)


@query(
    "sse_events",
    with_views(BODIES_SQL, body="""SELECT okey AS key, 0 AS event_index, CASE WHEN chat THEN NULL WHEN done THEN 'response.output_text.delta' ELSE 'response.failed' END AS event_type,
  CASE WHEN chat AND done THEN response_text WHEN chat THEN '' END AS content FROM bodies WHERE streaming
UNION ALL SELECT okey, 1, CASE WHEN chat THEN NULL ELSE 'response.completed' END, NULL FROM bodies WHERE streaming AND done"""),
)
def sse_events(spark, folder):
    events = features.sse_events(views.bodies(spark, folder).where("streaming"), "response", "key")
    return events.select(
        "key", "event_index", F.try_variant_get("event", "$.type", "string").alias("event_type"),
        F.try_variant_get("event", "$.choices[0].delta.content", "string").alias("content"),
    )


@query(
    "sse_summary",
    with_views(BODIES_SQL, body="""SELECT okey AS key, CASE WHEN chat AND done THEN response_text ELSE '' END AS text,
  CASE WHEN chat AND done THEN ti END AS input_tokens, CASE WHEN chat AND done AND response_text <> '' THEN 0 END AS first_text_event,
  1 + done::int AS events FROM bodies WHERE streaming"""),
)
def sse_summary(spark, folder):
    events = features.sse_events(views.bodies(spark, folder).where("streaming"), "response", "key")
    found = features.sse_summary(events, "key")
    return found.select("key", "text", F.get_json_object("usage", "$.prompt_tokens").cast("bigint").alias("input_tokens"), "first_text_event", "events")


@query(
    "usage_coalesce",
    with_views(TIMINGS, body="""SELECT event_id, CASE WHEN model IN ('click', 'view', 'purchase') THEN output_tokens + 1 END AS input_tokens,
  CASE WHEN model = 'signup' THEN NULL ELSE output_tokens END AS output_tokens, CASE WHEN model IN ('click', 'view') THEN output_tokens // 2 END AS cached_tokens FROM timings"""),
)
def usage_coalesce(spark, folder):
    rows = views.timings(spark, folder)
    k = F.col("output_tokens")
    half = F.call_function("div", k, F.lit(2))
    # Two spellings, a fraction, a boolean and a negative count.
    spelled = (
        F.when(F.col("model") == "click", F.to_json(F.struct((k + 1).alias("input_tokens"), k.alias("output_tokens"), F.struct(half.alias("cached_tokens")).alias("input_tokens_details"))))
        .when(F.col("model") == "view", F.to_json(F.struct((k + 1).alias("prompt_tokens"), k.alias("completion_tokens"), F.struct(half.alias("cached_tokens")).alias("prompt_tokens_details"))))
        .when(F.col("model") == "purchase", F.to_json(F.struct(F.lit(-1).alias("input_tokens"), (k + 1).alias("prompt_tokens"), k.alias("output_tokens"), F.lit(0.5).alias("x"))))
        .when(F.col("model") == "signup", F.to_json(F.struct(F.lit(True).alias("input_tokens"), F.lit("7").alias("output_tokens"))))
        .otherwise(F.to_json(F.struct(F.lit(1.5).alias("input_tokens"), k.alias("completion_tokens"))))
    )
    usage = features.usage_of_variant(F.parse_json(spelled))
    return rows.select("event_id", usage["input_tokens"].alias("input_tokens"), usage["output_tokens"].alias("output_tokens"), usage["cached_tokens"].alias("cached_tokens"))


@query(
    "conversation_examples",
    with_views(BODIES_SQL, body="""SELECT okey AS key, CASE WHEN streaming THEN 'streaming_not_supported' WHEN chat AND NOT done THEN 'multiple_or_missing_choices'
  WHEN NOT done THEN 'incomplete_assistant_turn' WHEN NOT chat AND tools THEN 'invalid_tool_arguments' WHEN response_text = '' AND NOT tools THEN 'no_visible_assistant_target' END AS reason,
  CASE WHEN reason IS NULL THEN 1 + (NOT chat)::int END AS context_messages, CASE WHEN reason IS NULL THEN tools::int END AS tools, CASE WHEN reason IS NULL THEN response_text END AS target,
  CASE WHEN reason IS NULL THEN tools::int END AS target_calls FROM bodies"""),
)
def conversation_examples(spark, folder):
    rows = convo.decode_examples(views.bodies(spark, folder))
    target = F.try_element_at("targets", F.lit(1))
    return rows.select(
        "key", F.col("reject_reason").alias("reason"), F.size(F.col("messages")).alias("m"), F.size("tool_names").alias("t"), F.coalesce(target["content"], F.array_join(target["parts"], "")).alias("target"),
        F.size(target["tool_calls"]).alias("c"),
    ).select(
        "key", "reason", F.when(F.col("reason").isNull(), F.col("m")).alias("context_messages"), F.when(F.col("reason").isNull(), F.col("t")).alias("tools"), "target",
        F.when(F.col("reason").isNull(), F.col("c")).alias("target_calls"),
    )


@query(
    "tool_sequence_violations",
    with_views(EXCHANGES, body="""SELECT key, CASE conv_id % 8 WHEN 1 THEN 'orphan_or_duplicate_tool_result' WHEN 2 THEN 'interrupted_tool_sequence' WHEN 3 THEN 'duplicate_or_unknown_tool_call'
  WHEN 4 THEN 'historical_tool_results_missing' WHEN 5 THEN 'nonassistant_target' WHEN 6 THEN 'duplicate_or_unknown_tool_call' END AS problem FROM exchanges"""),
)
def tool_sequence_violations(spark, folder):
    rows = views.exchanges(spark, folder)
    calls = "array<struct<id:string,name:string,arguments:string>>"
    none = F.array().cast(calls)

    def message(role, content=None, call=None, name="search", answer=None):
        made = F.array(F.struct(F.lit(call).alias("id"), F.lit(name).alias("name"), F.lit("{}").alias("arguments"))).cast(calls) if call else none
        text = F.col(content) if content else F.lit(None).cast("string")
        return F.struct(F.lit(role).alias("role"), text.alias("content"), F.lit(answer).cast("string").alias("tool_call_id"), made.alias("tool_calls"))

    user, reply = message("user", "request_text"), message("assistant", "response_text")
    call, result = message("assistant", call="a"), message("tool", "response_text", answer="a")
    kind = F.col("conv_id") % 8
    context = (
        F.when(kind == 1, F.array(user, call, result, result)).when(kind == 2, F.array(user, call, user, result))
        .when(kind == 3, F.array(user, call, result, call, result)).when(kind == 4, F.array(user, call))
        .when(kind == 6, F.array(user, message("assistant", call="b", name="other")))
        .when(kind == 7, F.array(user, call, message("assistant", call="b"), message("tool", "response_text", answer="b"), result))
        .otherwise(F.array(user, call, result))
    )
    targets = F.when(kind == 5, F.array(user)).otherwise(F.array(reply))
    problem = convo.tool_sequence_problem(context, targets, F.array(F.lit("search")))
    return rows.select("key", problem.alias("problem"))


#: What is written behind the documents, by doc_id mod 8, and what redaction leaves of it.
PLANTED = (
    ("", ""),
    (" API_KEY=abc123 next", " API_KEY=[redacted] next"),
    (" {''my-secret'': ''v w''}", " {''my-secret'': ''[redacted]''}"),
    (" Authorization: Bearer abc.def, x", " Authorization: Bearer [redacted], x"),
    (" TOKEN_FILE=/etc/x password: p;q", " TOKEN_FILE=/etc/x password: [redacted];q"),
    (' note: "db_password_2" = "a\\"b" c', ' note: "db_password_2" = "[redacted]" c'),
    (" CREDENT\u0130ALS=abc tokens=kept", " CREDENT\u0130ALS=[redacted] tokens=kept"),
    (" passwd=\"open", " passwd=[redacted]"),
)
_CASES = lambda k: "CASE doc_id % 8 " + " ".join(f"WHEN {i} THEN '{pair[k]}'" for i, pair in enumerate(PLANTED)) + " END"


@query(
    "redact_documents",
    f"""SELECT doc_id, raw <> clean AS changed, {sha('clean')} AS redacted_sha256 FROM (SELECT doc_id, text || {_CASES(0)} AS raw,
  regexp_replace(text, '(token = )"[^"]*"', '\\1"[redacted]"', 'g') || {_CASES(1)} AS clean FROM documents)""",
)
def redact_documents(spark, folder):
    planted = F.element_at(F.array(*[F.lit(pair[0].replace("''", "'")) for pair in PLANTED]), (F.col("doc_id") % 8 + 1).cast("int"))
    docs = table(spark, folder, "documents").withColumn("raw", F.concat("text", planted)).withColumn("clean", redact.redact("raw"))
    return docs.select("doc_id", (F.col("raw") != F.col("clean")).alias("changed"), sf.sha256_text("clean").alias("redacted_sha256"))


CUT_SQL = """from_hex(regexp_replace(regexp_replace({hex}, '^(?:[89AB][0-9A-F])+', ''), '(?:[CD][0-9A-F]|E[0-9A-F](?:[89AB][0-9A-F])?|F[0-9A-F](?:[89AB][0-9A-F])?(?:[89AB][0-9A-F])?)$', ''))"""
HEX = "hex(encode(text))"


@query(
    "utf8_excerpt",
    f"""SELECT doc_id, sha256({CUT_SQL.format(hex=f'substr({HEX}, 1, 4096)')}) AS prefix_sha256, CASE WHEN octet_length(encode(text)) <= 2048 THEN sha256(encode(text)) ELSE
  sha256({CUT_SQL.format(hex=f'substr({HEX}, 1, 1348)')} || encode(chr(10) || '...[middle omitted]...' || chr(10)) || {CUT_SQL.format(hex=f'right({HEX}, 2700)')}) END AS excerpt_sha256 FROM documents""",
)
def utf8_excerpt(spark, folder):
    docs = table(spark, folder, "documents")
    plain = features.classifier_excerpt("text", 2048, F.lit(False))
    tool = features.classifier_excerpt("text", 2048, F.lit(True))
    return docs.select("doc_id", sf.sha256_text(plain).alias("prefix_sha256"), sf.sha256_text(tool).alias("excerpt_sha256"))


@query(
    "recent_budget",
    """SELECT conv_id, turn, used FROM (SELECT conv_id, turn, sum(least(octet_length(encode(text)) + 3, 2048)) OVER (PARTITION BY conv_id ORDER BY turn DESC)::bigint AS used
  FROM conversations) WHERE used <= 2048""",
)
def recent_budget(spark, folder):
    return convo.recent_budget(table(spark, folder, "conversations"), ["conv_id"], "turn", "text", 2048).select("conv_id", "turn", "used")


@query(
    "last_k_turns",
    """WITH p AS (SELECT conv_id, turn FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS n FROM conversations WHERE role = 'user') WHERE n = 2)
SELECT c.conv_id, c.turn, c.role FROM conversations c LEFT JOIN p USING (conv_id) WHERE p.turn IS NULL OR c.turn >= p.turn""",
)
def last_k_turns(spark, folder):
    turns = table(spark, folder, "conversations")
    return convo.last_k_turns(turns, ["conv_id"], "turn", F.col("role") == "user", k=2).select("conv_id", "turn", "role")


BUDGET = 2500
CONTEXT_SQL = f"""WITH RECURSIVE kinds AS (SELECT conv_id, turn, role AS said, text,
  CASE role WHEN 'assistant' THEN 'assistant' ELSE 'user' END AS role,
  CASE WHEN role = 'user' THEN row_number() OVER (PARTITION BY conv_id, role ORDER BY turn DESC) <= 2 ELSE false END AS required FROM conversations),
shaped AS (SELECT conv_id, turn, required, octet_length(encode('{{"role":"' || role || '","content":' || to_json(CASE WHEN said = 'system'
    THEN 'Command:' || chr(10) || chr(10) || 'Exit: 0' || chr(10) || 'Output:' || chr(10) || text ELSE text END)::varchar || '}}')) + 1 AS size,
  octet_length(encode(text)) AS raw FROM kinds),
ranked AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS n, sum(CASE WHEN required THEN size ELSE 0 END) OVER (PARTITION BY conv_id) AS base FROM shaped),
walk AS (SELECT conv_id, 0 AS n, max(base)::bigint + 2 AS used, []::bigint[] AS kept FROM ranked GROUP BY conv_id
  UNION ALL SELECT w.conv_id, r.n, CASE WHEN r.required OR w.used + r.size > {BUDGET} THEN w.used ELSE w.used + r.size END,
    CASE WHEN r.required OR w.used + r.size <= {BUDGET} THEN list_append(w.kept, r.turn) ELSE w.kept END FROM walk w JOIN ranked r ON r.conv_id = w.conv_id AND r.n = w.n + 1)
SELECT conv_id, unnest(kept) AS turn FROM (SELECT conv_id, kept FROM walk QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY n DESC) = 1)"""


def step_log(spark, folder):
    """Conversations as step logs: user turns are prompts, answers are final, system turns are shell output."""
    turns = table(spark, folder, "conversations")
    kind = F.when(F.col("role") == "user", "prompt").when(F.col("role") == "assistant", "final").otherwise("shell-output")
    return turns.select(
        "conv_id", "turn", kind.alias("kind"), F.col("text").alias("content"), F.lit("").alias("command"), F.lit(0).alias("exit_code"),
        F.lit(None).cast("string").alias("call_id"), F.lit(None).cast("string").alias("message"),
    )


@query("context_window", CONTEXT_SQL)
def context_window(spark, folder):
    piece = F.call_function("div", F.col("turn"), F.lit(views.TURNS_PER_PIECE))
    messages = convo.render_log(step_log(spark, folder), ["conv_id"], "turn", BUDGET, piece)
    return convo.context_window(messages, ["conv_id"], "turn", BUDGET).select("conv_id", "turn")


PACK_SQL = "WITH RECURSIVE " + SAMPLING_SQL + f""",
chosen AS (SELECT key, request_bytes % 5000 AS size, row_number() OVER (ORDER BY key) AS n FROM eligible),
pack AS (SELECT 0::bigint AS n, -1 AS batch, 48 AS cnt, 0::bigint AS used, NULL::varchar AS key
  UNION ALL SELECT c.n, CASE WHEN full_ THEN p.batch + 1 ELSE p.batch END, CASE WHEN full_ THEN 1 ELSE p.cnt + 1 END, CASE WHEN full_ THEN c.size ELSE p.used + c.size + 1 END, c.key
  FROM (SELECT p.*, p.cnt >= 48 OR 1000 + p.used + c.size + 1 > 65536 AS full_ FROM pack p JOIN chosen c ON c.n = p.n + 1) p JOIN chosen c ON c.n = p.n + 1)
SELECT key, batch FROM pack WHERE n > 0"""


@query("pack_batches", PACK_SQL)
def pack_batches(spark, folder):
    sized = eligible_features(spark, folder).select("key", (F.col("request_bytes") % 5000).alias("size"))
    return convo.pack_batches(sized, "key", "size", overhead=1000).select("key", "batch")
