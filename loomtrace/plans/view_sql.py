"""The base views as standard SQL, for the side-by-side check of every bound query."""

SCOPE_HEX = "0000000000004000800000000000abcd"
WS = r"[\x09-\x0d\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def sha(text: str) -> str:
    return f"sha256(encode({text}))"


def group_sha(trajectory: str) -> str:
    return (
        f"sha256('source-group.v1'::blob || '\\x00'::blob || from_hex('{SCOPE_HEX}')"
        f" || from_hex(replace({trajectory}, '-', '')))"
    )


def split_bucket(group: str, kind: str) -> str:
    digest = (
        f"sha256(CASE WHEN {kind} = 'request' THEN 'split.request.v1'::blob ELSE 'split.trajectory.v1'::blob END"
        f" || '\\x00'::blob || from_hex({group}))"
    )
    return f"(('0x' || substr({digest}, 1, 4))::int % 10000)"


def split_of(bucket: str) -> str:
    return (
        f"CASE WHEN {bucket} < 8000 THEN 'train' WHEN {bucket} < 9000 THEN 'dev'"
        f" WHEN {bucket} < 9500 THEN 'calibration' ELSE 'sealed' END"
    )


def rate(n: str, d: str) -> str:
    return f"(CASE WHEN {d} <= 0 THEN 0 ELSE least(10000, ({n} * 10000 + {d} // 2) // {d}) END)::bigint"


def wilson(s: str, n: str, sign: str) -> str:
    z = "1.959963984540054::double"
    p = f"(({s})::double / ({n})::double)"
    d = f"(1.0::double + {z} * {z} / ({n})::double)"
    centre = f"(({p} + {z} * {z} / (2.0::double * ({n})::double)) / {d})"
    inner = f"{p} * (1.0::double - {p}) / ({n})::double + {z} * {z} / (4.0::double * ({n})::double * ({n})::double)"
    margin = f"({z} * sqrt({inner}) / {d})"
    bound = f"greatest({centre} - {margin}, 0.0::double)" if sign == "-" else f"least({centre} + {margin}, 1.0::double)"
    return f"(CASE WHEN {n} <= 0 THEN 0 ELSE floor({bound} * 10000 + 0.5) END)::bigint"


def bucket2(v: str) -> str:
    return f"(CASE WHEN {v} <= 1 THEN {v} ELSE (1::bigint << length(bin(({v} - 1)::bigint))) END)::bigint"


EXCHANGES = f"""
ex_turns AS (
  SELECT conv_id, turn, role, text, lead(role) OVER w AS nr, lead(text) OVER w AS nt
  FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
ex_user AS (
  SELECT conv_id, turn, printf('c/%09d/%04d', conv_id, turn) AS key, text AS request_text,
    CASE WHEN nr = 'assistant' THEN nt ELSE '' END AS response_text,
    coalesce(nr = 'assistant', false) AS model_completed,
    CASE WHEN conv_id % 4 <> 0 THEN printf('00000000-0000-4000-8000-%012d', conv_id) END AS trajectory_id,
    1704067200 + conv_id * 60 + turn * 7 AS start_s
  FROM ex_turns WHERE role = 'user'),
exchanges AS (
  SELECT *, {sha('request_text')} AS request_sha256, {sha('response_text')} AS response_sha256,
    sha256(encode(request_text) || '\\x00'::blob || encode(response_text)) AS content_sha256,
    octet_length(encode(request_text)) AS request_bytes, octet_length(encode(response_text)) AS response_bytes,
    CASE WHEN trajectory_id IS NULL THEN 'request' ELSE 'trajectory' END AS source_group_kind,
    CASE WHEN trajectory_id IS NULL THEN {sha('request_text')} ELSE {group_sha('trajectory_id')} END AS source_group_sha256,
    strftime(make_timestamp((start_s + octet_length(encode(response_text)) % 97) * 1000000), '%Y-%m-%dT%H:%M:%SZ') AS completed_at
  FROM ex_user)"""

TIMINGS = """
timings AS (
  SELECT event_id, user_id, event_type AS model, CASE WHEN event_type = 'error' THEN 500 ELSE 200 END AS status,
    ts AS started_at, cast(round(value * 1000) AS bigint) AS total_ms,
    make_timestamp(epoch_us(ts) + cast(round(value * 1000) AS bigint) * 1000) AS completed_at,
    cast(json_extract_string(props, '$.k') AS bigint) AS output_tokens
  FROM events)"""

FEATURES = TIMINGS + f""",
feature_base AS (
  SELECT *, output_tokens AS k, status = 200 AS success FROM timings),
feature_rows AS (
  SELECT event_id, printf('e/%09d', event_id) AS key, user_id,
    CASE WHEN user_id % 2 = 0 THEN 'responses' ELSE 'chat_completions' END AS endpoint, model, status,
    (status // 100)::varchar || 'xx' AS status_class, user_id % 3 = 0 AS streaming, success,
    success AND k % 9 <> 0 AS model_completed, k % 43 <> 0 AS request_parse, success OR k % 5 <> 0 AS response_parse,
    k % 43 <> 0 AND (success OR k % 5 <> 0) AS parse, success AND k % 17 = 0 AS refusal,
    CASE WHEN k % 7 = 0 THEN 'fallback' ELSE 'primary' END AS route_target,
    CASE WHEN k % 7 = 0 THEN 'timeout' ELSE 'none' END AS fallback_reason,
    CASE WHEN k % 31 = 0 THEN ['image', 'text'] ELSE ['text'] END AS modalities,
    k % 11 = 0 AS structured_output, CASE WHEN k % 13 = 0 THEN 'high' ELSE 'none' END AS reasoning_effort,
    CASE WHEN success AND k % 17 = 0 THEN 'refusal' WHEN success AND k % 9 = 0 THEN 'incomplete'
      WHEN k % 3 = 0 THEN 'length' WHEN success THEN 'stop' ELSE 'upstream_failure' END AS outcome,
    k % 4 AS tool_definitions, CASE WHEN k % 4 > 1 THEN k % 3 ELSE 0 END AS tool_calls,
    CASE WHEN k % 4 > 1 THEN k % 3 ELSE 0 END AS tool_argument_total,
    CASE WHEN k % 4 > 1 AND k % 5 <> 0 THEN k % 3 ELSE 0 END AS tool_argument_valid,
    total_ms * 3 + k AS request_bytes, k * 17 AS response_bytes, user_id % 5 AS message_count,
    user_id % 2 AS input_item_count, CASE WHEN user_id % 3 = 0 THEN total_ms // 3 END AS ttft_ms, total_ms,
    CASE WHEN total_ms > 0 THEN output_tokens * 1000000 // total_ms END AS tps_milli,
    k + user_id AS input_tokens, output_tokens, CASE WHEN k % 2 = 0 THEN k END AS cached_tokens,
    CASE WHEN k % 13 = 0 THEN k * 3 END AS reasoning_tokens, started_at, completed_at,
    {sha("concat_ws('/', model, output_tokens, user_id % 20)")} AS request_sha256,
    {sha("concat_ws('/', model, output_tokens, user_id % 20, total_ms % 10)")} AS content_sha256,
    CASE WHEN user_id % 4 <> 0 THEN printf('00000000-0000-4000-8000-%012d', user_id) END AS trajectory_id,
    CASE WHEN user_id % 4 = 0 THEN 'request' ELSE 'trajectory' END AS source_group_kind,
    CASE WHEN user_id % 4 = 0 THEN {sha("concat_ws('/', model, output_tokens, user_id % 20)")}
      ELSE {group_sha("printf('00000000-0000-4000-8000-%012d', user_id)")} END AS source_group_sha256
  FROM feature_base)"""

NORM = "array_to_string(regexp_extract_all(lower({t}), '[a-z0-9]+', 0), ' ')"

TEXTS = f"""
text_base AS (
  SELECT *, printf('00000000-0000-4000-8000-%012d', doc_id // 5) AS trajectory_id, {sha('text')} AS request_sha256,
    {sha(NORM.format(t='text'))} AS norm_sha256, 'trajectory' AS source_group_kind,
    {group_sha("printf('00000000-0000-4000-8000-%012d', doc_id // 5)")} AS source_group_sha256
  FROM documents),
texts AS (
  SELECT *, {split_of(split_bucket('source_group_sha256', 'source_group_kind'))} AS split FROM text_base)"""

OUTCOMES = """
outcomes AS (
  SELECT d.doc_id, l.quality = 1 AS task_correct, l.toxic = 1 AS unsafe
  FROM documents d LEFT JOIN labels l USING (doc_id))"""

RESULTS = """
results AS (
  SELECT l_orderkey, l_linenumber, l_returnflag AS branch, l_linestatus AS split,
    cast(round(l_discount * 100000) AS bigint) AS score_bps, cast(l_quantity AS bigint) AS latency_ms,
    (l_linenumber * 8)::bigint AS output_tokens
  FROM lineitem)"""


def with_views(*views: str, body: str) -> str:
    body = body.strip()
    head = "WITH " + ",".join(views)
    return head + ",\n" + body.removeprefix("WITH ") if body.startswith("WITH ") else head + "\n" + body
