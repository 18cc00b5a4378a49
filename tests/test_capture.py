import base64
import hashlib
import json
import uuid

import pytest
import zstandard
from pyspark.sql import functions as F

from loomtrace.functions.jsonwalk import json_nodes, walk
from loomtrace.operators import features
from loomtrace.sources import captures, steplog

SCOPE = str(uuid.uuid5(uuid.NAMESPACE_URL, "scope"))
IDENT = "01900000-0000-7000-8000-000000000001"


def side(raw: bytes, **changes):
    return {"body_base64": base64.b64encode(raw).decode(), "byte_len": len(raw), "sha256": hashlib.sha256(raw).hexdigest(), **changes}


def envelope(ask=b'{"model":"m","messages":[{"role":"user","content":"hi"}]}', reply=b'{"choices":[]}', **changes):
    value = {
        "schema_version": "exchange.v2", "scope_id": SCOPE, "profile": "production", "complete": True, "exchange_id": IDENT, "trajectory_id": None,
        "started_at": "2024-01-01T00:00:00Z", "completed_at": "2024-01-01T00:00:01Z", "endpoint": "chat_completions", "streaming": False,
        "request": side(ask), "response": side(reply, status=200), "timing": {"total_ms": 1000},
    }
    return {**value, **changes}


def scan(spark, envelopes):
    rows = [(f"{i}/{IDENT}.json.zst", e if isinstance(e, str) else json.dumps(e)) for i, e in enumerate(envelopes)]
    return captures.scan_envelopes(spark.createDataFrame(rows, "key string, body string"), SCOPE, "production")


def test_every_broken_rule_has_its_reason(spark):
    body = b'{"choices":[]}'
    planted = [
        (envelope(), None),
        ("not json", "not_an_exchange"),
        (envelope(schema_version="exchange.v1"), "not_an_exchange"),
        (envelope(scope_id="other"), "scope_profile_or_completion"),
        (envelope(complete=False), "scope_profile_or_completion"),
        (envelope(exchange_id="x"), "exchange_id_invalid"),
        (envelope(exchange_id=IDENT.replace("-7000", "-4000")), "exchange_id_invalid"),
        (envelope(exchange_id=IDENT[:-1] + "2"), "exchange_id_differs_from_key"),
        (envelope(trajectory_id="00000000-0000-0000-0000-000000000000"), "trajectory_id_invalid"),
        (envelope(trajectory_id=IDENT.upper().replace("0", "A")), "trajectory_id_invalid"),
        (envelope(started_at="2024-01-01T00:00:00+01:00"), "timestamp_invalid"),
        (envelope(completed_at="2023-12-31T23:59:59Z"), "completes_before_start"),
        (envelope(request=side(body, byte_len=1)), "request_identity_differs"),
        (envelope(request=side(body, sha256="0" * 64)), "request_identity_differs"),
        (envelope(request=side(body, body_base64="*")), "request_not_base64"),
        (envelope(response={"status": 200}), "response_missing"),
        (envelope(response=side(body, status=99)), "status_invalid"),
        (envelope(timing={"total_ms": -1}), "timing_invalid"),
        (envelope(timing={"total_ms": 1, "ttft_ms": -1}), "timing_invalid"),
    ]
    rows = scan(spark, [e for e, _ in planted]).select("key", "reject_reason").collect()
    got = {int(r.key.split("/")[0]): r.reject_reason for r in rows}
    assert got == {i: reason for i, (_, reason) in enumerate(planted)}


def test_zstd_objects(spark, tmp_path):
    good = zstandard.ZstdCompressor().compress(json.dumps(envelope()).encode())
    (tmp_path / "c").mkdir()
    (tmp_path / "c" / f"{IDENT}.json.zst").write_bytes(good)
    (tmp_path / "c" / "broken.json.zst").write_bytes(b"no zstd")
    objects = captures.read_objects(spark, str(tmp_path))
    rows = {r.key.rsplit("/", 1)[1]: r for r in captures.scan_envelopes(objects, SCOPE, "production").collect()}
    assert rows[f"{IDENT}.json.zst"].reject_reason is None
    assert rows[f"{IDENT}.json.zst"].object_sha256 == hashlib.sha256(good).hexdigest()
    assert rows["broken.json.zst"].reject_reason == "not_an_exchange"


def test_oversized_objects_and_streams(spark, tmp_path):
    packed = lambda raw: zstandard.ZstdCompressor().compress(raw)
    folder = tmp_path / "c"
    folder.mkdir()
    body = json.dumps(envelope()).encode()
    (folder / f"{IDENT}.json.zst").write_bytes(packed(body))
    (folder / "large.json.zst").write_bytes(packed(b" " * (len(body) + 1) + body))
    (folder / "bytes.json.zst").write_bytes(packed(b"\xff\xfe"))
    (folder / "other.txt").write_bytes(b"not read")
    reasons = lambda rows: sorted((r.key.rsplit("/", 1)[1], r.reject_reason) for r in rows.select("key", "reject_reason").collect())
    read = lambda limit: captures.scan_envelopes(captures.read_objects(spark, str(tmp_path), limit), SCOPE, "production")
    want = [(f"{IDENT}.json.zst", None), ("bytes.json.zst", "not_an_exchange"), ("large.json.zst", "oversized")]
    assert reasons(read(len(body))) == want
    assert dict(reasons(read(len(body) - 1)))[f"{IDENT}.json.zst"] == "oversized"
    assert dict(reasons(read(10**6)))["large.json.zst"] == "exchange_id_differs_from_key"

    # The stream gives the same rows, object by object, and takes up where it was when more come, keys before the last one included.
    def stream():
        rows = captures.scan_envelopes(captures.stream_objects(spark, str(tmp_path), len(body), 1), SCOPE, "production").select("key", "reject_reason")
        query = rows.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "log")).trigger(availableNow=True).start()
        query.awaitTermination(120)
        assert query.exception() is None
        return reasons(spark.read.parquet(str(tmp_path / "out")))

    assert stream() == want
    (folder / "a-late.json.zst").write_bytes(b"no zstd")
    assert stream() == sorted([*want, ("a-late.json.zst", "not_an_exchange")], key=str)


def test_deep_json_is_walked(spark):
    deep = "{\"a\":" * 5000 + "{\"text\":\"down here\"}" + "}" * 5000
    rows = spark.createDataFrame([(["[" * 5000 + "{\"b\":[1,{\"c\":2}]}" + "]" * 5000],), ([deep],)], "docs array<string>")
    first, second = (r[0] for r in rows.select(json_nodes("docs")).collect())
    assert [(n.parent, n.edge, n.item, n.ints) for n in first] == [(-1, None, True, {}), (0, "b", True, {"c": 2})]
    assert len(second) == 5001 and second[5000].strings == {"text": "down here"} and [n.parent for n in second] == list(range(-1, 5000))


def parse(spark, *envelopes):
    rows = features.parse_exchanges(scan(spark, envelopes), SCOPE).collect()
    return [r for r in sorted(rows, key=lambda r: int(r.key.split("/")[0]))]


def test_tool_exchange(spark):
    request = {
        "model": "m", "reasoning": {"effort": "low"}, "text": {"format": {"type": "json"}}, "instructions": "Be short.",
        "tools": [{"name": "f", "text": "hidden"}], "input": [
            {"role": "user", "content": [{"type": "input_text", "text": "look"}, {"type": "input_image"}]},
            {"type": "function_call", "call_id": "c1", "name": "f", "arguments": "{\"q\": 1}"},
            {"type": "function_call_output", "call_id": "c1", "output": "done"},
            {"type": "function_call_output", "call_id": "", "output": "dropped"},
        ],
    }
    response = {
        "status": "completed", "usage": {"input_tokens": None, "prompt_tokens": 5, "completion_tokens": 7, "completion_tokens_details": {"reasoning_tokens": 2}},
        "output": [{"type": "function_call", "call_id": "c2", "name": "f", "arguments": "{bad"}, {"type": "message", "content": [{"text": "ok"}]}],
    }
    row = parse(spark, envelope(json.dumps(request).encode(), json.dumps(response).encode(), endpoint="responses"))[0]
    assert row.modalities == ["image", "text"]
    assert (row.tool_definitions, row.tool_calls, row.tool_argument_total, row.tool_argument_valid) == (1, 1, 1, 0)
    assert (row.structured_output, row.reasoning_effort, row.model_completed, row.outcome) == (True, "low", True, "success")
    assert (row.message_count, row.input_item_count) == (0, 4)
    # A key that is there but empty is not replaced by its other spelling.
    assert row.usage.asDict() == {"input_tokens": None, "output_tokens": 7, "cached_tokens": None, "reasoning_tokens": 2}
    assert row.request_text.split("\n") == [
        "Be short.", "look", '{"type":"function_call","name":"f","arguments":"{\\"q\\": 1}","call_id":"c1"}',
        '{"type":"function_call_output","call_id":"c1","output":"done"}',
    ]
    assert row.response_text == '{"type":"function_call","name":"f","arguments":"{bad","call_id":"c2"}\nok'
    assert row.tps_milli == 7000 and row.has_request_response_text


def test_broken_bodies_and_last_usage(spark):
    stream = 'data: {"usage":{"output_tokens":1}}\r\n\r\nevent: x\ndata: {"a":{"usage":{"output_tokens":9}},"usage":{"output_tokens":3}}\ndata: [DONE]\n'
    rows = parse(
        spark,
        envelope(b"{", b"nope"),
        envelope(b"\xff", stream.encode(), streaming=True),
        envelope(b"[1]", b"event: none\n", streaming=True),
        envelope(b'{"messages":[]}', json.dumps({"choices": [{"index": 0, "finish_reason": "length", "message": {"refusal": "no"}}]}).encode()),
    )
    assert [(r.request_parse, r.response_parse, r.parse) for r in rows] == [(False, False, False), (False, True, False), (True, False, False), (True, True, True)]
    # The holder visited last decides, here the inner object.
    assert rows[1].usage.output_tokens == 9
    assert rows[0].modalities == ["unknown"] and rows[0].outcome == "incomplete"
    assert rows[3].refusal and rows[3].outcome == "refusal" and rows[3].model == "unknown"


@pytest.mark.parametrize(
    "endpoint,docs,want",
    [
        ("responses", [{"status": "completed"}], True),
        ("responses", [{"status": "incomplete"}], False),
        ("responses", [{"type": "response.completed", "response": {"status": "completed"}}], True),
        ("responses", [{"type": "x"}, {"type": "response.completed", "response": {"status": "completed"}}], True),
        ("responses", [{"type": "response.completed", "response": {"status": "failed"}}], False),
        ("responses", [{"type": "response.failed"}, {"type": "response.completed", "response": {"status": "completed"}}], False),
        ("chat_completions", [{"choices": [{"index": 0, "finish_reason": "stop"}]}], True),
        ("chat_completions", [{"choices": [{"index": 0}]}, {"choices": [{"index": 0, "finish_reason": "stop"}]}], True),
        ("chat_completions", [{"choices": [{"index": 0, "finish_reason": "stop"}, {"index": 1}]}], False),
        ("chat_completions", [{"choices": [{"index": 0, "finish_reason": "stop"}]}, {"choices": [{"index": 0, "finish_reason": "length"}]}], False),
        ("chat_completions", [{"choices": [{"finish_reason": "stop"}]}], False),
        ("chat_completions", [{"choices": [{"index": True, "finish_reason": "stop"}]}], False),
        ("chat_completions", [{"choices": [7]}], False),
        ("chat_completions", [{"choices": []}], False),
        ("other", [{"status": "completed"}], False),
    ],
)
def test_model_completed(spark, endpoint, docs, want):
    frame = spark.createDataFrame([(endpoint, [json.dumps(d) for d in docs])], "e string, d array<string>")
    nodes = frame.withColumn("n", json_nodes("d"))
    assert nodes.select(features.model_completed(F.col("e"), F.col("n"), F.col("d"))).first()[0] is want


def test_walk_order_and_lone_surrogates():
    nodes = walk(['{"a":{"t":"\\ud800x"},"l":[{"i":1},[{"i":2}],3],"big":99999999999999999999,"b":true}'])
    assert [(n["parent"], n["edge"], n["item"]) for n in nodes] == [(-1, None, False), (0, "a", False), (0, "l", True), (0, "l", True)]
    assert dict(nodes[0]["kinds"]) == {"a": "object", "l": "list", "big": "integer", "b": "boolean"} and nodes[0]["ints"] == []
    assert dict(nodes[1]["strings"]) == {"t": "�x"}
    assert walk(["{}", "{"]) is None


def test_step_log(spark, tmp_path):
    lines = ['{"type":"prompt","content":"do"}', "broken {", "[1]", '{"type":"reasoning","usage":{"prompt_tokens":3},"message":{"tool_calls":[{"function":{"name":"run"}},{}]}}', '{"type":"shell-output","exit":2}']
    # Text behind the value spoils a line; of repeated members the last one counts.
    lines += ['{"type":"spoilt"} junk', '{"type":"first","type":"agent","content":"c"}']
    (tmp_path / "log.jsonl").write_text("\n".join(lines))
    from loomtrace.operators.convo import tool_histogram

    steps = steplog.read_steps(spark, str(tmp_path))
    assert sorted((r.type, r.content, r.exit_code, r.usage.input_tokens) for r in steps.collect()) == [
        ("agent", "c", None, None), ("prompt", "do", None, None), ("reasoning", "", None, 3), ("shell-output", "", 2, None)
    ]
    assert sorted(map(tuple, tool_histogram(steps).collect())) == [("run", 1), ("unknown", 1)]
