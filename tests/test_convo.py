import json
import random
import re
import time

import pytest
from pyspark.sql import functions as F

from loomtrace.operators import convo, redact

CALL = {"id": "a", "type": "function", "function": {"name": "f", "arguments": "{}"}}
TOOLS = [{"type": "function", "function": {"name": "f", "parameters": {}}}]
USER = {"role": "user", "content": "q"}


def chat(messages, message=None, finish="stop", **request):
    reply = {"choices": [{"finish_reason": finish, "message": message or {"role": "assistant", "content": "a"}}]}
    return "chat_completions", False, {"messages": messages, **request}, reply


def flat(items, output=None, status="completed", **request):
    return "responses", False, {"input": items, **request}, {"status": status, "output": output if output is not None else [{"role": "assistant", "content": "a"}]}


CASES = [
    (chat([USER]), None),
    (("chat_completions", True, {}, {}), "streaming_not_supported"),
    (("chat_completions", False, [], {}), "invalid_protocol_body"),
    (chat([USER], conversation="c"), "server_side_history_missing"),
    (("other", False, {"messages": [USER]}, {}), "unsupported_endpoint"),
    (chat([USER], tools={"a": 1}), "invalid_tool_definitions"),
    (chat([USER], tools=[{"type": "web"}]), "unsupported_tool_definition"),
    (chat([USER], tools=[{"type": "function", "function": {"name": "f"}}]), "invalid_tool_definition"),
    (chat([USER], tools=TOOLS * 2), "duplicate_tool_definition"),
    (("chat_completions", False, {}, {"choices": []}), "missing_message_history"),
    (chat([]), "missing_message_history"),
    (chat([7]), "invalid_message"),
    (chat([{"type": "thing", "role": "user", "content": "x"}]), "unknown_response_item"),
    (chat([{"role": "user", "content": "x", "encrypted_content": "y"}]), "opaque_message_content"),
    (chat([{"role": "robot", "content": "x"}]), "unknown_message_role"),
    (chat([{"role": "user", "content": "x", "audio": {"id": 1}}]), "unsupported_message_semantics"),
    (chat([{"role": "user", "content": "x", "annotations": []}]), None),
    (chat([{"role": "user", "content": 5}]), "unsupported_content"),
    (chat([{"role": "user", "content": [{"type": "text", "text": "x"}, {"type": "image"}]}]), "multimodal_or_annotated_content"),
    (chat([{"role": "user", "content": [{"type": "text", "text": "x"}]}]), None),
    (chat([{"role": "user", "content": "x", "tool_calls": [CALL]}], tools=TOOLS), "invalid_tool_calls"),
    (chat([USER, {"role": "assistant", "content": None, "tool_calls": [{"id": "a", "type": "web"}]}]), "unsupported_tool_call"),
    (chat([USER, {"role": "assistant", "content": None, "tool_calls": [{**CALL, "id": ""}]}]), "invalid_tool_call"),
    (chat([USER, {"role": "assistant", "tool_calls": [{**CALL, "function": {"name": "f", "arguments": "{"}}]}]), "invalid_tool_arguments"),
    (chat([USER, {"role": "assistant", "tool_calls": [{**CALL, "function": {"name": "f", "arguments": "[]"}}]}]), "nonobject_tool_arguments"),
    (chat([USER, {"role": "assistant", "tool_calls": [{**CALL, "function": {"name": "f", "arguments": '{"a":1} x'}}]}]), "invalid_tool_arguments"),
    (chat([USER, {"role": "assistant", "tool_calls": [{**CALL, "function": {"name": "f", "arguments": '{"a":1,"a":2}'}}]}, {"role": "tool", "tool_call_id": "a", "content": "r"}], tools=TOOLS), None),
    (chat([USER, {"role": "tool", "content": "x"}]), "unsupported_tool_output"),
    (chat([USER, {"role": "assistant", "content": None}]), "missing_visible_message"),
    (chat([USER], finish="length"), "incomplete_assistant_turn"),
    (("chat_completions", False, {"messages": [USER]}, {"choices": [{}, {}]}), "multiple_or_missing_choices"),
    (chat([USER], {"role": "assistant", "content": ""}), "no_visible_assistant_target"),
    (chat([USER], {"role": "user", "content": "x"}), "nonassistant_target"),
    (chat([USER, {"role": "assistant", "tool_calls": [CALL]}, {"role": "tool", "tool_call_id": "a", "content": "r"}], tools=TOOLS), None),
    (chat([USER, {"role": "assistant", "tool_calls": [CALL]}], tools=TOOLS), "historical_tool_results_missing"),
    (chat([USER, {"role": "assistant", "tool_calls": [CALL]}, USER], tools=TOOLS), "interrupted_tool_sequence"),
    (chat([USER, {"role": "assistant", "tool_calls": [CALL]}, {"role": "tool", "tool_call_id": "b", "content": "r"}], tools=TOOLS), "orphan_or_duplicate_tool_result"),
    (chat([USER, {"role": "assistant", "tool_calls": [CALL]}, {"role": "tool", "tool_call_id": "a", "content": "r"}]), "duplicate_or_unknown_tool_call"),
    (chat([USER], {"role": "assistant", "content": None, "tool_calls": [CALL]}, finish="tool_calls", tools=TOOLS), None),
    (flat("hello"), None),
    (flat([USER], instructions="be brief"), None),
    (flat([USER], instructions=[1]), "unsupported_instructions"),
    (flat([USER], status="incomplete"), "incomplete_assistant_turn"),
    (flat([{"type": "reasoning", "encrypted_content": "z"}, USER]), None),
    (flat([USER, {"type": "function_call", "status": "in_progress", "call_id": "a", "name": "f", "arguments": "{}"}]), "incomplete_tool_call"),
    (flat([USER, {"type": "function_call_output", "call_id": "a"}]), "unsupported_tool_output"),
    (flat([USER], []), "no_visible_assistant_target"),
]


def test_decode_reasons(spark):
    rows = [(i, e, s, json.dumps(q), json.dumps(r)) for i, ((e, s, q, r), _) in enumerate(CASES)]
    frame = spark.createDataFrame(rows, "i int, endpoint string, streaming boolean, request string, response string")
    out = {r.i: r for r in convo.decode_examples(frame).collect()}
    got = {i: out[i].reject_reason for i in out}
    assert {i: (got[i], want) for i, (_, want) in enumerate(CASES) if got[i] != want} == {}
    with_lead = next(i for i, (c, _) in enumerate(CASES) if c[2] and isinstance(c[2], dict) and c[2].get("instructions") == "be brief")
    assert [(m.role, m.content) for m in out[with_lead].messages] == [("system", "be brief"), ("user", "q")]
    reasoned = next(i for i, (c, _) in enumerate(CASES) if isinstance(c[2], dict) and isinstance(c[2].get("input"), list) and c[2]["input"][0].get("type") == "reasoning")
    assert out[reasoned].omitted_reasoning and len(out[reasoned].messages) == 1


def plain_context(messages, limit):
    """The same choice made row by row. `messages` are (place, size, required, is_call, answers)."""
    answered = {m[4] for m in messages if m[4] is not None}
    used = 2 + sum(m[1] for m in messages if m[2])
    kept = {m[0] for m in messages if m[2]}
    for place, size, required, is_call, _ in reversed(messages):
        if required or (is_call and place not in answered) or used + size > limit:
            continue
        kept.add(place)
        used += size
    for place, *_, answers in messages:
        if answers is not None and not {place, answers} <= kept:
            kept -= {place, answers}
    return kept


def test_context_window_equals_the_plain_choice(spark):
    rng = random.Random(2)
    rows, want = [], {}
    for group in range(30):
        made, place = [], 0
        while place < 40:
            if rng.random() < 0.3:
                made.append((place, rng.randrange(30, 400), False, True, None))
                if rng.random() < 0.7:
                    made.append((place + 1, rng.randrange(30, 900), False, False, place))
            else:
                made.append((place, rng.randrange(30, 300), rng.random() < 0.05, False, None))
            place += 2
        rows += [(group, p, "c" if call else None, a, req, s) for p, s, req, call, a in made]
        want[group] = plain_context(made, 1500)
    frame = spark.createDataFrame(rows, "g int, o long, call_id string, answers long, required boolean, size long")
    got = {}
    for row in convo.context_window(frame, ["g"], "o", 1500).collect():
        got.setdefault(row.g, set()).add(row.o)
    assert {g: got.get(g, set()) for g in want} == want


def test_context_window_of_a_long_conversation(spark):
    made = [(place, 60 + place * 7919 % 301, place % 50_000 == 7, place % 5 == 0, place - 1 if place % 5 == 1 and place % 3 else None) for place in range(100_000)]
    rows = [(1, p, "c" if call else None, a, req, s) for p, s, req, call, a in made] + [(2, 0, None, None, False, 10), (None, 5, None, None, False, 20)]
    frame = spark.createDataFrame(rows, "g int, o long, call_id string, answers long, required boolean, size long").repartition(8).cache()
    frame.count()
    started = time.time()
    got = {}
    for row in convo.context_window(frame, ["g"], "o", 9_000_000).collect():
        got.setdefault(row.g, set()).add(row.o)
    assert time.time() - started < 60
    assert got[1] == plain_context(made, 9_000_000) and got[2] == {0}


def test_rendered_log(spark):
    native = json.dumps({"role": "assistant", "content": None, "tool_calls": [{"id": "c1"}]}, separators=(",", ":"))
    records = [
        (1, "prompt", "p" * 3000, None, None, None, None), (2, "reasoning", "think", None, None, "c1", native), (3, "driver-error", "x", None, None, None, None),
        (4, "shell-output", "é" * 2000, "ls", 0, None, None), (5, "shell-output", "y" * 2000, "ls", 1, None, None), (6, "final", "done", None, None, None, None),
    ]
    frame = spark.createDataFrame([("g", *r) for r in records], "g string, o long, kind string, content string, command string, exit_code int, call_id string, message string")
    out = {r.o: r for r in convo.render_log(frame, ["g"], "o", 3000, F.lit(0)).collect()}
    assert sorted(out) == [1, 2, 4, 5, 6]
    assert out[1].required and json.loads(out[1].message)["content"] == "p" * 512 + "\n[task middle truncated]\n" + "p" * 512
    assert out[4].answers == 2 and json.loads(out[4].message) == {
        "role": "tool", "tool_call_id": "c1", "content": "Exit: 0\nOutput:\n" + "é" * 256 + "\n[shell output middle truncated]\n" + "é" * 256
    }
    loose = json.loads(out[5].message)["content"]
    assert loose.startswith("[shell output truncated; tail follows]\n") and loose.endswith("y" * 1000) and len(loose) == 39 + 1024
    assert all(r.size == len(r.message.encode()) + 1 for r in out.values())


def test_pack_batches(spark):
    rng = random.Random(4)
    sizes = [rng.choice([10, 200, 900, 1200]) for _ in range(200)]
    frame = spark.createDataFrame(list(enumerate(sizes)), "o int, s int")
    runs = {n: [r.batch for r in convo.pack_batches(frame, "o", "s", overhead=100, max_rows=6, max_bytes=1200, piece=F.floor(F.col("o") / 30), run_rows=n).orderBy("o").collect()] for n in (6, 7, 50, 1000)}
    got = runs[1000]
    assert all(numbers == got for numbers in runs.values())
    want, batch, held = [], -1, None
    for size in sizes:
        if held is None or len(held) >= 6 or 100 + sum(held) + len(held) + size > 1200:
            batch, held = batch + 1, []
        held.append(size)
        want.append(batch)
    assert got == want


def test_recent_budget_keeps_an_oversized_newest_entry(spark):
    frame = spark.createDataFrame([("g", 1, "old"), ("g", 2, "abcdefghij" * 3)], "g string, o int, t string")
    rows = convo.recent_budget(frame, ["g"], "o", "t", 20).collect()
    assert [(r.o, r.rendered) for r in rows] == [(2, ("abcdefghij" * 3)[-20:])]


def test_prompt_context(spark):
    texts = [
        "Fix it", "Continue the saved task: x\nLatest operator instruction:  go on \nStatus changed: now", "Resume the interrupted task: y",
    ]
    frame = spark.createDataFrame([(t,) for t in texts], "t string").select(*convo.prompt_context(F.col("t")))
    assert sorted(map(tuple, frame.collect())) == sorted([("Fix it", False), ("go on", True), ("", True)])


@pytest.mark.parametrize(
    "text,want",
    [
        ("Authorization: Bearer abc.def, x", "Authorization: Bearer [redacted], x"),
        ("api-key  zzz", "api-key [redacted]"),
        ('token = "se cret"; y', 'token = "[redacted]"; y'),
        ("API_KEY=abc next", "API_KEY=[redacted] next"),
        ("'my-secret': 'v'", "'my-secret': '[redacted]'"),
        ("MY_TOKEN_FILE=/a/b", "MY_TOKEN_FILE=/a/b"),
        ('MY_TOKEN_ENV="token=abc" z', 'MY_TOKEN_ENV="token=abc" z'),
        ("TOKEN=API_KEY_FILE=foo", "TOKEN=[redacted]"),
        ('password: "unclosed', "password: [redacted]"),
        ("tokens = 3 and tokenizer=4", "tokens = 3 and tokenizer=4"),
        ("x_password_2:a,b", "x_password_2:[redacted],b"),
        ('secret="a\\"b" c', 'secret="[redacted]" c'),
        ("key hunter22 ab", "key [redacted] [redacted]"),
        ("cab ab", "cab [redacted]"),
        ("plain", "plain"),
        ("my_\u017fecret=x \u017f", "my_\u017fecret=[redacted] \u017f"),
    ],
)
def test_redact(spark, text, want):
    frame = spark.createDataFrame([(text,)], "t string")
    assert frame.select(redact.redact("t", ["hunter22", "ab"])).first()[0] == want


def test_redact_json(spark):
    body = {"id": "token=1", "content": "token=abc", "list": ["password: x"], "arguments": json.dumps({"note": "secret=1", "n": 2}), "type": "secret=1"}
    frame = spark.createDataFrame([(json.dumps(body),), ("nope",)], "t string")
    rows = [r[0] for r in frame.select(redact.redact_json(F.col("t"))).collect()]
    assert json.loads(rows[0]) == {
        "id": "token=1", "content": "token=[redacted]", "list": ["password: [redacted]"], "arguments": '{"note":"secret=[redacted]","n":2}', "type": "secret=1"
    }
    assert rows[1] is None
    assert not re.search("abc", rows[0])


def test_redact_long_values_in_linear_time():
    cases = ['token = "' + "x" * 1_000_000 + '"', "a_" * 100_000 + "token=1", "a" * 1_000_000 + " x", 'secret="' + '\\"' * 500_000, "token " * 100_000, '"' * 300_000]
    for text in cases:
        redact.redacted(text)
    assert redact.redacted(cases[0]) == 'token = "[redacted]"'
    assert redact.redacted("a_" * 100_000 + "token=1").endswith("token=[redacted]")
    assert redact.redacted("CREDENTİALS=abc123") == "CREDENTİALS=[redacted]"


def test_redacted_pieces_that_touch_or_overlap():
    given = ["hunter22", "ab", "22 lives", "x=y"]
    cases = {
        "hunter22hunter22": "[redacted][redacted]", "hunter22 lives": "[redacted]", "abhunter22": "[redacted][redacted]", "cab": "cab",
        "token=hunter22,ab": "token=[redacted],[redacted]", "hunter22token=z": "[redacted]token=[redacted]", "hunter22Bearer z": "[redacted]Bearer [redacted]",
        "Bearer token=abc": "Bearer [redacted]", "token=Bearer abc": "token=[redacted] [redacted]", "token x=y": "token [redacted]", "secret='' x": "secret='[redacted]' x",
    }
    assert {text: redact.redacted(text, given) for text in cases} == cases


def test_redact_messages(spark):
    kind = "array<struct<role:string,content:string,tool_call_id:string,tool_calls:array<struct<id:string,name:string,arguments:string>>>>"
    messages = [("user", "token=a b", None, None), ("assistant", None, None, [("token=1", "n", "secret: x"), ("c", "n", '{"k": 1}')]), ("tool", "Bearer q", "token=1", [])]
    frame = spark.createDataFrame([(messages,), (None,), ([],)], f"m {kind}")
    out = [r[0] for r in frame.select(redact.redact_messages(F.col("m"))).collect()]
    assert [m.content for m in out[0]] == ["token=[redacted] b", None, "Bearer [redacted]"]
    assert [c.arguments for c in out[0][1].tool_calls] == ["secret: [redacted]", '{"k": 1}']
    assert out[0][1].tool_calls[0].id == "token=1" and out[0][2].tool_call_id == "token=1"
    assert out[1] is None and out[2] == []
