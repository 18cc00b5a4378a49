"""Conversations: decoding to examples, tool sequences, and budgets over turns."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.jsonrules import argument_kinds, plain_json
from ..session import ensure_checkpoint_dir
from .ordered import computed_once, first_rows, running_sum, with_neighbour

ROLES = ("system", "developer", "user", "assistant", "tool")
TEXT_PARTS = ("text", "input_text", "output_text")
NO_CALLS = "array<struct<id:string,name:string,arguments:string>>"


def _kind(value: Column) -> Column:
    """Rough JSON kind of a VARIANT: OBJECT, ARRAY, STRING, VOID or another scalar; NULL when absent."""
    return F.regexp_extract(F.schema_of_variant(value), "^[A-Z]+", 0)


def _truthy(value: Column) -> Column:
    text = F.to_json(value)
    return value.isNotNull() & ~F.coalesce(text.isin("null", "false", "0", '""', "[]", "{}"), F.lit(True))


def _present(value: Column) -> Column:
    return value.isNotNull() & (_kind(value) != "VOID")


def _filled(value: Column) -> Column:
    return F.coalesce(value != "", F.lit(False))


def _part(value: Column, path: str) -> Column:
    return F.try_variant_get(value, path, "variant")


def _text(value: Column, path: str = "$") -> Column:
    """A JSON string, NULL for anything else."""
    part = _part(value, path)
    return F.when(_kind(part) == "STRING", F.try_variant_get(part, "$", "string"))


def _word(value: Column, path: str) -> Column:
    """A JSON string, NULL when absent; other values show as their JSON, which is no known word."""
    part = _part(value, path)
    return F.when(_kind(part) == "STRING", F.try_variant_get(part, "$", "string")).when(_present(part), F.to_json(part))


def _list(value: Column) -> Column:
    """A JSON list as an array of VARIANT, NULL for anything else."""
    return F.when(_kind(value) == "ARRAY", F.try_variant_get(value, "$", "array<variant>"))


def _is_object(value: Column) -> Column:
    return F.coalesce(_kind(value) == "OBJECT", F.lit(False))


def _call(value: Column, identifier: str, owner: str) -> Column:
    return F.struct(
        _text(value, f"$.{identifier}").alias("id"), _text(value, f"{owner}.name").alias("name"), _text(value, f"{owner}.arguments").alias("arguments")
    )


def _item(value: Column) -> Column:
    """A message or item as a typed struct; NULL when it is no object."""
    calls = _list(_part(value, "$.tool_calls"))
    fields = F.struct(
        _word(value, "$.type").alias("type"), _word(value, "$.role").alias("role"), _word(value, "$.status").alias("status"),
        _part(value, "$.content").alias("content"), _part(value, "$.tool_calls").alias("tool_calls"), _text(value, "$.tool_call_id").alias("tool_call_id"),
        _text(value, "$.output").alias("output"), _call(value, "call_id", "$").alias("own_call"),
        F.transform(calls, lambda c: F.struct(_word(c, "$.type").alias("type"), _call(c, "id", "$.function").alias("call"))).alias("calls"),
        _truthy(_part(value, "$.encrypted_content")).alias("opaque"), _truthy(_part(value, "$.reasoning_content")).alias("reasoned"),
        (_truthy(_part(value, "$.refusal")) | _truthy(_part(value, "$.audio")) | _truthy(_part(value, "$.function_call")) | _truthy(_part(value, "$.annotations"))).alias("special"),
    )
    return F.when(_is_object(value), fields)


def _call_problem(call: Column) -> Column:
    # Judged once per body as `json.loads` does, and looked up here by text.
    kind = F.col("__kinds")[call["arguments"]]
    return (
        F.when(~_filled(call["id"]) | ~_filled(call["name"]) | call["arguments"].isNull(), "invalid_tool_call")
        .when(F.coalesce(kind, F.lit("invalid")) == "invalid", "invalid_tool_arguments")
        .when(kind != "object", "nonobject_tool_arguments")
    )


def _item_problem(item: Column, responses: Column) -> Column:
    kind, role, content = item["type"], item["role"], item["content"]
    good_part = lambda p: F.coalesce(_text(p, "$.type").isin(*TEXT_PARTS), F.lit(False)) & _text(p, "$.text").isNotNull() & ~_truthy(_part(p, "$.annotations"))
    listed = F.transform(
        item["calls"], lambda c: F.when(~F.coalesce(c["type"] == "function", F.lit(False)), "unsupported_tool_call").otherwise(_call_problem(c["call"]))
    )
    call_problems = F.filter(listed, lambda p: p.isNotNull())
    wrong_call = F.when(~F.coalesce(item["status"] == "completed", F.lit(True)), "incomplete_tool_call").otherwise(_call_problem(item["own_call"]))
    called = _truthy(item["tool_calls"])
    plain = (
        F.when(~F.coalesce(kind == "message", F.lit(True)), "unknown_response_item")
        .when(item["opaque"], "opaque_message_content")
        .when(~F.coalesce(role.isin(*ROLES), F.lit(False)), "unknown_message_role")
        .when(item["special"], "unsupported_message_semantics")
        .when(_present(content) & ~_kind(content).isin("STRING", "ARRAY"), "unsupported_content")
        .when((_kind(content) == "ARRAY") & ~F.coalesce(F.forall(_list(content), good_part), F.lit(False)), "multimodal_or_annotated_content")
        .when(called & ((role != "assistant") | item["calls"].isNull()), "invalid_tool_calls")
        .when(called & (F.size(call_problems) > 0), F.try_element_at(call_problems, F.lit(1)))
        .when((role == "tool") & (item["tool_call_id"].isNull() | ~F.coalesce(_kind(content) == "STRING", F.lit(False))), "unsupported_tool_output")
        .when(~_present(content) & ~called, "missing_visible_message")
    )
    return (
        F.when(item.isNull(), "invalid_message")
        .when(_is_reasoning(item, responses), None)
        .when(responses & F.coalesce(kind == "function_call", F.lit(False)), wrong_call)
        .when(
            responses & F.coalesce(kind == "function_call_output", F.lit(False)),
            F.when(item["own_call"]["id"].isNull() | item["output"].isNull(), "unsupported_tool_output"),
        )
        .otherwise(plain)
    )


def _message(item: Column, responses: Column) -> Column:
    direct = responses & F.coalesce(item["type"] == "function_call", F.lit(False))
    output = responses & F.coalesce(item["type"] == "function_call_output", F.lit(False))
    listed = F.coalesce(F.transform(item["calls"], lambda c: c["call"]), F.array().cast(NO_CALLS))
    return F.struct(
        F.when(direct, "assistant").when(output, "tool").otherwise(item["role"]).alias("role"),
        F.when(output, item["output"]).when(~direct, _text(item["content"])).alias("content"),
        F.when(~direct & ~output, F.transform(_list(item["content"]), lambda p: _text(p, "$.text"))).alias("parts"),
        F.when(output, item["own_call"]["id"]).when(item["role"] == "tool", item["tool_call_id"]).alias("tool_call_id"),
        F.when(direct, F.array(item["own_call"])).otherwise(listed).alias("tool_calls"),
    )


def _is_reasoning(item: Column, responses: Column) -> Column:
    return responses & F.coalesce(item["type"] == "reasoning", F.lit(False))


def _messages(items: Column, responses: Column) -> Column:
    return F.transform(F.filter(items, lambda item: ~_is_reasoning(item, responses)), lambda item: _message(item, responses))


def _first_problem(items: Column, responses: Column) -> Column:
    problems = F.filter(F.transform(items, lambda item: _item_problem(item, responses)), lambda p: p.isNotNull())
    return F.when(items.isNull(), "missing_message_history").otherwise(F.try_element_at(problems, F.lit(1)))


def tool_sequence_problem(context: Column, targets: Column, tool_names: Column) -> Column:
    """First broken rule of a tool dialogue, NULL if it is sound.

    Every call is answered once before anything else is said, results belong to an open call, ids are new, names are
    known, and targets come from the assistant. One fold over the messages of the row.
    """
    texts = "array<string>"
    start = F.struct(
        F.lit(0).alias("place"), F.array().cast(texts).alias("open"), F.array().cast(texts).alias("seen"), F.lit(None).cast("string").alias("problem")
    )
    border = F.size(context)

    def step(state: Column, message: Column) -> Column:
        ids = F.transform(message["tool_calls"], lambda c: c["id"])
        called = F.size(ids) > 0
        is_tool = message["role"] == "tool"
        pending = F.size(state["open"]) > 0
        fresh = (
            (F.size(F.array_distinct(ids)) == F.size(ids))
            & ~F.arrays_overlap(ids, state["seen"])
            & F.forall(message["tool_calls"], lambda c: F.array_contains(tool_names, c["name"]))
        )
        found = (
            F.when((state["place"] == border) & pending, "historical_tool_results_missing")
            .when((state["place"] >= border) & (message["role"] != "assistant"), "nonassistant_target")
            .when(is_tool & ~F.coalesce(F.array_contains(state["open"], message["tool_call_id"]), F.lit(False)), "orphan_or_duplicate_tool_result")
            .when(~is_tool & pending & ~((message["role"] == "assistant") & called), "interrupted_tool_sequence")
            .when(~is_tool & called & ~fresh, "duplicate_or_unknown_tool_call")
        )
        opened = F.when(is_tool, F.array_remove(state["open"], message["tool_call_id"])).otherwise(F.array_union(state["open"], ids))
        return F.struct(
            (state["place"] + 1).alias("place"),
            opened.alias("open"),
            F.when(is_tool, state["seen"]).otherwise(F.array_union(state["seen"], ids)).alias("seen"),
            F.coalesce(state["problem"], found).alias("problem"),
        )

    return F.aggregate(F.concat(context, targets), start, step, lambda state: state["problem"])


def decode_examples(rows: DataFrame, request: str = "request", response: str = "response") -> DataFrame:
    """Decode request and response JSON texts to messages, tools and assistant targets.

    Adds `messages`, `tool_names`, `targets`, `omitted_reasoning` and `reject_reason` (NULL = supported). Every row stays.
    """
    parsed = rows.withColumn("__q", F.try_parse_json(plain_json(request))).withColumn("__r", F.try_parse_json(plain_json(response)))
    parsed = computed_once(parsed.withColumn("__kinds", argument_kinds(request, response)))
    q, r = F.col("__q"), F.col("__r")
    responses = F.col("endpoint") == "responses"
    given = _part(q, "$.input")
    asked = F.parse_json(F.to_json(F.array(F.struct(F.lit("user").alias("role"), _text(given).alias("content")))))
    inputs = F.when(given.isNull(), F.parse_json(F.lit("[]"))).when(_kind(given) == "STRING", asked).otherwise(given)
    history = F.when(responses, inputs).otherwise(_part(q, "$.messages"))
    parsed = parsed.withColumn("__in", F.transform(_list(history), _item)).withColumn("__choices", _list(_part(r, "$.choices")))
    said = F.transform("__choices", lambda c: _item(_part(c, "$.message")))
    parsed = parsed.withColumn("__out", F.when(responses, F.transform(_list(_part(r, "$.output")), _item)).otherwise(said))
    tools = _part(q, "$.tools")
    described = lambda t: F.struct(
        _word(t, "$.type").alias("type"),
        F.when(responses, _text(t, "$.name")).otherwise(_text(t, "$.function.name")).alias("name"),
        F.when(responses, _is_object(_part(t, "$.parameters"))).otherwise(_is_object(_part(t, "$.function.parameters"))).alias("described"),
    )
    parsed = parsed.withColumn("__tools", F.transform(_list(tools), described))
    parsed = parsed.withColumn("tool_names", F.coalesce(F.transform("__tools", lambda t: t["name"]), F.array().cast("array<string>")))
    parsed = computed_once(parsed)
    tool_problem = (
        F.when(tools.isNotNull() & F.col("__tools").isNull(), "invalid_tool_definitions")
        .when(F.exists("__tools", lambda t: ~F.coalesce(t["type"] == "function", F.lit(False))), "unsupported_tool_definition")
        .when(F.exists("__tools", lambda t: ~_filled(t["name"]) | ~t["described"]), "invalid_tool_definition")
        .when(F.size("tool_names") != F.size(F.array_distinct("tool_names")), "duplicate_tool_definition")
    )
    instructions = _part(q, "$.instructions")
    lead = F.when(
        responses & _truthy(instructions),
        F.array(F.struct(
            F.lit("system").alias("role"), _text(instructions).alias("content"), F.lit(None).cast("array<string>").alias("parts"),
            F.lit(None).cast("string").alias("tool_call_id"), F.array().cast(NO_CALLS).alias("tool_calls"),
        )),
    )
    body = _messages(F.col("__in"), responses)
    parsed = parsed.withColumn("messages", F.when(lead.isNotNull(), F.concat(lead, body)).otherwise(body)).withColumn(
        "targets", _messages(F.col("__out"), responses)
    )
    visible = F.exists(
        "targets", lambda m: (F.size(m["tool_calls"]) > 0) | _filled(m["content"]) | F.coalesce(F.exists(m["parts"], lambda p: p != ""), F.lit(False))
    )
    only = F.try_element_at("__choices", F.lit(1))
    turn_problem = F.when(
        responses, F.when(~F.coalesce(_word(r, "$.status") == "completed", F.lit(False)), "incomplete_assistant_turn")
    ).otherwise(
        F.when(F.col("__choices").isNull() | (F.size("__choices") != 1) | ~_is_object(only), "multiple_or_missing_choices").when(
            ~F.coalesce(_word(only, "$.finish_reason").isin("stop", "tool_calls"), F.lit(False)), "incomplete_assistant_turn"
        )
    )
    reason = F.coalesce(
        F.when(F.coalesce("streaming", F.lit(False)), "streaming_not_supported"),
        F.when(~_is_object(r) | ~_is_object(q), "invalid_protocol_body"),
        F.when(_truthy(_part(q, "$.previous_response_id")) | _truthy(_part(q, "$.conversation")), "server_side_history_missing"),
        F.when(~F.coalesce(F.col("endpoint").isin("responses", "chat_completions"), F.lit(False)), "unsupported_endpoint"),
        tool_problem,
        _first_problem(F.col("__in"), responses),
        F.when(responses & _truthy(instructions) & (_kind(instructions) != "STRING"), "unsupported_instructions"),
        F.when(F.size("messages") == 0, "missing_message_history"),
        turn_problem,
        _first_problem(F.col("__out"), responses),
        F.when((F.size("targets") == 0) | ~visible, "no_visible_assistant_target"),
        tool_sequence_problem(F.col("messages"), F.col("targets"), F.col("tool_names")),
    )
    both = F.concat("__in", "__out")
    omitted = F.size(F.filter(both, lambda i: _is_reasoning(i, responses) | i["reasoned"]))
    supported = F.col("reject_reason").isNull()
    out = parsed.withColumn("reject_reason", reason).withColumn("omitted_reasoning", F.when(supported, omitted > 0))
    return out.select(
        *rows.columns,
        F.when(supported, F.col("messages")).alias("messages"),
        F.when(supported, F.col("tool_names")).alias("tool_names"),
        F.when(supported, F.col("targets")).alias("targets"),
        "omitted_reasoning",
        "reject_reason",
    )


def last_k_turns(rows: DataFrame, keys: Sequence[str], order: str, is_prompt: Column, k: int = 3) -> DataFrame:
    """Rows from the k-th newest prompt on; everything when there are fewer prompts."""
    prompts = first_rows(rows.where(is_prompt).select(*keys, order), keys, [F.desc(order)], k, rank="__n")
    cut = prompts.where(F.col("__n") == k).select(*keys, F.col(order).alias("__from"))
    return rows.join(cut, list(keys), "left").where(F.col("__from").isNull() | (F.col(order) >= F.col("__from"))).drop("__from")


def recent_budget(rows: DataFrame, keys: Sequence[str], order: str, text: str, max_bytes: int) -> DataFrame:
    """Newest entries whose rendered bytes fit the budget, stopping at the first that does not; the newest always stays.

    An entry takes its bytes and three more, so no group needs more rows than a third of the budget.
    """
    size = F.octet_length(text).cast("bigint") + 3
    near = first_rows(rows.withColumn("size", size), keys, [F.desc(order)], max_bytes // 3 + 1, salt_by=[*keys, order])
    newest_first = Window.partitionBy(*keys).orderBy(F.desc(order)).rowsBetween(Window.unboundedPreceding, 0)
    used = F.sum(F.least(F.col("size"), F.lit(max_bytes))).over(newest_first)
    # An oversized newest entry keeps its last characters, as many as the budget has bytes.
    cut = F.when(F.col("size") > max_bytes, F.right(text, F.lit(max_bytes))).otherwise(F.col(text))
    return near.withColumn("used", used).where(F.col("used") <= max_bytes).withColumn("rendered", cut)


def _both_ends(content: Column, limit: int, marker: str) -> Column:
    raw = F.encode(content, "utf-8")
    half = limit // 2
    text = lambda part: F.make_valid_utf8(part.cast("string"))
    tail = F.substring(raw, F.octet_length(raw) - half + 1, F.lit(half))
    return F.when(F.octet_length(raw) > limit, F.concat(text(F.substring(raw, F.lit(1), F.lit(half))), F.lit(marker), text(tail))).otherwise(content)


# How a shell observation reads, and what stands where a text was cut.
EXIT_LINE, OUTPUT_LINE, COMMAND_LINE, NO_EXIT = "Exit: ", "Output:", "Command:", "None"
TAIL_CUT = "[shell output truncated; tail follows]"
OUTPUT_CUT = "[shell output middle truncated]"
TASK_CUT = "[task middle truncated]"


def render_log(records: DataFrame, keys: Sequence[str], order: str, max_bytes: int, piece: Column) -> DataFrame:
    """Step-log records as chat messages with their JSON size.

    Records carry kind (prompt, reasoning, shell-output, final), content, command, exit_code, and for a native call
    its `call_id` and whole `message` JSON. A shell output right after a native call becomes that call's result.
    """
    limit = max(1024, min(8192, max_bytes // 3))
    spoken = records.where(F.col("kind").isin("prompt", "reasoning", "shell-output", "final"))
    linked = with_neighbour(spoken, keys, order, {"__call": "call_id", "__call_at": order}, piece, back=True)
    is_shell = F.col("kind") == "shell-output"
    paired = is_shell & F.col("__call").isNotNull()
    exit_text = F.concat(F.lit(EXIT_LINE), F.coalesce(F.col("exit_code").cast("string"), F.lit(NO_EXIT)), F.lit(f"\n{OUTPUT_LINE}\n"))
    raw_shell = F.concat(F.lit(f"{COMMAND_LINE}\n"), F.coalesce("command", F.lit("")), F.lit("\n"), exit_text, F.col("content"))
    raw_bytes = F.encode(raw_shell, "utf-8")
    tail = F.make_valid_utf8(F.substring(raw_bytes, F.octet_length(raw_bytes) - limit + 1, F.lit(limit)).cast("string"))
    loose = F.when(F.octet_length(raw_bytes) > limit, F.concat(F.lit(f"{TAIL_CUT}\n"), tail)).otherwise(raw_shell)
    result = F.concat(exit_text, _both_ends(F.col("content"), limit, f"\n{OUTPUT_CUT}\n"))
    newest = first_rows(spoken.where(F.col("kind") == "prompt").select(*keys, order), keys, [F.desc(order)], 2)
    prompts = newest.withColumn("required", F.lit(True))
    marked = linked.join(prompts, [*keys, order], "left").withColumn("required", F.coalesce("required", F.lit(False)))
    content = (
        F.when(paired, result).when(is_shell, loose)
        .when(F.col("required"), _both_ends(F.col("content"), limit, f"\n{TASK_CUT}\n"))
        .otherwise(F.col("content"))
    )
    role = F.when(paired, "tool").when(F.col("kind").isin("prompt", "shell-output"), "user").otherwise("assistant")
    shaped = marked.withColumn("content", content).withColumn("role", role).withColumn("answers", F.when(paired, F.col("__call_at")))
    plain = F.to_json(F.struct("role", "content"))
    tool = F.to_json(F.struct("role", F.col("__call").alias("tool_call_id"), "content"))
    text = F.when(F.col("call_id").isNotNull(), F.col("message")).when(paired, tool).otherwise(plain)
    return shaped.withColumn("message", text).withColumn("size", F.octet_length("message").cast("bigint") + 1).select(
        *keys, order, "kind", "role", "call_id", "answers", "required", "message", "size"
    )


SMALLEST_MESSAGE = 24


def _walk(places: np.ndarray, sizes: np.ndarray, required: np.ndarray, answers: np.ndarray, is_call: np.ndarray, used: int, most: int) -> np.ndarray:
    """Which messages of one group are shown, newest first: one step per message, and a mark per message for the choice."""
    kept = required.copy()
    for k in np.flatnonzero(~required).tolist():
        size = sizes[k]
        if used + size <= most:
            used += size
            kept[k] = True
    reply = answers >= 0
    calls, replies = places[kept], answers[kept & reply]
    return kept & np.where(is_call, np.isin(places, replies), ~reply | np.isin(answers, calls))


def _choice(max_bytes: int):
    @F.arrow_udf(T.ArrayType(T.BooleanType()))
    def choose(place: pa.Array, size: pa.Array, required: pa.Array, answers: pa.Array, is_call: pa.Array) -> pa.Array:
        flat = [x.flatten().to_numpy(zero_copy_only=False) for x in (place, size, required, answers, is_call)]
        ends = np.concatenate([[0], np.cumsum(pc.list_value_length(place).to_numpy())]).astype(np.int32)
        shown = np.zeros(ends[-1], dtype=bool)
        for low, high in zip(ends[:-1], ends[1:], strict=True):
            mine = [x[low:high] for x in flat]
            base = 2 + int(mine[1][mine[2].astype(bool)].sum())
            shown[low:high] = _walk(mine[0], mine[1], mine[2].astype(bool), mine[3], mine[4].astype(bool), base, max_bytes)
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(shown))

    return choose


def context_window(messages: DataFrame, keys: Sequence[str], order: str, max_bytes: int) -> DataFrame:
    """Messages kept in a byte budget: required ones, then newest first whatever still fits, calls only with results.

    Going back in time the free space only shrinks, so of all messages of one size a group can keep just the newest
    budget/size. That bounds the rows (places and sizes only) of a group; one walk over them makes the choice. Places are whole
    numbers from 0 up.
    """
    # A native call whose result never came is not shown, nor does it use space.
    answered = messages.where(F.col("answers").isNotNull()).select(*keys, F.col("answers").alias(order)).withColumn("__answered", F.lit(True))
    usable = messages.join(answered, [*keys, order], "left").where(F.col("call_id").isNull() | F.col("__answered")).drop("__answered")
    place, answers = F.col(order).cast("bigint"), F.coalesce(F.col("answers").cast("bigint"), F.lit(-1))
    sizes = usable.select(*keys, place.alias("place"), F.col("size").cast("bigint").alias("size"), "required", answers.alias("answers"), F.col("call_id").isNotNull().alias("is_call"))
    optional = sizes.where(~F.col("required") & (F.col("size") <= max_bytes))
    room = F.call_function("div", F.lit(max_bytes), F.col("size"))
    near = first_rows(optional, [*keys, "size"], [F.desc("place")], room, salt_by=[*keys, "place"])
    fields = ("place", "size", "required", "answers", "is_call")
    newest_first = F.sort_array(F.collect_list(F.struct(*fields)), asc=False)
    listed = near.unionByName(sizes.where("required")).groupBy(*keys).agg(newest_first.alias("items"))
    shown = _choice(max_bytes)(*[F.col("items")[name] for name in fields])
    marked = listed.select(*keys, F.explode(F.arrays_zip(F.col("items")["place"].alias("place"), shown.alias("shown"))).alias("m"))
    chosen = marked.where("m.shown").select(*keys, F.col("m.place").alias(order))
    return usable.join(chosen, [*keys, order], "left_semi")


#: Rows of a run of the order that one task packs.
PACK_ROWS = 100_000


def pack_batches(
    rows: DataFrame,
    order: str,
    size: str,
    overhead: int,
    max_rows: int = 48,
    max_bytes: int = 65_536,
    part: str | None = None,
    piece: Column | None = None,
    run_rows: int = PACK_ROWS,
) -> DataFrame:
    """Greedy batches in row order: a row opens a new batch when the current one is full in rows or bytes.

    Where a batch ends depends only on where it starts. Rows are cut into runs of equal length; each run works out, for every
    row that may open its first batch (the first `max_rows`), how many batches start in it and which row of the next run opens
    one. These short maps are put together by doubling, so any number of rows is packed without a task that sees them all.
    `piece` grows with the order and cuts it for the running row number (by default, by 32 leading characters).
    Sizes are joined by commas, hence one byte between rows. Batches are numbered from 0, per `part` if given.
    """
    spark = rows.sparkSession
    keys = [part] if part else []
    run_rows = max(run_rows, max_rows)
    cut = F.substring(F.col(order).cast("string"), 1, 32) if piece is None else piece
    sized = rows.select(*keys, order, F.col(size).cast("bigint").alias("__size"))
    placed = running_sum(sized, keys, [order], F.lit(1), cut, "__at", inclusive=False)
    ensure_checkpoint_dir(spark)
    placed = placed.select(*keys, F.col(order).alias("__order"), "__size", F.floor(F.col("__at") / run_rows).alias("run"), (F.col("__at") % run_rows).cast("int").alias("place")).checkpoint()
    # The first rows of a run also show the run before where its last batches end.
    ahead = placed.where((F.col("run") > 0) & (F.col("place") < max_rows)).withColumn("run", F.col("run") - 1).withColumn("place", F.col("place") + run_rows)
    types = dict(placed.dtypes)
    by = "".join(f"{k} {types[k]}, " for k in keys) + "run bigint, "
    room = max_bytes - overhead

    def ends(frame: pd.DataFrame) -> tuple[np.ndarray, int]:
        """For each start the row after its batch, and the number of the run's own rows; `frame` is in order."""
        reach = np.concatenate([[0], np.cumsum(frame["__size"].to_numpy(np.int64) + 1)])
        at = np.arange(len(frame))
        fit = np.searchsorted(reach, reach[:-1] + room + 1, side="right") - 1
        return np.maximum(np.minimum(fit, at + max_rows), at + 1), int((frame["place"] < run_rows).sum())

    def summary(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("place")
        end, own = ends(frame)
        leave, count = [0] * own, [0] * own
        for i in range(own - 1, -1, -1):
            leave[i], count[i] = (end[i] - run_rows, 1) if end[i] >= own else (leave[end[i]], count[end[i]] + 1)
        first = [min(i, own - 1) for i in range(max_rows)]
        out = {k: [frame[k].iloc[0]] for k in [*keys, "run"]}
        # In the last run, which can be short, nothing is left to open.
        return pd.DataFrame({**out, "leave": [[max(int(leave[i]), 0) for i in first]], "count": [[int(count[i]) for i in first]]})

    maps = placed.unionByName(ahead).groupBy(*keys, "run").applyInPandas(summary, f"{by}leave array<int>, count array<bigint>").checkpoint()
    runs = (maps.agg(F.max("run")).first()[0] or 0) + 1
    back = 1
    while back < runs:
        before = maps.select(*keys, (F.col("run") + back).alias("run"), F.col("leave").alias("leave0"), F.col("count").alias("count0"))
        joined = maps.join(before, [*keys, "run"], "left")
        leave = F.transform("leave0", lambda i: F.get("leave", i))
        count = F.zip_with("leave0", "count0", lambda i, n: n + F.get("count", i))
        maps = joined.select(*keys, "run", F.coalesce(leave, "leave").alias("leave"), F.coalesce(count, "count").alias("count")).checkpoint()
        back *= 2
    entry = maps.select(*keys, (F.col("run") + 1).alias("run"), F.get("leave", F.lit(0)).alias("open"), F.get("count", F.lit(0)).alias("batches"))
    entered = placed.join(entry, [*keys, "run"], "left").na.fill({"open": 0, "batches": 0})

    def number(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("place")
        end, own = ends(frame)
        start, opens = int(frame["open"].iloc[0]), np.zeros(own, dtype=np.int64)
        while start < own:
            opens[start] = 1
            start = int(end[start])
        batch = int(frame["batches"].iloc[0]) - 1 + np.cumsum(opens)
        out = {k: frame[k] for k in keys} | {"__order": frame["__order"], "batch": batch.astype(np.int32), "too_large": overhead + frame["__size"] > max_bytes}
        return pd.DataFrame(out)

    schema = "".join(f"{k} {types[k]}, " for k in keys) + f"__order {types['__order']}, batch int, too_large boolean"
    packed = entered.groupBy(*keys, "run").applyInPandas(number, schema).withColumnRenamed("__order", order)
    return rows.join(packed, [*keys, order])


def tool_histogram(records: DataFrame, message: str = "message") -> DataFrame:
    """Calls per tool name over the reasoning records of a step log (message as VARIANT)."""
    calls = F.try_variant_get(message, "$.tool_calls", "array<variant>")
    named = records.where(F.col("type") == "reasoning").select(F.explode(calls).alias("call"))
    name = F.coalesce(F.try_variant_get("call", "$.function.name", "string"), F.lit("unknown"))
    return named.groupBy(name.alias("tool")).agg(F.count("*").alias("n"))


# Openings of a resumed task and the sentences that end its instruction.
RESUMED = ("Continue the saved task:", "Resume the interrupted task:")
INSTRUCTION_MARK = "\nLatest operator instruction: "
INSTRUCTION_ENDS = ("\nScheduled review is due.", "\nStatus changed: ", "\nInspect saved outputs and existing resources first;")


def prompt_context(content: Column) -> tuple[Column, Column]:
    """(instruction, resumed): the instruction inside a resumed task, or the whole text of a new one."""
    from ..functions.scalar import strip

    resumed = content.startswith(RESUMED[0]) | content.startswith(RESUMED[1])
    place = F.instr(content, F.lit(INSTRUCTION_MARK))
    after = F.when(place > 0, F.substring(content, place + len(INSTRUCTION_MARK), F.length(content))).otherwise("")
    for end in INSTRUCTION_ENDS:
        after = F.substring_index(after, end, 1)
    return F.when(resumed, strip(after)).otherwise(content), resumed
