"""Free JSON as a flat list of its objects, so that questions about it are Spark expressions.

The Python part only parses and walks. A node is one JSON object, in reading order, with its scalar members, the sizes
of its lists and the place it hangs from. What texts, tools, usage or completion mean is said in `operators.features`.
"""

from __future__ import annotations

import json

import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as T

TEXT_MAP = T.MapType(T.StringType(), T.StringType())
NODES = T.ArrayType(
    T.StructType(
        [
            T.StructField("doc", T.IntegerType()),
            T.StructField("under_top", T.BooleanType()),
            T.StructField("parent", T.IntegerType()),
            T.StructField("edge", T.StringType()),
            T.StructField("item", T.BooleanType()),
            T.StructField("hidden", T.BooleanType()),
            T.StructField("event", T.StringType()),
            T.StructField("arguments_ok", T.BooleanType()),
            T.StructField("kinds", TEXT_MAP),
            T.StructField("strings", TEXT_MAP),
            T.StructField("ints", T.MapType(T.StringType(), T.LongType())),
            T.StructField("sizes", T.MapType(T.StringType(), T.IntegerType())),
        ]
    )
)
_PAIRS = lambda kind: pa.map_(pa.string(), kind)
NODES_ARROW = pa.list_(
    pa.struct(
        [
            ("doc", pa.int32()), ("under_top", pa.bool_()), ("parent", pa.int32()), ("edge", pa.string()), ("item", pa.bool_()), ("hidden", pa.bool_()),
            ("event", pa.string()), ("arguments_ok", pa.bool_()), ("kinds", _PAIRS(pa.string())), ("strings", _PAIRS(pa.string())),
            ("ints", _PAIRS(pa.int64())), ("sizes", _PAIRS(pa.int32())),
        ]
    )
)
NAMES = {dict: "object", list: "list", str: "string", bool: "boolean", int: "integer", float: "number", type(None): "null"}


def clean(text: str) -> str:
    """Lone surrogates cannot leave Python as UTF-8; they become the replacement character."""
    try:
        text.encode()
    except UnicodeEncodeError:
        return text.encode("utf-16", "surrogatepass").decode("utf-16", "replace")
    return text


def parses(text: str) -> bool:
    try:
        json.loads(text)
    except (ValueError, RecursionError):
        return False
    return True


def _filled(owner, *names) -> bool:
    return isinstance(owner, dict) and all(isinstance(owner.get(name), str) and owner[name] for name in names)


def tool_event(node: dict, edge: str | None):
    """(is a tool node, its compact event or None): calls and results of both protocol families."""
    if edge == "tool_calls":
        function = node.get("function")
        if not (_filled(node, "id") and _filled(function, "name", "arguments")):
            return True, None
        event = {"type": "function_call", "name": function["name"], "arguments": function["arguments"], "call_id": node["id"]}
    elif node.get("type") == "function_call":
        if not _filled(node, "call_id", "name", "arguments"):
            return True, None
        event = {"type": "function_call", "name": node["name"], "arguments": node["arguments"], "call_id": node["call_id"]}
    elif node.get("type") == "function_call_output" or node.get("role") == "tool":
        direct = node.get("type") == "function_call_output"
        caller, output = node.get("call_id" if direct else "tool_call_id"), node.get("output" if direct else "content")
        if not (isinstance(caller, str) and caller and isinstance(output, str)):
            return True, None
        event = {"type": "function_call_output", "call_id": caller, "output": output}
    else:
        return False, None
    return True, json.dumps(event, ensure_ascii=False, separators=(",", ":"))


def walk(docs: list[str]) -> list[dict] | None:
    """Nodes of all documents in reading order, or None when one of them is not JSON."""
    try:
        values = [json.loads(text) for text in docs]
    except (ValueError, RecursionError):
        return None
    nodes: list[dict] = []
    # What is still to be read, the next one last: (value, document, under the top, parent, edge, in a list, hidden).
    todo = [(value, number, False, -1, None, False, False) for number, value in reversed(list(enumerate(values)))]
    while todo:
        value, doc, under_top, parent, edge, item, hidden = todo.pop()
        if isinstance(value, list):
            todo += [(child, doc, under_top, parent, edge, True, hidden) for child in reversed(value)]
            continue
        if not isinstance(value, dict):
            continue
        is_tool, event = (False, None) if hidden else tool_event(value, edge if edge == "tool_calls" and item else None)
        place = len(nodes)
        arguments = value.get("arguments")
        nodes.append(
            {
                "doc": doc, "under_top": under_top, "parent": parent, "edge": edge and clean(edge), "item": item, "hidden": hidden or is_tool, "event": event and clean(event),
                "arguments_ok": parses(arguments) if isinstance(arguments, str) else None,
                "kinds": [(clean(k), NAMES[type(v)]) for k, v in value.items()],
                "strings": [(clean(k), clean(v)) for k, v in value.items() if isinstance(v, str)],
                "ints": [(clean(k), v) for k, v in value.items() if type(v) is int and -(2**63) <= v < 2**63],
                "sizes": [(clean(k), len(v)) for k, v in value.items() if isinstance(v, list)],
            }
        )
        inside = parent == -1 and not item
        todo += [(child, doc, inside, place, name, False, hidden or is_tool or name == "tools") for name, child in reversed(value.items())]
    return nodes


@F.arrow_udf(NODES)
def json_nodes(docs: pa.Array) -> pa.Array:
    """Nodes of an array of JSON texts; NULL for NULL or when any text does not parse."""
    return pa.array([None if texts is None else walk(texts) for texts in docs.to_pylist()], NODES_ARROW)
