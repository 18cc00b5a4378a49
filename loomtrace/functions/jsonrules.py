"""Strict JSON and the supported subset of JSON schema, as Arrow-batched functions."""

from __future__ import annotations

import json
import math
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The deepest schema, and the words that a schema of each type may use.
MAX_DEPTH = 16
WORDS = {
    "object": {"type", "enum", "properties", "required", "additionalProperties"},
    "array": {"type", "enum", "items"},
    **dict.fromkeys(("string", "number", "integer", "boolean", "null"), {"type", "enum"}),
}
#: JSON types of Python values; a float must be finite besides.
TYPES = {dict: {"object"}, list: {"array"}, str: {"string"}, bool: {"boolean"}, int: {"integer", "number"}, float: {"number"}, type(None): {"null"}}
ITEM = ("[]",)


def _members(pairs: list) -> dict:
    out = dict(pairs)
    if len(out) < len(pairs):
        raise ValueError("a member comes twice")
    return out


def _finite(raw: str) -> float:
    number = float(raw)
    if number - number != 0:
        raise ValueError("not a finite number")
    return number


def strict_loads(text: str):
    """JSON as the standard has it: no repeated members, no NaN or Infinity, nothing behind the value."""
    return json.loads(text, object_pairs_hook=_members, parse_float=_finite, parse_constant=_finite)


def types_of(value) -> set[str]:
    return set() if isinstance(value, float) and not math.isfinite(value) else TYPES[type(value)]


@dataclass(frozen=True)
class Rule:
    """What a schema asks of the value at one path; paths name members, and any item of an array is one path."""

    kind: str
    options: tuple | None
    required: frozenset
    named: frozenset
    closed: bool


def _rule(schema) -> tuple[Rule, dict] | None:
    """The rule of one level and its inner schemas by step, None if this level is not a schema."""
    if not isinstance(schema, dict) or not isinstance(schema.get("type"), str) or schema["type"] not in WORDS:
        return None
    kind = schema["type"]
    fields, required, options, open_ = (schema.get(w, d) for w, d in (("properties", {}), ("required", []), ("enum", None), ("additionalProperties", True)))
    sound = [
        schema.keys() <= WORDS[kind],
        isinstance(fields, dict) and isinstance(required, list) and isinstance(open_, bool),
        options is None or (isinstance(options, list) and bool(options) and kind not in ("object", "array")),
    ]
    if not all(sound):
        return None
    if options is not None and (len({json.dumps(o) for o in options}) < len(options) or any(kind not in types_of(o) for o in options)):
        return None
    if any(not isinstance(name, str) or name not in fields for name in required) or len(set(required)) < len(required):
        return None
    inner = {(name,): child for name, child in fields.items()} if kind == "object" else {ITEM: schema["items"]} if "items" in schema else {}
    return Rule(kind, None if options is None else tuple(options), frozenset(required), frozenset(fields), not open_), inner


def compile_schema(schema) -> dict[tuple, Rule] | None:
    """A schema as flat rules by path, None if it is not one of the supported kind. Works level by level, without recursion."""
    rules: dict[tuple, Rule] = {}
    level = {(): schema}
    for _ in range(MAX_DEPTH + 1):
        deeper = {}
        for path, part in level.items():
            made = _rule(part)
            if made is None:
                return None
            rules[path] = made[0]
            deeper.update({path + (("item",) if step is ITEM else ("member", *step)): child for step, child in made[1].items()})
        if not deeper:
            return rules
        level = deeper
    return None


def fits(rules: dict[tuple, Rule], value) -> bool:
    """Whether a value keeps all rules. Only values at paths with a rule are looked at."""
    todo = [((), value)]
    while todo:
        path, here = todo.pop()
        rule = rules.get(path)
        if rule is None:
            continue
        if rule.kind not in types_of(here) or (rule.options is not None and here not in rule.options):
            return False
        if rule.kind == "object":
            if not rule.required <= here.keys() or (rule.closed and not here.keys() <= rule.named):
                return False
            todo += [(path + ("member", name), child) for name, child in here.items()]
        elif rule.kind == "array":
            todo += [(path + ("item",), child) for child in here]
    return True


@F.pandas_udf(T.BooleanType())
def strict_json_ok(texts: pd.Series) -> pd.Series:
    """True for strict JSON, false for anything else, NULL for NULL."""

    def check(text):
        if text is None:
            return None
        try:
            strict_loads(text)
        except (ValueError, RecursionError):
            return False
        return True

    return texts.map(check, na_action=None).astype("object")


@F.pandas_udf(T.BooleanType())
def schema_match(schemas: pd.Series, texts: pd.Series) -> pd.Series:
    """Whether a JSON text is strict and fits a schema text; NULL when either is NULL."""
    known: dict = {}

    def load(text):
        if text not in known:
            try:
                known[text] = compile_schema(json.loads(text))
            except (ValueError, RecursionError):
                known[text] = None
        return known[text]

    def check(schema_text, text):
        if schema_text is None or text is None:
            return None
        rules = load(schema_text)
        try:
            return rules is not None and fits(rules, strict_loads(text))
        except (ValueError, RecursionError):
            return False

    return pd.Series([check(s, t) for s, t in zip(schemas, texts)], dtype="object")


@F.pandas_udf(T.StringType())
def canonical_json(texts: pd.Series) -> pd.Series:
    """Free JSON with sorted keys, compact, closed by a newline; NULL when it does not parse."""

    def write(text):
        try:
            return json.dumps(json.loads(text), sort_keys=True, separators=(",", ":"), ensure_ascii=False) + "\n"
        except (TypeError, ValueError, RecursionError):
            return None

    return texts.map(write)


@F.pandas_udf(T.StringType())
def plain_json(texts: pd.Series) -> pd.Series:
    """JSON that `parse_json` reads as `json.loads` does: of repeated members the last, nothing but space behind the value.

    NULL for anything else. Spark's own parser refuses repeated members and takes text behind the value.
    """

    def write(text):
        try:
            return json.dumps(json.loads(text))
        except (TypeError, ValueError, RecursionError):
            return None

    return texts.map(write)


@F.pandas_udf(T.MapType(T.StringType(), T.StringType()))
def argument_kinds(requests: pd.Series, responses: pd.Series) -> pd.Series:
    """For every text in a member `arguments` of two JSON bodies: `object`, `other` or `invalid` JSON."""

    def kind(text: str) -> str:
        try:
            return "object" if isinstance(json.loads(text), dict) else "other"
        except (ValueError, RecursionError):
            return "invalid"

    def kinds(*bodies) -> dict:
        found, todo = {}, []
        for body in bodies:
            try:
                todo.append(json.loads(body))
            except (TypeError, ValueError, RecursionError):
                continue
        while todo:
            value = todo.pop()
            if isinstance(value, dict):
                if isinstance(value.get("arguments"), str):
                    found[value["arguments"]] = kind(value["arguments"])
                value = list(value.values())
            if isinstance(value, list):
                todo += [v for v in value if isinstance(v, (dict, list))]
        return found

    return pd.Series([kinds(*pair) for pair in zip(requests, responses)])
