"""Removal of credentials from texts and messages."""

from __future__ import annotations

import json
import re
from bisect import bisect_left
from collections.abc import Iterable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

REDACTED = "[redacted]"
#: Shorter given secrets are only replaced as words of their own.
SHORT = 4
# Words that make a name secret, endings that make it a mere selector, members kept as they are, header schemes.
SECRET_WORDS = ("apikey", "token", "secret", "password", "passwd", "credential", "credentials")
SECRET_PAIR = ("api", "key")
SELECTOR_ENDINGS = ("env", "name", "file", "path")
KEPT_MEMBERS = ("id", "tool_call_id", "name", "role", "type", "encrypted_content")
SCHEMES = ("bearer", "api-key")
#: Letters that equal one of a to z when case is ignored.
LIKE_ASCII = str.maketrans({"\u0130": "i", "\u0131": "i", "\u017f": "s", "\u212a": "k"})

_SCHEME = re.compile("|".join(SCHEMES), re.IGNORECASE)
_SIGN = re.compile("[:=]")
_STOP = re.compile(r"\s|,|;")
_MARKS = {quote: re.compile(rf"\\.|{quote}|[\r\n]") for quote in "\"'"}

#: A piece of the text and what stands there afterwards.
Edit = tuple[int, int, str]


def _folded(text: str) -> str:
    return text.translate(LIKE_ASCII).lower()


def _alphanumeric(letter: str) -> bool:
    return letter.isascii() and letter.isalnum()


def _in_name(letter: str) -> bool:
    return letter in "_-" or _alphanumeric(letter.translate(LIKE_ASCII))


def _bare_end(text: str, at: int) -> int:
    """Where a value without quotes ends: at a blank, a comma or a semicolon."""
    stop = _STOP.search(text, at)
    return stop.start() if stop else len(text)


def _blanks_end(text: str, at: int) -> int:
    while at < len(text) and text[at].isspace():
        at += 1
    return at


def _closing(text: str, at: int) -> int | None:
    """Place of the quote that closes the one at `at`, on the same line: the first that is not escaped, else the last that is."""
    escaped = None
    for mark in _MARKS[text[at]].finditer(text, at + 1):
        if mark[0] == text[at]:
            return mark.start()
        if mark[0][0] != "\\":
            break
        if mark[0][1] == text[at]:
            escaped = mark.start() + 1
    return escaped


class _Edits:
    """Edits in the order of the text; where some overlap, one edit hides all that they cover."""

    def __init__(self, edits: Iterable[Edit]):
        self.all: list[Edit] = []
        for low, high, text in sorted(edits):
            if self.all and low < self.all[-1][1]:
                before = self.all.pop()
                low, high, text = before[0], max(high, before[1]), before[2]
            self.all.append((low, high, text))
        self.starts = [edit[0] for edit in self.all]

    def touch(self, low: int, high: int) -> bool:
        """Whether an edit covers a part of a piece."""
        last = bisect_left(self.starts, high) - 1
        return last >= 0 and self.all[last][1] > low

    def end_before(self, place: int) -> int:
        """Where the last edit that begins before a place ends; 0 without one."""
        last = bisect_left(self.starts, place) - 1
        return self.all[last][1] if last >= 0 else 0

    def apply(self, text: str) -> str:
        out, upto = [], 0
        for low, high, instead in self.all:
            out += [text[upto:low], instead]
            upto = high
        return "".join([*out, text[upto:]])


def _places(text: str, secret: str) -> Iterator[tuple[int, int]]:
    low = text.find(secret)
    while low >= 0:
        yield low, low + len(secret)
        low = text.find(secret, low + len(secret))


def _given(text: str, secrets: Sequence[str]) -> _Edits:
    """Every place of a given secret; short ones only where no letter or digit is left next to them."""
    known = set(filter(None, secrets))
    hidden = _Edits((low, high, REDACTED) for secret in known if len(secret) >= SHORT for low, high in _places(text, secret))

    def free(at: int) -> bool:
        return not 0 <= at < len(text) or not _alphanumeric(text[at]) or hidden.touch(at, at + 1)

    short = [(low, high, REDACTED) for secret in known if len(secret) < SHORT for low, high in _places(text, secret) if free(low - 1) and free(high)]
    return _Edits([*hidden.all, *short])


def _headers(text: str, hidden: _Edits) -> Iterator[Edit]:
    """What follows a scheme and a blank."""
    upto = 0
    for scheme in _SCHEME.finditer(text):
        low, high = scheme.span()
        value = _blanks_end(text, high)
        end = _bare_end(text, value)
        inside_word = low > 0 and (text[low - 1].isalnum() or text[low - 1] == "_") and not hidden.touch(low - 1, low)
        if low >= upto and not inside_word and high < value < end and not hidden.touch(low, high):
            yield high, end, f" {REDACTED}"
            upto = end


def _name_before(text: str, sign: int, least: int) -> tuple[int, int]:
    """The run of name letters in front of a sign, behind which blanks and one quote may stand."""
    high = sign
    while high > least and text[high - 1].isspace():
        high -= 1
    if high > least and text[high - 1] in "\"'":
        high -= 1
    low = high
    while low > least and _in_name(text[low - 1]):
        low -= 1
    return low, high


def _kind(name: str) -> str | None:
    """`secret`, `selector` of a secret, or None for any other name."""
    parts = _folded(name).replace("-", "_").split("_")
    pairs = zip(parts, parts[1:], strict=False)
    if not all(parts) or not (any(part in SECRET_WORDS for part in parts) or SECRET_PAIR in pairs):
        return None
    points = len(parts) > 1 and parts[-1] in SELECTOR_ENDINGS and name[-len(parts[-1]) - 1] == "_"
    return "selector" if points else "secret"


def _assignments(text: str, hidden: _Edits) -> Iterator[Edit]:
    """The value behind each sign that has a secret name in front. Quotes around a value stay."""
    upto = 0
    for sign in _SIGN.finditer(text):
        if sign.start() < upto:
            continue
        low, high = _name_before(text, sign.start(), max(upto, hidden.end_before(sign.start())))
        kind = _kind(text[low:high]) if low < high else None
        if kind is None:
            continue
        value = _blanks_end(text, sign.end())
        closing = _closing(text, value) if text[value : value + 1] in ("'", '"') else None
        end = _bare_end(text, value) if closing is None else closing + 1
        if end == value:
            continue
        quoted = end - value > 1 and text[value] in "\"'" and text[end - 1] == text[value]
        if kind == "secret":
            yield (value + 1, end - 1, REDACTED) if quoted else (value, end, REDACTED)
        upto = end


def redacted(text: str | None, secrets: Sequence[str] = ()) -> str | None:
    """One text without given secrets, header values and the values of secret-looking assignments. Linear in the text.

    All three are found as pieces of the text as it came; pieces that overlap become one, and each is replaced once. What a given
    secret or a header hides is no scheme or name any more.
    """
    if text is None:
        return None
    hidden = _given(text, secrets)
    hidden = _Edits([*hidden.all, *_headers(text, hidden)])
    return _Edits([*hidden.all, *_assignments(text, hidden)]).apply(text)


def redact(text, secrets: Sequence[str] = ()) -> Column:
    """Replace given secrets, bearer and api-key headers, and the values of secret-looking assignments.

    Names that only point to a secret (ending in ENV, NAME, FILE or PATH) keep their value. Regular expressions of the JVM
    recurse over long values, so the scan is an Arrow-batched function; no text is spared it.
    """
    given = tuple(secrets)

    @F.pandas_udf(T.StringType())
    def hide(texts: pd.Series) -> pd.Series:
        return texts.map(lambda text: redacted(text, given), na_action="ignore")

    return hide(F.col(text) if isinstance(text, str) else text)


def redact_lists(texts: Column, secrets: Sequence[str] = ()) -> Column:
    """The same for lists of texts."""
    given = tuple(secrets)

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def hide(lists: pd.Series) -> pd.Series:
        return lists.map(lambda items: None if items is None else [redacted(text, given) for text in items])

    return hide(texts)


def redact_messages(messages: Column, secrets: Sequence[str] = ()) -> Column:
    """Redact the contents and call arguments of a message array; ids, names and roles stay.

    The scan gets one list of texts per message: its content, then the arguments of its calls.
    """
    given = tuple(secrets)

    @F.pandas_udf(T.ArrayType(T.ArrayType(T.StringType())))
    def hide(rows: pd.Series) -> pd.Series:
        return rows.map(lambda row: None if row is None else [[redacted(text, given) for text in texts] for texts in row])

    arguments = lambda m: F.coalesce(F.transform(m["tool_calls"], lambda c: c["arguments"]), F.array().cast("array<string>"))
    hidden = hide(F.transform(messages, lambda m: F.concat(F.array(m["content"]), arguments(m))))

    def mended(message: Column, texts: Column) -> Column:
        changed = F.transform(message["tool_calls"], lambda call, i: call.withField("arguments", F.get(texts, i + 1)))
        return message.withField("content", F.get(texts, F.lit(0))).withField("tool_calls", changed)

    return F.zip_with(messages, hidden, mended)


def json_texts(value, member: str = "") -> list[str]:
    """The texts of a JSON value that redaction may change, in reading order."""
    if isinstance(value, dict):
        return [text for name, child in value.items() for text in json_texts(child, name)]
    if isinstance(value, list):
        return [text for child in value for text in json_texts(child)]
    if not isinstance(value, str) or member in KEPT_MEMBERS:
        return []
    inner = _inner(value) if member == "arguments" else None
    return [value] if inner is None else json_texts(inner)


def _inner(text: str):
    try:
        return json.loads(text)
    except ValueError:
        return None


def fill_texts(value, texts, member: str = ""):
    """The JSON value with its texts replaced, in the same order, from an iterator."""
    if isinstance(value, dict):
        return {name: fill_texts(child, texts, name) for name, child in value.items()}
    if isinstance(value, list):
        return [fill_texts(child, texts) for child in value]
    if not isinstance(value, str) or member in KEPT_MEMBERS:
        return value
    inner = _inner(value) if member == "arguments" else None
    return next(texts) if inner is None else json.dumps(fill_texts(inner, texts), ensure_ascii=False, separators=(",", ":"))


@F.pandas_udf(T.ArrayType(T.StringType()))
def texts_of_json(bodies: pd.Series) -> pd.Series:
    return bodies.map(lambda body: None if body is None or (value := _inner(body)) is None else json_texts(value))


@F.pandas_udf(T.StringType())
def json_with_texts(bodies: pd.Series, texts: pd.Series) -> pd.Series:
    def fill(body, parts):
        if parts is None:
            return None
        return json.dumps(fill_texts(json.loads(body), iter(parts)), ensure_ascii=False, separators=(",", ":"))

    return pd.Series([fill(body, parts) for body, parts in zip(bodies, texts)])


def redact_json(body: Column, secrets: Sequence[str] = ()) -> Column:
    """Redact free JSON. Python only takes the texts out and puts them back; what to hide is decided above."""
    return json_with_texts(body, redact_lists(texts_of_json(body), secrets))
