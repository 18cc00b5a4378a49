"""Secret scans: fixed patterns, and sliding-window entropy per character class with an allow list."""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame

from .shared import no_text

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
KINDS = ("assign", "access", "hex")


@dataclass(frozen=True)
class EntropyClass:
    """A character class: its candidate strings, the window, the bits a window must reach, and the groups it must mix."""

    kind: str
    candidate: str
    window: int
    bits: float
    groups: tuple[str, ...]


UPPER, LOWER, DIGIT = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789"
#: Keys of one case hold letters beyond f, so that hex strings are left to the hex class.
CLASSES = (
    EntropyClass("entropy_hex", r"[0-9A-Fa-f]{24,}", 24, 3.0, (DIGIT, LOWER + UPPER)),
    EntropyClass("entropy_base64", r"[A-Za-z0-9+/_=-]{24,}", 24, 3.9, (DIGIT, LOWER, UPPER)),
    EntropyClass("entropy_base36", r"[0-9a-z]{24,}", 24, 3.6, (DIGIT, LOWER[6:])),
    EntropyClass("entropy_base32", r"[0-9A-Z]{24,}", 24, 3.6, (DIGIT, UPPER[6:])),
)
#: Windows that overlap a match of one of these, with the letters and digits around it, are no secrets: placeholders, dashed ids.
ALLOW = (
    r"(?i)example|sample|dummy|placeholder|xxxx|lorem",
    r"(?i)(?<![0-9a-z])[0-9a-f]{8}-(?:[0-9a-f]{4}-){3}[0-9a-f]{12}(?![0-9a-z])",
)
#: Web addresses, told by the scheme or www before them; windows that overlap one are no secrets.
ADDRESS = re.compile(r"(?<=[A-Za-z0-9]:)//[A-Za-z0-9+/_=-]*|(?<=[Ww]{3}\.)[A-Za-z0-9+/_=-]+")


@dataclass
class Scanner:
    """Finds spans (start, kind, end) in a text; base patterns are never suppressed."""

    classes: Sequence[EntropyClass] = CLASSES
    allow: Sequence[str] = ALLOW
    _ready: list = field(default_factory=list)

    def __post_init__(self) -> None:
        self._ready = [(c, re.compile(c.candidate), [frozenset(g) for g in c.groups]) for c in self.classes]
        self._allow = [re.compile(p) for p in self.allow]

    def base(self, text: str) -> list[tuple[int, int, int]]:
        found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 12]
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 18]
        found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
        return sorted(found)

    def entropy(self, text: str) -> list[tuple[int, int, int]]:
        found = []
        addresses: list[tuple[int, int]] | None = None
        for place, (rule, candidate, groups) in enumerate(self._ready):
            passed = 0
            for m in candidate.finditer(text):
                piece = m[0]
                if any(g.isdisjoint(piece) for g in groups):
                    continue
                if addresses is None:
                    addresses = [a.span() for a in ADDRESS.finditer(text)]
                # Candidates and addresses both come in the order of the text.
                while passed < len(addresses) and addresses[passed][1] <= m.start():
                    passed += 1
                allowed, here = self._allowed(piece), passed
                while here < len(addresses) and addresses[here][0] < m.end():
                    allowed.append((addresses[here][0] - m.start(), addresses[here][1] - m.start()))
                    here += 1
                found += [(m.start() + a, len(KINDS) + place, m.start() + b) for a, b in high_windows(piece, rule, groups, allowed)]
        return sorted(found)

    def _allowed(self, piece: str) -> list[tuple[int, int]]:
        """Stretches of the candidate that the allow list matches, each with the letters and digits it is part of."""
        out = []
        for rule in self._allow:
            end = 0
            for m in rule.finditer(piece):
                a, b = m.span()
                if b <= end:
                    continue
                while a > end and piece[a - 1].isalnum():
                    a -= 1
                while b < len(piece) and piece[b].isalnum():
                    b += 1
                out.append((a, b))
                end = b
        return out

    def kind(self, place: int) -> str:
        return KINDS[place] if place < len(KINDS) else self.classes[place - len(KINDS)].kind


def _joined(stretches: Sequence[tuple[int, int]]) -> list[tuple[int, int]]:
    """The places that stretches cover, as stretches in order that do not touch."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(stretches):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        elif a < b:
            out.append((a, b))
    return out


def high_windows(piece: str, rule: EntropyClass, groups: Sequence[frozenset], allowed: Sequence[tuple[int, int]] = ()) -> list[tuple[int, int]]:
    """Joined windows of `piece` whose entropy reaches the rule's bits and which hold each of the groups, without those over `allowed`.

    One character enters and one leaves per step; the sum of c*log2(c) and the groups' counts follow by differences.
    """
    width = rule.window
    share = [0.0] + [c * math.log2(c) for c in range(1, width + 1)]
    counts: dict[str, int] = {}
    held = [0] * len(groups)
    total, spans = 0.0, []
    allowed, passed = _joined(allowed), 0
    most = width * (math.log2(width) - rule.bits) + 1e-9
    for i, new in enumerate(piece):
        c = counts.get(new, 0)
        total += share[c + 1] - share[c] if c < width else 0.0
        counts[new] = c + 1
        for k, group in enumerate(groups):
            held[k] += new in group
        if i >= width:
            old = piece[i - width]
            c = counts[old]
            total += share[c - 1] - share[c] if c <= width else 0.0
            counts[old] = c - 1
            for k, group in enumerate(groups):
                held[k] -= old in group
        if i >= width - 1 and total <= most and all(held):
            a, b = i - width + 1, i + 1
            while passed < len(allowed) and allowed[passed][1] <= a:
                passed += 1
            if passed < len(allowed) and allowed[passed][0] < b:
                continue
            if spans and spans[-1][1] >= a:
                spans[-1] = (spans[-1][0], b)
            else:
                spans.append((a, b))
    return spans


def scan_secrets(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    classes: Sequence[EntropyClass] = CLASSES,
    allow: Sequence[str] = ALLOW,
) -> DataFrame:
    """One row per input row: id, counts of base patterns, digest of the base spans, all spans as kind:start:end.

    A null text counts as empty, an empty one has no spans; a null id stays null; repeated rows each give their row; other
    columns are not read. Offsets are code points. Nothing is shuffled, a task holds one Arrow batch.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(classes, allow)
        for batch in batches:
            rows = []
            for text in batch.column(1).to_pylist():
                base = scanner.base(text)
                both = sorted(base + scanner.entropy(text))
                said = [",".join(f"{scanner.kind(k)}:{a}:{b}" for a, k, b in found) for found in (base, both)]
                rows.append((*[sum(x[1] == k for x in base) for k in range(3)], hashlib.sha256(said[0].encode()).hexdigest(), said[1]))
            columns = list(zip(*rows, strict=True)) or [[]] * 5
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *[pa.array(c, t) for c, t in zip(columns, kinds, strict=True)]],
                ["id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"],
            )

    kind = docs.schema[id_col].dataType.simpleString()
    picked = docs.select(docs[id_col].alias("id"), no_text(text_col).alias("text"))
    schema = f"id {kind}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"
    return picked.mapInArrow(scan, schema).withColumnRenamed("id", id_col)


def redact_secrets(
    docs: DataFrame,
    text_col: str = "text",
    count_col: str | None = "n_chars",
    mask: str = "[SECRET]",
    classes: Sequence[EntropyClass] = CLASSES,
    allow: Sequence[str] = ALLOW,
) -> DataFrame:
    """All rows with all their columns; every span that is found in a text is replaced by `mask`, spans that touch by one.

    Where a text changes, its length in `count_col` (if there is such a column) follows. Null texts stay null.
    """
    names = docs.columns
    place, length = names.index(text_col), names.index(count_col) if count_col in names else None

    def mend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(classes, allow)
        for batch in batches:
            columns = list(batch.columns)
            texts = columns[place].to_pylist()
            changed = {}
            for i, text in enumerate(texts):
                spans = sorted((a, b) for a, _, b in scanner.base(text) + scanner.entropy(text)) if text else []
                if spans:
                    changed[i] = masked(text, spans, mask)
            if changed:
                columns[place] = pa.array([changed.get(i, t) for i, t in enumerate(texts)], columns[place].type)
                if length is not None:
                    sizes = columns[length].to_pylist()
                    columns[length] = pa.array([len(changed[i]) if i in changed else n for i, n in enumerate(sizes)], columns[length].type)
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    return docs.mapInArrow(mend, docs.schema)


def masked(text: str, spans: Sequence[tuple[int, int]], mask: str) -> str:
    """`text` with its sorted spans replaced; overlapping and touching spans count as one."""
    out, upto = [], 0
    for a, b in spans:
        if a > upto or not out:
            out += [text[upto:a], mask]
        upto = max(upto, b)
    return "".join([*out, text[upto:]])
