"""Benchmark decontamination: CGK walks turn edit distance into Hamming distance, bit samples of the walks are LSH keys.

A walk reads words; at step j it writes the word it stands on and moves on if bit j of that word's hash is set. Two texts that
differ by few edits write mostly the same symbols. A key is a hash of a few sampled steps; each repetition has its own bits and
its own sample. Text windows start every `stride` words of a document and items at every word, so that several pairs of windows
of a leaked item are aligned. Equal keys are candidates, and an exact edit distance decides.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import Words, chunks, mix, no_text, texts_of, words_of, written

#: Repetitions, sampled steps in a key, share of an item's words that may be edited, and the shortest item that is looked for.
REPEATS, SAMPLED, EDITS, MIN_WORDS = 6, 4, 0.2, 5
#: Slots of the fixed-size filter that spares windows without any item's key from the shuffle.
FILTER_BITS = 26
_SEED = np.uint64(0xA24BAED4963EE407)


@dataclass(frozen=True)
class SizeClass:
    """Windows for items of `least` to `below` - 1 words: steps of a walk and stride of its starts in documents."""

    least: int
    below: int
    steps: int
    stride: int

    @property
    def reach(self) -> int:
        """Words a walk covers on average; items' windows start at least so far before their end."""
        return self.steps // 2

    def repeats(self, few: int) -> int:
        """Repetitions: a longer walk meets more edits before its last sampled step, and costs less as it starts more rarely."""
        return few * -(-self.steps // 24)


def size_class(words: int) -> SizeClass:
    """Items of 2c to 4c - 1 words get walks over about c words that start every c / 2 words."""
    if words < 8:
        return SizeClass(1, 8, 6, 1)
    c = 1 << (words.bit_length() - 2)
    return SizeClass(2 * c, 4 * c, 2 * c, c // 2)


class Walks:
    """Walks over the words of several texts; a text's end is a symbol that no walk leaves."""

    def __init__(self, words: Words):
        texts = len(words.first) - 1
        n = len(words.hash)
        self.first = words.first + np.arange(texts + 1)
        self.symbols = np.zeros(n + texts, np.uint64)
        self.symbols[np.arange(n) + words.text_of()] = words.hash
        self.ends = self.symbols == 0
        self.bits: dict[tuple[int, int], np.ndarray] = {}

    def _bits(self, repeat: int, block: int) -> np.ndarray:
        if (repeat, block) not in self.bits:
            made = mix(self.symbols + np.uint64(int(_SEED) * (1 + repeat + 1000 * block) % 2**64))
            made[self.ends] = 0
            self.bits = {(repeat, block): made} if block == 0 else {**self.bits, (repeat, block): made}
        return self.bits[repeat, block]

    def keys(self, starts: np.ndarray, size: SizeClass, repeat: int) -> np.ndarray:
        """Key of the walk from each start (in positions with one end symbol per text before)."""
        draw = np.random.default_rng([repeat, size.steps])
        edges = np.linspace(0, size.steps, SAMPLED + 1).astype(int)
        sampled = {int(draw.integers(a, max(b, a + 1))) for a, b in zip(edges[:-1], edges[1:], strict=True)}
        place = starts.astype(np.int64)
        key = np.full(len(starts), np.uint64(size.steps * 64 + repeat), np.uint64)
        move = np.empty(len(starts), np.uint64)
        for step in range(max(sampled) + 1):
            if step in sampled:
                key = key * _SEED + self.symbols.take(place, mode="clip")
            self._bits(repeat, step // 64).take(place, out=move, mode="clip")
            np.right_shift(move, np.uint64(step % 64), out=move)
            np.bitwise_and(move, np.uint64(1), out=move)
            place += move.view(np.int64)
        return mix(key)


def edit_match(item: list[str], text: list[str]) -> tuple[int, int, int]:
    """Least word edit distance of `item` to a stretch of `text`, and that stretch (the first of the best ends)."""

    def last_row(a: list[str], b: list[str], free: bool) -> np.ndarray:
        codes: dict[str, int] = {}
        x = np.array([codes.setdefault(w, len(codes)) for w in a], dtype=np.int64)
        y = np.array([codes.setdefault(w, len(codes)) for w in b], dtype=np.int64)
        at = np.arange(len(b) + 1)
        row = np.zeros(len(b) + 1, np.int64) if free else at.copy()
        for i, w in enumerate(x, 1):
            new = np.empty_like(row)
            new[0] = i
            new[1:] = np.minimum(row[1:] + 1, row[:-1] + (y != w))
            row = np.minimum.accumulate(new - at) + at
        return row

    row = last_row(item, text, True)
    end = int(row.argmin())
    back = last_row(item[::-1], text[:end][::-1], False)
    return int(row[end]), end - int(back.argmin()), end


def item_keys(items: DataFrame, repeats: int) -> DataFrame:
    """Keys of every start of every item: item, digest of its text, number of its words, the start and the key; never the text."""

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in chunks(batch, "text", 300_000):
                walks = Walks(words_of(texts_of(piece.column("text")), lower=True))
                for i in range(piece.num_rows):
                    n = int(walks.first[i + 1] - walks.first[i]) - 1
                    if n < MIN_WORDS:
                        continue
                    size = size_class(n)
                    shift = np.arange(max(1, n - size.reach + 1))
                    for repeat in range(size.repeats(repeats)):
                        keys = walks.keys(walks.first[i] + shift, size, repeat).view(np.int64)
                        same = pa.array(np.full(len(shift), i))
                        columns = [piece.column("item").take(same), piece.column("said").take(same), pa.array(np.full(len(shift), n, np.int32))]
                        yield pa.RecordBatch.from_arrays([*columns, pa.array(shift, pa.int32()), pa.array(keys)], ["item", "said", "item_words", "shift", "key"])

    kind = items.schema["item"].dataType.simpleString()
    return items.mapInArrow(keyed, f"item {kind}, said long, item_words int, shift int, key long")


def key_filter(keys: DataFrame) -> np.ndarray:
    """Bits of the slots that items' keys fall in: 2**FILTER_BITS bits (8 MB), however many items there are."""
    slot = F.shiftrightunsigned("key", 64 - FILTER_BITS)
    bits = keys.groupBy(F.shiftright(slot, 5).alias("at")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), (slot % 32).cast("int"))).alias("bits"))
    found = bits.toPandas()
    out = np.zeros(1 << (FILTER_BITS - 5), np.uint32)
    out[found["at"].to_numpy(np.int64)] = found["bits"].to_numpy(np.int64).astype(np.uint32)
    return out


def window_hits(docs: DataFrame, slots: np.ndarray, sizes: list[SizeClass], repeats: int, id_col: str, text_col: str) -> DataFrame:
    """Windows of documents whose key is in the filter: document, key, first word, the words around it and where they begin."""
    shared = docs.sparkSession.sparkContext.broadcast(slots)

    def hits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        # One byte per 128 bits of the filter stays in a processor's cache.
        coarse = (table.reshape(-1, 4) != 0).any(axis=1)
        for batch in batches:
            for piece in chunks(batch, "text"):
                texts = texts_of(piece.column("text"))
                words = words_of(texts, lower=True)
                walks = Walks(words)
                count = np.diff(words.first)
                found: list[list[np.ndarray]] = []
                starts = []
                for size in sizes:
                    number = -(-count // size.stride)
                    owner = np.repeat(np.arange(len(count)), number)
                    nth = (np.arange(len(owner)) - np.repeat(np.cumsum(number) - number, number)) * size.stride
                    starts.append((size, owner, nth, walks.first[:-1][owner] + nth))
                for repeat in range(max(size.repeats(repeats) for size in sizes)):
                    for size, owner, nth, start in starts:
                        if repeat >= size.repeats(repeats):
                            continue
                        keys = walks.keys(start, size, repeat)
                        likely = np.flatnonzero(coarse.take((keys >> np.uint64(64 - FILTER_BITS + 7)).astype(np.int64), mode="clip"))
                        slot = (keys[likely] >> np.uint64(64 - FILTER_BITS)).astype(np.int64)
                        hit = likely[((table[slot >> 5] >> (slot & 31).astype(np.uint32)) & np.uint32(1)).astype(bool)]
                        found.append([keys[hit].view(np.int64), owner[hit], nth[hit], np.full(len(hit), size.below)])
                keys, owner, nth, below = (np.concatenate(c) for c in zip(*found, strict=True))
                # An item that is aligned here begins less than `below` words before and ends less than 1.25 * below after.
                low = np.maximum(nth - below - below // 4, 0)
                high = np.minimum(nth + below + below // 4, count[owner])
                base = words.first[:-1][owner]
                raw = texts.data.tobytes()
                stretch = [raw[a:b].decode() for a, b in zip(words.start[base + low], words.end[base + high - 1], strict=True)] if len(owner) else []
                yield pa.RecordBatch.from_arrays(
                    [piece.column("doc").take(pa.array(owner)), pa.array(keys), pa.array(nth), pa.array(low), pa.array(stretch, pa.string())],
                    ["doc", "key", "start", "low", "stretch"],
                )

    kind = docs.schema[id_col].dataType.simpleString()
    picked = docs.select(docs[id_col].alias("doc"), no_text(text_col).alias("text"))
    return picked.mapInArrow(hits, f"doc {kind}, key long, start long, low long, stretch string")


def find_leaks(
    docs: DataFrame,
    items: DataFrame,
    edits: float = EDITS,
    repeats: int = REPEATS,
    doc_id: str = "doc_id",
    doc_text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
) -> DataFrame:
    """Pairs of document and benchmark item: the document holds the item's words with at most `edits` of them edited.

    Words are compared with A-Z lowered. Per pair the least distance and the first such stretch (in words) are given. Items
    under five words are not looked for; null and empty texts leak nothing; rows with the same id (null too) count as one
    document or item; repeated rows change nothing; other columns are not read; an empty table gives no rows. Nothing that grows
    with documents or items is broadcast: windows that pass the fixed-size filter meet the items' keys in a shuffle join.
    """
    known = items.select(items[item_id].alias("item"), no_text(item_text).alias("text")).withColumn("said", F.xxhash64("text"))
    known = written(known.dropDuplicates(["item", "said"]), "items")
    keys = written(item_keys(known, repeats), "item-keys")
    lengths = [row.item_words for row in keys.select(F.floor(F.log2("item_words")).alias("c"), "item_words").groupBy("c").agg(F.min("item_words").alias("item_words")).collect()]
    sizes = sorted({size_class(n) for n in lengths}, key=lambda s: s.least)
    if not sizes:
        sizes = [size_class(8)]
    hits = window_hits(docs, key_filter(keys), sizes, repeats, doc_id, doc_text)
    # A stretch reaches further than begins of one item differ in a 32nd of its words, so one stretch serves them all.
    near = F.floor((F.col("start") - F.col("shift")) / F.greatest(F.lit(1), F.floor(F.col("item_words") / 32)))
    aligned = hits.join(keys, "key").withColumn("begin", near)
    one = aligned.groupBy("doc", "item", "said", "begin").agg(F.min(F.struct("low", "stretch")).alias("v"))
    texts = known.select(F.col("item").alias("its_item"), F.col("said").alias("its_said"), F.col("text").alias("item_text"))
    mine = F.col("item").eqNullSafe(F.col("its_item")) & (F.col("said") == F.col("its_said"))
    candidates = one.join(texts, mine).select("doc", "item", "v.*", "item_text")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.to_pylist()
            out: list[tuple] = []
            for row in rows:
                item, text = (lowered_words(row[c]) for c in ("item_text", "stretch"))
                # Every word of the item that the stretch lacks costs an edit.
                held = set(text)
                if sum(w not in held for w in item) > edits * len(item):
                    continue
                distance, begin, end = edit_match(item, text)
                if distance <= edits * len(item):
                    out.append((row["doc"], row["item"], len(item), distance, row["low"] + begin, row["low"] + end))
            columns = list(zip(*out, strict=True)) or [[]] * 6
            kinds = (batch.schema.field(0).type, batch.schema.field(1).type, *[pa.int64()] * 4)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["doc", "item", "item_words", "distance", "start_word", "end_word"])

    doc_kind, item_kind = (f.dataType.simpleString() for f in (docs.schema[doc_id], items.schema[item_id]))
    found = candidates.mapInArrow(verify, f"doc {doc_kind}, item {item_kind}, item_words long, distance long, start_word long, end_word long")
    best = found.groupBy("doc", "item").agg(F.min(F.struct("distance", "start_word", "end_word", "item_words")).alias("v"))
    return best.select(F.col("doc").alias(doc_id), F.col("item").alias(item_id), "v.item_words", "v.distance", "v.start_word", "v.end_word")


_SPLIT = dict.fromkeys(map(ord, "\t\n\x0b\x0c\r"), " ") | {c: c + 32 for c in range(65, 91)}


def lowered_words(text: str) -> list[str]:
    """The words that walks read: split at ASCII white space, A-Z lowered."""
    return [w for w in text.translate(_SPLIT).split(" ") if w]


def drop_leaks(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of `docs` that hold no benchmark item, with all their columns. Rows without an id are judged together."""
    hit = find_leaks(docs, items, doc_id=id_col, doc_text=text_col, **options).select(F.col(id_col).alias("__hit")).distinct()
    return docs.join(hit, docs[id_col].eqNullSafe(hit["__hit"]), "left_anti")
