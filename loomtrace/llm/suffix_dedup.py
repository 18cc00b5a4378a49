"""Byte-level deduplication by a hash-compared suffix sort.

Every window of `width` bytes has an anchor, the place of its least 64-byte gram; equal windows have it at the same offset.
Anchors whose gram occurs once anywhere rule out their windows. The others' surroundings meet by gram, and the windows' suffixes
are put in order by a mergesort that compares two suffixes by binary search over prefix hashes; neighbours with a common
extension of `width` bytes are repeats, which their bytes then confirm.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .recompression import _keyed, _owned
from .shared import NO_ID, PrefixHash, Texts, chunks, mix, texts_of

WIDTH, GRAM = 200, 64
#: More surroundings of one gram than this are not sorted in one task; their windows are spread by digest.
CROWD = 2000
_POSITION = np.uint64(2**30 - 1)


def anchors(texts: Texts, hashes: PrefixHash, width: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts of whole windows and the anchor of each: the leftmost least gram, by doubling minima."""
    n = len(texts.data)
    none = np.zeros(0, np.int64)
    if n < width:
        return none, none
    at = np.arange(n - gram + 1)
    least = (hashes.of(at, at + gram) & ~_POSITION) | at.astype(np.uint64)
    span, size = width - gram + 1, 1
    while size * 2 <= span:
        least = np.minimum(least[: len(least) - size], least[size:])
        size *= 2
    if size < span:
        least = np.minimum(least[: len(least) - (span - size)], least[span - size :])
    anchor = (least & _POSITION).astype(np.int64)
    length = np.diff(texts.begins)
    room = np.maximum(length - width + 1, 0)
    start = np.arange(room.sum()) - np.repeat(np.cumsum(room) - room, room) + np.repeat(texts.begins[:-1], room)
    return start, anchor[start]


def anchor_rows(docs: DataFrame, width: int, gram: int) -> DataFrame:
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in chunks(batch, "text"):
                texts = texts_of(piece.column("text"))
                hashes = PrefixHash(texts.data)
                place = np.unique(anchors(texts, hashes, width, gram)[1])
                owner = np.searchsorted(texts.begins, place, side="right") - 1
                columns = [hashes.of(place, place + gram).view(np.int64), *_owned(piece, owner), place - texts.begins[owner]]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["key", "doc", "tag", "at"])

    return docs.mapInArrow(emit, "key long, doc long, tag long, at long")


SURROUNDINGS = "key long, check long, doc long, tag long, at long, known boolean, windows int, left int, bytes binary"


def surrounding_rows(docs: DataFrame, width: int, gram: int) -> DataFrame:
    """Of each repeated anchor (`places` of each document: twice the place, plus one in a crowd) the bytes of its windows.

    Equal surroundings in one chunk of rows are settled there: only the first goes on, the others are known to be repeats.
    Windows of crowded grams go on as two independent digests each, under a key of their own.
    """

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in chunks(batch, "text"):
                texts = texts_of(piece.column("text"))
                hashes = PrefixHash(texts.data)
                start, anchor = anchors(texts, hashes, width, gram)
                lists = piece.column("places")
                owner = np.repeat(np.arange(piece.num_rows), lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
                marks = lists.flatten().to_numpy(zero_copy_only=False)
                kind = np.zeros(len(texts.data) + 1, np.int8)
                kind[texts.begins[owner] + (marks >> 1)] = 1 + (marks & 1)
                wanted = kind[anchor] if len(anchor) else np.zeros(0, np.int8)
                plain = wanted == 1
                s, a = start[plain], anchor[plain]
                edge = np.flatnonzero(np.append(True, a[1:] != a[:-1])) if len(a) else np.zeros(0, np.int64)
                low, place, number = s[edge], a[edge], np.diff(np.append(edge, len(a)))
                high = low + number - 1 + width
                key = hashes.of(place, place + gram)
                check = mix(hashes.of(low, high) + (place - low).astype(np.uint64))
                order = np.lexsort((low, check, key))
                same = np.zeros(len(order), dtype=bool)
                same[1:] = (key[order][1:] == key[order][:-1]) & (check[order][1:] == check[order][:-1])
                twice = same.copy()
                twice[:-1] |= same[1:]
                if len(order):
                    yield from _rows(piece, texts, order, same, twice, key, check, low, number, place - low, high)
                s, a = start[wanted == 2], anchor[wanted == 2]
                if len(s):
                    key = mix(hashes.of(s, s + width) + np.uint64(1))
                    check = hashes.of(s, s + width // 2) ^ mix(hashes.of(s + width // 2, s + width))
                    order = np.lexsort((s, check, key))
                    same = np.zeros(len(order), dtype=bool)
                    same[1:] = (key[order][1:] == key[order][:-1]) & (check[order][1:] == check[order][:-1])
                    twice = same.copy()
                    twice[:-1] |= same[1:]
                    yield from _rows(piece, texts, order, same, twice, key, check, s, np.ones(len(s), np.int64), a - s, None)

    return docs.mapInArrow(emit, SURROUNDINGS)


def _rows(piece, texts, order, same, twice, key, check, low, number, left, high) -> Iterator[pa.RecordBatch]:
    owner = np.searchsorted(texts.begins, low, side="right") - 1
    (doc, tag), at = _owned(piece, owner), low - texts.begins[owner]
    spread = mix(doc.view(np.uint64) + mix(tag.view(np.uint64) + mix(at.view(np.uint64))))
    raw = texts.data.tobytes() if high is not None else b""
    for cut in range(0, len(order), 5000):
        o, later, again = order[cut : cut + 5000], same[cut : cut + 5000], twice[cut : cut + 5000]
        content = [None if x or high is None else raw[a:b] for x, a, b in zip(later, low[o], (high if high is not None else low)[o], strict=True)]
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(np.where(later, spread[o], key[o]).view(np.int64)),
                pa.array(check[o].view(np.int64)),
                pa.array(doc[o]),
                pa.array(tag[o]),
                pa.array(at[o]),
                pa.array(again),
                pa.array(number[o], pa.int32()),
                pa.array(left[o], pa.int32()),
                pa.array(content, pa.binary()),
            ],
            ["key", "check", "doc", "tag", "at", "known", "windows", "left", "bytes"],
        )


class SuffixOrder:
    """Mergesort of suffixes inside blocks; two suffixes are compared by their common extension, at most `width` bytes."""

    def __init__(self, data: np.ndarray, width: int):
        self.data, self.width, self.hashes = data, width, PrefixHash(data)

    def extension(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Length of the common extension of each pair, by binary search over prefix hashes."""
        low, high = np.zeros(len(a), np.int64), np.full(len(a), self.width)
        for _ in range(self.width.bit_length()):
            middle = (low + high + 1) >> 1
            same = self.hashes.of(a, a + middle) == self.hashes.of(b, b + middle)
            low, high = np.where(same, middle, low), np.where(same, high, np.maximum(middle - 1, low))
        return low

    def before(self, a: np.ndarray, b: np.ndarray, ties: np.ndarray) -> np.ndarray:
        """Whether suffix `a` comes before `b`; equal ones as `ties` says."""
        common = self.extension(a, b)
        last = len(self.data) - 1
        left, right = self.data[np.minimum(a + common, last)], self.data[np.minimum(b + common, last)]
        return np.where(common == self.width, ties, left < right)

    def sort(self, suffix: np.ndarray, block: np.ndarray) -> np.ndarray:
        """Suffixes in order inside each block; `block` does not decrease. All blocks' runs are merged at once per round."""
        n = len(suffix)
        begin = np.searchsorted(block, block, side="left")
        end = np.searchsorted(block, block, side="right")
        at, size = np.arange(n) - begin, 1
        out = suffix.copy()
        most = int((end - begin).max(initial=0))
        while size < most:
            run = at // size
            other = begin + (run ^ 1) * size
            stop = np.minimum(other + size, end)
            first = (run & 1) == 0
            todo = np.flatnonzero(other < end)
            low, high = other[todo].copy(), stop[todo].copy()
            while True:
                open_ = np.flatnonzero(low < high)
                if not len(open_):
                    break
                middle = (low[open_] + high[open_]) >> 1
                # Of equal suffixes those of the first run stay in front.
                less = self.before(out[middle], out[todo[open_]], ~first[todo[open_]])
                low[open_] = np.where(less, middle + 1, low[open_])
                high[open_] = np.where(less, high[open_], middle)
            place = begin + at
            target = place.copy()
            pair = begin[todo] + (run[todo] >> 1) * 2 * size
            target[todo] = pair + (at[todo] - run[todo] * size) + (low - other[todo])
            merged = np.empty_like(out)
            merged[target] = out
            out, size = merged, size * 2
        return out


def repeated_starts(data: np.ndarray, begin: np.ndarray, windows: np.ndarray, left: np.ndarray, group: np.ndarray, width: int) -> np.ndarray:
    """For every window (text by text) whether another text of its group has the same `width` bytes at the same offset."""
    text = np.repeat(np.arange(len(begin)), windows)
    nth = np.arange(len(text)) - np.repeat(np.cumsum(windows) - windows, windows)
    suffix, offset = begin[text] + nth, left[text] - nth
    order = np.lexsort((offset, group[text]))
    g, o = group[text][order], offset[order]
    block = np.cumsum(np.append(True, (g[1:] != g[:-1]) | (o[1:] != o[:-1]))) - 1
    sorter = SuffixOrder(data, width)
    ordered = sorter.sort(suffix[order], block)
    inside = np.flatnonzero(block[1:] == block[:-1])
    near = inside[sorter.hashes.of(ordered[inside], ordered[inside] + width) == sorter.hashes.of(ordered[inside + 1], ordered[inside + 1] + width)]
    rows = np.lib.stride_tricks.sliding_window_view(data, width)
    hit = np.zeros(len(data), dtype=bool)
    for cut in range(0, len(near), 20_000):
        a, b = ordered[near[cut : cut + 20_000]], ordered[near[cut : cut + 20_000] + 1]
        equal = (rows[a] == rows[b]).all(axis=1)
        hit[a[equal]] = True
        hit[b[equal]] = True
    return hit[suffix]


def settle(table: pa.Table, width: int) -> pa.RecordBatch:
    """Removed stretches (doc, tag, at, size) of rows that are sorted by key and check and hold whole groups."""
    key, check, doc, tag, at = (table.column(c).to_numpy() for c in ("key", "check", "doc", "tag", "at"))
    known = table.column("known").to_numpy(zero_copy_only=False).astype(bool)
    number, left = table.column("windows").to_numpy().astype(np.int64), table.column("left").to_numpy().astype(np.int64)
    content = table.column("bytes").combine_chunks()
    holds = content.is_valid().to_numpy(zero_copy_only=False)
    n = len(key)
    newkey = np.append(True, key[1:] != key[:-1])
    newkind = newkey | np.append(True, (check[1:] != check[:-1]) | (holds[1:] != holds[:-1]))
    kind = np.cumsum(newkind) - 1
    count = np.bincount(kind, 1 + known)
    whole = count[kind] > 1
    # Kinds that occur once, in keys with several kinds, are compared with the others of their key.
    first = np.flatnonzero(newkind & holds)
    group = (np.cumsum(newkey) - 1)[first]
    several = np.bincount(group, minlength=1)[group] > 1
    single = np.bincount(group, ~whole[first], minlength=1)[group] > 0
    reps = first[several & single]
    docs, tags, starts, sizes = [doc[whole]], [tag[whole]], [at[whole]], [number[whole] - 1 + width]
    if len(reps):
        size = number[reps] - 1 + width
        begin = np.cumsum(size) - size
        data = np.frombuffer(b"".join(content.take(pa.array(reps)).to_pylist()), np.uint8)
        hit = repeated_starts(data, begin, number[reps], left[reps], group[several & single], width)
        text = np.repeat(np.arange(len(reps)), number[reps])
        nth = np.arange(len(text)) - np.repeat(np.cumsum(number[reps]) - number[reps], number[reps])
        hit &= ~whole[reps][text]
        opens = np.flatnonzero(hit & np.append(True, ~hit[:-1] | (text[1:] != text[:-1])))
        closes = np.flatnonzero(hit & np.append(~hit[1:] | (text[1:] != text[:-1]), True))
        docs.append(doc[reps][text[opens]])
        tags.append(tag[reps][text[opens]])
        starts.append(at[reps][text[opens]] + nth[opens])
        sizes.append(closes - opens + width)
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c).astype(np.int64)) for c in (docs, tags, starts, sizes)], ["doc", "tag", "at", "size"]) if n else None


def removed_stretches(rows: DataFrame, width: int) -> DataFrame:
    placed = rows.repartition("key").sortWithinPartitions("key", "check")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch])
            held = table if held is None else pa.concat_tables([held, table])
            key = held.column("key").to_numpy()
            cut = int(np.searchsorted(key, key[-1], side="left"))
            if cut:
                yield settle(held.slice(0, cut), width)
                held = held.slice(cut)
        if held is not None and held.num_rows:
            yield settle(held, width)

    return placed.mapInArrow(work, "doc long, tag long, at long, size long")


def deduplicate_bytes(docs: DataFrame, width: int = WIDTH, gram: int = GRAM, crowd: int = CROWD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, n_bytes, n_removed, n_spans, kept_bytes and its digest.

    A byte goes if a string of `width` bytes over it also starts anywhere else, in another or the same document. Null texts
    count as empty; shorter texts keep all; null ids are allowed; rows with the same id and text stand in for one document
    each, so that they are repeats of one another; extra columns are not read; an empty table gives no rows.
    """
    keyed = _keyed(docs, id_col, text_col)
    found = anchor_rows(keyed, width, gram)
    counts = found.groupBy("key").agg(F.count("*").alias("rows")).where("rows > 1")
    crowded = (F.col("rows") > crowd).cast("long")
    marked = found.join(counts, "key").select("doc", "tag", (F.col("at") * 2 + crowded).alias("place"))
    candidates = marked.groupBy("doc", "tag").agg(F.collect_set("place").alias("places"))
    asked = keyed.join(candidates, ["doc", "tag"]).select("doc", "tag", "text", "places")
    stretches = removed_stretches(surrounding_rows(asked, width, gram), width)
    per_document = stretches.select("doc", "tag", F.struct(F.col("at").alias("start"), "size").alias("s"))
    removed = per_document.groupBy("doc", "tag").agg(F.collect_list("s").alias("stretches"))
    final = keyed.join(removed, ["doc", "tag"], "left").select("doc", "text", "stretches")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in chunks(batch, "text"):
                texts = texts_of(piece.column("text"))
                sizes, gone, spans, kept = [], [], [], []
                for i, found in enumerate(piece.column("stretches")):
                    data = texts.data[texts.begins[i] : texts.begins[i + 1]]
                    stays = np.ones(len(data), dtype=bool)
                    if found.is_valid and len(found):
                        edge = np.zeros(len(data) + 1, np.int64)
                        start = found.values.field("start").to_numpy(zero_copy_only=False)
                        np.add.at(edge, start, 1)
                        np.add.at(edge, start + found.values.field("size").to_numpy(zero_copy_only=False), -1)
                        stays = np.cumsum(edge[:-1]) == 0
                    out = ~stays
                    sizes.append(len(data))
                    gone.append(int(out.sum()))
                    spans.append(int((out & np.append(True, stays[:-1])).sum()) if len(data) else 0)
                    kept.append(data[stays].tobytes())
                digests = [hashlib.sha256(k).hexdigest() for k in kept]
                yield pa.RecordBatch.from_arrays(
                    [piece.column("doc"), *[pa.array(c, pa.int64()) for c in (sizes, gone, spans)], pa.array(kept, pa.binary()), pa.array(digests, pa.string())],
                    ["doc", "n_bytes", "n_removed", "n_spans", "kept_bytes", "kept_sha256"],
                )

    out = final.mapInArrow(cut, "doc long, n_bytes long, n_removed long, n_spans long, kept_bytes binary, kept_sha256 string")
    name = F.nullif("doc", F.lit(NO_ID)).cast(docs.schema[id_col].dataType).alias(id_col)
    return out.select(name, "n_bytes", "n_removed", "n_spans", "kept_bytes", "kept_sha256")
