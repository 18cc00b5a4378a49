"""Substring deduplication by recompression.

Rounds name runs of a token and then pairs of neighbours (left and right kinds by a hash of the name). A name is a digest of what
it stands for, so that every task of the cluster gives the same run or pair the same name without asking another, and equal
stretches of text get equal symbols inside. For a window of words, the first symbol that its own words decide, whatever stands
around, is its anchor, at the highest level that fits: both occurrences of a repeated window agree on it. Anchors whose phrase
occurs once anywhere rule out their windows; the windows of the others are compared over the whole corpus.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import NO_ID, Words, chunks, mix, no_text, texts_of, whole, windows, words_of

WINDOW, PHRASE, ROUNDS = 20, 6, 8
_NAME = np.uint64(0xC2B2AE3D27D4EB4F)


class Level:
    """Symbols of one level: name, first word, and the last word (exclusive) that had to be read to tell the symbol."""

    def __init__(self, name: np.ndarray, start: np.ndarray, reach: np.ndarray, last: np.ndarray):
        self.name, self.start, self.reach, self.last = name, start, reach, last  # last: last symbol of its text


def first_level(words: Words) -> Level:
    n = len(words.hash)
    last = np.zeros(n, dtype=bool)
    ends = words.first[1:][np.diff(words.first) > 0] - 1
    last[ends] = True
    return Level(words.hash, np.arange(n), np.arange(1, n + 1), last)


def name_runs(level: Level) -> tuple[Level, np.ndarray]:
    """Name maximal runs of one symbol. Also each old symbol's run. A run is known once the symbol after it was read."""
    n = len(level.name)
    opens = np.ones(n, dtype=bool)
    opens[1:] = (level.name[1:] != level.name[:-1]) | level.last[:-1]
    at = np.flatnonzero(opens)
    end = np.append(at[1:], n)
    size = end - at
    name = np.where(size > 1, mix(level.name[at] * _NAME + size.astype(np.uint64)), level.name[at])
    closing = level.last[end - 1]
    follow = level.reach[np.minimum(end, n - 1)]
    # At a text's end the symbol after the run is missing: one word more than the text has.
    reach = np.where(closing, level.reach[end - 1] + 1, follow)
    return Level(name, level.start[at], reach, closing), np.cumsum(opens) - 1


def name_pairs(level: Level, turn: int) -> tuple[Level, np.ndarray, np.ndarray]:
    """Name neighbours of left and right kind. Also which old symbols are of the right kind, and each old symbol's new one."""
    n = len(level.name)
    right = (mix(level.name + np.uint64(int(_NAME) * (turn + 1) % 2**64)) & np.uint64(1)).astype(bool)
    joins = np.zeros(n, dtype=bool)  # with the next one
    joins[:-1] = ~right[:-1] & right[1:] & ~level.last[:-1]
    stays = np.ones(n, dtype=bool)
    stays[1:] = ~joins[:-1]
    at = np.flatnonzero(stays)
    after = np.minimum(at + 1, n - 1)
    name = np.where(joins[at], mix(level.name[at] * _NAME ^ mix(level.name[after] + np.uint64(1))), level.name[at])
    looks = ~right[at]
    reach = np.where(looks, np.where(level.last[at], level.reach[at] + 1, level.reach[after]), level.reach[at])
    reach = np.maximum(reach, level.reach[at])
    last = level.last[at] | (joins[at] & level.last[after])
    return Level(name, level.start[at], reach, last), right, np.cumsum(stays) - 1


def anchors(words: Words, width: int = WINDOW, phrase: int = PHRASE, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """Starts of whole windows, and the anchor (a word) of each.

    At each level the window's first symbol is given up where its left neighbour could belong to it: the first run always, and
    a symbol of the right kind. All that was read lies inside the window, else the level below decides; level 0 always can.
    """
    n = len(words.hash)
    window = np.flatnonzero(whole(words.first, width, max(n - width + 1, 0))) if n >= width else np.zeros(0, np.int64)
    best = window.copy()
    if not len(window):
        return window, best
    level = first_level(words)
    level, of = name_runs(level)
    alive = np.arange(len(window))
    at = of[window] + 1
    seen = level.start[np.minimum(at, len(level.start) - 1)] + 1
    limit = window + width
    for turn in range(rounds):
        fits = (at < len(level.start)) & (seen <= limit[alive])
        alive, at, seen = alive[fits], at[fits], seen[fits]
        seen = np.maximum(seen, level.reach[at])
        upper, right, of = name_pairs(level, turn)
        at = at + right[at]
        fits = (at < len(level.start)) & (seen <= limit[alive])
        alive, at, seen = alive[fits], at[fits], seen[fits]
        place = level.start[at]
        good = place + phrase <= limit[alive]
        alive, at, seen, place = alive[good], at[good], seen[good], place[good]
        best[alive] = place
        at = of[at]
        level = upper
        if not len(alive):
            break
    return window, best


def _local_first(key: np.ndarray, doc: np.ndarray, tag: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order of rows by (key, doc, tag, at); in that order, which are the first of their key, and which keys come again."""
    order = np.lexsort((at, tag, doc, key))
    k, d, t, a = key[order], doc[order], tag[order], at[order]
    first = np.ones(len(order), dtype=bool)
    first[1:] = k[1:] != k[:-1]
    same = np.zeros(len(order), dtype=bool)
    same[1:] = ~first[1:] & (d[1:] == d[:-1]) & (t[1:] == t[:-1]) & (a[1:] == a[:-1])
    return order[~same], first[~same], k[~same]


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Rows with the key of a document: its id (null as the least) and a 64-bit hash of its text."""
    tag = F.xxhash64(no_text(text_col))
    return docs.select(F.coalesce(docs[id_col].cast("long"), F.lit(NO_ID)).alias("doc"), tag.alias("tag"), no_text(text_col).alias("text"))


def _per_document(places: DataFrame) -> DataFrame:
    return places.select("doc", "tag", F.col("at").cast("int").alias("place")).groupBy("doc", "tag").agg(F.collect_list("place").alias("places"))


ROWS = "key long, doc long, tag long, at long"


def _batch(key: np.ndarray, doc: np.ndarray, tag: np.ndarray, at: np.ndarray) -> pa.RecordBatch:
    """Rows in the order of their documents: neighbours share doc and tag, which shuffle files then hold in few bytes."""
    order = np.lexsort((at, tag, doc))
    columns = [pa.array(c[order]) for c in (key.view(np.int64), doc, tag, at)]
    return pa.RecordBatch.from_arrays(columns, ["key", "doc", "tag", "at"])


def _settled(doc: np.ndarray, tag: np.ndarray, at: np.ndarray) -> pa.RecordBatch:
    """Rows that are settled in their chunk: a negative key of their document marks them."""
    return _batch(mix(doc.view(np.uint64) ^ mix(tag.view(np.uint64))) | np.uint64(1 << 63), doc, tag, at)


def _owned(piece: pa.RecordBatch, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Id and text hash of the documents that own the places."""
    return piece.column("doc").to_numpy(zero_copy_only=False)[owner], piece.column("tag").to_numpy(zero_copy_only=False)[owner]


def anchor_rows(docs: DataFrame, width: int, phrase: int) -> DataFrame:
    """Anchors with the digest of their phrase. Of equal phrases in a chunk of rows only the first meets other chunks."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in chunks(batch, "text"):
                words = words_of(texts_of(piece.column("text")))
                _, anchor = anchors(words, width, phrase)
                place = np.unique(anchor)
                key = windows(words.hash, phrase, 0xA0761D6478BD642F)[place]
                owner = np.searchsorted(words.first, place, side="right") - 1
                (doc, tag), at = _owned(piece, owner), place - words.first[owner]
                order, first, k = _local_first(key, doc, tag, at)
                again = ~first
                again[:-1] |= again[1:]
                doc, tag, at = doc[order], tag[order], at[order]
                # 48 bits rule out nearly all phrases that occur once; others only cost a look at their windows.
                yield _batch(k[first] >> np.uint64(16), doc[first], tag[first], at[first])
                yield _settled(doc[again], tag[again], at[again])

    return docs.mapInArrow(emit, ROWS)


def window_rows(docs: DataFrame, width: int, phrase: int) -> DataFrame:
    """Windows of repeated anchors (`places` of each document) with their digest; later ones of a chunk are known to be repeats."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in chunks(batch, "text"):
                words = words_of(texts_of(piece.column("text")))
                window, anchor = anchors(words, width, phrase)
                lists = piece.column("places")
                owner = np.repeat(np.arange(piece.num_rows), lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
                marked = np.zeros(len(words.hash) + 1, dtype=bool)
                marked[words.first[owner] + lists.flatten().to_numpy(zero_copy_only=False)] = True
                window = window[marked[anchor]]
                key = windows(words.hash, width, 0xE7037ED1A0B428DB)[window]
                owner = np.searchsorted(words.first, window, side="right") - 1
                (doc, tag), at = _owned(piece, owner), window - words.first[owner]
                order, first, k = _local_first(key, doc, tag, at)
                doc, tag, at = doc[order], tag[order], at[order]
                yield _batch(k[first] >> np.uint64(1), doc[first], tag[first], at[first])
                yield _settled(doc[~first], tag[~first], at[~first])

    return docs.mapInArrow(emit, ROWS)


def deduplicate(docs: DataFrame, width: int = WINDOW, phrase: int = PHRASE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, n_words, n_removed, kept_text (kept words joined by one space) and its digest.

    A word goes if a window of `width` words over it also starts earlier (smaller id, or same document and earlier place). Null
    texts count as empty; texts under `width` words keep all; null ids are the smallest; rows with the same id and text are one
    document, with the same id and other text they are ordered by the 64-bit hash of the text that tells them apart. Extra columns are not read.

    Repeats inside a chunk of rows are settled there, so that a passage of a third of all documents reaches the shuffle once
    per chunk. Windows are told apart by 63-bit digests.
    """
    keyed = _keyed(docs, id_col, text_col)
    found = anchor_rows(keyed, width, phrase)
    again = F.count("*").over(Window.partitionBy("key")) > 1
    candidates = _per_document(found.withColumn("again", again | (F.col("key") < 0)).where("again"))
    asked = keyed.join(candidates, ["doc", "tag"]).select("doc", "tag", "text", "places")
    rows = window_rows(asked, width, phrase)
    later = F.rank().over(Window.partitionBy("key").orderBy("doc", "tag", "at")) > 1
    repeats = _per_document(rows.withColumn("later", later | (F.col("key") < 0)).where("later"))
    final = keyed.join(repeats, ["doc", "tag"], "left").select("doc", "text", "places")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in chunks(batch, "text"):
                texts = texts_of(piece.column("text"))
                raw = texts.data.tobytes()
                sizes, removed, kept = [], [], []
                for i, places in enumerate(piece.column("places")):
                    words = raw[texts.begins[i] : texts.begins[i + 1]].split()
                    sizes.append(len(words))
                    if places.is_valid and len(places):
                        edge = np.zeros(len(words) + 1, np.int64)
                        at = places.values.to_numpy(zero_copy_only=False)
                        np.add.at(edge, at, 1)
                        np.add.at(edge, at + width, -1)
                        stays = np.cumsum(edge[:-1]) == 0
                        words = list(compress(words, stays))
                    removed.append(sizes[-1] - len(words))
                    kept.append(b" ".join(words))
                digests = [hashlib.sha256(k).hexdigest() for k in kept]
                yield pa.RecordBatch.from_arrays(
                    [piece.column("doc"), pa.array(sizes, pa.int64()), pa.array(removed, pa.int64()), pa.array([k.decode() for k in kept], pa.string()), pa.array(digests, pa.string())],
                    ["doc", "n_words", "n_removed", "kept_text", "kept_sha256"],
                )

    out = final.mapInArrow(cut, "doc long, n_words long, n_removed long, kept_text string, kept_sha256 string")
    name = F.nullif("doc", F.lit(NO_ID)).cast(docs.schema[id_col].dataType).alias(id_col)
    return out.select(name, "n_words", "n_removed", "kept_text", "kept_sha256")
