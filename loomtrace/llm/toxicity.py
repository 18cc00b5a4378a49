"""Toxicity by compression: zstandard dictionaries of toxic and of ordinary text, compared window by window."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import Texts, chunks, mix, no_text, texts_of, words_of, written

#: Windows of words, their step, and the compressor.
WIDTH, STEP, LEVEL, MATCH = 8, 4, 3, 5
#: Size of the ordinary dictionary, most bytes of toxic text, and the lengths of the letter groups that toxic text is picked by.
ORDINARY_BYTES, TOXIC_BYTES, GRAMS = 112_640, 65_536, (5, 7)
#: A letter group marks toxic text if chance explains its places with a probability under exp(-CHANCE) and it is exp(RATIO) times as
#: frequent there as in ordinary texts.
CHANCE, RATIO = 8.0, 3.0
#: The words around a word that make its surroundings.
AROUND = (-2, -1, 1, 2)
#: Labelled rows, per label, from which everything is learnt; and the most windows that train the ordinary dictionary.
SAMPLE, SAMPLE_WINDOWS = 4000, 60_000
CUT = 0.3


@dataclass(frozen=True)
class Model:
    """Dictionary contents and the logistic calibration (intercept, best window, gain per word)."""

    ordinary: bytes
    toxic: bytes
    weights: tuple[float, float, float]
    prior: float


def lowered(texts: Texts) -> bytes:
    data = texts.data
    return np.where((data >= 65) & (data <= 90), data | 32, data).astype(np.uint8).tobytes()


def _compressor(content: bytes) -> zstandard.ZstdCompressor:
    options = zstandard.ZstdCompressionParameters.from_level(
        LEVEL, min_match=MATCH, hash_log=18, chain_log=18, window_log=18, write_content_size=0, write_checksum=0, write_dict_id=0, format=zstandard.FORMAT_ZSTD1_MAGICLESS
    )
    if not content:
        return zstandard.ZstdCompressor(compression_params=options)
    return zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT), compression_params=options)


class Meter:
    """Compressed lengths of windows with either dictionary.

    The toxic dictionary is the ordinary one with toxic text at its end, so that a window without such text is compressed alike
    by both and the difference measures toxic text alone.
    """

    def __init__(self, model: Model):
        self.both = _compressor(model.ordinary), _compressor(model.ordinary + model.toxic)

    def gains(self, data: bytes, start: np.ndarray, length: np.ndarray) -> np.ndarray:
        out = np.zeros(len(start), np.int64)
        spans = np.stack([start, length], axis=1).astype("<u8")
        for low in range(0, len(start), 4000):
            cut = spans[low : low + 4000].tobytes()
            sizes = []
            for compressor in self.both:
                packed = compressor.multi_compress_to_buffer(zstandard.BufferWithSegments(data, cut))
                sizes.append(np.fromiter((len(packed[i]) for i in range(len(packed))), np.int64, len(packed)))
            out[low : low + 4000] = sizes[0] - sizes[1]
        return out

    def features(self, texts: Texts) -> np.ndarray:
        """Per text: gain of the best window, and gains of all windows per word. A text without words has none."""
        words = words_of(texts)
        count = np.diff(words.first)
        owner, start, length = text_windows(words)
        gains = self.gains(lowered(texts), start, length) if len(start) else np.zeros(0, np.int64)
        best = np.zeros(len(count))
        np.maximum.at(best, owner, gains)
        total = np.bincount(owner, np.maximum(gains, 0), len(count)) if len(owner) else np.zeros(len(count))
        return np.stack([np.minimum(best, 12.0), np.sqrt(np.minimum(total / np.maximum(count, 1), 1.0)) * 10], axis=1)


def text_windows(words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows of WIDTH words every STEP words over whole texts, the last one reaching the end: text, first byte, bytes."""
    count = np.diff(words.first)
    number = np.where(count > 0, np.maximum(-(-(count - WIDTH) // STEP), 0) + 1, 0)
    owner = np.repeat(np.arange(len(count)), number)
    nth = np.arange(len(owner)) - np.repeat(np.cumsum(number) - number, number)
    first = words.first[:-1][owner] + nth * STEP
    last = np.minimum(first + WIDTH, words.first[1:][owner]) - 1
    if not len(first):
        return owner, first, first
    return owner, words.start[first], words.end[last] - words.start[first]


def contexts(texts: DataFrame) -> DataFrame:
    """(word, toxic, ordinary): in how many different surroundings (two words before and two after) a word stands in texts of
    either label. Copies and near copies of a text repeat their surroundings, so they do not make a word look frequent."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in chunks(batch, "text"):
                texts = texts_of(piece.column("text"))
                words = words_of(texts, lower=True)
                if not len(words.start):
                    continue
                data = lowered(texts)
                owner = words.text_of()
                around = np.zeros(len(owner), np.uint64)
                for step in AROUND:
                    other = np.zeros(len(owner), np.uint64)
                    to, of = (slice(step, None), slice(None, -step)) if step > 0 else (slice(None, step), slice(-step, None))
                    other[to] = np.where(owner[to] == owner[of], words.hash[of], 0)
                    around = mix(around * np.uint64(3) + other + np.uint64(1))
                label = piece.column("label").to_numpy()[owner]
                once = np.unique(np.stack([words.hash, around, label.astype(np.uint64)]), axis=1, return_index=True)[1]
                found = [data[a:b] for a, b in zip(words.start[once], words.end[once], strict=True)]
                columns = [pa.array(found, pa.binary()), pa.array(around[once].view(np.int64)), pa.array(label[once], pa.int32())]
                yield pa.RecordBatch.from_arrays(columns, ["word", "around", "label"])

    rows = texts.mapInArrow(emit, "word binary, around long, label int").distinct()
    return rows.groupBy("word").agg(F.count_if(F.col("label") == 1).alias("toxic"), F.count_if(F.col("label") == 0).alias("ordinary"))


def toxic_text(texts: DataFrame) -> bytes:
    """The stretches of words that mark toxic texts, most frequent last (nearest to the window).

    A letter group is a mark if chance does not explain where it stands: under the labels' shares of all surroundings, one as
    lopsided has a probability under exp(-CHANCE) (Chernoff's bound), and it is exp(RATIO) times as frequent in toxic texts. The
    rule holds at any number of texts; with more of them, rarer marks pass.
    """
    counts = written(contexts(texts), "words")
    total = counts.agg(F.coalesce(F.sum("toxic"), F.lit(0)).alias("toxic"), F.coalesce(F.sum("ordinary"), F.lit(0)).alias("ordinary")).first()
    if not total["toxic"] or not total["ordinary"]:
        return b""
    words = counts.where("toxic > 0")

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for word, toxic, ordinary in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                spaced = b" " + word
                rows += [(word, spaced[i : i + n], i, i + n, toxic, ordinary) for n in GRAMS for i in range(len(spaced) - n + 1)]
            columns = list(zip(*rows, strict=True)) or [[]] * 6
            kinds = (pa.binary(), pa.binary(), pa.int32(), pa.int32(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["word", "gram", "low", "high", "toxic", "ordinary"])

    found = counts.mapInArrow(places, "word binary, gram binary, low int, high int, toxic long, ordinary long")
    grams = found.select("word", "gram", "toxic", "ordinary").distinct().groupBy("gram").agg(F.sum("toxic").alias("a"), F.sum("ordinary").alias("b"))
    a, b, chance = F.col("a"), F.col("b"), total["toxic"] / (total["toxic"] + total["ordinary"])
    share = a / (a + b)
    part = lambda n, x, p: F.when(n > 0, n * F.log(x / p)).otherwise(0.0)
    surprise = part(a, share, chance) + part(b, 1 - share, 1 - chance)
    often = F.log((a + 0.5) / total["toxic"]) - F.log((b + 0.5) / total["ordinary"])
    marks = grams.where((share > chance) & (surprise > CHANCE) & (often > RATIO)).select("gram")
    hits = found.where("toxic > 0").select("word", "gram", "low", "high").join(marks, "gram")
    spans = hits.groupBy("word").agg(F.min("low").alias("low"), F.max("high").alias("high"))
    cut = F.expr("substring(concat(X'20', word), low + 1, high - low)").alias("stretch")
    stretches = spans.join(words, "word").select(cut, "toxic").groupBy("stretch").agg(F.sum("toxic").alias("times"))
    # A stretch has at least as many bytes as a letter group, which bounds how many fit.
    out, size = [], 0
    for row in stretches.orderBy(F.desc("times"), "stretch").limit(TOXIC_BYTES // min(GRAMS)).collect():
        stretch = bytes(row.stretch)
        if size + len(stretch) <= TOXIC_BYTES:
            out.append(stretch)
            size += len(stretch)
    return b"".join(reversed(out))


def trained(samples: list[bytes], size: int) -> bytes:
    """Content of a trained dictionary; the samples themselves where there are too few to train on."""
    try:
        content = zstandard.train_dictionary(size, samples).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-size:]
    return content[min(len(content) // 2, 512) :]  # without the entropy tables in front


def logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float, float]:
    """Ridge logistic regression by Newton steps."""
    x = np.column_stack([np.ones(len(x)), x])
    w, ridge = np.zeros(x.shape[1]), np.diag([1e-6, 1e-2, 1e-2])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        w -= np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge, x.T @ (p - y) + ridge @ w)
    return tuple(float(v) for v in w)


def sampled_windows(texts: DataFrame, most: int) -> list[bytes]:
    """About `most` windows from anywhere in the texts (column text), drawn by a hash of the window."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in chunks(batch, "text"):
                texts = texts_of(piece.column("text"))
                data = lowered(texts)
                _, start, length = text_windows(words_of(texts))
                found = [data[a : a + n] for a, n in zip(start, length, strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(found, pa.binary())], ["window"])

    found = texts.select("text").mapInArrow(emit, "window binary")
    return [bytes(r.window) for r in found.orderBy(F.xxhash64("window", F.lit(1)), "window").limit(most).collect()]


def measured(texts: DataFrame, model: Model) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of whole texts; only these come to the driver."""

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        meter = Meter(model)
        for batch in batches:
            for piece in chunks(batch, "text"):
                x = meter.features(texts_of(piece.column("text")))
                yield pa.RecordBatch.from_arrays([piece.column("id"), piece.column("label"), pa.array(x[:, 0]), pa.array(x[:, 1])], ["id", "label", "best", "gain"])

    kind = texts.schema["id"].dataType.simpleString()
    found = texts.select("id", "text", "label").mapInArrow(measure, f"id {kind}, label int, best double, gain double")
    frame = found.toPandas().drop_duplicates("id").sort_values("id")
    return frame[["best", "gain"]].to_numpy(float), frame["label"].to_numpy(int)


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample: int = SAMPLE) -> Model:
    """Everything comes from at most `sample` labelled rows of either label, drawn by a hash of the id.

    Texts are read whole. crc32(id) mod 4 = 2 is never read; remainders 0 and 1 give the dictionaries, 3 the calibration. Ids,
    languages and sources are not used in a score.
    """
    fold = F.crc32(F.col("id").cast("string").cast("binary")) % 4
    known = labels.select(labels[id_col].alias("id"), labels[label_col].cast("int").alias("label")).where("id is not null and label in (0, 1)")
    known = known.dropDuplicates(["id"]).withColumn("fold", fold).where(F.col("fold") != 2)
    shares = dict(known.groupBy("label").count().collect())
    if not shares:
        return Model(b"", b"", (-3.0, 0.0, 0.0), 0.0)
    order = F.xxhash64("id", F.lit(5))
    picked = known.where("label = 0").orderBy(order).limit(sample).unionByName(known.where("label = 1").orderBy(order).limit(sample))
    texts = docs.select(docs[id_col].alias("id"), no_text(text_col).alias("text"))
    # The ids of at most 2 * sample rows.
    chosen = written(texts.join(F.broadcast(picked), "id"), "labelled")
    drawn = dict(chosen.select("id", "label").distinct().groupBy("label").count().collect())
    if not drawn:
        return Model(b"", b"", (-3.0, 0.0, 0.0), 0.0)
    ordinary = trained(sampled_windows(chosen.where("fold <> 3 and label = 0"), SAMPLE_WINDOWS), ORDINARY_BYTES)
    model = Model(ordinary, toxic_text(chosen.where("fold <> 3").select("text", "label")), (0.0, 0.0, 0.0), 0.0)
    x, label = measured(chosen.where("fold = 3"), model)
    if len(set(label)) < 2:
        x, label = measured(chosen, model)
    weights = logistic(x, label.astype(float))
    # Both labels are drawn up to the same number; the intercept is set back to the share of toxic rows among all labelled ones.
    shift = math.log(max(shares.get(1, 0), 1) / max(shares.get(0, 0), 1)) - math.log(max(drawn.get(1, 0), 1) / max(drawn.get(0, 0), 1))
    return Model(ordinary, model.toxic, (weights[0] + shift, *weights[1:]), shift)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, held_out, score from 0 to 1, predicted (1 from 0.3 up).

    Every window of every whole text is compressed with both dictionaries. Null and empty texts get the score of a text without
    gains; null ids are not held out; repeated rows each give their row; no other column is read.
    """

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        meter = Meter(model)
        for batch in batches:
            for piece in chunks(batch, "text"):
                x = meter.features(texts_of(piece.column("text")))
                z = model.weights[0] + x @ np.asarray(model.weights[1:])
                yield pa.RecordBatch.from_arrays([piece.column("id"), pa.array(1 / (1 + np.exp(-np.clip(z, -30, 30))), pa.float64())], ["id", "score"])

    kind = docs.schema[id_col].dataType.simpleString()
    picked = docs.select(docs[id_col].alias("id"), no_text(text_col).alias("text"))
    scored = picked.mapInArrow(measure, f"id {kind}, score double")
    held = F.coalesce(F.crc32(F.col("id").cast("string").cast("binary")) % 4 == 2, F.lit(False))
    return scored.select(F.col("id").alias(id_col), held.alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    return score(docs, learn(docs, labels, id_col, text_col), id_col, text_col)


def drop_toxic(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", cut: float = CUT) -> DataFrame:
    """The rows of `docs` whose text scores under `cut`, with all their columns; null and empty texts stay."""
    model = learn(docs, labels, id_col, text_col)
    place = docs.columns.index(text_col)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        meter = Meter(model)
        for batch in batches:
            for piece in chunks(batch, batch.schema.names[place]):
                x = meter.features(texts_of(piece.column(place)))
                z = model.weights[0] + x @ np.asarray(model.weights[1:])
                yield piece.filter(pa.array(z < math.log(cut / (1 - cut))))

    return docs.mapInArrow(keep, docs.schema)
