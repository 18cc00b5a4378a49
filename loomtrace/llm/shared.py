"""Helpers shared by the operators: written tables in the cluster's shared folder, and vectorised words of Arrow texts."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

NO_ID = -(2**63)
CHUNK_BYTES = 3_000_000
ROWS_A_TASK = 100_000
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_M1, _M2, _STEP = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; one of our own only in a single local process, as in tests."""
    context = spark.sparkContext
    named = context.getConf().get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if named:
        return named
    if not context.master.startswith("local[") and context.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    folder = tempfile.mkdtemp(prefix="loomtrace-shared-")
    context.setCheckpointDir(folder)
    return context.getCheckpointDir()


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows of `df`, written once to the shared folder and read back: the lineage is cut and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/llm-{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def few_tasks(df: DataFrame, rows: int) -> DataFrame:
    """`df`, made from `rows` rows, in a task per ROWS_A_TASK of them if these are fewer than a shuffle's tasks."""
    tasks = max(1, -(-rows // ROWS_A_TASK))
    return df.coalesce(tasks) if tasks < int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) else df


def no_text(column: str) -> Column:
    """The text column with null as empty."""
    return F.coalesce(F.col(column), F.lit(""))


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of unsigned 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


@dataclass
class Texts:
    """UTF-8 bytes of several texts, one after the other, and where each begins (one entry more than texts)."""

    data: np.ndarray
    begins: np.ndarray


@dataclass
class Words:
    """Words of several texts: their bytes' start and end, their 64-bit hash, and the first word of each text."""

    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    first: np.ndarray

    def text_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def texts_of(column: pa.Array) -> Texts:
    """View an Arrow string column without building Python strings; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    begins = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    raw = column.buffers()[2]
    data = np.frombuffer(raw, dtype=np.uint8) if raw is not None else np.zeros(0, np.uint8)
    return Texts(data[begins[0] : begins[-1]], begins - begins[0])


def chunks(batch: pa.RecordBatch, column: str, limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch into runs of whole rows of about `limit` bytes of text."""
    size = texts_of(batch.column(column)).begins
    at = 0
    while at < batch.num_rows:
        upto = max(at + 1, int(np.searchsorted(size, size[at] + limit, side="right")) - 1)
        yield batch.slice(at, upto - at)
        at = upto


def words_of(texts: Texts, lower: bool = False) -> Words:
    """Words `[^\\x20\\x09-\\x0D]+` of each text, with a 64-bit hash of their bytes (A-Z lowered if asked)."""
    data, begins = texts.data, texts.begins
    if lower and len(data):
        data = np.where((data >= 65) & (data <= 90), data | 32, data)
    if not len(data):
        none = np.zeros(0, np.int64)
        return Words(none, none, none.astype(np.uint64), np.zeros(len(begins), np.int64))
    inside = ~_SPACE[data]
    edge = np.zeros(len(data) + 1, dtype=bool)
    edge[begins] = True
    opens = inside.copy()
    opens[1:] &= ~inside[:-1] | edge[1:-1]
    closes = inside.copy()
    closes[:-1] &= ~inside[1:] | edge[1:-1]
    start = np.flatnonzero(opens)
    end = np.flatnonzero(closes) + 1
    first = np.searchsorted(start, begins)
    return Words(start, end, hash_pieces(data, start, end - start), first)


def hash_pieces(data: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """64-bit hash of each piece of bytes, eight bytes a step."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    eight = np.ndarray(len(data) + 1, dtype="<u8", buffer=padded.data, strides=(1,))
    out = mix(length.astype(np.uint64) + _STEP)
    todo = np.arange(len(start))
    done = 0
    while len(todo):
        left = length[todo] - done
        todo, left = todo[left > 0], left[left > 0]
        if not len(todo):
            break
        block = eight[start[todo] + done]
        short = left < 8
        keep = np.where(short, (np.uint64(1) << (np.minimum(left, 7).astype(np.uint64) * np.uint64(8))) - np.uint64(1), np.uint64(2**64 - 1))
        out[todo] = mix((out[todo] + _STEP) ^ ((block & keep) * _M1))
        done += 8
    return out


def windows(values: np.ndarray, width: int, factor: int) -> np.ndarray:
    """Polynomial hash of every run of `width` values, by doubling; texts' ends are not looked at."""
    n = len(values) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    base, size, have, out, taken = np.uint64(factor | 1), 1, values, None, 0
    left = width
    power = base
    with np.errstate(over="ignore"):
        while left:
            if left & 1:
                part = have[taken : taken + n]
                # Append the next `size` values to what was taken so far.
                out = part.copy() if out is None else out * power + part
                taken += size
            left >>= 1
            if left:
                have = have[: len(have) - size] * power + have[size:]
                size *= 2
                power = power * power
    return mix(out)


def whole(first: np.ndarray, width: int, n: int) -> np.ndarray:
    """Which of the first `n` starts hold a run of `width` values inside one text; `first` has each text's first value."""
    last = np.repeat(first[1:], np.diff(first))
    return np.arange(n) + width <= last[:n]


_FACTOR = 0x9E3779B97F4A7C15 | 1
_POWERS = [np.ones(1, np.uint64), np.ones(1, np.uint64)]
_BYTES = mix(np.arange(256, dtype=np.uint64) * _STEP + _M2)


def _powers(n: int) -> list[np.ndarray]:
    """Powers of the factor and of its inverse modulo 2**64, kept and extended as longer texts come."""
    if len(_POWERS[0]) < n:
        size = max(n, 1 << 20)
        for k, base in enumerate((_FACTOR, pow(_FACTOR, -1, 2**64))):
            out = np.full(size, np.uint64(base))
            out[0] = 1
            _POWERS[k] = np.multiply.accumulate(out)
    return _POWERS


class PrefixHash:
    """Polynomial prefix hashes of bytes: the hash of any piece costs two look-ups."""

    def __init__(self, data: np.ndarray):
        power, self.back = _powers(len(data) + 1)
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_BYTES[data] * power[: len(data)], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.back[start] + (end - start).astype(np.uint64) * _M2)
