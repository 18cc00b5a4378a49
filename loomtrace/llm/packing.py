"""Concatenate-and-cut packing: token totals per partition give global offsets, fixed windows cut the stream."""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import no_text, written

SEQUENCE = 1024
END_ID = 0
_ENCODERS: dict[tuple[str, str], Encoder] = {}


class Encoder:
    """Token ids of whole texts as little-endian 32-bit bytes.

    `path` is the tokenizers file that defines the ids. `ranks` is the same vocabulary for the faster tiktoken, which gives the
    same ids (the tests compare them); a text that holds the file's special token goes to the tokenizers library itself.
    """

    def __init__(self, path: str, ranks: str):
        import tiktoken
        from public_tokenizers import PATTERN
        from tokenizers import Tokenizer

        with open(ranks, "rb") as lines:
            table = {base64.b64decode(word): int(rank) for word, rank in map(bytes.split, lines)}
        self.exact = Tokenizer.from_file(path)
        self.fast = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=table, special_tokens={})
        self.special = [t.content for t in self.exact.get_added_tokens_decoder().values()]

    def ids(self, text: str) -> bytes:
        if any(s in text for s in self.special):
            found = self.exact.encode(text, add_special_tokens=False).ids
        else:
            found = self.fast.encode_ordinary(text)
        return np.asarray(found, dtype="<u4").tobytes()


def encoder(path: str, ranks: str) -> Encoder:
    if (path, ranks) not in _ENCODERS:
        _ENCODERS[path, ranks] = Encoder(path, ranks)
    return _ENCODERS[path, ranks]


def vocabulary(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def encode_documents(docs: DataFrame, path: str, ranks: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Id, token ids with the end id, their count, and the row's place (partition, number in it). Null text is empty."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, part, at = encoder(path, ranks), TaskContext.get().partitionId(), 0
        end = np.asarray([END_ID], dtype="<u4").tobytes()
        for batch in batches:
            for low in range(0, batch.num_rows, 500):
                piece = batch.slice(low, 500)
                ids = [known.ids(t) + end for t in piece.column(1).to_pylist()]
                n = len(ids)
                yield pa.RecordBatch.from_arrays(
                    [piece.column(0), pa.array(ids, pa.binary()), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array([part] * n, pa.int32()), pa.array(range(at, at + n), pa.int64())],
                    ["id", "ids", "n", "part", "row"],
                )
                at += n

    kind = docs.schema[id_col].dataType.simpleString()
    picked = docs.select(docs[id_col].alias("id"), no_text(text_col).alias("text"))
    return picked.mapInArrow(encode, f"id {kind}, ids binary, n long, part int, row long")


def pack(
    docs: DataFrame,
    path: str | None = None,
    ranks: str | None = None,
    length: int = SEQUENCE,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Pieces of packed sequences with their token ids; only the last sequence can be short.

    The first pass encodes and writes the ids, the second adds up partition totals (one row per partition) and the rows inside
    each partition; a document's offset in the whole stream says where the fixed windows cut it. Every row is packed, repeated
    rows and null ids too; an empty or null text is its end id alone; an empty table gives no rows.
    """
    encoded = written(encode_documents(docs, path or vocabulary(), ranks or vocabulary("byte_bpe_50k.tiktoken"), id_col, text_col), "ids")
    totals = encoded.groupBy("part").agg(F.sum("n").alias("total"))
    # One row per partition: a number that the cluster's file splits bound, not the documents.
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("part", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("offset"))
    inside = Window.partitionBy("part").orderBy("row").rowsBetween(Window.unboundedPreceding, -1)
    places = encoded.select("part", "row", "n").withColumn("inside", F.coalesce(F.sum("n").over(inside), F.lit(0)))
    places = places.join(offsets, "part").select("part", "row", (F.col("offset") + F.col("inside")).alias("begin"))
    placed = encoded.join(places, ["part", "row"]).select("id", "ids", "n", "begin")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in range(8)]
            for key, ids, n, begin in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                at = 0
                while at < n:
                    offset = (begin + at) % length
                    size = min(n - at, length - offset)
                    piece = ids[4 * at : 4 * (at + size)]
                    for column, value in zip(out, (key, at, size, zlib.crc32(piece), n, (begin + at) // length, offset, piece), strict=True):
                        column.append(value)
                    at += size
            kinds = (batch.schema.field(0).type, *[pa.int64()] * 6, pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds, strict=True)], NAMES)

    kind = docs.schema[id_col].dataType.simpleString()
    columns = f"id {kind}, " + ", ".join(f"{name} long" for name in NAMES[1:-1]) + ", ids binary"
    return placed.mapInArrow(cut, columns).withColumnRenamed("id", id_col)


NAMES = ["id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"]
