"""Vector code compression: product codes whose codebooks come from Lloyd rounds over cover trees.

Trees are built once per chunk of a task's rows, one for each part of the vectors, and written. A round walks each tree from its
root with all entries as candidates: an entry goes as soon as it is farther from a node's centre than the nearest one by more than
twice the covering radius. A node with one candidate left is assigned whole, with its count and its difference of running sums;
ambiguous nodes descend, and only rows of ambiguous leaves are compared exactly, with the candidates that are left there.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .cover_tree import MARGIN, Tree, build, pack, unpack
from .shared import written
from .vectors import matrix, scaled, shape, squares

SCALE, PARTS, ENTRIES, ROUNDS = 1024, 4, 256, 4
#: Vector entries of a chunk: what a tree covers, and what a task holds at a time.
CHUNK_ENTRIES = 1 << 18


def assign(points: np.ndarray, tree: Tree, codebook: np.ndarray) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
    """Nearest entry of every row (ties to the lower), nodes assigned whole, and the rows that were compared one by one."""
    code = np.empty(len(points), np.int64)
    nodes = np.zeros(1, np.int64)
    open_ = np.ones((1, len(codebook)), dtype=bool)
    sure, alone = [], []
    while len(nodes):
        away = np.sqrt(squares(points[tree.centre[nodes]], codebook).astype(float))
        away[~open_] = np.inf
        reach = away.min(axis=1) * MARGIN + 2 * tree.radius[nodes]
        open_ &= away <= reach[:, None]
        single = open_.sum(axis=1) == 1
        rows, which = tree.rows(nodes[single])
        code[rows] = open_[single].argmax(axis=1)[which]
        sure.append(nodes[single])
        leaf = ~single & (tree.first[nodes] == tree.last[nodes])
        rows, which = tree.rows(nodes[leaf])
        if len(rows):
            exactly = squares(points[rows], codebook)
            code[rows] = np.where(open_[leaf][which], exactly, np.inf if exactly.dtype == object else np.iinfo(np.int64).max).argmin(axis=1)
            alone.append(rows)
        wide = ~single & ~leaf
        nodes, parent = tree.children(nodes[wide])
        open_ = open_[wide][parent]
    return code, sure, np.concatenate(alone) if alone else np.zeros(0, np.int64)


def sums(points: np.ndarray, tree: Tree, codebook: np.ndarray) -> np.ndarray:
    """Per entry the sum of its rows and, last, their number, as Python's whole numbers."""
    code, sure, alone = assign(points, tree, codebook)
    largest = int(np.abs(points).max()) + 1
    kind = np.int64 if largest * len(points) < 2**62 else object
    with_one = np.column_stack([points, np.ones(len(points), np.int64)]).astype(kind)
    running = np.concatenate([np.zeros((1, with_one.shape[1]), kind), np.cumsum(with_one[tree.order], axis=0)])
    out = np.zeros((len(codebook), with_one.shape[1]), kind)
    for nodes in sure:
        np.add.at(out, code[tree.order[tree.begin[nodes]]], running[tree.end[nodes]] - running[tree.begin[nodes]])
    np.add.at(out, code[alone], with_one[alone])
    return out.astype(object)


def _trees(rows: DataFrame, width: int, chunk: int) -> DataFrame:
    """One row per chunk: ids, labels, and the points with a tree for each part."""
    kinds = rows.schema
    schema = T.StructType([T.StructField(name, T.ArrayType(kinds[name].dataType)) for name in ("key", "label")] + [T.StructField("block", T.BinaryType())])

    def plant(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def row(held: list[pa.RecordBatch]) -> pa.RecordBatch:
            table = pa.Table.from_batches(held).combine_chunks()
            points = matrix(table.column("v").combine_chunks(), width)
            block = pack(points, [build(part) for part in np.split(points, PARTS, axis=1)])
            lists = [pa.ListArray.from_arrays([0, table.num_rows], table.column(name).combine_chunks()) for name in ("key", "label")]
            return pa.RecordBatch.from_arrays([*lists, pa.array([block], pa.binary())], names=["key", "label", "block"])

        held, n = [], 0
        for batch in batches:
            while batch.num_rows:
                part, batch = batch.slice(0, chunk - n), batch.slice(chunk - n)
                held.append(part)
                n += part.num_rows
                if n == chunk:
                    yield row(held)
                    held, n = [], 0
        if held:
            yield row(held)

    return written(rows.mapInArrow(plant, schema), "trees")


def _round(trees: DataFrame, codebooks: list[np.ndarray]) -> list[np.ndarray]:
    """New codebooks: entries that rows are assigned to become their floored means."""
    size = codebooks[0].shape[1] + 1

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((PARTS, len(codebooks[0]), size), dtype=object)
        for batch in batches:
            for block in batch.column("block"):
                points, own = unpack(block.as_py())
                for k, part in enumerate(np.split(points, PARTS, axis=1)):
                    total[k] += sums(part, own[k], codebooks[k])
        flat = total.ravel()
        place = np.flatnonzero(flat != 0)
        yield pa.RecordBatch.from_arrays([pa.array(place, pa.int32()), pa.array([Decimal(x) for x in flat[place]], pa.decimal128(38, 0))], names=["place", "total"])

    partial = trees.select("block").mapInArrow(gather, "place int, total decimal(38,0)")
    total = np.zeros(PARTS * len(codebooks[0]) * size, dtype=object)
    for place, amount in partial.groupBy("place").agg(F.sum("total").cast("decimal(38,0)")).collect():
        total[place] = int(amount)
    out = []
    for part, codebook in zip(total.reshape(PARTS, -1, size), codebooks, strict=True):
        n = part[:, -1:]
        out.append(np.where(n > 0, part[:, :-1] // np.where(n > 0, n, 1), codebook.astype(object)).astype(np.int64))
    return out


def compress(vectors: DataFrame, id: str = "vec_id", vector: str = "embedding", label: str = "label", entries: int = ENTRIES, rounds: int = ROUNDS, chunk: int | None = None) -> DataFrame:
    """Rows (id, code, error, label_error, codebooks_sha256) of every vector.

    Entries become floor(1024 * entry), vectors are cut into 4 equal parts, and codebooks start from the vectors with the smallest
    ids (equal ids by their entries, null ids last; all vectors, if there are fewer than `entries`). Rows that repeat count as often
    as they are there and get equal codes. Null labels are one group. Vectors that are null, empty or hold null or non-finite entries
    give no row, as does an empty table; several widths, or one that 4 does not divide, are errors. Other columns are not read.
    """
    spark = vectors.sparkSession
    key, kind = vectors.schema[id].dataType, vectors.schema[label].dataType
    schema = T.StructType([T.StructField(id, key), T.StructField(label, kind), T.StructField("code", T.StringType()), T.StructField("error", T.LongType())])
    rows = scaled(vectors, SCALE, keep=[id, label], vector=vector).toDF("key", "label", "v")
    n, width = shape(rows)
    if width % PARTS:
        raise ValueError(f"vectors of {width} entries cannot be cut into {PARTS} equal parts")
    if not n:
        empty = spark.createDataFrame([], schema)
        return empty.drop(label).withColumns({"label_error": F.lit(0).cast("bigint"), "codebooks_sha256": F.lit("")})
    trees = _trees(rows, width, chunk or max(64, CHUNK_ENTRIES // width))
    # As many rows as the codebook has entries: bounded by a parameter.
    first = np.array([r["v"] for r in rows.orderBy(F.asc_nulls_last("key"), "v").limit(entries).collect()], np.int64)
    codebooks = np.split(first, PARTS, axis=1)
    for _ in range(rounds):
        codebooks = _round(trees, codebooks)
    digest = hashlib.sha256(",".join(str(x) for book in codebooks for x in book.ravel().tolist()).encode()).hexdigest()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key_, label_, block in zip(batch.column("key"), batch.column("label"), batch.column("block"), strict=True):
                points, own = unpack(block.as_py())
                codes, error = [], np.zeros(len(points), dtype=object)
                for k, part in enumerate(np.split(points, PARTS, axis=1)):
                    code, _, _ = assign(part, own[k], codebooks[k])
                    codes.append(code)
                    apart = part - codebooks[k][code]
                    error = error + (apart.astype(object) ** 2).sum(axis=1)
                text = ["".join(f"{c:02x}" for c in row) for row in np.column_stack(codes).tolist()]
                yield pa.RecordBatch.from_arrays([key_.values, label_.values, pa.array(text), pa.array(error.tolist(), pa.int64())], names=schema.names)

    coded = written(trees.mapInArrow(encode, schema), "codes")
    totals = coded.groupBy(F.col(label).alias("same_label")).agg(F.sum("error").alias("label_error"))
    joined = coded.join(totals, coded[label].eqNullSafe(totals["same_label"]))
    return joined.select(id, "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))
