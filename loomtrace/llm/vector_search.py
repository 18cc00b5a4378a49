"""Exact top-k inner products by a dual-tree search over cover trees.

All vectors are dealt to bands by their nearest pivot (a bounded sample), so that a band's vectors lie together, and a hot pivot's
vectors fill several bands. Bands and query bands hold cover trees over chunks of their rows. Each pair of a band and a query band is
one cell of bounded size. In a cell, pairs of nodes go if the largest inner product that their centres and covering radii allow is
below the worst k-th score of the query node's vectors; what is left at the leaves is compared exactly. Query scores against the
pivots, which are candidates themselves, start the k-th scores.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .cover_tree import Tree, build, pack, unpack
from .shared import written
from .vectors import dots, matrix, scaled, shape, squares

SCALE, TOP, EVERY = 256, 5, 50
PIVOTS = 256
#: Entries of the vectors in a chunk (a tree), in a band and in a query band; bands also follow the cores there are.
CHUNK_ENTRIES, BAND_ENTRIES, QUERY_ENTRIES = 1 << 18, 1 << 22, 1 << 20
NONE = np.iinfo(np.int64).min
LEAVES = 32


class Best:
    """The k highest scores so far of several queries, ties to the smaller id, and the score that a newcomer must reach."""

    def __init__(self, ids: np.ndarray, bar: np.ndarray, k: int):
        self.ids, self.bar, self.k = ids, bar.copy(), k
        self.score = np.full((len(ids), k), NONE)
        self.found = np.full((len(ids), k), NONE)

    def offer(self, rows: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> None:
        r, c = np.nonzero((scores >= self.bar[rows][:, None]) & (ids != self.ids[rows][:, None]))
        if not len(r):
            return
        touched, place = np.unique(r, return_inverse=True)
        at = rows[touched]
        which = np.concatenate([place, np.repeat(np.arange(len(at)), self.k)])
        score = np.concatenate([scores[r, c].astype(np.int64), self.score[at].ravel()])
        found = np.concatenate([ids[c], self.found[at].ravel()])
        # Falling scores: the complement of a 64-bit number turns its order round without overflow.
        order = np.lexsort((found, ~score, which))
        which = which[order]
        rank = np.arange(len(which)) - np.searchsorted(which, which)
        order, which, rank = order[rank < self.k], which[rank < self.k], rank[rank < self.k]
        self.score[at[which], rank], self.found[at[which], rank] = score[order], found[order]
        self.bar[at] = np.maximum(self.bar[at], self.score[at, -1])


def bounds(q: np.ndarray, queries: Tree, p: np.ndarray, data: Tree) -> np.ndarray:
    """For every pair of a query node and a data node, a score that no pair of their vectors exceeds."""
    a, b = q[queries.centre].astype(float), p[data.centre].astype(float)
    long_a, long_b = np.sqrt((a * a).sum(axis=1))[:, None], np.sqrt((b * b).sum(axis=1))
    out = a @ b.T + long_a * data.radius + queries.radius[:, None] * (long_b + data.radius)
    return out + 1e-9 * (long_a + queries.radius[:, None]) * (long_b + data.radius) + 1e-6


def search(q: np.ndarray, queries: Tree, best: Best, p: np.ndarray, ids: np.ndarray, data: Tree) -> int:
    """Offer every vector of `p` that may be among a query's best; returns the number of inner products made."""
    bound, made = bounds(q, queries, p, data), 0
    todo = [(0, np.zeros(1, np.int64))]
    while todo:
        node, near = todo.pop()
        rows = queries.order[queries.begin[node] : queries.end[node]]
        near = near[bound[node, near] >= best.bar[rows].min()]
        is_leaf = data.first[near] == data.last[near]
        if queries.first[node] < queries.last[node]:
            wide = ~is_leaf & (data.radius[near] >= queries.radius[node])
            near = np.concatenate([near[~wide], data.children(near[wide])[0]])
            if len(near):
                todo += [(child, near) for child in range(queries.first[node], queries.last[node])]
            continue
        while not is_leaf.all():
            near = np.concatenate([near[is_leaf], data.children(near[~is_leaf])[0]])
            near = near[bound[node, near] >= best.bar[rows].min()]
            is_leaf = data.first[near] == data.last[near]
        near = near[np.argsort(-bound[node, near], kind="stable")]
        for at in range(0, len(near), LEAVES):
            some = near[at : at + LEAVES]
            some = some[bound[node, some] >= best.bar[rows].min()]
            if not len(some):
                break  # bounds fall from here on
            members, _ = data.rows(some)
            made += len(rows) * len(members)
            best.offer(rows, dots(q[rows], p[members]), ids[members])
    return made


def _planted(rows: DataFrame, band: str, width: int, chunk: int, pivots: np.ndarray, pivot_ids: np.ndarray, k: int) -> DataFrame:
    """One row per chunk of a partition: its band, a number for its first row, ids, first k-th scores (queries), and the vectors with their tree."""
    seeds = band == "query_band"

    def row(number: int, before: int, held: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(held).combine_chunks()
        points, ids = matrix(table.column("v").combine_chunks(), width), table.column("key").to_numpy()
        bar = np.full(len(ids) if seeds else 0, NONE)
        if seeds and len(pivots):
            scores = np.where(pivot_ids != ids[:, None], dots(points, pivots), NONE)
            if scores.shape[1] >= k:
                bar = np.sort(scores, axis=1)[:, -k].astype(np.int64)
        serial = pa.array([(number << 40) + before], pa.int64())
        lists = [pa.array([x], pa.list_(pa.int64())) for x in (ids, bar)]
        block = pa.array([pack(points, [build(points, leaf=32)])], pa.binary())
        columns = [pa.array([number], pa.int32()), serial, *lists, block]
        return pa.RecordBatch.from_arrays(columns, names=[band, "serial", "ids", "bar", "block"])

    def plant(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n, number, before = [], 0, 0, 0
        for batch in batches:
            while batch.num_rows:
                number = batch.column("band")[0].as_py()
                part, batch = batch.slice(0, chunk - n), batch.slice(chunk - n)
                held.append(part)
                n += part.num_rows
                if n == chunk:
                    yield row(number, before, held)
                    held, n, before = [], 0, before + n
        if held:
            yield row(number, before, held)

    sorted_ = rows.sortWithinPartitions("near", "key").withColumn("band", F.spark_partition_id())
    return written(sorted_.mapInArrow(plant, f"{band} int, serial bigint, ids array<bigint>, bar array<bigint>, block binary"), band)


def top_products(
    vectors: DataFrame, k: int = TOP, every: int = EVERY, id: str = "vec_id", vector: str = "embedding",
    chunk: int | None = None, bands: int | None = None, query_bands: int | None = None,
) -> DataFrame:
    """Rows (query_id, rank, <id>, score): for each vector whose id `every` divides, the k others of highest inner product.

    Entries become floor(256 * entry); scores are exact whole numbers, ties go to the smaller id; with fewer candidates all are
    returned. Vectors that are null, empty or hold null or non-finite entries, and null ids, take no part; an empty table gives no
    rows; several widths are an error. Rows that share an id are no candidates of each other, and each is a query if `every` divides
    the id; equal vectors under different ids are candidates like any others. Other columns, whatever their names, are not read.
    """
    spark = vectors.sparkSession
    rows = scaled(vectors.where(F.col(id).isNotNull()), SCALE, keep=[id], vector=vector).toDF("key", "v")
    rows = written(rows.withColumn("key", F.col("key").cast("bigint")), "vectors")
    n, width = shape(rows)
    schema = f"query_id bigint, serial bigint, `{id}` bigint, score bigint"
    if not n:
        return spark.createDataFrame([], schema).select("query_id", F.lit(1).alias("rank"), id, "score")
    sample = rows.orderBy(F.xxhash64("key", "v"), "key").limit(PIVOTS).collect()  # bounded by the parameter
    pivots, pivot_ids = np.array([r["v"] for r in sample], np.int64), np.array([r["key"] for r in sample], np.int64)

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                near = squares(matrix(batch.column("v"), width), pivots).argmin(axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(near, pa.int32()), *batch.columns], names=["near", "key", "v"])

    placed = written(rows.mapInArrow(nearest, "near int, key bigint, v array<bigint>"), "placed")
    asked = placed.where(F.col("key") % every == 0)
    cores = max(1, spark.sparkContext.defaultParallelism)
    bands = bands or max(cores, -(-n * width // BAND_ENTRIES))
    query_bands = query_bands or max(1, -(-asked.count() * width // QUERY_ENTRIES))
    chunk = chunk or max(64, CHUNK_ENTRIES // width)
    data = _planted(placed.repartitionByRange(bands, "near", "key"), "band", width, chunk, pivots, pivot_ids, k)
    queries = _planted(asked.repartitionByRange(query_bands, "near", "key"), "query_band", width, chunk, pivots, pivot_ids, k)

    def cell(left: pa.Table, right: pa.Table) -> pa.Table:
        out = {name: [] for name in ("query_id", "serial", id, "score")}
        members = [(np.array(r["ids"], np.int64), *unpack(r["block"])) for r in left.to_pylist()]
        for r in right.to_pylist():
            ids, (q, (tree,)) = np.array(r["ids"], np.int64), unpack(r["block"])
            best = Best(ids, np.array(r["bar"], np.int64), k)
            tops = [bounds(q, tree, p, own)[0, 0] for _, p, (own,) in members]
            for j in np.argsort(-np.array(tops), kind="stable"):
                theirs, p, (own,) = members[j]
                search(q, tree, best, p, theirs, own)
            at, rank = np.nonzero(best.score != NONE)
            for name, x in zip(out, (ids[at], r["serial"] + at, best.found[at, rank], best.score[at, rank]), strict=True):
                out[name].append(x)
        return pa.table({name: np.concatenate(x) if x else np.zeros(0, np.int64) for name, x in out.items()})

    # Spark may have made other numbers of partitions than asked for.
    last, last_query = data.agg(F.max("band")).first()[0], queries.agg(F.max("query_band")).first()[0]
    wanted = queries.withColumn("band", F.explode(F.sequence(F.lit(0), F.lit(last))))
    held = data.drop("serial").withColumn("query_band", F.explode(F.sequence(F.lit(0), F.coalesce(F.lit(last_query), F.lit(0)))))
    met = held.groupBy("query_band", "band").cogroup(wanted.groupBy("query_band", "band")).applyInArrow(cell, schema)
    order = Window.partitionBy("query_id", "serial").orderBy(F.desc("score"), id)
    ranked = met.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", id, "score")
