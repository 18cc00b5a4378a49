"""Shards as ranges of a few files: a data source that writes rows and their manifest in one pass.

Every task writes one file of rows per split and one file of manifest lines, a shard being a row group. What the driver gets is the
names of a task's files; the commit writes the list of those names, so files of failed or repeated attempts are not part of a table.
The folder is a path or address that pyarrow's file systems know (local, hdfs, s3, gs).
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

NAME = "loomtrace_shards"
COMMITTED = "_committed.json"
MANIFEST = pa.schema(
    [("split", pa.string()), ("shard", pa.int64()), ("start", pa.int64()), ("end", pa.int64()), ("rows", pa.int64()), ("content_xor", pa.int64()), ("file", pa.string()), ("row_group", pa.int32())]
)


class NotCommitted(FileNotFoundError):
    """The folder holds no committed shards."""


@dataclass
class TaskFiles(WriterCommitMessage):
    data: list[str]
    manifest: str | None


def _place(path: str) -> tuple[fs.FileSystem, str]:
    """The file system and folder of a path; Hadoop writes local ones as file:/path."""
    return fs.FileSystem.from_uri(path.removeprefix("file:") if path.startswith("file:/") and not path.startswith("file://") else path)


def _fingerprint(texts: pa.Array) -> int:
    """The same number as `evaldata.content_fingerprint`: the first 60 bits of each digest, put together by exclusive or."""
    out = 0
    for text in texts.to_pylist():
        if text is not None:
            out ^= int(hashlib.sha256(text.encode()).hexdigest()[:15], 16)
    return out


class ShardWriter(DataSourceArrowWriter):
    def __init__(self, path: str, split: str, shard: str, order: str, content: str):
        self.path, self.split, self.shard, self.order, self.content = path, split, shard, order, content

    def write(self, batches: Iterator[pa.RecordBatch]) -> TaskFiles:
        """Rows come sorted by split, shard and order; a shard ends where the next begins."""
        store, folder = _place(self.path)
        attempt, lines, files = uuid.uuid4().hex, [], []
        writer, current, held = None, None, []
        group = 0

        def close_shard() -> None:
            nonlocal group, held
            if held:
                table = pa.Table.from_batches(held)
                order = table.column(self.order)
                writer.write_table(table, row_group_size=table.num_rows)
                lines.append((current[0], current[1], pc.min(order).as_py(), pc.max(order).as_py() + 1, table.num_rows, _fingerprint(table.column(self.content)), files[-1], group))
                group, held = group + 1, []

        store.create_dir(folder, recursive=True)
        try:
            for batch in batches:
                names = list(zip(batch.column(self.split).to_pylist(), batch.column(self.shard).to_pylist(), strict=True))
                at = 0
                while at < len(names):
                    upto = at + 1
                    while upto < len(names) and names[upto] == names[at]:
                        upto += 1
                    if names[at] != current:
                        close_shard()
                        if writer is None or names[at][0] != current[0]:
                            if writer is not None:
                                writer.close()
                            files.append(f"{len(files):03d}-{attempt}.parquet")
                            writer, group = pq.ParquetWriter(f"{folder}/{files[-1]}", batch.schema, filesystem=store, compression="zstd"), 0
                        current = names[at]
                    held.append(batch.slice(at, upto - at))
                    at = upto
            close_shard()
        finally:
            if writer is not None:
                writer.close()
        if not lines:
            return TaskFiles([], None)
        manifest = f"manifest-{attempt}.parquet"
        columns = [pa.array(column, kind) for column, kind in zip(zip(*lines, strict=True), MANIFEST.types, strict=True)]
        pq.write_table(pa.Table.from_arrays(columns, schema=MANIFEST), f"{folder}/{manifest}", filesystem=store)
        return TaskFiles(files, manifest)

    def commit(self, messages: list[TaskFiles | None]) -> None:
        store, folder = _place(self.path)
        done = [m for m in messages if m is not None and m.manifest]
        listed = {"data": [f for m in done for f in m.data], "manifest": [m.manifest for m in done]}
        store.create_dir(folder, recursive=True)
        with store.open_output_stream(f"{folder}/{COMMITTED}") as out:
            out.write(json.dumps(listed).encode())

    def abort(self, messages: list[TaskFiles | None]) -> None:
        """Nothing is listed, so nothing that was written counts."""


class ShardSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def writer(self, schema: T.StructType, overwrite: bool) -> ShardWriter:
        return ShardWriter(*[self.options[name] for name in ("path", "split", "shard", "order", "content")])


def write(cases: DataFrame, path: str, shard_rows: int, split: str = "split", ordinal: str = "split_ordinal", order: str = "order", content: str = "case_id") -> None:
    """Write shards of `shard_rows` rows, by their place in the split. Every shard lands in one task; tasks hold many shards."""
    spark = cases.sparkSession
    spark.dataSource.register(ShardSource)
    store, folder = _place(path)
    if store.get_file_info(f"{folder}/{COMMITTED}").type != fs.FileType.NotFound:
        raise FileExistsError(f"{path} holds shards already")
    keyed = cases.withColumn("shard", F.call_function("div", F.col(ordinal), F.lit(shard_rows)).cast("bigint"))
    sorted_ = keyed.repartitionByRange(split, "shard").sortWithinPartitions(split, "shard", order)
    sorted_.write.format(NAME).options(path=path, split=split, shard="shard", order=order, content=content).mode("append").save()


def _committed(path: str) -> dict[str, list[str]]:
    store, folder = _place(path)
    if store.get_file_info(f"{folder}/{COMMITTED}").type == fs.FileType.NotFound:
        raise NotCommitted(path)
    with store.open_input_stream(f"{folder}/{COMMITTED}") as listed:
        return json.loads(listed.read())


def read(spark: SparkSession, path: str) -> DataFrame:
    """The committed rows, with their shard; a table without rows has no schema to read."""
    return spark.read.parquet(*[f"{path}/{name}" for name in _committed(path)["data"]])


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """(split, shard, start, end, rows, content_xor, file, row_group) of every committed shard."""
    names = _committed(path)["manifest"]
    if not names:
        return spark.createDataFrame([], "split string, shard long, start long, end long, rows long, content_xor long, file string, row_group int")
    return spark.read.parquet(*[f"{path}/{name}" for name in names])
