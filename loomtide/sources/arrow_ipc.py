"""Arrow IPC files (stream or file format) by record batch.

An index says where each record batch lies: a task reads only the headers of its files' messages and skips the bodies. Scans deal
record batches to tasks, so a file of any size is read by many; fetches read only the batches that hold a wanted row. Only the
wanted columns are decoded. Files are opened through pyarrow's file systems (local or shared folders, and the stores that
pyarrow knows by the path's scheme); a path that only the JVM can open has to be read with ``binaryFile``.
"""

from __future__ import annotations

import json
import struct
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.pandas.types import from_arrow_schema
from pyspark.sql.types import StructType

_SCHEMA, _DICTIONARY, _BATCH = 1, 2, 3
_END = b"\xff\xff\xff\xff\0\0\0\0"
#: Bytes of record batches that a task reads, about.
SPLIT = 64 << 20
#: Rows that a block of the fetch join spans.
BLOCK = 1 << 16
_INDEX = "path string, file int, batch int, first long, rows long, at long, size long, head array<struct<at:bigint,size:bigint>>, kind string"


def _opened(path: str):
    if "://" in path or path.startswith("file:"):
        system, inner = fs.FileSystem.from_uri(path if "://" in path else path.replace("file:", "file://", 1))
        return system.open_input_file(inner)
    return fs.LocalFileSystem().open_input_file(path)


def _field(meta: bytes, table: int, k: int) -> int | None:
    """Where the k-th field of a flat table lies."""
    fields = table - struct.unpack_from("<i", meta, table)[0]
    if 4 + 2 * k >= struct.unpack_from("<H", meta, fields)[0]:
        return None
    off = struct.unpack_from("<H", meta, fields + 4 + 2 * k)[0]
    return table + off if off else None


def _header(meta: bytes) -> tuple[int, int, int]:
    """Kind, bytes of the body and rows of a message."""
    table = struct.unpack_from("<I", meta, 0)[0]
    kind, head, body = (_field(meta, table, k) for k in (1, 2, 3))
    size = struct.unpack_from("<q", meta, body)[0] if body is not None else 0
    kind = meta[kind] if kind is not None else 0
    rows = 0
    if kind == _BATCH:
        inner = head + struct.unpack_from("<I", meta, head)[0]
        at = _field(meta, inner, 0)
        rows = struct.unpack_from("<q", meta, at)[0] if at is not None else 0
    return kind, size, rows


def messages(file, size: int) -> Iterator[tuple[int, int, int, int]]:
    """(kind, place, bytes, rows) of a file's messages, from their headers alone."""
    at = 8 if file.read_at(6, 0) == b"ARROW1" else 0
    while at + 8 <= size:
        first, second = struct.unpack("<II", file.read_at(8, at))
        start, n = (at + 8, second) if first == 0xFFFFFFFF else (at + 4, first)
        if not n:
            return
        if start + n > size:
            raise ValueError("Arrow data ends inside a message")
        kind, body, rows = _header(file.read_at(n, start))
        if start + n + body > size:
            raise ValueError("Arrow data ends inside a message")
        yield kind, at, start - at + n + body, rows
        at = start + n + body


def batches_of(path: str) -> list[dict]:
    """The record batches of a file in order, with what must be read before each: the schema and dictionaries."""
    with _opened(path) as file:
        out, head, first, kind = [], [], 0, None
        try:
            for what, at, size, rows in messages(file, file.size()):
                if what == _BATCH and head:
                    out.append({"batch": len(out), "first": first, "rows": rows, "at": at, "size": size, "head": list(head)})
                    first += rows
                elif what in (_SCHEMA, _DICTIONARY):
                    head.append({"at": at, "size": size})
            if head:
                kind = str(_reader(file, head[:1], None).schema.remove_metadata())
        except (struct.error, pa.ArrowInvalid) as e:
            raise ValueError(f"{path} is not an Arrow IPC file: {e}") from None
        if not head:
            raise ValueError(f"{path} is not an Arrow IPC file")
    # a file without batches keeps its place, and its schema is compared
    return [x | {"kind": kind} for x in out or [{"batch": -1, "first": 0, "rows": 0, "at": 0, "size": 0, "head": head}]]


def _reader(file, parts: list[dict], fields: list[int] | None) -> pa.RecordBatchStreamReader:
    data = b"".join(file.read_at(p["size"], p["at"]) for p in parts) + _END
    return pa.ipc.open_stream(pa.BufferReader(data), options=pa.ipc.IpcReadOptions(included_fields=fields or []))


def read_batch(file, path: str, head: list[dict], at: int, size: int, columns: list[str]) -> pa.RecordBatch:
    """The wanted columns of one record batch; nothing but it, its schema and dictionaries is read."""
    names = _reader(file, head[:1], None).schema.names
    if missing := [c for c in columns if c not in names]:
        raise ValueError(f"columns {missing} are missing in {path}")
    got = _reader(file, [*head, {"at": at, "size": size}], sorted(names.index(c) for c in columns)).read_next_batch().select(columns)
    if all(not pa.types.is_dictionary(f.type) for f in got.schema):
        return got
    plain = [c.dictionary_decode() if pa.types.is_dictionary(c.type) else c for c in got.columns]
    return pa.RecordBatch.from_arrays(plain, columns)


def arrow_index(spark: SparkSession, paths: list[str]) -> DataFrame:
    """A row for each record batch of the files, in the order of ``paths``, with pos, the place of its first row in all files.
    Files are dealt to tasks. All files must have one schema."""
    if not paths:
        raise ValueError("no Arrow files")

    def rows(some: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in some:
            for path, k in zip(b.column("path").to_pylist(), b.column("file").to_pylist(), strict=True):
                found = [{"path": path, "file": k} | x for x in batches_of(path)]
                names = [x.split()[0] for x in _INDEX.split(", ")]
                kinds = {"file": pa.int32(), "batch": pa.int32(), "path": pa.string(), "kind": pa.string(), "head": pa.list_(pa.struct([("at", pa.int64()), ("size", pa.int64())]))}
                yield pa.RecordBatch.from_arrays([pa.array([x[n] for x in found], kinds.get(n, pa.int64())) for n in names], names)

    files = spark.createDataFrame([(p, k) for k, p in enumerate(paths)], "path string, file int").repartition(min(len(paths), 4096), "file")
    index = files.mapInArrow(rows, _INDEX).cache()  # some numbers a batch; read again by what follows
    kinds = [r["kind"] for r in index.select("kind").distinct().limit(2).collect()]
    if len(kinds) > 1:
        raise ValueError(f"Arrow schema mismatch: {kinds[0]} and {kinds[1]}")
    per = index.groupBy("file").agg(F.sum("rows").alias("n"))
    before = per.select("file", (F.sum("n").over(Window.orderBy("file")) - F.col("n")).alias("before"))  # a row a file
    return index.join(before, "file").select("*", (F.col("before") + F.col("first")).alias("pos")).where("batch >= 0").drop("before", "kind")


def _schema(columns: dict[str, str], first: str) -> str:
    return ", ".join([first, *(f"`{c}` {t}" for c, t in columns.items())])


def scan_arrow(spark: SparkSession, paths: list[str], columns: dict[str, str]) -> DataFrame:
    """Arrow IPC files as one table in the order of ``paths``: pos and the wanted columns, with their Spark types."""
    index = arrow_index(spark, paths)
    names = list(columns)

    def rows(some: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in some:
            for x in b.to_pylist():
                with _opened(x["path"]) as file:
                    got = read_batch(file, x["path"], x["head"], x["at"], x["size"], names)
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(x["pos"], x["pos"] + got.num_rows)), *got.columns], ["pos", *names])

    size = index.agg(F.sum("size"), F.count("*")).first()
    tasks = min(size[1], max(spark.sparkContext.defaultParallelism, -(-(size[0] or 0) // SPLIT)))
    # a given number of partitions, which adaptive execution leaves alone: the index is small, what it stands for is not
    return index.repartition(max(1, tasks), "path", "batch").mapInArrow(rows, _schema(columns, "pos long"))


def fetch_arrow(spark: SparkSession, paths: list[str], wanted: DataFrame, columns: dict[str, str]) -> DataFrame:
    """The rows at ``wanted`` (req, pos), as often as asked: req, pos and the wanted columns. Requests are joined to the index
    and gathered by record batch, and only those batches are read. A place outside all files is an error."""
    index = arrow_index(spark, paths)
    names = list(columns)
    last = F.expr(f"(pos + greatest(rows, 1) - 1) div {BLOCK}")
    spread = index.select("path", "batch", "head", "at", "size", "rows", F.col("pos").alias("start"), F.explode(F.sequence(F.expr(f"pos div {BLOCK}"), last)).alias("block"))
    asked = wanted.select(F.col("req").cast("long").alias("req"), F.col("pos").cast("long").alias("pos")).withColumn("block", F.expr(f"pos div {BLOCK}"))
    found = asked.join(spread, (asked["block"] == spread["block"]) & F.expr("pos >= start AND pos < start + rows"), "left").drop("block")
    outside = F.raise_error(F.concat(F.lit("no row at "), F.coalesce(F.col("pos").cast("string"), F.lit("null"))))
    found = found.withColumn("path", F.when(F.col("path").isNull(), outside).otherwise(F.col("path")))

    def rows(some: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, got = None, None
        for b in some:
            path, batch = b.column("path"), b.column("batch").to_numpy()
            cut = np.flatnonzero(np.concatenate(([True], batch[1:] != batch[:-1], [True]))) if b.num_rows else np.zeros(1, np.int64)
            names_ = np.array(path.to_pylist(), object)
            cut = np.unique(np.concatenate((cut, np.flatnonzero(names_[1:] != names_[:-1]) + 1))) if b.num_rows else cut
            for i, j in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
                x = b.slice(i, 1).to_pylist()[0]
                if key != (x["path"], x["batch"]):
                    with _opened(x["path"]) as file:
                        key, got = (x["path"], x["batch"]), read_batch(file, x["path"], x["head"], x["at"], x["size"], names)
                part = b.slice(i, j - i)
                at = pa.array(part.column("pos").to_numpy() - x["start"])
                yield pa.RecordBatch.from_arrays([part.column("req"), part.column("pos"), *got.take(at).columns], ["req", "pos", *names])

    dealt = found.repartition("path", "batch").sortWithinPartitions("path", "batch")
    return dealt.mapInArrow(rows, _schema(columns, "req long, pos long"))


class ArrowIpc(DataSource):
    """``spark.read.format("arrow_ipc")``: options path (one, or a JSON list in paths) and columns (a JSON list of names).
    Record batches are the partitions, put together up to SPLIT bytes."""

    @classmethod
    def name(cls) -> str:
        return "arrow_ipc"

    def _paths(self) -> list[str]:
        found = json.loads(self.options["paths"]) if "paths" in self.options else [self.options["path"]] if "path" in self.options else []
        if not found:
            raise ValueError("no Arrow files")
        return found

    def schema(self) -> StructType:
        path = self._paths()[0]
        with _opened(path) as file:
            head = batches_of(path)[0]["head"]
            have = _reader(file, head[:1], None).schema
        flat = pa.schema([pa.field(f.name, f.type.value_type if pa.types.is_dictionary(f.type) else f.type) for f in have])
        whole = from_arrow_schema(flat)
        names = json.loads(self.options["columns"]) if "columns" in self.options else whole.names
        if missing := [c for c in names if c not in whole.names]:
            raise ValueError(f"columns {missing} are missing in {path}")
        return StructType([whole[c] for c in names])

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(self._paths(), schema.names)


class _Reader(DataSourceReader):
    def __init__(self, paths: list[str], names: list[str]) -> None:
        self.paths, self.names = paths, names

    def partitions(self) -> list[InputPartition]:
        with ThreadPoolExecutor(16) as pool:
            found = list(pool.map(batches_of, self.paths))
        kinds = {x[0]["kind"] for x in found}
        if len(kinds) > 1:
            raise ValueError(f"Arrow schema mismatch: {' and '.join(sorted(kinds)[:2])}")
        out, size = [[]], 0
        for path, batches in zip(self.paths, found, strict=True):
            for x in batches:
                if x["batch"] >= 0:
                    if out[-1] and size + x["size"] > SPLIT:
                        out, size = [*out, []], 0
                    out[-1].append((path, x["head"], x["at"], x["size"]))
                    size += x["size"]
        return [InputPartition(x) for x in out if x] or [InputPartition([])]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        for path, head, at, size in partition.value:
            with _opened(path) as file:
                yield read_batch(file, path, head, at, size, self.names)
