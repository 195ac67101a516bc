"""What the corpus operators share: shared-folder tables, word patterns and blocks of UTF-8 bytes."""

from __future__ import annotations

import hashlib
import tempfile
import uuid
from collections.abc import Iterator
from contextvars import ContextVar

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word: a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Where that is unset a temporary one serves a local master only: on a cluster
    every executor would write to its own disk, so there it is an error."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("spark.checkpoint.dir is not set; it must name a folder that the driver and all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="spark-"))
    return sc.getCheckpointDir()


def settled(df: DataFrame, name: str, **options: int) -> DataFrame:
    """``df`` written as a Parquet table in the shared folder, with the writer's ``options``, and read again: lineage ends
    there, and a lost executor costs a re-read. The table stays until the folder is cleared, as checkpoints do, or until its ``Scratch`` ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.options(compression="zstd", **options).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.settled_path = path
    if inside := _scratch.get():
        inside[-1].paths.append(path)
    return out


#: The open blocks of this thread or task, outermost first.
_scratch: ContextVar[tuple[Scratch, ...]] = ContextVar("scratch", default=())


def dropped(spark: SparkSession, path: str) -> None:
    """Removes a settled table that nothing reads any more."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


class Scratch:
    """A with block whose settled tables go when it ends, but for those that ``keep`` names. What leaves the block must read
    no other table; after an error all stay."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.paths, self.kept = spark, [], set()

    def __enter__(self) -> Scratch:
        _scratch.set((*_scratch.get(), self))
        return self

    def keep(self, *tables: DataFrame) -> None:
        self.kept |= {t.settled_path for t in tables}

    def __exit__(self, kind, *_) -> None:
        outer = _scratch.get()[:-1]
        _scratch.set(outer)
        for p in self.paths:
            if kind is None and p not in self.kept:
                dropped(self.spark, p)
            elif outer:  # now the outer block's
                outer[-1].paths.append(p)


def words(text: Column) -> Column:
    """The words of a text, in order; none for null."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD), F.lit(0))


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once, however often a lambda in the body reads it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def crc32_mod(doc_id: Column, mod: int) -> Column:
    """crc32 of the id as text, modulo ``mod``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % mod


def utf8_blocks(column: pa.Array, target: int = 1 << 20) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Runs of whole texts of about ``target`` bytes: (first row, offsets from 0, bytes). Null is the empty text.

    A text over ``target`` is a run by itself, so memory follows the longest text and not the batch."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if pa.types.is_large_string(column.type) or pa.types.is_string(column.type):
        column = column.fill_null("")
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    n = len(column)
    if not n:
        return
    buffers = column.buffers()
    offsets = np.frombuffer(buffers[1], kind)[column.offset : column.offset + n + 1].astype(np.int64)
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None else np.empty(0, np.uint8)
    first = 0
    while first < n:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + target, "right")) - 1)
        yield first, offsets[first : last + 1] - offsets[first], data[offsets[first] : offsets[last]]
        first = last


def mixed(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser, elementwise on uint64."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def loads(data: np.ndarray) -> np.ndarray:
    """A view of ``data`` (bytes) as the 8 bytes from each place on, little-endian; zeros follow the end."""
    padded = np.concatenate((data, np.zeros(8, np.uint8)))
    return np.ndarray((len(data) + 1,), np.dtype("<u8"), padded, strides=(1,))


_SEEDS = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))
_LANE = np.uint64(0xA0761D6478BD642F)
#: Ranges over so many bytes are digested one by one.
LONG_RANGE = 1024


def range_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, lanes: int = 1) -> tuple[np.ndarray, ...]:
    """``lanes`` (1 or 2) independent 64-bit hashes of the byte ranges [start, end), equal for equal bytes.

    A lane takes the bytes by eights and mixes each into its state by a bijection that is not linear, so ranges of up to
    eight bytes of one length never meet, and longer ones only by chance (2**-64 a pair and lane)."""
    at, size = loads(data), (end - start).astype(np.int64)
    out = [mixed(size.astype(np.uint64) + _SEEDS[k]) for k in range(lanes)]
    far = size > LONG_RANGE
    for k in np.flatnonzero(far).tolist():
        told = np.frombuffer(hashlib.blake2b(data[start[k] : end[k]], digest_size=16).digest(), np.uint64)
        for lane in range(lanes):
            out[lane][k] ^= told[lane]
    live = np.flatnonzero((size > 0) & ~far)
    place, left = np.asarray(start)[live], size[live]
    while len(live):
        x = at[place]
        short = left < 8
        x[short] &= (np.uint64(1) << (left[short] * 8).astype(np.uint64)) - np.uint64(1)
        for lane in range(lanes):
            out[lane][live] = mixed(out[lane][live] ^ (x if lane == 0 else x * _LANE))
        on = left > 8
        live, place, left = live[on], place[on] + 8, left[on] - 8
    return tuple(out)


def window_hashes(data: np.ndarray, size: int, seed: int = 0) -> np.ndarray:
    """64-bit hashes of all ``size``-byte windows (8 or more) of ``data``: halves are mixed, from eight bytes up."""
    n = len(data) - size + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    h, span = mixed(loads(data)[: len(data) - 7] ^ _SEEDS[seed]), 8
    while 2 * span <= size:
        h, span = mixed((h[:-span] * _LANE) ^ h[span:]), 2 * span
    # what is left is covered by the last full span of the window
    return h[:n] if span == size else mixed((h[:n] * _LANE) ^ h[size - span : size - span + n])


_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def word_ranges(offsets: np.ndarray, data: np.ndarray, outside: np.ndarray = _IS_SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, text) of every word of the block's texts; no word crosses from text to text. ``outside`` says for each
    byte value whether it parts words."""
    inside = ~outside[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    cuts = offsets[1:-1]
    cuts = cuts[cuts < len(data)]
    first[cuts] = inside[cuts]
    start = np.flatnonzero(first)
    last = inside.copy()
    if len(data):
        last[:-1] &= ~inside[1:]
        ends = offsets[1:]
        ends = ends[ends > 0] - 1
        last[ends] = inside[ends]
    end = np.flatnonzero(last) + 1
    return start, end, np.searchsorted(offsets, start, "right") - 1


#: Bytes with A to Z in lower case and all others as they are.
LOWERED = np.arange(256, dtype=np.uint8)
LOWERED[65:91] += 32


def lowered(text: Column) -> Column:
    """A text with A to Z in lower case and all other characters as they are; null is the empty text."""
    return F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


class Vocabulary:
    """Distinct words, numbered as given, that words of a block are looked up in; two lanes of hash tell words apart."""

    def __init__(self, words: list[str]) -> None:
        raw = [w.encode() for w in words]
        end = np.cumsum([len(w) for w in raw], dtype=np.int64)
        self.size = len(raw)
        h, g = range_hashes(np.frombuffer(b"".join(raw), np.uint8), end - [len(w) for w in raw], end, 2) if raw else (np.empty(0, np.uint64),) * 2
        self.order = np.argsort(h)
        self.first, self.second = h[self.order], g[self.order]

    def numbers(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """The number of each word of the block, or -1."""
        out = np.full(len(start), -1, np.int64)
        if self.size and len(start):
            (h,) = range_hashes(data, start, end)
            at = np.minimum(np.searchsorted(self.first, h), self.size - 1)
            near = np.flatnonzero(self.first[at] == h)
            _, g = range_hashes(data, start[near], end[near], 2)
            same = self.second[at[near]] == g
            out[near[same]] = self.order[at[near[same]]]
        return out


#: Ids up to which a set of ids is broadcast (8 bytes each); a larger one is joined by a shuffle.
MAX_IDS = 2_000_000


def among(rows: DataFrame, ids: DataFrame, how: str = "left_semi") -> DataFrame:
    """``rows`` whose doc_id is (left_semi) or is not (left_anti) in ``ids``; broadcast only below MAX_IDS."""
    n = ids.count()
    return rows.join(F.broadcast(ids) if n <= MAX_IDS else ids, "doc_id", how)


def sorted_groups(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Tables of whole groups from batches sorted by ``key``; a group is held until its last row has come."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        if not b.num_rows:
            continue
        k = b.column(key).to_numpy(zero_copy_only=False)
        cut = int(np.searchsorted(k, k[-1], "left"))  # rows before the batch's last key are whole groups
        if held and held[0].column(key)[-1].as_py() != k[-1]:
            yield pa.Table.from_batches([*held, b.slice(0, cut)])
            held = [b.slice(cut)]
        elif held or cut == 0:
            held.append(b)
        else:
            yield pa.Table.from_batches([b.slice(0, cut)])
            held = [b.slice(cut)]
    if held:
        yield pa.Table.from_batches(held)
