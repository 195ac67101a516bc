"""A text pipeline: chosen rows, a seeded order, encoding, and rectangular batches."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator
from concurrent.futures import Future, ThreadPoolExecutor
from dataclasses import dataclass, replace
from itertools import islice

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import selection
from ..operators.rng import combine
from ..operators.stored import removed, stored
from ..operators.text import WordLevel, collate
from ..operators.tokenizer_file import TokenizerFile


class TextError(RuntimeError):
    """What ended a loader, with the source rows of its batch."""

    def __init__(self, said: str, sources: list[int] | None = None) -> None:
        super().__init__(said)
        self.sources = sources or []


@dataclass(frozen=True)
class TextPipeline:
    """``df`` has pos (dense from 0), text, perhaps text_pair and label."""

    df: DataFrame
    tokenizer: WordLevel | TokenizerFile
    index: DataFrame | None = None
    shuffle_: int | None = None
    epoch_: int = 0
    size: int = 1
    drop_last: bool = False
    options: tuple = ()
    label_mode: str = "sample"
    padding: tuple = ()

    def indices(self, wanted: list[int] | DataFrame) -> TextPipeline:
        """Rows in this order, as often as asked: a short list, or a table (req, pos) of any size."""
        if not isinstance(wanted, DataFrame):
            if any(i < 0 for i in wanted):
                raise IndexError("indices are not negative")
            wanted = self.df.sparkSession.createDataFrame(list(enumerate(wanted)), "req long, pos long")
        return replace(self, index=wanted)

    def shuffle(self, seed: int) -> TextPipeline:
        return replace(self, shuffle_=seed)

    def epoch(self, epoch: int) -> TextPipeline:
        return replace(self, epoch_=epoch)

    def encode(self, **options) -> TextPipeline:
        """Options of ``WordLevel.encode``."""
        return replace(self, options=tuple(options.items()))

    def pad(self, **options) -> TextPipeline:
        """Options of ``collate``: pad_to, side, multiple, ignore."""
        return replace(self, padding=tuple(options.items()))

    def labels(self, mode: str) -> TextPipeline:
        if mode not in ("sample", "causal"):
            raise ValueError("labels are sample or causal")
        return replace(self, label_mode=mode)

    def batch(self, size: int, drop_last: bool = False) -> TextPipeline:
        if size <= 0:
            raise ValueError("batch size must be positive")
        return replace(self, size=size, drop_last=drop_last)

    def rows(self, strict: bool = True) -> DataFrame:
        """The chosen rows in their order: pos, source and their columns. The indices come first, then the order of the
        generator of combine(seed, epoch). An index without a row is an error; not ``strict``, its row has source -1 - index."""
        df = self.df.withColumn("source", F.col("pos"))
        if self.index is not None:
            # a row that is not there is an error, not a row less
            found = self.index.join(df, "pos", "left")
            missing = F.raise_error(F.concat(F.lit("no row at index "), F.col("pos").cast("string"))).cast("long") if strict else -1 - F.col("pos")
            df = found.withColumn("source", F.when(F.col("source").isNull(), missing).otherwise(F.col("source"))).withColumn("pos", F.col("req")).drop("req")
        if self.shuffle_ is not None:
            n, state = (self.df if self.index is None else self.index).count(), combine(self.shuffle_, self.epoch_)
            df = selection.drawn_shuffle(df, n, state)
        if self.drop_last:  # the tail is not even encoded
            df = selection.batch(df, self.size, True).drop("batch_id", "batch_pos")
        return df

    def execute(self) -> DataFrame:
        """Collated rows with batch_id, batch_pos and source."""
        return self._collated(self.rows())

    def _collated(self, rows: DataFrame) -> DataFrame:
        pair = "text_pair" in rows.columns
        encoded = self.tokenizer.encode(rows, pair=pair, **dict(self.options))
        kept = ["pos", "source", *(["label"] if self.label_mode == "sample" and "label" in rows.columns else [])]
        pad_id = self.tokenizer.token_to_id(self.tokenizer.padding).get(self.tokenizer.padding)
        if pad_id is None:
            raise ValueError("the vocabulary has no padding token")
        return collate(encoded.join(rows.select(*kept), "pos"), self.size, pad_id, labels=self.label_mode, **dict(self.padding))

    def loader(self, at_once: int = 4096, ahead: int = 2) -> Iterator[list]:
        """Batches in order, as lists of rows. Rows are written once by ranges of their place, before any is encoded; a stretch of
        batches of about ``at_once`` rows is then one job, and ``ahead`` jobs run before they are asked for, so the driver holds no
        more stretches than that. The first error ends the loader: the batches before it come first, then it is raised once,
        with the source rows of its batch."""
        stretch = max(1, at_once // self.size) * self.size
        spark = self.df.sparkSession
        table = stored(self.rows(False).repartitionByRange("pos").sortWithinPartitions("pos"), "rows")
        top = table.agg(F.max("pos")).first()[0]
        n = 0 if top is None else top + 1

        def read(low: int, high: int) -> list[list]:
            rows = table.where((F.col("pos") >= low) & (F.col("pos") < high))
            gone = F.raise_error(F.concat(F.lit("no row at index "), (-1 - F.col("source")).cast("string"))).cast("long")
            got = self._collated(rows.withColumn("source", F.when(F.col("source") < 0, gone).otherwise(F.col("source")))).collect()
            got.sort(key=lambda r: r["pos"])
            return [got[k : k + self.size] for k in range(0, len(got), self.size)]

        starts = iter(range(0, n, stretch))
        waiting: deque[tuple[int, Future]] = deque()
        pool = ThreadPoolExecutor(max(1, ahead))
        try:
            while True:
                for low in islice(starts, max(1, ahead) - len(waiting)):
                    waiting.append((low, pool.submit(inheritable_thread_target(spark)(read), low, min(n, low + stretch))))
                if not waiting:
                    return
                low, job = waiting.popleft()
                try:
                    yield from job.result()
                    continue
                except Exception:  # noqa: BLE001  found below, batch by batch
                    pass
                for first in range(low, min(n, low + stretch), self.size):
                    try:
                        (batch,) = read(first, min(n, first + self.size))
                    except Exception as e:
                        sources = [r["source"] for r in table.where((F.col("pos") >= first) & (F.col("pos") < first + self.size)).orderBy("pos").select("source").collect()]
                        raise TextError(f"batch {first // self.size}, source rows {sources}: {e}", sources) from e
                    yield batch
        finally:
            for _, job in waiting:
                job.cancel()
            pool.shutdown(wait=True)
            removed(table)
