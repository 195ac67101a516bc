"""Uniform temporal subsampling of videos held as tensors: rows with data (binary), shape (array<int>) and dtype, along any axis, and
video samples whose timestamps go along. Rows stay where they are; a row's frames are gathered by one strided take."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def places(frames: int, n: int) -> np.ndarray:
    """``n`` places among ``frames``: a float32 line from the first to the last, its second half measured from the end,
    truncated. More than there are repeats some; one sample is the first frame."""
    if frames < 1 or n < 1:
        raise ValueError("a video needs a frame, and a sample of it one place")
    last, k = np.float32(frames - 1), np.arange(n, dtype=np.float32)
    step = last / np.float32(max(1, n - 1))
    at = np.where(np.arange(n) < n / 2, step * k, last - step * (np.float32(n - 1) - k))
    return np.clip(at.astype(np.int64), 0, frames - 1)


def _taken(data: bytes, shape: list[int], dtype: str, n: int, axis: int) -> tuple[bytes, list[int]]:
    if not -len(shape) <= axis < len(shape):
        raise ValueError(f"axis {axis} is not among those of shape {shape}")
    x = np.frombuffer(data, dtype)
    if x.size != int(np.prod(shape)):
        raise ValueError(f"{len(data)} bytes do not fill shape {shape} of {dtype}")
    out = x.reshape(shape).take(places(shape[axis], n), axis)
    return out.tobytes(), list(out.shape)


def subsample(df: DataFrame, n: int, temporal_dim: int = -4) -> DataFrame:
    """``df`` with ``n`` of the frames along an axis of its tensors (data, shape, dtype); all other columns stay."""
    if n < 1:
        raise ValueError("a sample needs one place at least")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = [_taken(d, s, t, n, temporal_dim) for d, s, t in zip(*(b.column(c).to_pylist() for c in ("data", "shape", "dtype")), strict=True)]
            new = {"data": pa.array([d for d, _ in made], pa.binary()), "shape": pa.array([s for _, s in made], pa.list_(pa.int32()))}
            yield pa.RecordBatch.from_arrays([new.get(c, b.column(c)) for c in b.schema.names], b.schema.names)

    return df.mapInArrow(rows, df.schema)


def sample_videos(df: DataFrame, n: int) -> DataFrame:
    """Video samples (data, shape, dtype, layout THWC or TCHW, timestamps array<double> or null): ``n`` frames with their times.
    Samples must be uint8 or float32 of four axes, times as many as frames, finite and not falling."""
    t, shape = F.col("timestamps"), F.col("shape")
    frames = F.element_at("shape", 1)
    rising = F.forall(F.transform(F.sequence(F.lit(1), F.size(t)), lambda k: F.coalesce(F.get(t, k) >= F.get(t, k - 1), F.lit(True))), lambda x: x)
    finite = F.forall(t, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    fine = (F.size(shape) == 4) & F.forall(shape, lambda x: x > 0) & F.col("dtype").isin("uint8", "float32") & F.col("layout").isin("THWC", "TCHW")
    said = F.raise_error(F.lit("a video needs four axes, none empty, of uint8 or float32, THWC or TCHW"))
    late = F.raise_error(F.lit("timestamps must be one a frame, finite and not falling"))
    timed = F.when(t.isNull(), t).when((F.size(t) == frames) & finite & rising, t).otherwise(late)
    checked = df.withColumns({"shape": F.when(fine, shape).otherwise(said), "timestamps": timed})

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, shapes, kinds, times = (b.column(c).to_pylist() for c in ("data", "shape", "dtype", "timestamps"))
            made = [_taken(d, s, k, n, 0) for d, s, k in zip(data, shapes, kinds, strict=True)]
            told = [None if x is None else [x[i] for i in places(s[0], n).tolist()] for x, s in zip(times, shapes, strict=True)]
            new = {"data": pa.array([d for d, _ in made], pa.binary()), "shape": pa.array([s for _, s in made], pa.list_(pa.int32())), "timestamps": pa.array(told, pa.list_(pa.float64()))}
            yield pa.RecordBatch.from_arrays([new.get(c, b.column(c)) for c in b.schema.names], b.schema.names)

    return checked.mapInArrow(rows, df.schema)
