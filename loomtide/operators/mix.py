"""MixUp and CutMix over batched rows: a row meets the one before it in its batch (the first meets the last).

The partner comes by a window over the batch; the batch's draws come from its ordinal, so they are the same in any task."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

from .image_ops import beta_draw
from .rng import Context, Stream, op_key
from .selection import previous_in_batch


def rectangle(s: Stream, h: int, w: int, lam: float) -> tuple[int, int, int, int]:
    """x1, y1, x2, y2 of a box of area 1 - lam around a random pixel, clipped to the image."""
    x, y = s.below(w), s.below(h)
    return cut_box(x, y, h, w, lam)


def cut_box(x: int, y: int, h: int, w: int, lam: float) -> tuple[int, int, int, int]:
    """Half the box's sides are whole pixels, to both sides of the pixel."""
    half = 0.5 * math.sqrt(1 - lam)
    dx, dy = int(half * w), int(half * h)
    return max(0, x - dx), max(0, y - dy), min(w, x + dx), min(h, y + dy)


def mixed(rows: DataFrame, kind: str, num_classes: int | None, alpha: float, seed: int = 0, epoch: int = 0) -> DataFrame:
    """``rows`` of a pipeline with mixed data and a soft_label column; the images of a batch have one shape. MixUp takes
    float32 images. Labels are class numbers, or arrays of floats (soft labels) of one length."""
    if not (math.isfinite(alpha) and alpha > 0) or num_classes is not None and num_classes <= 0:
        raise ValueError("alpha and num_classes must be positive")
    soft_in = isinstance(rows.schema["label"].dataType, ArrayType)
    if num_classes is None and not soft_in:
        raise ValueError("num_classes is required for class numbers")
    context, key = Context(seed, epoch), op_key(kind)
    paired = rows.withColumns({"before": previous_in_batch(F.struct("data", "label", "h", "w", "c", "dtype"))})
    out = rows.schema.fieldNames()
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema) + ", soft_label array<float>"

    def one_hot(label) -> np.ndarray:
        if soft_in:
            v = np.array(label, np.float32)
            if num_classes is not None and len(v) != num_classes or not np.isfinite(v).all():
                raise ValueError("soft labels must be finite, one for each class")
            return v
        if not 0 <= label < num_classes:
            raise ValueError(f"label {label} is out of range")
        return (np.arange(num_classes) == label).astype(np.float32)

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cols = {c: b.column(c).to_pylist() for c in (*out, "before")}
            soft = []
            for i in range(b.num_rows):
                prev = cols["before"][i]
                if any(prev[k] != cols[k][i] for k in ("h", "w", "c", "dtype")):
                    raise ValueError("images of a batch differ")
                s = context.stream(cols["batch_id"][i], key)
                lam = beta_draw(s, alpha)
                shape = (cols["h"][i], cols["w"][i], cols["c"][i]) if cols["layout"][i] == "HWC" else (cols["c"][i], cols["h"][i], cols["w"][i])
                cur, old = (np.frombuffer(d, cols["dtype"][i]).reshape(shape) for d in (cols["data"][i], prev["data"]))
                if kind == "MixUp":
                    if cols["dtype"][i] != "float32":
                        raise ValueError("MixUp takes float32 images; convert them first")
                    lam = np.float32(lam)
                    px = old * (np.float32(1) - lam) + cur * lam
                else:
                    x1, y1, x2, y2 = rectangle(s, cols["h"][i], cols["w"][i], lam)
                    part = (slice(y1, y2), slice(x1, x2)) if cols["layout"][i] == "HWC" else (slice(None), slice(y1, y2), slice(x1, x2))
                    px = cur.copy()
                    px[part] = old[part]
                    lam = np.float32(1 - (x2 - x1) * (y2 - y1) / (cols["h"][i] * cols["w"][i]))
                cols["data"][i] = px.tobytes()
                soft.append((one_hot(prev["label"]) * (np.float32(1) - lam) + one_hot(cols["label"][i]) * lam).tolist())
            arrays = [pa.array(cols[c], b.column(c).type) for c in out]
            yield pa.RecordBatch.from_arrays([*arrays, pa.array(soft, pa.list_(pa.float32()))], [*out, "soft_label"])

    return paired.select(*out, "before").mapInArrow(made, schema)


def mixed_batches(rows: DataFrame, kind: str, num_classes: int, alpha: float, seed: int = 0, epoch: int = 0) -> DataFrame:
    """``rows`` of ``Pipeline.stacked`` with mixed data and soft_labels, a list for each image: the same values as ``mixed`` gives row
    by row. A batch is in one row, so nothing is shuffled, and each batch is one array operation."""
    if not (math.isfinite(alpha) and alpha > 0) or num_classes <= 0:
        raise ValueError("alpha and num_classes must be positive")
    context, key = Context(seed, epoch), op_key(kind)

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):
                one = b.slice(k, 1)
                at = {c: one.column(c)[0].as_py() for c in ("batch_id", "n", "h", "w", "c", "dtype", "layout", "labels")}
                shape = (at["h"], at["w"], at["c"]) if at["layout"] == "HWC" else (at["c"], at["h"], at["w"])
                px = np.frombuffer(one.column("data")[0].as_buffer(), at["dtype"]).reshape(at["n"], *shape)
                labels = np.array(at["labels"])
                if len(bad := labels[(labels < 0) | (labels >= num_classes)]):
                    raise ValueError(f"label {bad[0]} is out of range")
                s = context.stream(at["batch_id"], key)
                lam, old = beta_draw(s, alpha), np.roll(px, 1, axis=0)
                if kind == "MixUp":
                    if at["dtype"] != "float32":
                        raise ValueError("MixUp takes float32 images; convert them first")
                    lam = np.float32(lam)
                    px = old * (np.float32(1) - lam) + px * lam
                else:
                    x1, y1, x2, y2 = rectangle(s, at["h"], at["w"], lam)
                    part = (slice(None), slice(y1, y2), slice(x1, x2)) if at["layout"] == "HWC" else (slice(None), slice(None), slice(y1, y2), slice(x1, x2))
                    px = px.copy()
                    px[part] = old[part]
                    lam = np.float32(1 - (x2 - x1) * (y2 - y1) / (at["h"] * at["w"]))
                hot = (labels[:, None] == np.arange(num_classes)).astype(np.float32)
                soft = np.roll(hot, 1, axis=0) * (np.float32(1) - lam) + hot * lam
                new = {"data": pa.array([px.tobytes()], pa.binary())}
                names = one.schema.names
                yield pa.RecordBatch.from_arrays([*(new.get(c, one.column(c)) for c in names), pa.array([soft.tolist()], pa.list_(pa.list_(pa.float32())))], [*names, "soft_labels"])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema) + ", soft_labels array<array<float>>"
    return rows.mapInArrow(made, schema)
