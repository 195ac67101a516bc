"""Image tables as DataFrames (pos, image, label)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from ..operators import png
from ..operators.selection import with_pos
from .arrow_ipc import scan_arrow

#: Paths up to which their order is broadcast, some hundred bytes each.
MOST_PATHS = 200_000
EXTENSIONS = ("jpg", "jpeg", "png", "bmp", "webp")


def _checked(df: DataFrame, image: str, label: str) -> DataFrame:
    kinds = {f.name: f.dataType.simpleString() for f in df.schema}
    for c in (image, label):
        if c not in kinds:
            raise ValueError(f"column {c} is missing")
    struct = kinds[image].startswith("struct<") and "bytes:binary" in kinds[image]
    if kinds[image] != "binary" and not struct:
        raise ValueError(f"column {image} must be binary or a struct with binary bytes")
    if kinds[label] not in ("int", "bigint"):
        raise ValueError(f"column {label} must be int32 or int64")
    value = F.col(f"{image}.bytes") if struct else F.col(image)
    here = F.when(value.isNull(), F.raise_error(F.concat(F.lit(f"{image} is null at row "), F.col("pos").cast("string")))).otherwise(value)
    return df.select("pos", here.alias("image"), F.col(label).cast("long").alias("label"))


def scan_parquet(spark: SparkSession, path: str | list[str], key: str, image_column: str = "image", label_column: str = "label") -> DataFrame:
    """Rows of Parquet files in the order of an integer key; only the columns that are needed are read."""
    df = spark.read.parquet(*([path] if isinstance(path, str) else path))
    return _checked(with_pos(df.select(key, image_column, label_column), key), image_column, label_column)


def scan_image_folder(spark: SparkSession, root: str) -> DataFrame:
    """Images below root/class/: classes sorted by name give labels, files sorted by path give pos."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path", "content")
    files = files.where(F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1)).isin(*EXTENSIONS))
    inner = F.expr(f"substring(path, locate('{root.rstrip('/')}/', path) + {len(root.rstrip('/')) + 1})")
    files = files.withColumn("class", F.element_at(F.split(inner, "/"), 1))
    # A path sorts by its class and the slash after it, so files are ranked in their class, and classes are counted.
    named = files.select("path", "class")
    classes = named.groupBy("class").agg(F.count("*").alias("n"))  # a row per class
    by_name, by_path = Window.orderBy("class"), Window.orderBy(F.concat("class", F.lit("/")))
    classes = classes.select("class", (F.row_number().over(by_name) - 1).cast("long").alias("label"), (F.sum("n").over(by_path) - F.col("n")).alias("before"))
    ranked = named.withColumn("rank", F.row_number().over(Window.partitionBy("class").orderBy("path")) - 1)
    order = ranked.join(classes, "class").select("path", "label", (F.col("before") + F.col("rank")).cast("long").alias("pos"))
    # the bytes stay where they are read, unless the paths are too many to be sent to them
    order = F.broadcast(order) if named.count() <= MOST_PATHS else order
    return files.join(order, "path").select("pos", F.col("content").alias("image"), "label", "class", "path")


def scan_decoded_folder(spark: SparkSession, root: str) -> DataFrame:
    """Images of a folder decoded by Spark's own image source (any format of the JVM): origin, h, w, c, image (RGB). A file
    with an image's extension that is none is an error that names it."""
    pattern = "*.{" + ",".join(x for e in EXTENSIONS for x in (e, e.upper())) + "}"
    rows = spark.read.format("image").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(root).select("image.*")

    def turned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        for b in batches:
            d = b.to_pydict()
            out = []
            for origin, h, w, c, data in zip(d["origin"], d["height"], d["width"], d["nChannels"], d["data"], strict=True):
                if h is None or h < 0 or not data:
                    raise ValueError(f"{origin} is not an image")
                px = np.frombuffer(data, np.uint8).reshape(h, w, c)
                out.append(np.ascontiguousarray(px[..., 2::-1] if c >= 3 else px.repeat(3, axis=2)).tobytes())
            yield pa.RecordBatch.from_arrays([b.column("origin"), b.column("height"), b.column("width"), pa.array([3] * b.num_rows, pa.int32()), pa.array(out, pa.binary())], ["origin", "h", "w", "c", "image"])

    return rows.select("origin", "height", "width", "nChannels", "data").mapInArrow(turned, "origin string, h int, w int, c int, image binary")


def scan_cached_dataset(spark: SparkSession, dataset, columns: dict[str, str]) -> DataFrame:
    """The Arrow files behind a loaded dataset object (its ``cache_files``), as one table. A dataset whose rows were chosen
    or put in order by an index table has other rows than its files, so it is an error."""
    if getattr(dataset, "_indices", None) is not None:
        raise ValueError("the dataset has an index table; write its rows out first")
    files = [f["filename"] if isinstance(f, dict) else str(f) for f in getattr(dataset, "cache_files", None) or []]
    if not files:
        raise ValueError("the dataset has no Arrow files")
    return scan_arrow(spark, files, columns)


def read_image_batch(rows: DataFrame, batch_size: int, start: int = 0, as_numpy: bool = True) -> dict:
    """Rows start .. start + batch_size of (pos, image, label), decoded, on the driver: images (n, h, w, 3) and labels, or
    with ``as_numpy`` off their bytes, shape and a list of labels. Images of several shapes are an error, and so is a start
    at or beyond the end."""
    from ..plans.pipeline import Pipeline, to_numpy

    if batch_size <= 0 or start < 0:
        raise ValueError("batch_size must be positive and start not negative")
    batches = list(to_numpy(Pipeline(rows).skip(start).take(batch_size).decode_image().batch(batch_size)))
    if not batches:
        raise ValueError(f"no rows from {start} on")
    return batches[0] if as_numpy else as_bytes(batches[0])


def as_bytes(batch: dict) -> dict:
    """A batch of arrays as bytes and lists."""
    x = batch["images"]
    return {"images": x.tobytes(), "shape": list(x.shape), "dtype": str(x.dtype), "labels": batch["labels"].tolist()}


def encoded_png(rows: DataFrame) -> DataFrame:
    """``rows`` with raw uint8 HWC images (image, h, w, c) as PNG files: image holds their bytes and the sizes go. Null images stay
    null; one of another length than its sizes say is an error."""

    def files(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sizes = np.stack([b.column(k).to_numpy() for k in ("h", "w", "c")], 1).tolist()
            made = [None if not x.is_valid else png.encode(np.frombuffer(x.as_buffer(), np.uint8).reshape(s)) for x, s in zip(b.column("image"), sizes, strict=True)]
            kept = [k for k in b.schema.names if k not in ("image", "h", "w", "c")]
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in kept), pa.array(made, pa.binary())], [*kept, "image"])

    kept = [f for f in rows.schema.fields if f.name not in ("image", "h", "w", "c")]
    return rows.mapInArrow(files, StructType([*kept, StructField("image", BinaryType())]))
