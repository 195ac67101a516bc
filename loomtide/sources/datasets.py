"""Named splits with a manifest, stored as Parquet."""

from __future__ import annotations

import json
import os

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.stored import removed, stored

MANIFEST = "dataset.json"
KINDS = ("image", "class_label", "scalar", "binary", "text")


class ManifestError(ValueError):
    pass


def upgraded(m: dict) -> dict:
    """A manifest of version 1 (splits with a path and perhaps a number of rows, no features) as one of version 2."""
    splits = m.get("splits")
    if not isinstance(splits, dict) or not all(isinstance(s, dict) and s.get("path") for s in splits.values()):
        raise ManifestError("a manifest of version 1 needs splits with a path")
    return {"version": 1, "name": m.get("name") or "legacy-dataset", "features": {}, "splits": {k: {"uri": s["path"], "num_rows": s.get("num_rows")} for k, s in splits.items()}}


def checked(m: dict) -> dict:
    """A manifest of version 2: a name, features (column and kind), splits (uri and num_rows). One of version 1 comes back
    with no features: its splits' columns are taken as they are."""
    version = m.get("version", m.get("format_version"))
    if version == 1:
        m = upgraded(m)
    elif version != 2:
        raise ManifestError(f"unsupported manifest version {version!r}")
    for k in ("name", "splits", *(["features"] if version == 2 else [])):
        if not m.get(k):
            raise ManifestError(f"manifest without {k}")
    for name, f in m["features"].items():
        if f.get("kind") not in KINDS or not f.get("column"):
            raise ManifestError(f"feature {name} needs a column and one of the kinds {', '.join(KINDS)}")
    for name, s in m["splits"].items():
        uri = s.get("uri", "")
        if not uri or "num_rows" not in s:
            raise ManifestError(f"split {name} needs uri and num_rows")
        if "://" in uri and not uri.startswith("file://"):
            raise ManifestError(f"split {name}: only relative paths and file:// are read")
        if "://" not in uri and ".." in uri.split("/"):
            raise ManifestError(f"split {name}: the path leaves the dataset")
    return m


def _read_text(spark: SparkSession, path: str) -> str | None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(p):
        return None
    return "\n".join(r[0] for r in spark.read.text(path).collect())


def manifest(spark: SparkSession, root: str) -> dict | None:
    text = _read_text(spark, f"{root}/{MANIFEST}")
    return None if text is None else checked(json.loads(text))


def load_dataset(spark: SparkSession, root: str, split: str | None = None) -> dict[str, DataFrame] | DataFrame:
    """The splits of a dataset folder by name; from its manifest, else its *.parquet children."""
    if root.endswith(".parquet"):
        if split is not None:
            raise ValueError("a Parquet path is one split already")
        return spark.read.parquet(root)
    m = manifest(spark, root)
    if m is not None:
        place = {k: (s["uri"] if "://" in s["uri"] else f"{root}/{s['uri']}") for k, s in m["splits"].items()}
        columns = [f["column"] for f in m["features"].values()]
        named = lambda df: df.select(*[F.col(f"`{c}`").alias(n) for n, c in zip(m["features"], columns, strict=True)]) if columns else df
        out = {k: named(spark.read.parquet(p)) for k, p in place.items()}
    else:
        sc = spark.sparkContext
        path = sc._jvm.org.apache.hadoop.fs.Path(root)
        found = path.getFileSystem(sc._jsc.hadoopConfiguration()).listStatus(path)
        names = sorted(s.getPath().getName() for s in found)
        out = {n.removesuffix(".parquet"): spark.read.parquet(f"{root}/{n}") for n in names if n.endswith(".parquet")}
    if split is None:
        return out
    if split not in out:
        raise KeyError(f"split {split} is not among {', '.join(out)}")
    return out[split]


#: Bytes of images in a file, at most.
MOST_BYTES = 1 << 31


def convert(splits: dict[str, DataFrame], root: str, name: str, image_column: str = "image", label_column: str = "label", max_rows: int = 1_048_576, most_bytes: int = MOST_BYTES) -> dict:
    """Writes splits as Parquet (image binary, label int) with at most ``max_rows`` rows and ``most_bytes`` bytes of images a file (more
    only where one image is larger than half of that), and the manifest. Rows go to files by the bytes before them, a
    two-level prefix sum in the order of pos, so one large image makes no other file smaller."""
    m = {"version": 2, "name": name, "features": {"image": {"kind": "image", "column": "image"}, "label": {"kind": "class_label", "column": "label"}}, "splits": {}}
    spark = None
    for split, df in splits.items():
        spark = df.sparkSession
        kind = dict(df.dtypes)[image_column]
        image = F.col(f"{image_column}.bytes") if kind.startswith("struct") else F.col(image_column)
        extra = [c for c in df.columns if c == "pos"]
        out = df.select(*extra, image.alias("image"), F.col(label_column).cast("int").alias("label"))
        kept = None
        if not extra:  # places that stay what they are when read again
            kept = out = stored(out.withColumn("pos", F.monotonically_increasing_id()), "rows")
        sizes = out.select("pos", F.octet_length("image").cast("long").alias("n"), F.expr("pos div 4096").alias("run"))
        large = sizes.agg(F.max("n")).first()[0] or 0
        bound = max(most_bytes - large, most_bytes // 2, 1)  # a file's last image may begin just below it
        totals = sizes.groupBy("run").agg(F.sum("n").alias("total"))
        before = totals.select("run", (F.sum("total").over(Window.orderBy("run")) - F.col("total")).alias("before"))
        files = max(1, -(-(totals.agg(F.sum("total")).first()[0] or 1) // bound))
        at = F.col("before") + F.sum("n").over(Window.partitionBy("run").orderBy("pos")) - F.col("n")
        places = sizes.join(before, "run").withColumn("file", F.least(F.floor(at / bound), F.lit(files - 1)).cast("int")).select("pos", "file")
        rows = out.join(places, "pos").repartitionById(files, "file").sortWithinPartitions("pos").select(*extra, "image", "label")
        rows.write.mode("errorifexists").option("maxRecordsPerFile", max_rows).parquet(f"{root}/{split}.parquet")
        if kept is not None:
            removed(kept)
        m["splits"][split] = {"uri": f"{split}.parquet", "num_rows": spark.read.parquet(f"{root}/{split}.parquet").count()}
    checked(m)
    sc = spark.sparkContext
    path = sc._jvm.org.apache.hadoop.fs.Path(f"{root}/{MANIFEST}")
    stream = path.getFileSystem(sc._jsc.hadoopConfiguration()).create(path, True)
    stream.write(bytearray(json.dumps(m, indent=1).encode()))
    stream.close()
    return m


def classes(root: str) -> list[str]:
    """Class names of a local image folder, sorted."""
    return sorted(d for d in os.listdir(root) if os.path.isdir(os.path.join(root, d)))
