"""Registered queries of seeded draws below random steps, of CutMix boxes and of equalization, with their SQL.

The SQL mixes the row's number with the seed and the step's key itself; both are numbers under their names here."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import pixels
from ..operators import image_ops, rng
from ..operators.mix import rectangle
from .queries import number, number_sql, register, table

# The root of seed 42 and epoch 3, and the mixed keys of the first RandomHorizontalFlip, of the first
# RandomApply and the second RandomHorizontalFlip below it, and of the first CutMix; the finaliser's factors and the
# stream's step.
ROOT, FLIP, APPLY = 16626565845750415834, 17017183065694297897, 16308957253192314141
FLIP_BELOW, CUTMIX = 7198858492091629599, 15793510699368716618
F1, F2, STEP = 13787848793156543929, 10723151780598845931, 11400714819323198485


def mixed_sql(rows: str, v: str) -> str:
    """(vec_id, v): the finaliser of ``v`` over ``rows``."""
    one = f"SELECT vec_id, CAST({v} AS UBIGINT) AS v FROM ({rows})"
    for shift, factor in ((30, F1), (27, F2)):
        one = f"SELECT vec_id, CAST(xor(v, v >> {shift})::UHUGEINT * {factor} % 18446744073709551616 AS UBIGINT) AS v FROM ({one})"
    return f"SELECT vec_id, xor(v, v >> 31) AS v FROM ({one})"


def draw_sql(key: int, n: int) -> str:
    """(vec_id, v): the n-th draw of each row's stream for a mixed key."""
    rows = mixed_sql("SELECT vec_id FROM embeddings", "vec_id")
    rows = mixed_sql(rows, f"xor({ROOT}::UBIGINT, v)")
    rows = mixed_sql(rows, f"xor({key}::UBIGINT, v)")
    return mixed_sql(rows, f"(v::UHUGEINT + {STEP}::UHUGEINT * {n}) % 18446744073709551616")


_F64 = "({}.v >> 11)::DOUBLE / 9007199254740992.0"


@register("rng_horizontal_flip", f"SELECT vec_id, {_F64.format('a')} AS draw, {_F64.format('a')} < 0.5 AS flips FROM ({draw_sql(FLIP, 1)}) a")
def rng_horizontal_flip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The draw by which each row's random flip is decided, whatever the partitioning."""
    context, key = rng.Context(42, 3), rng.op_key("RandomHorizontalFlip")

    def draws(batches):
        for b in batches:
            v = rng.first_draws(rng.row_states(context, b.column("vec_id").to_numpy(), key))
            d = (v >> np.uint64(11)).astype(np.float64) / float(1 << 53)
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), pa.array(d), pa.array(d < 0.5)], ["vec_id", "draw", "flips"])

    return table(spark, sf_dir, "embeddings").select("vec_id").mapInArrow(draws, "vec_id long, draw double, flips boolean")


@register(
    "rng_nested_flip",
    f"SELECT vec_id, {_F64.format('a')} < 0.5 AS applies, {_F64.format('b')} AS draw FROM ({draw_sql(APPLY, 1)}) a JOIN ({draw_sql(FLIP_BELOW, 1)}) b USING (vec_id)",
)
def rng_nested_flip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The draws of a random step and of the second flip below it."""
    ((_, args, outer),) = image_ops.keyed([("RandomApply", {"p": 0.5, "steps": (("RandomHorizontalFlip", {}), ("Invert", {}), ("RandomHorizontalFlip", {}))})])
    inner = image_ops.keyed(args["steps"], outer)[2][2]
    context = rng.Context(42, 3)

    def draws(batches):
        for b in batches:
            ids = b.column("vec_id").to_numpy()
            first = lambda key: (rng.first_draws(rng.row_states(context, ids, key)) >> np.uint64(11)).astype(float) / (1 << 53)  # noqa: B023, E731
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), pa.array(first(outer) < 0.5), pa.array(first(inner))], ["vec_id", "applies", "draw"])

    return table(spark, sf_dir, "embeddings").select("vec_id").mapInArrow(draws, "vec_id long, applies boolean, draw double")


W, H = 32, 24


@register(
    "batch_cutmix_box",
    f"""SELECT vec_id, greatest(x - dx, 0) AS x1, greatest(y - dy, 0) AS y1, least(x + dx, {W}) AS x2, least(y + dy, {H}) AS y2 FROM (
  SELECT vec_id, CAST(a.v % {W} AS INTEGER) AS x, CAST(b.v % {H} AS INTEGER) AS y,
    CAST(trunc(0.5 * sqrt(1 - (label + 0.5) / 10) * {W}) AS INTEGER) AS dx, CAST(trunc(0.5 * sqrt(1 - (label + 0.5) / 10) * {H}) AS INTEGER) AS dy
  FROM embeddings JOIN ({draw_sql(CUTMIX, 1)}) a USING (vec_id) JOIN ({draw_sql(CUTMIX, 2)}) b USING (vec_id))""",
)
def batch_cutmix_box(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CutMix's box of each batch: a random pixel, and sides by the weight that the label stands for."""
    context, key = rng.Context(42, 3), rng.op_key("CutMix")

    def made(batches):
        for b in batches:
            ids, label = b.column("vec_id").to_pylist(), b.column("label").to_pylist()
            boxes = [rectangle(context.stream(i, key), H, W, (k + 0.5) / 10) for i, k in zip(ids, label, strict=True)]
            cols = zip(*boxes, strict=True) if boxes else [[]] * 4
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), *[pa.array(c, pa.int32()) for c in cols]], ["vec_id", "x1", "y1", "x2", "y2"])

    return table(spark, sf_dir, "embeddings").select("vec_id", "label").mapInArrow(made, "vec_id long, x1 int, y1 int, x2 int, y2 int")


@register(
    "pixel_equalize",
    f"""WITH q AS (SELECT vec_id, list_transform(embedding, lambda e: CAST(least(greatest(floor((CAST(e AS DOUBLE) + 1) * 127.5), 0), 255) AS INTEGER)) AS q FROM embeddings),
p AS (SELECT vec_id, k, k % 3 AS c, (q[k % 64 + 1] * (1 + k // 64) + k) % 256 AS v FROM q, unnest(range(864)) t(k)),
r AS (SELECT *, rank() OVER (PARTITION BY vec_id, c ORDER BY v) - 1 AS below, max(v) OVER (PARTITION BY vec_id, c) AS top FROM p),
s AS (SELECT *, count(*) FILTER (WHERE v < top) OVER (PARTITION BY vec_id, c) // 255 AS step FROM r)
SELECT vec_id, {number_sql('sum(CASE WHEN step = 0 THEN v ELSE least((step // 2 + below) // step, 255) END * (k + 1))')} AS pixels FROM s GROUP BY vec_id""",
)
def pixel_equalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Equalization of 18 x 16 RGB images, spread from each vector: enough pixels for a step above 0."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", pixels.from_unit(F.col("embedding")).alias("q"))
    px = F.transform(F.sequence(F.lit(0), F.lit(863)), lambda k: (F.get("q", k % 64) * (1 + F.floor(k / 64)) + k) % 256)
    rows = rows.select("vec_id", pixels.equalize(F.transform(px, lambda v: v.cast("int"))).alias("px"))
    return rows.select("vec_id", number(F.aggregate(F.transform("px", lambda v, k: (v * (k + 1)).cast("long")), F.lit(0).cast("long"), lambda s, v: s + v)).alias("pixels"))
