"""Registered queries of broadcast forms, shapes and the wider linear algebra, with their SQL.

x is a vector of 64 numbers, y the same reversed; both are read as matrices of several shapes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import linalg as L
from ..functions import tensor as T
from .queries import EMBEDDINGS_SQL, embeddings, register, results, table

M, C = (8, 8), (4, 4, 4)


def grid(rows: int, cols: int, e: str) -> str:
    """An array by rows: ``e`` reads the row as {i} and the column as {j}."""
    return f"list_transform(range({rows * cols}), lambda q: {e.format(i=f'(q // {cols})', j=f'(q % {cols})')})"


def summed(k: int, e: str) -> str:
    return f"list_sum(list_transform(range({k}), lambda t: {e}))"


def part(name: str, first: int, last: int) -> str:
    return f"{name}[{first}:{last}]"



results(
    "tensor_broadcast", embeddings, EMBEDDINGS_SQL,
    {
        "row_added": (lambda x, y, px: T.broadcast_add(x, M, F.slice(y, 1, 8), (8,)), grid(8, 8, "x[{i} * 8 + {j} + 1] + y[{j} + 1]")),
        "column_taken": (lambda x, y, px: T.broadcast_sub(x, M, F.slice(y, 1, 8), (8, 1)), grid(8, 8, "x[{i} * 8 + {j} + 1] - y[{i} + 1]")),
        "both_ways": (lambda x, y, px: T.broadcast_mul(F.slice(x, 1, 8), (8, 1), F.slice(y, 1, 8), (1, 8)), grid(8, 8, "x[{i} + 1] * y[{j} + 1]")),
        "divided": (lambda x, y, px: T.broadcast_div(x, M, T.add_scalar(F.slice(y, 1, 8), 2.0), (8,)), grid(8, 8, "x[{i} * 8 + {j} + 1] / (y[{j} + 1] + 2.0)")),
        "powered": (lambda x, y, px: T.broadcast_pow(T.absolute(x), M, T.absolute(F.slice(y, 1, 8)), (8,)), grid(8, 8, "pow(abs(x[{i} * 8 + {j} + 1]), abs(y[{j} + 1]))")),
        "spread": (lambda x, y, px: T.broadcast_as(F.slice(x, 1, 12), (3, 1, 4), (3, 2, 4)), "list_transform(range(24), lambda q: x[(q // 8) * 4 + q % 4 + 1])"),
        "led": (lambda x, y, px: T.broadcast_left(F.slice(x, 1, 6), (2, 3), (3,)), "list_transform(range(18), lambda q: x[q % 6 + 1])"),
        "multiplied": (lambda x, y, px: L.broadcast_matmul(x, C, F.slice(y, 1, 16), (4, 4)), "list_transform(range(64), lambda q: " + summed(4, "x[(q // 4) * 4 + t + 1] * y[t * 4 + q % 4 + 1]") + ")"),
    },
)
results(
    "tensor_shapes", embeddings, EMBEDDINGS_SQL,
    {
        "reshaped": (lambda x, y, px: T.transpose(T.reshape(x, M, (4, -1)), 4, 16), grid(16, 4, "x[{j} * 16 + {i} + 1]")),
        "squeezed": (lambda x, y, px: T.broadcast_as(F.slice(x, 1, 8), T.squeezed(T.unsqueezed((8,), 0), 0), (2, 8)), "list_concat(x[1:8], x[1:8])"),
        "flattened": (lambda x, y, px: T.index_select(x, T.flattened(C, 0, 1), 0, [15, 0]), "list_concat(x[61:64], x[1:4])"),
        "row": (lambda x, y, px: T.get(x, M, 3), part("x", 25, 32)), "column": (lambda x, y, px: T.get_on_dim(x, M, 1, 3), "list_transform(range(8), lambda i: x[i * 8 + 4])"),
        "log_sums": (lambda x, y, px: T.log_sum_exp_dim(x, M, 0), "list_transform(range(8), lambda j: ln(list_sum(list_transform(range(8), lambda i: exp(x[i * 8 + j + 1])))))"),
        "added_rows": (lambda x, y, px: T.index_add(x, M, 0, [2, 5, 2], F.slice(y, 1, 24)), grid(8, 8, "x[{i} * 8 + {j} + 1] + CASE {i} WHEN 2 THEN y[{j} + 1] + y[{j} + 17] WHEN 5 THEN y[{j} + 9] ELSE 0.0 END")),
        "added_columns": (lambda x, y, px: T.index_add(x, M, 1, [7, 0], F.slice(y, 1, 16)), grid(8, 8, "x[{i} * 8 + {j} + 1] + CASE {j} WHEN 7 THEN y[{i} * 2 + 1] WHEN 0 THEN y[{i} * 2 + 2] ELSE 0.0 END")),
        "columns_put": (lambda x, y, px: T.slice_scatter_dim(x, M, 1, F.slice(y, 1, 16), 2, 3), grid(8, 8, "CASE WHEN {j} BETWEEN 3 AND 4 THEN y[{i} * 2 + {j} - 2] ELSE x[{i} * 8 + {j} + 1] END")),
        "as_u8": (lambda x, y, px: T.convert(T.affine(x, 4000.0, 100.0), "u8"), "list_transform(x, lambda v: trunc(least(greatest(v * 4000.0 + 100.0, 0.0), 255.0)))"),
        "as_i16": (lambda x, y, px: T.convert(T.mul_scalar(x, 1e5), "i16"), "list_transform(x, lambda v: trunc(least(greatest(v * 1e5, -32768.0), 32767.0)))"),
        "as_f32": (lambda x, y, px: T.convert(T.div_scalar(x, 3.0), "f32"), "list_transform(x, lambda v: CAST(CAST(v / 3.0 AS FLOAT) AS DOUBLE))"),
    },
)
_MIRROR = "x[greatest({i}, {j}) * 8 + least({i}, {j}) + 1]"
_OUTER = "y[{i} + 1] * y[{j} + 1]"
_LOWER = "CASE WHEN t < {i} THEN x[{i} * 8 + t + 1] WHEN t = {i} THEN 1.0 ELSE 0.0 END"
results(
    "linalg_updates", embeddings, EMBEDDINGS_SQL,
    {
        "rank1": (lambda x, y, px: L.rank1_update(x, F.slice(y, 1, 8), 8, 2.0, 0.5, True), grid(8, 8, f"0.5 * {_MIRROR} + 2.0 * {_OUTER}")),
        "rank2": (lambda x, y, px: L.rank2_update(x, F.slice(y, 1, 8), F.slice(y, 9, 8), 8, 2.0, 0.5, True), grid(8, 8, f"0.5 * {_MIRROR} + 2.0 * (y[{{i}} + 1] * y[{{j}} + 9] + y[{{i}} + 9] * y[{{j}} + 1])")),
        "gram_rows": (lambda x, y, px: L.gram_update(x, F.slice(y, 1, 24), 8, 3, False, 1.5, -1.0), grid(8, 8, f"-{_MIRROR} + 1.5 * " + summed(3, "y[{i} * 3 + t + 1] * y[{j} * 3 + t + 1]"))),
        "gram_columns": (lambda x, y, px: L.gram_update(x, F.slice(y, 1, 24), 8, 3, True, 1.5, 0.0), grid(8, 8, "1.5 * " + summed(3, "y[t * 8 + {i} + 1] * y[t * 8 + {j} + 1]"))),
        "rank2k": (lambda x, y, px: L.rank2k_update(x, F.slice(y, 1, 24), F.slice(y, 25, 24), 8, 3, False, 0.5, 1.0), grid(8, 8, f"{_MIRROR} + 0.5 * " + summed(3, "y[{i} * 3 + t + 1] * y[{j} * 3 + t + 25] + y[{i} * 3 + t + 25] * y[{j} * 3 + t + 1]"))),
        "symmetric_right": (lambda x, y, px: L.symmetric_matmul(x, F.slice(y, 1, 24), 8, 3, True, "right"), grid(3, 8, summed(8, "y[{i} * 8 + t + 1] * x[greatest(t, {j}) * 8 + least(t, {j}) + 1]"))),
        "triangular_unit": (lambda x, y, px: L.triangular_matmul(x, F.slice(y, 1, 24), 8, 3, True, True), grid(8, 3, summed(8, f"({_LOWER}) * y[t * 3 + {{j}} + 1]"))),
        "triangular_turned": (lambda x, y, px: L.triangular_matmul(x, F.slice(y, 1, 24), 8, 3, True, False, True), grid(8, 3, summed(8, "CASE WHEN t >= {i} THEN x[t * 8 + {i} + 1] ELSE 0.0 END * y[t * 3 + {j} + 1]"))),
        "triangular_vector": (lambda x, y, px: L.triangular_mv(x, F.slice(y, 1, 8), 8, False), "list_transform(range(8), lambda i: " + summed(8, "CASE WHEN t >= i THEN x[i * 8 + t + 1] ELSE 0.0 END * y[t + 1]") + ")"),
        "turned_copy": (lambda x, y, px: L.matrix_copy(x, 4, 16, True, -2.0), grid(16, 4, "-2.0 * x[{j} * 16 + {i} + 1]")),
        "swapped": (lambda x, y, px: L.swap(x, y)[0], "y"),
    },
)
_BATCH = "(q // 16) * 16 + ((q % 16) // 4) * 4"
results(
    "linalg_batched", embeddings, EMBEDDINGS_SQL,
    {
        "vectors": (lambda x, y, px: L.batch_mv(x, F.slice(y, 1, 16), 4, 4, 4), "list_transform(range(16), lambda q: " + summed(4, "x[q * 4 + t + 1] * y[(q // 4) * 4 + t + 1]") + ")"),
        "vectors_added": (lambda x, y, px: L.batch_addmv(F.slice(y, 17, 16), x, F.slice(y, 1, 16), 4, 4, 4, 2.0, -1.0), "list_transform(range(16), lambda q: 2.0 * y[q + 17] - " + summed(4, "x[q * 4 + t + 1] * y[(q // 4) * 4 + t + 1]") + ")"),
        "added": (lambda x, y, px: L.baddbmm(y, x, y, 4, 4, 4, 4, 0.5, 2.0), "list_transform(range(64), lambda q: 0.5 * y[q + 1] + 2.0 * " + summed(4, f"x[{_BATCH} + t + 1] * y[(q // 16) * 16 + t * 4 + q % 4 + 1]") + ")"),
        "summed": (lambda x, y, px: L.addbmm(F.slice(x, 1, 16), x, y, 4, 4, 4, 4, 1.0, 0.25), "list_transform(range(16), lambda q: x[q + 1] + 0.25 * " + summed(16, "x[(t // 4) * 16 + (q // 4) * 4 + t % 4 + 1] * y[(t // 4) * 16 + (t % 4) * 4 + q % 4 + 1]") + ")"),
        # solutions are told by what they give when they are multiplied back
        "solved": (
            lambda x, y, px: L.batch_mv(_steep(x, 4), L.batch_triangular_solve(_steep(x, 4), F.slice(y, 1, 16), 4, 4), 4, 4, 4),
            "y[1:16]",
        ),
        "solved_columns": (lambda x, y, px: L.triangular_matmul(_steep(x, 8), L.triangular_solve(_steep(x, 8), F.slice(y, 1, 24), 8, cols=3), 8, 3), "y[1:24]"),
        "solved_turned": (lambda x, y, px: L.triangular_matmul(_steep(x, 8), L.triangular_solve(_steep(x, 8), F.slice(y, 1, 8), 8, transpose=True), 8, 1, transpose=True), "y[1:8]"),
        "solved_right": (lambda x, y, px: L.triangular_matmul(_steep(x, 8), L.triangular_solve(_steep(x, 8), F.slice(y, 1, 16), 8, cols=2, side="right"), 8, 2, side="right"), "y[1:16]"),
    },
)


def _steep(x, n: int):
    """Lower triangles with 2 on the diagonal."""
    return F.transform(x, lambda v, k: F.when(k % n == (k / n).cast("int") % n, F.lit(2.0)).when(k % n < (k / n).cast("int") % n, v).otherwise(F.lit(0.0)))


_THOUSANDTHS = "list_transform(embedding, lambda x: CAST(trunc(CAST(x AS DOUBLE) * 1000.0) AS BIGINT))"


@register(
    "tensor_typed",
    f"""WITH t AS (SELECT vec_id, {_THOUSANDTHS} AS v FROM embeddings),
u AS (SELECT vec_id, v, list_transform(v, lambda x: (x % 256 + 256) % 256) AS u FROM t)
SELECT vec_id, CAST(list_sum(u) % 256 AS DOUBLE) AS sum8, CAST((list_sum(u) % 256) // 64 AS DOUBLE) AS mean8, CAST(list_max(u) AS DOUBLE) AS most8,
CAST((list_sum(list_transform(v, lambda x: x * x)) + 32768) % 65536 - 32768 AS DOUBLE) AS square16 FROM u""",
)
def tensor_typed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors in thousandths as int16, their bytes as uint8: sums that wrap in their own type, a mean and a largest element."""
    from ..functions import typed

    rows = table(spark, sf_dir, "embeddings").select("vec_id", typed.tensor(F.transform("embedding", lambda x: x.cast("double") * 1000.0), (64,), "int16").alias("t"))
    rows = rows.withColumn("u", typed.to_dtype(F.col("t"), "uint8"))
    one = lambda c: F.get(typed.values(c), F.lit(0))
    square = typed.reduce("sum", typed.binary("mul", F.col("t"), F.col("t")), 0)
    return rows.select("vec_id", one(typed.reduce("sum", F.col("u"), 0)).alias("sum8"), one(typed.reduce("mean", F.col("u"), 0)).alias("mean8"), one(typed.reduce("max", F.col("u"), 0)).alias("most8"), one(square).alias("square16"))
