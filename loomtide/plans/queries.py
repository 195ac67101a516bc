"""Registered queries of the engine's own operators, each with the SQL that gives the same rows.

Most are a table of results per row: a column is a Spark expression and its SQL over the same carrier. Arrays are told
as position-weighted sums, which any misplaced element changes."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import boxes, linalg, pixels, tokens
from ..functions import tensor as T
from ..functions.core import at
from ..operators import selection as S

Query = Callable[[SparkSession, str], DataFrame]
_queries: dict[str, Query] = {}
_sql: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def register(name: str, sql: str | None = None):
    def add(f: Query) -> Query:
        _queries[name] = f
        if sql is not None:
            _sql[name] = sql
        return f

    return add


def weighed(a: Column) -> Column:
    """Sum of value * (place + 1), to 6 digits."""
    return F.round(F.aggregate(F.transform(a, lambda v, k: v.cast("double") * (k + 1)), F.lit(0.0), lambda s, x: s + x), 6) + 0.0


def weighed_sql(a: str) -> str:
    return f"round(coalesce(list_sum(list_transform({a}, lambda v, i: CAST(v AS DOUBLE) * i)), 0.0), 6) + 0.0"


def number(x: Column) -> Column:
    return F.round(x.cast("double"), 6) + 0.0


def number_sql(x: str) -> str:
    return f"round(CAST({x} AS DOUBLE), 6) + 0.0"


EMBEDDINGS_SQL = "SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS x, list_reverse(CAST(embedding AS DOUBLE[])) AS y FROM embeddings"
PIXELS_SQL = """SELECT vec_id, label, list_transform(range(48), lambda k: q[(k // 3) * 4 + k % 3 + 1]) AS px FROM (
  SELECT vec_id, label, list_transform(embedding, lambda e: CAST(least(greatest(floor((CAST(e AS DOUBLE) + 1) * 127.5), 0), 255) AS INTEGER)) AS q FROM embeddings)"""


def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = F.col("embedding").cast("array<double>")
    return table(spark, sf_dir, "embeddings").select("vec_id", "label", x.alias("x"), F.reverse(x).alias("y"))


def images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """4 x 4 RGB images: each vector is a 4 x 4 RGBA image and loses its alpha."""
    df = table(spark, sf_dir, "embeddings")
    return df.select("vec_id", "label", pixels.rgb(pixels.from_unit(F.col("embedding")), 16, 4).alias("px"))


def results(name: str, carrier: Callable, carrier_sql: str, arrays: dict[str, tuple[Callable[..., Column], str]] | None = None, numbers: dict[str, tuple[Callable[..., Column], str]] | None = None) -> None:
    arrays, numbers = arrays or {}, numbers or {}
    said = [f"{weighed_sql(s)} AS {k}" for k, (_, s) in arrays.items()] + [f"{number_sql(s)} AS {k}" for k, (_, s) in numbers.items()]

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = carrier(spark, sf_dir)
        own = [F.col(c) if c in df.columns else None for c in ("x", "y", "px")]
        told = [(k, weighed(f(*own))) for k, (f, _) in arrays.items()] + [(k, number(f(*own))) for k, (f, _) in numbers.items()]
        return df.select("vec_id", *[c.alias(k) for k, c in told])

    register(name, f"SELECT vec_id, {', '.join(said)} FROM ({carrier_sql})")(run)




def _map(e: str, a: str = "x") -> str:
    return f"list_transform({a}, lambda v, i: {e})"


_W = re.compile(r"\bw\b")


def _zip(e: str) -> str:
    return f"list_transform(x, lambda v, i: {_W.sub('y[i]', e)})"


results(
    "tensor_arithmetic", embeddings, EMBEDDINGS_SQL,
    {
        "added": (lambda x, y, px: T.add(x, y), _zip("v + w")),
        "subtracted": (lambda x, y, px: T.sub(x, y), _zip("v - w")),
        "multiplied": (lambda x, y, px: T.mul(x, y), _zip("v * w")),
        "divided": (lambda x, y, px: T.div(x, T.add_scalar(y, 2.0)), _zip("v / (w + 2.0)")),
        "plus_scalar": (lambda x, y, px: T.add_scalar(x, 0.5), _map("v + 0.5")),
        "minus_scalar": (lambda x, y, px: T.sub_scalar(x, 0.25), _map("v - 0.25")),
        "times_scalar": (lambda x, y, px: T.mul_scalar(x, 3.0), _map("v * 3.0")),
        "over_scalar": (lambda x, y, px: T.div_scalar(x, 7.0), _map("v / 7.0")),
        "negated": (lambda x, y, px: T.neg(x), _map("-v")),
        "absolutes": (lambda x, y, px: T.absolute(x), _map("abs(v)")),
    },
)
results(
    "tensor_unary", embeddings, EMBEDDINGS_SQL,
    {
        "affine": (lambda x, y, px: T.affine(x, 2.0, 1.0), _map("v * 2.0 + 1.0")),
        "elu": (lambda x, y, px: T.elu(x, 0.7), _map("CASE WHEN v > 0 THEN v ELSE 0.7 * (exp(v) - 1) END")),
        "powered": (lambda x, y, px: T.powf(T.absolute(x), 1.5), _map("pow(abs(v), 1.5)")),
        "power_of": (lambda x, y, px: T.power(T.absolute(x), T.absolute(y)), _zip("pow(abs(v), abs(w))")),
    },
)
results("tensor_compare", embeddings, EMBEDDINGS_SQL, {f"is_{k}": (lambda x, y, px, k=k: T.compare(k, x, y), _zip(f"CAST(v {o} w AS INTEGER)")) for k, o in {"eq": "=", "ne": "<>", "lt": "<", "le": "<=", "gt": ">", "ge": ">="}.items()} | {"above_zero": (lambda x, y, px: T.compare("gt", x, 0.0), _map("CAST(v > 0.0 AS INTEGER)"))})
results("tensor_select", embeddings, EMBEDDINGS_SQL, {"clamped": (lambda x, y, px: T.clamp(x, -0.05, 0.1), _map("least(greatest(v, -0.05), 0.1)")), "chosen": (lambda x, y, px: T.where(T.compare("gt", x, y), x, y), _zip("CASE WHEN v > w THEN v ELSE w END"))})
results(
    "tensor_reduce", embeddings, EMBEDDINGS_SQL, None,
    {
        "total": (lambda x, y, px: T.total(x),
        "list_sum(x)"),
        "average": (lambda x, y, px: T.mean(x),
        "list_avg(x)"),
        "lowest": (lambda x, y, px: T.minimum(x),
        "list_min(x)"),
        "highest": (lambda x, y, px: T.maximum(x),
        "list_max(x)"),
        "lowest_at": (lambda x, y, px: T.argmin(x),
        "list_position(x, list_min(x)) - 1"),
        "highest_at": (lambda x, y, px: T.argmax(x),
        "list_position(x, list_max(x)) - 1"),
        "variance": (lambda x, y, px: T.var(x),
        "list_var_samp(x)"),
        "log_sum_exp": (lambda x, y, px: T.log_sum_exp(x),
        "ln(list_sum(list_transform(x, lambda v: exp(v))))"),
        "dotted": (lambda x, y, px: T.dot(x, y),
        "list_dot_product(x, y)"),
        "l2": (lambda x, y, px: T.norm(x),
        "sqrt(list_dot_product(x, x))"),
        "l1": (lambda x, y, px: T.norm_l1(x),
        "list_sum(list_transform(x, lambda v: abs(v)))"),
        "largest_abs_at": (lambda x, y, px: T.argmax_abs(x),
        "list_position(list_transform(x, lambda v: abs(v)), list_max(list_transform(x, lambda v: abs(v)))) - 1"),
    },
)
M = (8, 8)
results(
    "tensor_axes", embeddings, EMBEDDINGS_SQL,
    {
        "running": (lambda x, y, px: T.cumsum(x),
        "list_transform(range(64), lambda k: list_sum(x[1:k + 1]))"),
        "by_column": (lambda x, y, px: T.reduce_dim(x, M, 0, T.total),
        "list_transform(range(8), lambda j: list_sum(list_transform(range(8), lambda i: x[i * 8 + j + 1])))"),
        "by_row": (lambda x, y, px: T.reduce_dim(x, M, 1, T.mean),
        "list_transform(range(8), lambda i: list_avg(x[i * 8 + 1:i * 8 + 8]))"),
        "row_max": (lambda x, y, px: T.reduce_dim(x, M, 1, T.maximum),
        "list_transform(range(8), lambda i: list_max(x[i * 8 + 1:i * 8 + 8]))"),
        "down_columns": (lambda x, y, px: T.cumsum_dim(x, M, 0),
        "list_transform(range(64), lambda k: list_sum(list_transform(range(k // 8 + 1), lambda i: x[i * 8 + k % 8 + 1])))"),
    },
)
_MM = "list_transform(range(64), lambda q: list_sum(list_transform(range(8), lambda t: {})))"
results(
    "tensor_matmul", embeddings, EMBEDDINGS_SQL,
    {
        "product": (lambda x, y, px: linalg.matmul(x, y, 8, 8, 8), _MM.format("x[(q // 8) * 8 + t + 1] * y[t * 8 + q % 8 + 1]")),
        "by_vector": (lambda x, y, px: linalg.mv(x, F.slice(y, 1, 8), 8, 8),
        "list_transform(range(8), lambda i: list_sum(list_transform(range(8), lambda t: x[i * 8 + t + 1] * y[t + 1])))"),
        "gram": (lambda x, y, px: linalg.gram(x, 8, 8), _MM.format("x[(q // 8) * 8 + t + 1] * x[(q % 8) * 8 + t + 1]")),
        "outer_product": (lambda x, y, px: linalg.outer(F.slice(x, 1, 8), F.slice(y, 1, 8)),
        "list_transform(range(64), lambda q: x[q // 8 + 1] * y[q % 8 + 1])"),
        "fused": (lambda x, y, px: linalg.addmm(y, x, y, 8, 8, 8, 0.5, 2.0),
        "list_transform(range(64), lambda q: 0.5 * y[q + 1] + 2.0 * list_sum(list_transform(range(8), lambda t: x[(q // 8) * 8 + t + 1] * y[t * 8 + q % 8 + 1])))"),
        "batched": (lambda x, y, px: linalg.batch_matmul(x, y, 4, 4, 4, 4),
        "list_transform(range(64), lambda q: list_sum(list_transform(range(4), lambda t: x[(q // 16) * 16 + ((q % 16) // 4) * 4 + t + 1] * y[(q // 16) * 16 + t * 4 + q % 4 + 1])))"),
        "axpy": (lambda x, y, px: linalg.axpy(1.5, x, y), _zip("1.5 * v + w")),
        "axpby": (lambda x, y, px: linalg.axpby(1.5, x, -0.5, y), _zip("1.5 * v + (-0.5) * w")),
        "rank1": (lambda x, y, px: linalg.rank1_update(x, F.slice(y, 1, 8), 8, 2.0),
        "list_transform(range(64), lambda q: x[q + 1] + 2.0 * y[q // 8 + 1] * y[q % 8 + 1])"),
        "lower_times": (lambda x, y, px: linalg.triangular_matmul(x, y, 8, 8), _MM.format("CASE WHEN t <= q // 8 THEN x[(q // 8) * 8 + t + 1] ELSE 0.0 END * y[t * 8 + q % 8 + 1]")),
        "symmetric_times": (lambda x, y, px: linalg.symmetric_matmul(x, y, 8, 8), _MM.format("x[greatest(q // 8, t) * 8 + least(q // 8, t) + 1] * y[t * 8 + q % 8 + 1]")),
    },
)
# a lower triangle with 2 on the diagonal: substitution written out row by row
_rows = []
for _i in range(8):
    _terms = "".join(f" - x[{_i * 8 + _j + 1}] * s{_j}" for _j in range(_i))
    _rows.append(f"(y[{_i + 1}]{_terms}) / 2.0 AS s{_i}")
_nested = f"SELECT *, {_rows[0]} FROM ({EMBEDDINGS_SQL})"
for _r in _rows[1:]:
    _nested = f"SELECT *, {_r} FROM ({_nested})"
results("linalg_triangular_solve", embeddings, _nested, {"solved": (lambda x, y, px: linalg.triangular_solve(F.transform(x, lambda v, k: F.when(k % 9 == 0, F.lit(2.0)).otherwise(v)), F.slice(y, 1, 8), 8), "[" + ", ".join(f"s{i}" for i in range(8)) + "]")})
_R = "sqrt(v * v + y[i] * y[i])"
results(
    "linalg_givens", embeddings, EMBEDDINGS_SQL,
    {k: (lambda x, y, px, k=k: F.zip_with(x, y, lambda p, q: linalg.givens(p, q)[k]), _map(s)) for k, s in {"c": f"v / {_R}", "s": f"y[i] / {_R}", "r": _R}.items()},
)
results(
    "tensor_views", embeddings, EMBEDDINGS_SQL,
    {
        "narrowed": (lambda x, y, px: T.narrow(x, M, 1, 2, 3),
        "list_transform(range(24), lambda k: x[(k // 3) * 8 + 2 + k % 3 + 1])"),
        "transposed": (lambda x, y, px: T.transpose(x, 8, 8),
        "list_transform(range(64), lambda k: x[(k % 8) * 8 + k // 8 + 1])"),
        "permuted": (lambda x, y, px: T.permute(x, (4, 4, 4), (2, 0, 1)),
        "list_transform(range(64), lambda k: x[((k // 4) % 4) * 16 + (k % 4) * 4 + k // 16 + 1])"),
        "flipped": (lambda x, y, px: T.flip(x, M, 1),
        "list_transform(range(64), lambda k: x[(k // 8) * 8 + 7 - k % 8 + 1])"),
        "rolled": (lambda x, y, px: T.roll(x, M, 0, 3),
        "list_transform(range(64), lambda k: x[((k // 8 + 5) % 8) * 8 + k % 8 + 1])"),
        "repeated": (lambda x, y, px: T.repeat(x, (64,), 0, 2),
        "list_concat(x, x)"),
        "second_chunk": (lambda x, y, px: T.chunk(x, M, 0, 3)[1], "x[25:48]"),
        "windows": (lambda x, y, px: T.unfold(x, 8, 4, 64),
        "list_transform(range(120), lambda k: x[(k // 8) * 4 + k % 8 + 1])"),
        "zero_padded": (lambda x, y, px: T.pad_with_zeros(x, 2, 3),
        "list_concat(list_concat([0.0, 0.0], x), [0.0, 0.0, 0.0])"),
        "edge_padded": (lambda x, y, px: T.pad_with_same(x, 1, 2),
        "list_concat(list_concat([x[1]], x), [x[64], x[64]])"),
    },
)


def _idx() -> Column:
    return F.array(*[F.lit(i) for i in (5, 0, 63, 5, 7)])


results(
    "tensor_index", embeddings, EMBEDDINGS_SQL,
    {
        "gathered": (lambda x, y, px: T.gather(x, _idx()),
        "[x[6], x[1], x[64], x[6], x[8]]"),
        "selected": (lambda x, y, px: T.index_select(x, M, 0, [3, 3, 1]),
        "list_concat(list_concat(x[25:32], x[25:32]), x[9:16])"),
        "added_at": (lambda x, y, px: T.scatter_add(x, _idx(), F.slice(y, 1, 5)),
        "list_transform(x, lambda v, i: v + CASE i WHEN 6 THEN y[1] + y[4] WHEN 1 THEN y[2] WHEN 64 THEN y[3] WHEN 8 THEN y[5] ELSE 0.0 END)"),
        "put_at": (lambda x, y, px: T.scatter(x, _idx(), F.slice(y, 1, 5)),
        "list_transform(x, lambda v, i: CASE i WHEN 6 THEN y[4] WHEN 1 THEN y[2] WHEN 64 THEN y[3] WHEN 8 THEN y[5] ELSE v END)"),
        "slice_put": (lambda x, y, px: T.slice_scatter(x, F.slice(y, 1, 4), 10),
        "list_transform(x, lambda v, i: CASE WHEN i BETWEEN 11 AND 14 THEN y[i - 10] ELSE v END)"),
        "joined": (lambda x, y, px: T.cat([x, y], [M, M], 1),
        "list_transform(range(128), lambda k: CASE WHEN k % 16 < 8 THEN x[(k // 16) * 8 + k % 16 + 1] ELSE y[(k // 16) * 8 + k % 16 - 7] END)"),
        "stacked": (lambda x, y, px: T.stack([x, y], M, 0),
        "list_concat(x, y)"),
        "counted": (lambda x, y, px: T.arange(0, 10, 3), "[0.0, 3.0, 6.0, 9.0]"),
    },
)


@register(
    "tensor_rows_reduce",
    """SELECT label, CAST(p - 1 AS INTEGER) AS place, round(sum(v), 6) AS total, round(avg(v), 6) AS average, round(var_samp(v), 6) AS variance, round(min(v), 6) AS lowest, round(max(v), 6) AS highest
FROM (SELECT label, unnest(CAST(embedding AS DOUBLE[])) AS v, unnest(range(1, 65)) AS p
FROM embeddings)
GROUP BY ALL""",
)
def tensor_rows_reduce(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = embeddings(spark, sf_dir).select("label", F.posexplode("x").alias("place", "v"))
    r = lambda c, k: F.round(c, 6).alias(k)
    return rows.groupBy("label", "place").agg(r(F.sum("v"), "total"), r(F.avg("v"), "average"), r(F.var_samp("v"), "variance"), r(F.min("v"), "lowest"), r(F.max("v"), "highest"))


@register(
    "tensor_rows_cumsum",
    "SELECT vec_id, CAST(k AS INTEGER) AS k, round(sum(v) OVER (PARTITION BY k ORDER BY vec_id), 6) AS running FROM (SELECT vec_id, unnest(range(64)) AS k, unnest(CAST(embedding AS DOUBLE[])) AS v FROM embeddings)",
)
def tensor_rows_cumsum(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Running sums of every column over the rows, as two-level prefix sums."""
    rows = embeddings(spark, sf_dir).select("vec_id", F.posexplode("x").alias("k", "v"), F.floor(F.col("vec_id") / 256).alias("run"))
    totals = rows.groupBy("k", "run").agg(F.sum("v").alias("t"))
    before = Window.partitionBy("k").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select("k", "run", F.coalesce(F.sum("t").over(before), F.lit(0.0)).alias("before"))
    within = F.sum("v").over(Window.partitionBy("k", "run").orderBy("vec_id"))
    return rows.join(totals, ["k", "run"]).select("vec_id", "k", F.round(F.col("before") + within, 6).alias("running"))


@register(
    "tensor_rows_matmul",
    """WITH e AS (SELECT vec_id AS k, label AS i, unnest(range(0, 64)) AS j, unnest(CAST(embedding AS DOUBLE[])) AS v FROM embeddings)
SELECT CAST(a.j AS BIGINT) AS i, CAST(b.j AS INTEGER) AS j, round(sum(a.v * b.v), 5) AS v FROM e a JOIN e b ON a.k = b.k GROUP BY a.j, b.j""",
)
def tensor_rows_matmul(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table's transpose by the table: 64 by 64 sums over all rows."""
    e = embeddings(spark, sf_dir)
    a = e.select(F.col("vec_id").alias("k"), F.posexplode("x").alias("i", "v")).select(F.col("i").cast("long").alias("i"), "k", "v")
    b = e.select(F.col("vec_id").alias("k"), F.posexplode("x").alias("j", "v"))
    return linalg.matmul_rows(a, b).select("i", "j", F.round("v", 5).alias("v"))


@register(
    "tensor_embedding_lookup",
    """SELECT e.event_id, v.label AS label, round(CAST(v.embedding[1] AS DOUBLE), 6) AS first
FROM events e
JOIN embeddings v ON v.vec_id = e.user_id % (SELECT count(*)
FROM embeddings)""",
)
def tensor_embedding_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """embedding(ids): rows of a table by index, as a join."""
    rows = embeddings(spark, sf_dir)
    ids = table(spark, sf_dir, "events").select("event_id", (F.col("user_id") % rows.count()).alias("vec_id"))
    return ids.join(rows, "vec_id").select("event_id", "label", F.round(at(F.col("x"), 0), 6).alias("first"))


# pixels
_Y = "((19595 * px[3 * (k // 3) + 1] + 38470 * px[3 * (k // 3) + 2] + 7471 * px[3 * (k // 3) + 3] + 32768) >> 16)"
_BLEND = "CAST(trunc(least(greatest(CAST({b} AS FLOAT) + CAST({f} AS FLOAT) * (CAST({v} AS FLOAT) - CAST({b} AS FLOAT)), CAST(0 AS FLOAT)), CAST(255 AS FLOAT))) AS INTEGER)"
_K = "list_transform(range(48), lambda k: {})"
_MEANY = "CAST(floor(list_avg(list_transform(range(0, 48, 3), lambda k: " + _Y + ")) + 0.5) AS BIGINT)"
results(
    "pixel_colour", images, PIXELS_SQL,
    {
        "bright": (lambda x, y, px: pixels.brightness(px, 1.3), _K.format(_BLEND.format(b="0", f="1.3", v="px[k + 1]"))),
        "contrasted": (lambda x, y, px: pixels.contrast(px, 16, 0.6), _K.format(_BLEND.format(b=_MEANY.replace("lambda k", "lambda z").replace("k //", "z //"), f="0.6", v="px[k + 1]"))),
        "saturated": (lambda x, y, px: pixels.saturation(px, 16, 1.7), _K.format(_BLEND.format(b=_Y, f="1.7", v="px[k + 1]"))),
        "corrected": (lambda x, y, px: pixels.gamma(px, 0.8), _K.format("CAST(trunc(least(greatest((256 - 1e-3) * 1.0 * pow(px[k + 1] / 255.0, 0.8), 0.0), 255.0)) AS INTEGER)")),
        "grey": (lambda x, y, px: pixels.grayscale(px, 16, 1),
        "list_transform(range(0, 48, 3), lambda k: " + _Y + ")"),
        "grey3": (lambda x, y, px: pixels.grayscale(px, 16, 3), _K.format(_Y)),
        "inverted": (lambda x, y, px: pixels.invert(px), _K.format("255 - px[k + 1]")),
        "posterized": (lambda x, y, px: pixels.posterize(px, 3), _K.format("px[k + 1] & 224")),
        "solarized": (lambda x, y, px: pixels.solarize(px, 128), _K.format("CASE WHEN px[k + 1] >= 128 THEN 255 - px[k + 1] ELSE px[k + 1] END")),
        "stretched": (lambda x, y, px: pixels.autocontrast(px), _K.format("CASE WHEN hi[k % 3 + 1] = lo[k % 3 + 1] THEN px[k + 1] ELSE (px[k + 1] - lo[k % 3 + 1]) * 255 // (hi[k % 3 + 1] - lo[k % 3 + 1]) END")),
        "equalized": (lambda x, y, px: pixels.equalize(px), "px"),
    },
)
_sql["pixel_colour"] = _sql["pixel_colour"].replace(PIXELS_SQL, f"SELECT *, list_transform([0, 1, 2], lambda c: list_min(list_transform(range(16), lambda p: px[p * 3 + c + 1]))) AS lo, list_transform([0, 1, 2], lambda c: list_max(list_transform(range(16), lambda p: px[p * 3 + c + 1]))) AS hi FROM ({PIXELS_SQL})")
_MEAN, _STD = [0.5, 0.4, 0.3], [0.25, 0.5, 0.2]
import numpy as _np  # noqa: E402

_SC = ", ".join(f"CAST({float(_np.float32(1) / (_np.float32(255) * _np.float32(s)))!r} AS FLOAT)" for s in _STD)
_BI = ", ".join(f"CAST({float(-_np.float32(m) / _np.float32(s))!r} AS FLOAT)" for m, s in zip(_MEAN, _STD, strict=True))
results(
    "pixel_representation", images, PIXELS_SQL,
    {
        "normalized": (lambda x, y, px: pixels.normalize(px, _MEAN, _STD), _K.format(f"CAST(px[k + 1] AS FLOAT) * ([{_SC}])[k % 3 + 1] + ([{_BI}])[k % 3 + 1]")),
        "planes": (lambda x, y, px: pixels.hwc_to_chw(px, 16), _K.format("px[(k % 16) * 3 + k // 16 + 1]")),
        "back": (lambda x, y, px: pixels.chw_to_hwc(pixels.hwc_to_chw(px, 16), 16),
        "px"),
        "swapped": (lambda x, y, px: pixels.permute_channels(px, [2, 0, 1]), _K.format("px[k - k % 3 + ([2, 0, 1])[k % 3 + 1] + 1]")),
        "as_float": (lambda x, y, px: pixels.to_float(px), _K.format("CAST(px[k + 1] AS FLOAT) / CAST(255 AS FLOAT)")),
        "as_uint8": (lambda x, y, px: pixels.to_uint8(pixels.to_float(px)), _K.format("CAST(trunc(CAST(px[k + 1] AS FLOAT) / CAST(255 AS FLOAT) * CAST(255.999 AS FLOAT)) AS BIGINT) % 256")),
    },
)
results(
    "pixel_geometry", images, PIXELS_SQL,
    {
        "cropped": (lambda x, y, px: pixels.crop(px, 4, 4, 2, 1, 3, 3),
        "list_transform(range(27), lambda k: CASE WHEN k // 9 + 1 < 4 AND (k // 3) % 3 + 2 < 4 THEN px[((k // 9 + 1) * 4 + (k // 3) % 3 + 2) * 3 + k % 3 + 1] ELSE 0 END)"),
        "centred": (lambda x, y, px: pixels.center_crop(px, 4, 4, 2, 2),
        "list_transform(range(12), lambda k: px[((k // 6 + 1) * 4 + (k // 3) % 2 + 1) * 3 + k % 3 + 1])"),
        "mirrored": (lambda x, y, px: pixels.horizontal_flip(px, 4, 4), _K.format("px[((k // 12) * 4 + 3 - (k // 3) % 4) * 3 + k % 3 + 1]")),
        "turned": (lambda x, y, px: pixels.vertical_flip(px, 4, 4), _K.format("px[(3 - k // 12) * 12 + k % 12 + 1]")),
        "padded": (lambda x, y, px: pixels.pad(px, 4, 4, (1, 0, 0, 1),
        "constant", 7),
        "list_transform(range(75), lambda k: CASE WHEN k // 15 < 4 AND (k // 3) % 5 >= 1 THEN px[((k // 15) * 4 + (k // 3) % 5 - 1) * 3 + k % 3 + 1] ELSE 7 END)"),
        "edged": (lambda x, y, px: pixels.pad(px, 4, 4, (1, 1, 1, 1),
        "edge"),
        "list_transform(range(108), lambda k: px[(least(greatest(k // 18 - 1, 0), 3) * 4 + least(greatest((k // 3) % 6 - 1, 0), 3)) * 3 + k % 3 + 1])"),
        "reflected": (lambda x, y, px: pixels.pad(px, 4, 4, (2, 2, 2, 2),
        "reflect"),
        "list_transform(range(192), lambda k: px[(([2, 1, 0, 1, 2, 3, 2, 1])[k // 24 + 1] * 4 + ([2, 1, 0, 1, 2, 3, 2, 1])[(k // 3) % 8 + 1]) * 3 + k % 3 + 1])"),
        "symmetric": (lambda x, y, px: pixels.pad(px, 4, 4, (2, 2, 2, 2),
        "symmetric"),
        "list_transform(range(192), lambda k: px[(([1, 0, 0, 1, 2, 3, 3, 2])[k // 24 + 1] * 4 + ([1, 0, 0, 1, 2, 3, 3, 2])[(k // 3) % 8 + 1]) * 3 + k % 3 + 1])"),
    },
)
_MATRIX = [[((i * 7 + j * 3) % 5 - 2) / 4 for j in range(48)] for i in range(48)]
results("pixel_linear_transform", images, PIXELS_SQL, {"moved": (lambda x, y, px: pixels.linear_transform(F.transform(px, lambda v: v / F.lit(255.0)), _MATRIX, [0.5] * 48), "list_transform(range(48), lambda j: list_sum(list_transform(range(48), lambda i: (px[i + 1] / 255.0 - 0.5) * (((i * 7 + j * 3) % 5 - 2) / 4.0))))")})


@register(
    "pixel_five_crop",
    f"""SELECT vec_id, CAST(view - 1 AS INTEGER) AS view, label, {weighed_sql('list_transform(range(12), lambda k: px[((k // 6 + oy) * 4 + (k // 3) % 2 + ox) * 3 + k % 3 + 1])')} AS pixels
FROM ({PIXELS_SQL}), (SELECT *
FROM (VALUES (1, 0, 0), (2, 2, 0), (3, 0, 2), (4, 2, 2), (5, 1, 1)) t(view, ox, oy))""",
)
def pixel_five_crop(spark: SparkSession, sf_dir: str) -> DataFrame:
    views = images(spark, sf_dir).select("vec_id", "label", F.posexplode(pixels.five_crop(F.col("px"), 4, 4, 2, 2)).alias("view", "crop"))
    return views.select("vec_id", "view", "label", weighed(F.col("crop")).alias("pixels"))


@register(
    "pixel_ten_crop",
    f"""SELECT vec_id, CAST(view - 1 AS INTEGER) AS view, {weighed_sql('list_transform(range(12), lambda k: px[((k // 6 + oy) * 4 + CASE WHEN view > 5 THEN 3 - ((k // 3) % 2 + ox) ELSE (k // 3) % 2 + ox END) * 3 + k % 3 + 1])')} AS pixels
FROM ({PIXELS_SQL}), (SELECT *
FROM (VALUES (1, 0, 0), (2, 2, 0), (3, 0, 2), (4, 2, 2), (5, 1, 1), (6, 0, 0), (7, 2, 0), (8, 0, 2), (9, 2, 2), (10, 1, 1)) t(view, ox, oy))""",
)
def pixel_ten_crop(spark: SparkSession, sf_dir: str) -> DataFrame:
    views = images(spark, sf_dir).select("vec_id", F.posexplode(pixels.ten_crop(F.col("px"), 4, 4, 2, 2)).alias("view", "crop"))
    return views.select("vec_id", "view", weighed(F.col("crop")).alias("pixels"))


# selection and batches


@register(
    "batch_channel_means",
    f"""SELECT CAST(pos // 32 AS BIGINT) AS batch_id, CAST(k % 3 AS INTEGER) AS channel, round(avg(CAST(v AS DOUBLE)), 4) AS average
FROM (SELECT vec_id AS pos, unnest(range(48)) AS k, unnest({_K.format('CAST(' + _BLEND.format(b='0', f='1.2', v='px[k + 1]') + f' AS FLOAT) * ([{_SC}])[k % 3 + 1] + ([{_BI}])[k % 3 + 1]')}) AS v
FROM ({PIXELS_SQL}))
WHERE pos // 32 < (SELECT count(*)
FROM embeddings) // 32
GROUP BY ALL""",
)
def batch_channel_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Source to batches: brightness, normalize, batches without the partial tail, and their channel means."""
    rows = images(spark, sf_dir).withColumnRenamed("vec_id", "pos")
    rows = S.batch(rows, 32, drop_last=True).withColumn("v", pixels.normalize(pixels.brightness(F.col("px"), 1.2), _MEAN, _STD))
    flat = rows.select("batch_id", F.posexplode("v").alias("k", "v"))
    return flat.groupBy("batch_id", (F.col("k") % 3).cast("int").alias("channel")).agg(F.round(F.avg(F.col("v").cast("double")), 4).alias("average"))


@register("select_skip_take", "SELECT doc_id - 7 - 5 AS pos, doc_id FROM documents WHERE doc_id >= 12 AND doc_id < 7 + 120")
def select_skip_take(spark: SparkSession, sf_dir: str) -> DataFrame:
    """skip(7).take(120).skip(5): ranges in their declared order."""
    rows = S.with_pos(table(spark, sf_dir, "documents").select("doc_id"), "doc_id", block=128)
    return S.skip(S.take(S.skip(rows, 7), 120), 5).select("pos", "doc_id")


@register(
    "select_indices",
    """SELECT e.event_id AS pos, o.o_orderkey, o.o_totalprice
FROM events e
JOIN orders o ON o.o_orderkey = (e.event_id * 37) % (SELECT count(*)
FROM orders)""",
)
def select_indices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows by requested index, with order and duplicates kept."""
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("pos"), "o_orderkey", "o_totalprice")
    wanted = table(spark, sf_dir, "events").select(F.col("event_id").alias("req"), ((F.col("event_id") * 37) % orders.count()).alias("pos"))
    return S.indices(orders, wanted).select("pos", "o_orderkey", "o_totalprice")


@register(
    "batch_assign",
    """SELECT o_orderkey, CAST(o_orderkey // 128 AS BIGINT) AS batch_id, CAST(o_orderkey % 128 AS INTEGER) AS batch_pos
FROM orders
WHERE o_orderkey // 128 < (SELECT count(*)
FROM orders) // 128""",
)
def batch_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderkey").alias("pos"))
    return S.batch(rows, 128, drop_last=True).select("o_orderkey", "batch_id", "batch_pos")


@register("select_shuffle")
def select_shuffle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A seeded order of the vectors: Fisher-Yates, or by hash where they are too many for the driver."""
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("pos"), "vec_id")
    return S.shuffle(rows, rows.count(), seed=42, epoch=1)


@register("batch_mixup", "SELECT vec_id, round(lam, 6) AS lam, " + weighed_sql("list_transform(range(64), lambda k: p[k + 1] * (1 - lam) + x[k + 1] * lam)") + " AS pixels, " + weighed_sql("list_transform(range(10), lambda c: CAST(pl = c AS DOUBLE) * (1 - lam) + CAST(label = c AS DOUBLE) * lam)") + " AS labels FROM (SELECT *, (vec_id // 16 % 9 + 1) / 10.0 AS lam, coalesce(lag(x) OVER w, last(x) OVER all_w) AS p, coalesce(lag(label) OVER w, last(label) OVER all_w) AS pl FROM (" + EMBEDDINGS_SQL + ") WINDOW w AS (PARTITION BY vec_id // 16 ORDER BY vec_id), all_w AS (PARTITION BY vec_id // 16 ORDER BY vec_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))")
def batch_mixup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each row of a batch mixed with the one before it (the first with the last), pixels and soft labels alike."""
    rows = S.batch(embeddings(spark, sf_dir).withColumn("pos", F.col("vec_id")), 16).withColumn("lam", (F.col("batch_id") % 9 + 1) / F.lit(10.0))
    rows = rows.withColumns({"p": S.previous_in_batch(F.col("x")), "pl": S.previous_in_batch(F.col("label"))})
    soft = pixels.mixed(pixels.soft_labels(F.col("pl"), 10), pixels.soft_labels(F.col("label"), 10), F.col("lam"))
    return rows.select("vec_id", F.round("lam", 6).alias("lam"), weighed(pixels.mixed(F.col("p"), F.col("x"), F.col("lam"))).alias("pixels"), weighed(soft).alias("labels"))


# boxes over line items: quantity, discount and tax make corners on a 40 x 40 canvas
_BOX_SQL = "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity % 30 AS a, l_discount * 200 AS b, l_quantity % 30 + l_tax * 200 + 0.5 AS c, l_discount * 200 + l_quantity AS d FROM lineitem"


def _boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    q, d, t = F.col("l_quantity"), F.col("l_discount"), F.col("l_tax")
    rows = table(spark, sf_dir, "lineitem")
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", F.array(q % 30, d * 200, q % 30 + t * 200 + 0.5, d * 200 + q).alias("box"))


@register(
    "box_convert",
    f"""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, {weighed_sql('[a, b, c - a, d - b]')} AS xywh, {weighed_sql('[a + (c - a) / 2, b + (d - b) / 2, c - a, d - b]')} AS cxcywh, {weighed_sql('[least(greatest(a, 0.0), 40.0), least(greatest(b, 0.0), 40.0), least(greatest(c, 0.0), 40.0), least(greatest(d, 0.0), 40.0)]')} AS clamped, {weighed_sql('[40 - c, b, 40 - a, d]')} AS mirrored
FROM ({_BOX_SQL})""",
)
def box_convert(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = F.col("box")
    back = boxes.convert(boxes.convert(b, "xyxy", "cxcywh"), "cxcywh", "xywh")
    return _boxes(spark, sf_dir).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", weighed(back).alias("xywh"), weighed(boxes.convert(b, "xyxy", "cxcywh")).alias("cxcywh"), weighed(boxes.clamp(b, F.lit(40), F.lit(40))).alias("clamped"), weighed(boxes.horizontal_flip(b, F.lit(40.0))).alias("mirrored"))


@register(
    "box_sanitize",
    f"""SELECT l_orderkey, count(*) AS kept, CAST(sum(l_partkey) AS BIGINT) AS parts
FROM ({_BOX_SQL})
WHERE c - a >= 2 AND d - b >= 2 AND (c - a) * (d - b) >= 20 AND a >= 0 AND b >= 0 AND c <= 40 AND d <= 40
GROUP BY l_orderkey""",
)
def box_sanitize(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Objects of an image as one array; small boxes and those outside go with all their fields."""
    per = _boxes(spark, sf_dir).groupBy("l_orderkey").agg(F.collect_list(F.struct("box", F.col("l_partkey").alias("label"))).alias("o"))
    per = per.withColumn("o", boxes.sanitize(F.col("o"), F.lit(40), F.lit(40), 2.0, 20.0)).where(F.size("o") > 0)
    return per.select("l_orderkey", F.size("o").cast("long").alias("kept"), F.aggregate("o", F.lit(0).cast("long"), lambda s, b: s + b["label"]).alias("parts"))


@register(
    "box_iou",
    f"""WITH b AS ({_BOX_SQL}),
p AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS n
FROM b)
SELECT q.l_orderkey, q.n, round(coalesce(CASE WHEN u > 0 THEN i / u END, 0.0), 6) AS iou
FROM (SELECT s.l_orderkey, s.n, greatest(least(s.c, t.c) - greatest(s.a, t.a), 0.0) * greatest(least(s.d, t.d) - greatest(s.b, t.b), 0.0) AS i, (s.c - s.a) * (s.d - s.b) + (t.c - t.a) * (t.d - t.b) - greatest(least(s.c, t.c) - greatest(s.a, t.a), 0.0) * greatest(least(s.d, t.d) - greatest(s.b, t.b), 0.0) AS u
FROM p s
JOIN p t ON s.l_orderkey = t.l_orderkey AND t.n = s.n - 1) q""",
)
def box_iou(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlap of each box of an image with the one before it."""
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    rows = _boxes(spark, sf_dir).withColumns({"n": F.row_number().over(w).cast("long"), "before": F.lag("box").over(w)}).where(F.col("before").isNotNull())
    return rows.select("l_orderkey", "n", F.round(boxes.iou(F.col("box"), F.col("before")), 6).alias("iou"))


@register("video_temporal_subsample", "WITH f AS (SELECT user_id, list(value ORDER BY ts) AS v FROM events GROUP BY user_id), g AS (SELECT user_id, v, CAST(len(v) - 1 AS FLOAT) AS l FROM f) SELECT user_id, " + weighed_sql("list_transform(range(8), lambda k: v[least(greatest(CAST(trunc(CASE WHEN k < 4 THEN l / CAST(7 AS FLOAT) * CAST(k AS FLOAT) ELSE l - l / CAST(7 AS FLOAT) * CAST(7 - k AS FLOAT) END) AS INTEGER), 0), len(v) - 1) + 1])") + " AS frames FROM g")
def video_temporal_subsample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eight frames of each user's clip, evenly spaced."""
    clips = table(spark, sf_dir, "events").groupBy("user_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("ts", "value"))), lambda s: s["value"]).alias("v"))
    return clips.select("user_id", weighed(S.uniform_temporal_subsample(F.col("v"), 8)).alias("frames"))


# text
_WORDS_SQL = r"list_filter(regexp_split_to_array(lower(text), '\s+'), lambda w: w <> '')"
_IDS_SQL = f"SELECT doc_id, list_transform({_WORDS_SQL}, lambda w: CAST(CAST('0x' || substr(md5(w), 1, 8) AS BIGINT) % 50000 + 100 AS INTEGER)) AS ids FROM documents"


def _ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A word's id is its bucket of a hashed vocabulary of 50,000, after 100 reserved ids."""
    bucket = lambda w: (F.conv(F.substring(F.md5(w), 1, 8), 16, 10).cast("long") % 50_000 + 100).cast("int")
    return table(spark, sf_dir, "documents").select("doc_id", F.transform(tokens.pieces(F.col("text")), bucket).alias("ids"))


@register(
    "text_vocabulary_encode",
    f"""WITH w AS (SELECT doc_id, unnest({_WORDS_SQL}) AS w
FROM documents),
c AS (SELECT w, count(*) AS n
FROM w
GROUP BY w),
v AS (SELECT w, row_number() OVER (ORDER BY n DESC, w) AS id
FROM (SELECT *
FROM c ORDER BY n DESC, w LIMIT 1000))
SELECT w.doc_id, count(*) AS n_tokens, CAST(count(v.id) AS BIGINT) AS n_known, CAST(coalesce(sum(v.id), 0) AS BIGINT) AS id_sum
FROM w
LEFT JOIN v ON v.w = w.w
GROUP BY w.doc_id""",
)
def text_vocabulary_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A word-level vocabulary of the 1,000 commonest words, and every document encoded by it."""
    w = table(spark, sf_dir, "documents").select("doc_id", F.explode(tokens.pieces(F.col("text"))).alias("w"))
    common = w.groupBy("w").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "w").limit(1000)
    vocabulary = common.select("w", F.row_number().over(Window.orderBy(F.desc("n"), "w")).alias("id"))
    # 1,000 rows at most: broadcast
    known = w.join(F.broadcast(vocabulary), "w", "left")
    return known.groupBy("doc_id").agg(F.count("*").alias("n_tokens"), F.count("id").alias("n_known"), F.coalesce(F.sum("id"), F.lit(0)).alias("id_sum"))


@register(
    "text_truncate_pad",
    f"""WITH t AS (SELECT doc_id, ids[1:128] AS ids, ids[greatest(1, len(ids) - 15):len(ids)] AS tail
FROM ({_IDS_SQL})),
b AS (SELECT *, CAST((max(len(ids)) OVER (PARTITION BY doc_id // 16) + 7) // 8 * 8 AS BIGINT) AS width
FROM t)
SELECT doc_id, width, {weighed_sql('list_concat(ids, list_transform(range(width - len(ids)), lambda k: 99))')} AS padded, {weighed_sql('list_concat(list_transform(range(width - len(ids)), lambda k: 99), ids)')} AS left_padded, {weighed_sql('tail')} AS tail, {weighed_sql('list_transform(range(width), lambda k: CASE WHEN k < len(ids) THEN k ELSE 0 END)')} AS places, {weighed_sql('list_concat(ids, list_transform(range(width - len(ids)), lambda k: -100))')} AS labels
FROM b""",
)
def text_truncate_pad(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Truncation to 128, padding to the batch's longest (a multiple of 8), position ids and causal labels."""
    rows = S.batch(_ids(spark, sf_dir).withColumn("pos", F.col("doc_id")), 16)
    rows = rows.withColumns({"tail": tokens.truncate(F.col("ids"), 16, "left"), "ids": tokens.truncate(F.col("ids"), 128)})
    longest = F.max(F.size("ids")).over(Window.partitionBy("batch_id"))
    rows = rows.withColumn("width", (F.ceil(longest / 8) * 8).cast("long"))
    mask = tokens.mask(F.size("ids"), F.col("width").cast("int"))
    padded = tokens.pad(F.col("ids"), F.col("width"), 99, "right", 8)
    return rows.withColumns({"mask": mask, "padded": padded}).select("doc_id", "width", weighed(F.col("padded")).alias("padded"), weighed(tokens.pad(F.col("ids"), F.col("width"), 99, "left", 8)).alias("left_padded"), weighed(F.col("tail")).alias("tail"), weighed(tokens.positions(F.col("mask"))).alias("places"), weighed(tokens.causal_labels(F.col("padded"), F.col("mask"))).alias("labels"))


@register(
    "text_pack",
    f"""WITH d AS (SELECT doc_id, list_concat(ids, [0]) AS ids
FROM ({_IDS_SQL})),
o AS (SELECT ids, sum(len(ids)) OVER (ORDER BY doc_id) - len(ids) AS start
FROM d),
t AS (SELECT start + unnest(range(len(ids))) AS p, unnest(ids) AS id
FROM o)
SELECT CAST(p // 512 AS BIGINT) AS block, count(*) AS n, round(sum(CAST(id AS DOUBLE) * (p % 512 + 1)), 6) AS ids
FROM t
GROUP BY p // 512
HAVING count(*) = 512""",
)
def text_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents packed into blocks of 512 ids with a separator after each; the short tail goes."""
    blocks = S.packed(_ids(spark, sf_dir).withColumnRenamed("doc_id", "pos"), 512, 0)
    return blocks.select("block", F.size("ids").cast("long").alias("n"), weighed(F.col("ids")).alias("ids"))


@register("text_pairs", r"SELECT a.conv_id, a.turn, CAST(len(" + _WORDS_SQL.replace("text", "a.text") + r") AS BIGINT) AS n_first, CAST(len(" + _WORDS_SQL.replace("text", "b.text") + r") AS BIGINT) AS n_second FROM conversations a JOIN conversations b ON b.conv_id = a.conv_id AND b.turn = a.turn + 1")
def text_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each turn with the next one, as a text pair."""
    t = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.size(tokens.pieces(F.col("text"))).cast("long").alias("n_first"))
    after = t.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("n_first").alias("n_second"))
    return t.join(after, ["conv_id", "turn"])


def _raw_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """4 x 4 x 4 uint8 rows for pipelines."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "label", pixels.from_unit(F.col("embedding")).alias("q"))
    image = F.to_binary(F.array_join(F.transform("q", lambda v: F.lpad(F.hex(v), 2, "0")), ""), F.lit("hex"))
    return rows.select(F.col("vec_id").alias("pos"), image.alias("image"), F.col("label").cast("long").alias("label"), F.lit(4).alias("h"), F.lit(4).alias("w"), F.lit(4).alias("c"))


def _dealt(rows: DataFrame, key: str, each: int) -> DataFrame:
    """Rows dealt evenly to tasks of about ``each`` of them, so there are more tasks with more rows; 16 at least."""
    return rows.repartition(max(16, -(-rows.count() // each)), key)


@register(
    "pipeline_flip_posterize",
    f"""SELECT CAST(vec_id - 10 AS BIGINT) AS pos, CAST((vec_id - 10) // 32 AS BIGINT) AS batch_id, label, {number_sql('list_sum(' + _K.format('(px[((k // 12) * 4 + 3 - (k // 3) % 4) * 3 + k % 3 + 1] & 240) * (k + 1)') + ')')} AS pixels
FROM (SELECT vec_id, CAST(label AS BIGINT) AS label, px
FROM ({PIXELS_SQL}))
WHERE vec_id >= 10 AND (vec_id - 10) // 32 < ((SELECT count(*)
FROM embeddings) - 10) // 32""",
)
def pipeline_flip_posterize(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A whole pipeline in one Arrow stage: skip, rgb, flip, posterize, batches without the tail."""
    from .pipeline import Pipeline

    out = Pipeline(_raw_images(spark, sf_dir)).decode_image().skip(10).rgb().horizontal_flip().posterize(4).batch(32, drop_last=True).execute()
    told = F.aggregate(F.sequence(F.lit(1), F.octet_length("data")), F.lit(0).cast("long"), lambda s, k: s + F.conv(F.substr(F.hex("data"), 2 * k - 1, F.lit(2)), 16, 10).cast("long") * k)
    return out.select("pos", "batch_id", "label", number(told).alias("pixels"))


@register("pipeline_augment")
def pipeline_augment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A training pipeline: seeded shuffle, random crop and flip, jitter, erasing, normalize, CHW, batches."""
    from .pipeline import Pipeline, Transform

    p = Pipeline(_raw_images(spark, sf_dir)).seed(42).epoch(3).shuffle().decode_image().rgb().resize(12, 12).random_crop(8, padding=2)
    p = p.random_horizontal_flip().color_jitter(0.4, 0.4, 0.1, 0.4).random_apply(0.5, Transform().gaussian_blur(0.8, 3)).random_erasing().normalize((0.5, 0.4, 0.3), (0.25, 0.5, 0.2)).hwc_to_chw()
    return p.batch(64).execute().select("pos", "source", "batch_id", "batch_pos", "h", "w", "c", "dtype", F.md5("data").alias("digest"), "label")


@register("pipeline_cifar")
def pipeline_cifar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """32 x 32 RGB images, one for each event: random crop with padding, flip, normalize, CHW, batches of 128."""
    from .pipeline import Pipeline

    # the hash's digits, over and over, are the pixels
    digits = F.sha2(F.concat_ws(":", "event_id", "props"), 512)
    rows = table(spark, sf_dir, "events").select(
        F.col("event_id").alias("pos"), F.to_binary(F.substring(F.repeat(digits, 24), 1, 3072), F.lit("utf-8")).alias("image"), (F.col("user_id") % 10).alias("label"), *[F.lit(n).alias(k) for k, n in (("h", 32), ("w", 32), ("c", 3))]
    )
    p = Pipeline(rows).seed(42).decode_image().random_crop(32, padding=4).random_horizontal_flip().normalize((0.5, 0.4, 0.3), (0.25, 0.5, 0.2)).hwc_to_chw()
    return p.batch(128).execute().select("pos", "batch_id", "batch_pos", "label", "dtype", F.crc32("data").alias("checksum"))


@register("pipeline_cifar_png")
def pipeline_cifar_png(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same images and steps from PNG files: each is encoded in one stage and decoded at the start of the other."""
    from ..sources.images import encoded_png
    from .pipeline import Pipeline

    digits = F.sha2(F.concat_ws(":", "event_id", "props"), 512)
    # a file of a few row groups would be the work of a few tasks
    events = _dealt(table(spark, sf_dir, "events").select("event_id", "props", "user_id"), "event_id", 16_384)
    rows = events.select(
        F.col("event_id").alias("pos"), F.to_binary(F.substring(F.repeat(digits, 24), 1, 3072), F.lit("utf-8")).alias("image"), (F.col("user_id") % 10).alias("label"), *[F.lit(n).alias(k) for k, n in (("h", 32), ("w", 32), ("c", 3))]
    )
    p = Pipeline(encoded_png(rows)).seed(42).decode_image().random_crop(32, padding=4).random_horizontal_flip()
    return p.normalize((0.5, 0.4, 0.3), (0.25, 0.5, 0.2)).hwc_to_chw().batch(128).execute().select("pos", "batch_id", "batch_pos", "label", "dtype", F.crc32("data").alias("checksum"))


@register("pipeline_imagenet")
def pipeline_imagenet(spark: SparkSession, sf_dir: str) -> DataFrame:
    """256 x 256 PNG files, one for each vector, each of whose 64 values is a band of pixels: random resized crop to 224, flip,
    jitter, normalize, CHW, batches of 64."""
    from ..sources.images import encoded_png
    from .pipeline import Pipeline

    # what the images are made of is dealt out, not the images
    vectors = _dealt(table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label"), "vec_id", 512)
    band = F.transform("embedding", lambda x: F.repeat(F.substring(F.md5(x.cast("string")), 1, 24), 128))
    rows = vectors.select(
        F.col("vec_id").alias("pos"), F.to_binary(F.array_join(band, ""), F.lit("utf-8")).alias("image"), F.col("label").cast("long").alias("label"), *[F.lit(n).alias(k) for k, n in (("h", 256), ("w", 256), ("c", 3))]
    )
    p = Pipeline(encoded_png(rows)).seed(42).decode_image().random_resized_crop(224).random_horizontal_flip()
    p = p.color_jitter(0.4, 0.4, 0.1, 0.4).normalize((0.485, 0.456, 0.406), (0.229, 0.224, 0.225)).hwc_to_chw().batch(64)
    return p.execute().select("pos", "batch_id", "batch_pos", "label", "dtype", F.crc32("data").alias("checksum"))


@register("pipeline_jpeg")
def pipeline_jpeg(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a JPEG file of a drawn quality keeps of 32 x 32 images, one for each vector: mean and extremes of each."""
    from .pipeline import Pipeline

    digits = F.array_join(F.transform("embedding", lambda x: F.repeat(F.md5(x.cast("string")), 2)), "")
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("pos"), F.to_binary(F.substring(digits, 1, 3072), F.lit("utf-8")).alias("image"), F.col("label").cast("long").alias("label"), *[F.lit(n).alias(k) for k, n in (("h", 32), ("w", 32), ("c", 3))])
    return Pipeline(rows).seed(7).decode_image().jpeg((10, 95)).execute().select("pos", "h", "w", "c", F.crc32("data").alias("checksum"))


def queries() -> dict[str, Query]:
    from . import algebra_queries, draw_queries, text_queries  # noqa: F401  they register theirs

    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    queries()
    return dict(_sql)
