"""Dense linear algebra on flat row-major array<double> columns, as native expressions.

A zero coefficient ignores its operand's values, NaN included. Operands are bound once (``let``), so an expression as an
operand is not computed anew for each element that reads it. Factor-sized problems (a matrix in a row) stay in one
expression; matrices over many rows multiply as a join on the inner index (``matmul_rows``)."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .core import at, built, checked, let
from .tensor import Shape, broadcast_as, broadcast_shape, permute


def _up_to(n: int) -> Column:
    return F.sequence(F.lit(0), F.lit(n - 1))


def _dot(x: Column, y: Column) -> Column:
    return F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)


def _product(a: Column, b: Column, m: int, k: int, n: int, at_a: Column | int = 0, at_b: Column | int = 0) -> Column:
    """(m, k) by (k, n) of bound operands, from the places ``at_a`` and ``at_b`` on: rows and columns are cut out once, and
    every element is one dot product of two of them."""
    rows = F.transform(_up_to(m), lambda i: F.slice(a, at_a + i * k + 1, k))
    cols = F.transform(_up_to(n), lambda j: F.transform(_up_to(k), lambda t: at(b, at_b + t * n + j)))
    return let(cols, lambda c: F.flatten(F.transform(rows, lambda x: F.transform(c, lambda y: _dot(x, y)))))


def matmul(a: Column, b: Column, m: int, k: int, n: int) -> Column:
    """(m, k) by (k, n)."""
    return let(a, lambda x: let(b, lambda y: _product(x, y, m, k, n)))


def mv(a: Column, x: Column, m: int, k: int) -> Column:
    return matmul(a, x, m, k, 1)


def batch_matmul(a: Column, b: Column, batch: int, m: int, k: int, n: int) -> Column:
    return let(a, lambda x: let(b, lambda y: F.flatten(F.transform(_up_to(batch), lambda q: _product(x, y, m, k, n, q * (m * k), q * (k * n))))))


def broadcast_matmul(a: Column, s: Shape, b: Column, t: Shape) -> Column:
    """(..., m, k) by (..., k, n): the axes before the last two are broadcast."""
    if len(s) < 2 or len(t) < 2 or s[-1] != t[-2]:
        raise ValueError(f"shapes {s} and {t} do not multiply")
    batch = broadcast_shape(s[:-2], t[:-2])
    return batch_matmul(broadcast_as(a, s, (*batch, *s[-2:])), broadcast_as(b, t, (*batch, *t[-2:])), math.prod(batch), s[-2], s[-1], t[-1])


def batch_mv(a: Column, x: Column, batch: int, m: int, k: int) -> Column:
    return batch_matmul(a, x, batch, m, k, 1)


def baddbmm(c: Column, a: Column, b: Column, batch: int, m: int, k: int, n: int, beta: float = 1.0, alpha: float = 1.0) -> Column:
    """beta * c + alpha * a b for each batch."""
    made = batch_matmul(a, b, batch, m, k, n) if alpha else F.array_repeat(F.lit(0.0), batch * m * n)
    return F.zip_with(scaled(c, beta), scaled(made, alpha), lambda x, y: x + y)


def batch_addmv(c: Column, a: Column, x: Column, batch: int, m: int, k: int, beta: float = 1.0, alpha: float = 1.0) -> Column:
    return baddbmm(c, a, x, batch, m, k, 1, beta, alpha)


def addbmm(c: Column, a: Column, b: Column, batch: int, m: int, k: int, n: int, beta: float = 1.0, alpha: float = 1.0) -> Column:
    """beta * c + alpha * the sum of all batches' products."""
    if not alpha:
        return scaled(c, beta)
    total = lambda v: built(m * n, lambda q: F.aggregate(_up_to(batch), F.lit(0.0), lambda s, z: s + at(v, z * (m * n) + q)))
    return F.zip_with(scaled(c, beta), scaled(let(batch_matmul(a, b, batch, m, k, n), total), alpha), lambda x, y: x + y)


def outer(x: Column, y: Column) -> Column:
    return F.flatten(F.transform(x, lambda p: F.transform(y, lambda q: p * q)))


def scaled(a: Column, coefficient: float) -> Column:
    c = float(coefficient)
    return F.transform(a, lambda x: x * F.lit(c)) if c else F.transform(a, lambda x: F.lit(0.0))


def addmm(c: Column, a: Column, b: Column, m: int, k: int, n: int, beta: float = 1.0, alpha: float = 1.0) -> Column:
    """beta * c + alpha * a b."""
    return F.zip_with(scaled(c, beta), scaled(matmul(a, b, m, k, n), alpha) if alpha else F.array_repeat(F.lit(0.0), m * n), lambda x, y: x + y)


def addmv(c: Column, a: Column, x: Column, m: int, k: int, beta: float = 1.0, alpha: float = 1.0) -> Column:
    return addmm(c, a, x, m, k, 1, beta, alpha)


def addr(c: Column, x: Column, y: Column, beta: float = 1.0, alpha: float = 1.0) -> Column:
    return F.zip_with(scaled(c, beta), scaled(outer(x, y), alpha), lambda p, q: p + q)


def gram(a: Column, m: int, k: int) -> Column:
    """a aT."""
    rows = lambda x: F.transform(_up_to(m), lambda i: F.slice(x, i * k + 1, k))
    return let(let(a, rows), lambda r: F.flatten(F.transform(r, lambda x: F.transform(r, lambda y: _dot(x, y)))))


def matrix_copy(a: Column, rows: int, cols: int, transpose: bool = False, alpha: float = 1.0) -> Column:
    """A copy, transposed or scaled; a zero coefficient clears it without reading values."""
    return scaled(permute(a, (rows, cols), (1, 0)) if transpose else a, alpha)


def copy_from(a: Column, b: Column) -> Column:
    """``a`` overwritten by ``b`` of the same size."""
    return checked(F.size(a) == F.size(b), b, "tensors must have equal shapes")


def swap(a: Column, b: Column) -> tuple[Column, Column]:
    return copy_from(a, b), copy_from(b, a)


def _row_col(n: int):
    return (lambda q: (q / n).cast("int")), (lambda q: q % n)


def mirrored(a: Column, n: int, lower: bool = True) -> Column:
    """The symmetric matrix of which ``a`` holds one triangle; the other is not read."""
    i, j = _row_col(n)
    return let(a, lambda x: built(n * n, lambda q: F.when((j(q) <= i(q)) if lower else (j(q) >= i(q)), at(x, q)).otherwise(at(x, j(q) * n + i(q)))))


def triangle(a: Column, n: int, lower: bool = True, unit: bool = False) -> Column:
    """The triangle of ``a`` with zeros beside it; the other is not read, nor a unit diagonal."""
    i, j = _row_col(n)
    return F.transform(a, lambda x, q: F.when(i(q) == j(q), F.lit(1.0) if unit else x).when((j(q) < i(q)) if lower else (j(q) > i(q)), x).otherwise(F.lit(0.0)))


def symmetric_matmul(a: Column, b: Column, n: int, cols: int, lower: bool = True, side: str = "left") -> Column:
    """a b (or b a of an ``b`` with ``cols`` rows) where only one triangle of ``a`` is read."""
    if side == "left":
        return matmul(mirrored(a, n, lower), b, n, n, cols)
    return matmul(b, mirrored(a, n, lower), cols, n, n)


def triangular_matmul(a: Column, b: Column, n: int, cols: int, lower: bool = True, unit: bool = False, transpose: bool = False, side: str = "left") -> Column:
    """op(a) b, or b op(a); the triangle is that of ``a`` before it is transposed."""
    t = triangle(a, n, lower, unit)
    t = permute(t, (n, n), (1, 0)) if transpose else t
    return matmul(t, b, n, n, cols) if side == "left" else matmul(b, t, cols, n, n)


def triangular_mv(a: Column, x: Column, n: int, lower: bool = True, unit: bool = False) -> Column:
    return triangular_matmul(a, x, n, 1, lower, unit)


def _solved(a: Column, b: Column, n: int, lower: bool, unit: bool, at_a: Column | int, at_b: Column | int, step_b: int, message: Column) -> Column:
    """x of a x = b, from bound operands: ``a`` from at_a on, the right side at at_b, at_b + step_b, ..."""
    order = _up_to(n) if lower else F.sequence(F.lit(n - 1), F.lit(0), F.lit(-1))

    def step(x: Column, i: Column) -> Column:
        known = F.aggregate(_up_to(n), F.lit(0.0), lambda s, j: s + F.when((j < i) if lower else (j > i), at(a, at_a + i * n + j) * at(x, j)).otherwise(F.lit(0.0)))
        pivot = F.lit(1.0) if unit else at(a, at_a + i * n + i)
        value = F.when(pivot != 0, (at(b, at_b + i * step_b) - known) / pivot).otherwise(F.raise_error(F.concat(message, i.cast("string"))))
        return F.transform(x, lambda v, k: F.when(k == i, value).otherwise(v))

    return F.aggregate(order, F.array_repeat(F.lit(0.0), n), step)


def triangular_solve(a: Column, b: Column, n: int, lower: bool = True, unit: bool = False, cols: int = 1, transpose: bool = False, side: str = "left") -> Column:
    """X of op(a) X = b, or of X op(a) = b, by substitution; a zero on the diagonal is an error that names its row. ``b`` has
    ``cols`` columns on the left side, ``cols`` rows on the right one. The triangle is that of ``a`` before it is transposed."""
    if side == "right":  # X op(a) = b is op(a)T XT = bT
        turned = triangular_solve(a, permute(b, (cols, n), (1, 0)), n, lower, unit, cols, not transpose)
        return permute(turned, (n, cols), (1, 0))
    if transpose:
        return triangular_solve(permute(a, (n, n), (1, 0)), b, n, not lower, unit, cols)
    said = F.lit("singular matrix at diagonal ")
    if cols == 1:
        return let(a, lambda x: let(b, lambda y: _solved(x, y, n, lower, unit, 0, 0, 1, said)))
    columns = lambda x, y: F.transform(_up_to(cols), lambda c: _solved(x, y, n, lower, unit, 0, c, cols, said))
    return let(a, lambda x: let(b, lambda y: permute(F.flatten(columns(x, y)), (cols, n), (1, 0))))


def batch_triangular_solve(a: Column, b: Column, batch: int, n: int, lower: bool = True, unit: bool = False) -> Column:
    """The solution of each batch's vector; a zero on a diagonal is an error that names the batch and the row."""
    said = lambda q: F.concat(F.lit("singular matrix in batch "), q.cast("string"), F.lit(" at diagonal "))
    return let(a, lambda x: let(b, lambda y: F.flatten(F.transform(_up_to(batch), lambda q: _solved(x, y, n, lower, unit, q * (n * n), q * n, 1, said(q))))))


def axpy(alpha: float, x: Column, y: Column) -> Column:
    return F.zip_with(scaled(x, alpha), y, lambda p, q: p + q)


def axpby(alpha: float, x: Column, beta: float, y: Column) -> Column:
    return F.zip_with(scaled(x, alpha), scaled(y, beta), lambda p, q: p + q)


def rotate(x: Column, y: Column, c: Column, s: Column) -> tuple[Column, Column]:
    return F.zip_with(x, y, lambda p, q: c * p + s * q), F.zip_with(x, y, lambda p, q: c * q - s * p)


def rank1_update(a: Column, x: Column, n: int, alpha: float = 1.0, beta: float = 1.0, lower: bool | None = None) -> Column:
    """beta * a + alpha * x xT; with ``lower`` given only that triangle of ``a`` is read, and the result is symmetric."""
    return F.zip_with(scaled(_seed(a, n, lower), beta), scaled(let(x, lambda v: outer(v, v)), alpha), lambda p, q: p + q)


def rank2_update(a: Column, x: Column, y: Column, n: int, alpha: float = 1.0, beta: float = 1.0, lower: bool | None = None) -> Column:
    """beta * a + alpha * (x yT + y xT)."""
    both = let(x, lambda v: let(y, lambda w: F.zip_with(outer(v, w), outer(w, v), lambda p, q: p + q)))
    return F.zip_with(scaled(_seed(a, n, lower), beta), scaled(both, alpha), lambda p, q: p + q)


def _seed(a: Column, n: int, lower: bool | None) -> Column:
    return a if lower is None else mirrored(a, n, lower)


def gram_update(c: Column, a: Column, n: int, k: int, transpose: bool = False, alpha: float = 1.0, beta: float = 1.0, lower: bool = True) -> Column:
    """beta * c + alpha * a aT of an (n, k) matrix, or alpha * aT a of a (k, n) one."""
    made = gram(permute(a, (k, n), (1, 0)) if transpose else a, n, k)
    return F.zip_with(scaled(mirrored(c, n, lower), beta), scaled(made, alpha), lambda p, q: p + q)


def rank2k_update(c: Column, a: Column, b: Column, n: int, k: int, transpose: bool = False, alpha: float = 1.0, beta: float = 1.0, lower: bool = True) -> Column:
    """beta * c + alpha * (a bT + b aT) of (n, k) matrices, or alpha * (aT b + bT a) of (k, n) ones."""
    turn = (lambda v: permute(v, (k, n), (1, 0))) if transpose else (lambda v: v)
    pair = lambda x, y, q: F.aggregate(_up_to(k), F.lit(0.0), lambda s, t: s + at(x, (q / n).cast("int") * k + t) * at(y, (q % n) * k + t))
    made = let(turn(a), lambda x: let(turn(b), lambda y: built(n * n, lambda q: pair(x, y, q) + pair(y, x, q))))
    return F.zip_with(scaled(mirrored(c, n, lower), beta), scaled(made, alpha), lambda p, q: p + q)


def givens(a: Column, b: Column) -> Column:
    """struct(c, s, r) that turns (a, b) to (r, 0); null where a or b is not finite."""
    fine = ~F.isnan(a) & ~F.isnan(b) & (F.abs(a) < float("inf")) & (F.abs(b) < float("inf"))
    r = F.hypot(a, b)
    return F.when(fine, F.when(r == 0, F.struct(F.lit(1.0).alias("c"), F.lit(0.0).alias("s"), F.lit(0.0).alias("r"))).otherwise(F.struct((a / r).alias("c"), (b / r).alias("s"), r.alias("r"))))


def matmul_rows(a: DataFrame, b: DataFrame) -> DataFrame:
    """(i, j, v): product of two matrices in long form (i, k, v) and (k, j, v); sums are combined before the shuffle."""
    pairs = a.select("i", "k", F.col("v").alias("x")).join(b.select("k", "j", F.col("v").alias("y")), "k")
    return pairs.groupBy("i", "j").agg(F.sum(F.col("x") * F.col("y")).alias("v"))
