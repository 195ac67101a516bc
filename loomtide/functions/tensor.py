"""Tensor algebra on flat row-major array<double> columns; a shape is a Python tuple.

Strict like the operations it mirrors: operands of a binary operation have equal lengths (a scalar is broadcast by name
only), reductions of nothing are errors, indices are not negative. Comparisons give 0 and 1. Where the first NaN must
win (min, max, argmin, argmax) it does: Spark orders NaN above all numbers, so these walk the array.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .core import at, built, checked, let, steps

Shape = tuple[int, ...]


def _both(a: Column, b: Column, f) -> Column:
    return checked(F.size(a) == F.size(b), F.zip_with(a, b, f), "tensors must have equal shapes")


def add(a: Column, b: Column) -> Column:
    return _both(a, b, lambda x, y: x + y)


def sub(a: Column, b: Column) -> Column:
    return _both(a, b, lambda x, y: x - y)


def mul(a: Column, b: Column) -> Column:
    return _both(a, b, lambda x, y: x * y)


def ieee_div(x: Column, y: Column) -> Column:
    """Division of doubles: a zero divisor gives an infinity or NaN, not an error."""
    inf = F.lit(float("inf"))
    zero = F.when((x == 0) | F.isnan(x), F.lit(float("nan"))).when(x > 0, inf).otherwise(-inf)
    return F.when(y == 0, zero).otherwise(x / F.when(y == 0, F.lit(1.0)).otherwise(y))


def div(a: Column, b: Column) -> Column:
    return _both(a, b, ieee_div)


def add_scalar(a: Column, s: float) -> Column:
    return F.transform(a, lambda x: x + F.lit(float(s)))


def sub_scalar(a: Column, s: float) -> Column:
    return F.transform(a, lambda x: x - F.lit(float(s)))


def mul_scalar(a: Column, s: float) -> Column:
    return F.transform(a, lambda x: x * F.lit(float(s)))


def div_scalar(a: Column, s: float) -> Column:
    return F.transform(a, lambda x: ieee_div(x, F.lit(float(s))))


def neg(a: Column) -> Column:
    return F.transform(a, lambda x: -x)


def absolute(a: Column) -> Column:
    return F.transform(a, F.abs)


def affine(a: Column, scale: float, bias: float) -> Column:
    return F.transform(a, lambda x: x * F.lit(float(scale)) + F.lit(float(bias)))


def elu(a: Column, alpha: float = 1.0) -> Column:
    return F.transform(a, lambda x: F.when(x > 0, x).otherwise(F.lit(float(alpha)) * F.expm1(x)))


def powf(a: Column, e: float) -> Column:
    return F.transform(a, lambda x: F.pow(x, F.lit(float(e))))


def power(a: Column, b: Column) -> Column:
    return _both(a, b, F.pow)


_COMPARE = {"eq": lambda x, y: x == y, "ne": lambda x, y: x != y, "lt": lambda x, y: x < y, "le": lambda x, y: x <= y, "gt": lambda x, y: x > y, "ge": lambda x, y: x >= y}


def compare(op: str, a: Column, b: Column | float) -> Column:
    """0 / 1 by element; ``b`` is a tensor or a number."""
    f = _COMPARE[op]
    if isinstance(b, int | float):
        return F.transform(a, lambda x: f(x, F.lit(float(b))).cast("int"))
    return _both(a, b, lambda x, y: f(x, y).cast("int"))


def clamp(a: Column, low: float, high: float) -> Column:
    """Maximum with ``low``, then minimum with ``high``; NaN becomes ``low``."""
    return F.transform(a, lambda x: F.least(F.greatest(F.when(F.isnan(x), F.lit(float(low))).otherwise(x), F.lit(float(low))), F.lit(float(high))))


def where(cond: Column, a: Column, b: Column) -> Column:
    return checked((F.size(cond) == F.size(a)) & (F.size(a) == F.size(b)), F.transform(F.arrays_zip(cond.alias("c"), a.alias("a"), b.alias("b")), lambda z: F.when(z["c"] != 0, z["a"]).otherwise(z["b"])), "tensors must have equal shapes")


# broadcast forms: shapes are aligned from the last axis on, and an axis of one is repeated


def broadcast_shape(s: Shape, t: Shape) -> Shape:
    n = max(len(s), len(t))
    one, two = (1,) * (n - len(s)) + tuple(s), (1,) * (n - len(t)) + tuple(t)
    if any(p != q and 1 not in (p, q) for p, q in zip(one, two, strict=True)):
        raise ValueError(f"shapes {s} and {t} do not broadcast")
    return tuple(q if p == 1 else p for p, q in zip(one, two, strict=True))


def broadcast_as(a: Column, shape: Shape, to: Shape) -> Column:
    """``a`` repeated to the shape ``to``; also called expand."""
    if broadcast_shape(shape, to) != tuple(to):
        raise ValueError(f"shape {shape} does not broadcast to {to}")
    own = (1,) * (len(to) - len(shape)) + tuple(shape)
    old, new = strides(own), strides(tuple(to))
    if own == tuple(to):
        return a
    terms = [(new[d], to[d], old[d]) for d in range(len(to)) if own[d] > 1]
    place = lambda k: reduce(lambda x, y: x + y, [((k / step).cast("int") % n) * jump for step, n, jump in terms], F.lit(0))
    return let(a, lambda v: built(size_of(tuple(to)), lambda k: at(v, place(k))))


expand = broadcast_as


def broadcast_left(a: Column, shape: Shape, left: Shape) -> Column:
    """``a`` repeated for new axes before its own."""
    return broadcast_as(a, shape, (*left, *shape))


def _broadcast(f):
    def run(a: Column, s: Shape, b: Column, t: Shape) -> Column:
        to = broadcast_shape(s, t)
        return f(broadcast_as(a, s, to), broadcast_as(b, t, to))

    return run


broadcast_add, broadcast_sub, broadcast_mul, broadcast_div, broadcast_pow = (_broadcast(f) for f in (add, sub, mul, div, power))


# reductions of the whole tensor


def total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def _some(a: Column, value: Column) -> Column:
    return checked(F.size(a) > 0, value, "reduction of an empty tensor")


def mean(a: Column) -> Column:
    return _some(a, total(a) / F.size(a))


def var(a: Column) -> Column:
    """Sample variance, by n - 1; fewer than two elements are an error."""
    return checked(F.size(a) > 1, let(total(a) / F.size(a), lambda m: F.aggregate(a, F.lit(0.0), lambda s, x: s + (x - m) * (x - m))) / (F.size(a) - 1), "variance needs two elements")


def _best(a: Column, better) -> Column:
    """(value, place) of the first best element; the first NaN stays."""
    start = F.struct(at(a, 0).alias("v"), F.lit(0).alias("i"), F.lit(0).alias("k"))

    def step(s: Column, x: Column) -> Column:
        take = ~F.isnan(s["v"]) & (F.isnan(x) | better(x, s["v"]))
        return F.struct(F.when(take, x).otherwise(s["v"]).alias("v"), F.when(take, s["k"]).otherwise(s["i"]).alias("i"), (s["k"] + 1).alias("k"))

    return _some(a, F.aggregate(a, start, step))


def maximum(a: Column) -> Column:
    return _best(a, lambda x, v: x > v)["v"]


def minimum(a: Column) -> Column:
    return _best(a, lambda x, v: x < v)["v"]


def argmax(a: Column) -> Column:
    return _best(a, lambda x, v: x > v)["i"]


def argmin(a: Column) -> Column:
    return _best(a, lambda x, v: x < v)["i"]


def argmax_abs(a: Column) -> Column:
    return argmax(absolute(a))


def log_sum_exp(a: Column) -> Column:
    """Shifted by the maximum; NaN if any, -inf if the maximum is."""
    return let(maximum(a), lambda m: F.when(F.isnan(m) | (m == float("-inf")), m).otherwise(m + F.log(F.aggregate(a, F.lit(0.0), lambda s, x: s + F.exp(x - m)))))


def dot(a: Column, b: Column) -> Column:
    return total(mul(a, b))


def norm(a: Column) -> Column:
    return F.sqrt(total(F.transform(a, lambda x: x * x)))


def norm_l1(a: Column) -> Column:
    return total(absolute(a))


def cumsum(a: Column) -> Column:
    """Running sums."""
    out = F.aggregate(a, F.struct(F.array().cast("array<double>").alias("r"), F.lit(0.0).alias("s")), lambda s, x: F.struct(F.array_append(s["r"], s["s"] + x).alias("r"), (s["s"] + x).alias("s")))
    return out["r"]


# shapes


def size_of(shape: Shape) -> int:
    return math.prod(shape)


def strides(shape: Shape) -> Shape:
    return tuple(math.prod(shape[k + 1 :]) for k in range(len(shape)))


def _axis(shape: Shape, dim: int) -> tuple[int, int, int]:
    """Elements outside, along and inside a dimension."""
    return math.prod(shape[:dim]), shape[dim], math.prod(shape[dim + 1 :])


def reduce_dim(a: Column, shape: Shape, dim: int, f) -> Column:
    """``f`` (a reduction of a flat tensor) along a dimension."""
    outer, n, inner = _axis(shape, dim)
    line = lambda k: built(n, lambda j: at(a, (k / inner).cast("int") * (n * inner) + j * inner + k % inner))
    return F.transform(steps(outer * inner), lambda k: f(line(k)))


def cumsum_dim(a: Column, shape: Shape, dim: int) -> Column:
    outer, n, inner = _axis(shape, dim)
    lines = F.transform(steps(outer * inner), lambda k: cumsum(built(n, lambda j: at(a, (k / inner).cast("int") * (n * inner) + j * inner + k % inner))))
    return let(lines, lambda r: built(outer * n * inner, lambda k: at(at(r, (k / (n * inner)).cast("int") * inner + k % inner), (k / inner).cast("int") % n)))


def permute(a: Column, shape: Shape, order: Shape) -> Column:
    """Axes in a new order."""
    new = tuple(shape[k] for k in order)
    old, now = strides(shape), strides(new)
    place = lambda k: reduce(lambda x, y: x + y, [((k / now[d]).cast("int") % new[d]) * old[order[d]] for d in range(len(new))])
    return let(a, lambda v: built(size_of(shape), lambda k: at(v, place(k))))


def reshape(a: Column, shape: Shape, to: Shape) -> Column:
    """The same elements in another shape; one axis of ``to`` may be -1."""
    known = math.prod(n for n in to if n != -1)
    size = size_of(shape)
    if to.count(-1) > 1 or (size % known if known and -1 in to else size != known):
        raise ValueError(f"shape {shape} does not reshape to {to}")
    return a


def squeezed(shape: Shape, dim: int) -> Shape:
    """The shape without an axis of one; elements stay as they are."""
    if shape[dim] != 1:
        raise ValueError("only an axis of one can be squeezed")
    return (*shape[:dim], *shape[dim + 1 :])


def unsqueezed(shape: Shape, dim: int) -> Shape:
    return (*shape[:dim], 1, *shape[dim:])


def flattened(shape: Shape, start: int = 0, end: int | None = None) -> Shape:
    """The shape with the axes start .. end as one; elements stay as they are."""
    end = len(shape) - 1 if end is None else end
    if not 0 <= start <= end < len(shape):
        raise IndexError("axes are out of range")
    return (*shape[:start], math.prod(shape[start : end + 1]), *shape[end + 1 :])


def get_on_dim(a: Column, shape: Shape, dim: int, i: int) -> Column:
    """The slice at ``i`` of an axis, without that axis."""
    return narrow(a, shape, dim, i, 1)


def get(a: Column, shape: Shape, i: int) -> Column:
    return get_on_dim(a, shape, 0, i)


def log_sum_exp_dim(a: Column, shape: Shape, dim: int) -> Column:
    return reduce_dim(a, shape, dim, log_sum_exp)


def transpose(a: Column, rows: int, cols: int) -> Column:
    return permute(a, (rows, cols), (1, 0))


def narrow(a: Column, shape: Shape, dim: int, start: int, length: int) -> Column:
    if start < 0 or length < 0 or start + length > shape[dim]:
        raise IndexError("narrow is out of range")
    outer, n, inner = _axis(shape, dim)
    return built(outer * length * inner, lambda k: at(a, (k / (length * inner)).cast("int") * (n * inner) + start * inner + k % (length * inner)))


def chunk(a: Column, shape: Shape, dim: int, chunks: int) -> list[Column]:
    """Equal parts along a dimension, the last ones one shorter where it does not divide."""
    n, each = shape[dim], -(-shape[dim] // chunks)
    return [narrow(a, shape, dim, s, min(each, n - s)) for s in range(0, n, each)]


def index_select(a: Column, shape: Shape, dim: int, index: list[int]) -> Column:
    if any(i < 0 or i >= shape[dim] for i in index):
        raise IndexError("index is out of range")
    outer, n, inner = _axis(shape, dim)
    m = len(index)
    idx = F.array(*[F.lit(i) for i in index])
    return built(outer * m * inner, lambda k: at(a, (k / (m * inner)).cast("int") * (n * inner) + at(idx, (k / inner).cast("int") % m) * inner + k % inner))


def flip(a: Column, shape: Shape, dim: int) -> Column:
    return index_select(a, shape, dim, list(range(shape[dim] - 1, -1, -1)))


def roll(a: Column, shape: Shape, dim: int, shift: int) -> Column:
    n = shape[dim]
    return index_select(a, shape, dim, [(j - shift) % n for j in range(n)])


def repeat(a: Column, shape: Shape, dim: int, times: int) -> Column:
    return index_select(a, shape, dim, list(range(shape[dim])) * times)


def unfold(a: Column, length: int, step: int, n: int) -> Column:
    """Windows of a one-dimensional tensor of ``n`` elements, one after another."""
    count = (n - length) // step + 1
    return built(count * length, lambda k: at(a, (k / length).cast("int") * step + k % length))


def pad_with_zeros(a: Column, left: int, right: int) -> Column:
    z = lambda n: F.array_repeat(F.lit(0.0), n)
    return F.concat(z(left), a, z(right))


def pad_with_same(a: Column, left: int, right: int) -> Column:
    return F.concat(F.array_repeat(at(a, 0), left), a, F.array_repeat(F.element_at(a, -1), right))


def gather(a: Column, index: Column) -> Column:
    bad = F.exists(index, lambda i: (i < 0) | (i >= F.size(a)))
    return checked(~bad, F.transform(index, lambda i: F.get(a, i.cast("int"))), "index is out of range")


def scatter_add(a: Column, index: Column, source: Column) -> Column:
    """``a`` with every source element added at its index; repeated indices accumulate."""
    pairs = F.arrays_zip(index.alias("i"), source.alias("s"))
    return F.transform(a, lambda x, k: x + F.aggregate(F.filter(pairs, lambda p: p["i"] == k), F.lit(0.0), lambda t, p: t + p["s"]))


def scatter(a: Column, index: Column, source: Column) -> Column:
    """``a`` with every source element put at its index; the last writer wins."""
    pairs = F.arrays_zip(index.alias("i"), source.alias("s"))
    return F.transform(a, lambda x, k: F.coalesce(F.element_at(F.concat(F.array(F.struct(F.lit(None).cast("int").alias("i"), F.lit(None).cast("double").alias("s"))), F.filter(pairs, lambda p: p["i"] == k)), -1)["s"], x))


def slice_scatter(a: Column, source: Column, start: int) -> Column:
    return F.transform(a, lambda x, k: F.when((k >= start) & (k < start + F.size(source)), F.get(source, k - start)).otherwise(x))


def slice_scatter_dim(a: Column, shape: Shape, dim: int, source: Column, length: int, start: int) -> Column:
    """``a`` with the places start .. start + length of an axis taken from ``source``."""
    if start < 0 or start + length > shape[dim]:
        raise IndexError("slice is out of range")
    outer, n, inner = _axis(shape, dim)
    along = lambda k: (k / inner).cast("int") % n
    inside = lambda k: (along(k) >= start) & (along(k) < start + length)
    new = lambda k: at(source, (k / (n * inner)).cast("int") * (length * inner) + (along(k) - start) * inner + k % inner)
    return F.transform(a, lambda x, k: F.when(inside(k), new(k)).otherwise(x))


def index_add(a: Column, shape: Shape, dim: int, index: list[int], source: Column) -> Column:
    """``a`` with the source's slices added at ``index`` of an axis; repeated indices accumulate in order."""
    if any(i < 0 or i >= shape[dim] for i in index):
        raise IndexError("index is out of range")
    outer, n, inner = _axis(shape, dim)
    m = len(index)
    hits = F.array(*[F.array(*[F.lit(p) for p in range(m) if index[p] == c]).cast("array<int>") for c in range(n)])
    from_ = lambda k, p: at(source, (k / (n * inner)).cast("int") * (m * inner) + p * inner + k % inner)
    return F.transform(a, lambda x, k: F.aggregate(at(hits, (k / inner).cast("int") % n), x, lambda s, p: s + from_(k, p)))


#: Number types and the least and greatest whole number of each.
RANGES = {"u8": (0, 2**8 - 1), "u32": (0, 2**32 - 1), "i16": (-(2**15), 2**15 - 1), "i32": (-(2**31), 2**31 - 1), "i64": (-(2**63), 2**63 - 1)}


def convert(a: Column, dtype: str) -> Column:
    """The values as another type holds them: whole numbers are truncated and stop at their type's ends, NaN is 0; f32 rounds.
    They come back as doubles, the one type of these columns."""
    if dtype == "f64":
        return a
    if dtype == "f32":
        return F.transform(a, lambda x: x.cast("float").cast("double"))
    if dtype not in RANGES:
        raise ValueError(f"unknown dtype {dtype}")
    low, high = (F.lit(float(v)) for v in RANGES[dtype])
    whole = lambda x: F.when(x < 0, F.ceil(x)).otherwise(F.floor(x)).cast("double")
    return F.transform(a, lambda x: F.when(F.isnan(x), F.lit(0.0)).when(x <= low, low).when(x >= high, high).otherwise(whole(x)))


def argsort(*_args) -> Column:
    raise NotImplementedError("argsort is unsupported")


def cat(parts: list[Column], shapes: list[Shape], dim: int) -> Column:
    """Tensors one after another along a dimension."""
    outer = math.prod(shapes[0][:dim])
    runs = [math.prod(s[dim:]) for s in shapes]
    return F.flatten(F.transform(steps(outer), lambda o: F.flatten(F.array(*[F.slice(p, o * r + 1, r) for p, r in zip(parts, runs, strict=True)]))))


def stack(parts: list[Column], shape: Shape, dim: int) -> Column:
    one = (*shape[:dim], 1, *shape[dim:])
    return cat(parts, [one] * len(parts), dim)


def zeros(n: int) -> Column:
    return F.array_repeat(F.lit(0.0), n)


def ones(n: int) -> Column:
    return F.array_repeat(F.lit(1.0), n)


def full(n: int, value: float) -> Column:
    return F.array_repeat(F.lit(float(value)), n)


def arange(start: float, end: float, step: float = 1.0) -> Column:
    """Half open."""
    if step == 0:
        raise ValueError("step must not be zero")
    return built(max(0, math.ceil((end - start) / step)), lambda k: F.lit(float(start)) + k * F.lit(float(step)))
