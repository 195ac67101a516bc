"""Tensors of an element type of their own: columns of struct(dtype, shape, data), where data are the elements' bytes by rows.

Types are uint8, uint32, int16, int32, int64, bfloat16, float16, float32 and float64. Integers wrap; their division truncates and
refuses 0. Floats round to the nearest even after every step, sums too: a sum adds one element after another in its own
type, so it is the same whatever the batch. A conversion to integers truncates and stops at the type's ends, NaN becomes 0; from
integers to integers it wraps. Work runs in Arrow stages by row, vectorised over a row's elements."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

KIND = "dtype string, shape array<int>, data binary"
INTEGERS = ("uint8", "uint32", "int16", "int32", "int64")
FLOATS = ("bfloat16", "float16", "float32", "float64")


def _known(dtype: str) -> str:
    if dtype not in INTEGERS + FLOATS:
        raise ValueError(f"element type {dtype} is not one of {', '.join(INTEGERS + FLOATS)}")
    return dtype


def to_bf16(x: np.ndarray) -> np.ndarray:
    """float32 rounded to the nearest bfloat16, ties to even; NaN stays NaN. The result is float32 again."""
    bits = np.ascontiguousarray(x, np.float32).view(np.uint32)
    up = bits + np.uint32(0x7FFF) + ((bits >> np.uint32(16)) & np.uint32(1))
    return np.where(np.isnan(x), np.uint32(0x7FC00000), up & np.uint32(0xFFFF0000)).view(np.float32)


def unpack(data: bytes, shape: list[int], dtype: str) -> np.ndarray:
    """The elements; bfloat16 as the float32 numbers that they are."""
    if _known(dtype) == "bfloat16":
        x = (np.frombuffer(data, np.uint16).astype(np.uint32) << np.uint32(16)).view(np.float32)
    else:
        x = np.frombuffer(data, dtype)
    if x.size != int(np.prod(shape, dtype=np.int64)):
        raise ValueError(f"{len(data)} bytes do not fill shape {list(shape)} of {dtype}")
    return x.reshape(shape)


def pack(x: np.ndarray, dtype: str) -> tuple[str, list[int], bytes]:
    if dtype == "bfloat16":
        return dtype, list(x.shape), (np.ascontiguousarray(x, np.float32).view(np.uint32) >> np.uint32(16)).astype(np.uint16).tobytes()
    return dtype, list(x.shape), np.ascontiguousarray(x, dtype).tobytes()


def cast(x: np.ndarray, old: str, new: str) -> np.ndarray:
    """Elements of one type as those of another."""
    if old == new:
        return x
    with np.errstate(over="ignore", invalid="ignore"):
        if new in INTEGERS and old in FLOATS:
            ends = np.iinfo(new)
            v = np.trunc(np.nan_to_num(x.astype(np.float64), nan=0.0, posinf=np.inf, neginf=-np.inf))
            inside = (v > float(ends.min)) & (v < float(ends.max))
            return np.where(inside, np.where(inside, v, 0).astype(new), np.where(v > 0, np.array(ends.max, new), np.where(v < 0, np.array(ends.min, new), np.array(0, new)))).astype(new)
        if new == "bfloat16":
            wide = x.astype(np.float64)
            near = wide.astype(np.float32)
            # rounded twice only where nothing is lost: the last bit of the float32 says whether something was cut off
            bits = near.view(np.uint32).copy()
            cut, far = near.astype(np.float64) != wide, np.abs(near.astype(np.float64)) > np.abs(wide)
            bits = np.where(cut & np.isfinite(near), np.where(far, bits - np.uint32(1), bits) | np.uint32(1), bits)
            return to_bf16(bits.view(np.float32))
        return x.astype(new)


def _ran(op: Callable[[np.ndarray, np.ndarray], np.ndarray], dtype: str, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    with np.errstate(all="ignore"):
        out = op(a, b)
    return to_bf16(out) if dtype == "bfloat16" else out.astype(dtype)


def _divided(dtype: str) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
    if dtype in FLOATS:
        return np.divide

    def run(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        if (b == 0).any():
            raise ValueError(f"division by zero in {dtype}")
        q = a // b
        least = (b == -1) if dtype.startswith("int") else np.zeros(np.shape(b), bool)
        q = np.where(least, np.negative(a), q)  # the least number by -1 wraps
        return np.where(~least & ((a % b) != 0) & ((a < 0) != (b < 0)), q + np.array(1, dtype), q)

    return run


BINARY = {"add": lambda _: np.add, "sub": lambda _: np.subtract, "mul": lambda _: np.multiply, "div": _divided, "minimum": lambda _: np.minimum, "maximum": lambda _: np.maximum}


def summed(x: np.ndarray, dtype: str, axis: int) -> np.ndarray:
    """The sum along an axis, one element after another in its own type."""
    shape = x.shape[:axis] + x.shape[axis + 1 :]
    if not x.shape[axis]:
        return np.zeros(shape, np.float32 if dtype == "bfloat16" else dtype)
    if dtype != "bfloat16":
        with np.errstate(over="ignore", invalid="ignore"):
            return np.cumsum(x, axis=axis, dtype=dtype).take(-1, axis)
    out = np.zeros(shape, np.float32)
    for part in np.moveaxis(x, axis, 0):
        out = to_bf16(out + part)
    return out


def _reduced(how: str, x: np.ndarray, dtype: str, axis: int) -> np.ndarray:
    if not -x.ndim <= axis < x.ndim:
        raise ValueError(f"dimension {axis} is not among those of shape {list(x.shape)}")
    axis %= x.ndim
    n = x.shape[axis]
    if not n and how != "sum":
        raise ValueError(f"{how} of no elements along dimension {axis}")
    if how == "sum":
        return summed(x, dtype, axis)
    if how == "mean":
        of = cast(np.array([n]), "int64", dtype)
        if dtype in INTEGERS and not of[0]:
            raise ValueError(f"division by zero in {dtype}")
        return _ran(_divided(dtype), dtype, summed(x, dtype, axis), of[0])
    return x.min(axis) if how == "min" else x.max(axis)


def _each(rows: list) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=["dtype", "shape", "data"])


def _unpacked(t: pd.DataFrame):
    return zip(t["dtype"], (unpack(d, list(s), k) for d, s, k in zip(t["data"], t["shape"], t["dtype"], strict=True)), strict=True)


def tensor(values: Column, shape: tuple[int, ...], dtype: str) -> Column:
    """A tensor of an element type from an array of doubles."""
    _known(dtype)

    @F.pandas_udf(KIND)
    def made(v: pd.Series) -> pd.DataFrame:
        return _each([pack(cast(np.asarray(x, np.float64).reshape(shape), "float64", dtype), dtype) for x in v])

    return made(values)


def to_dtype(t: Column, dtype: str) -> Column:
    _known(dtype)

    @F.pandas_udf(KIND)
    def made(v: pd.DataFrame) -> pd.DataFrame:
        return _each([pack(cast(x, kind, dtype), dtype) for kind, x in _unpacked(v)])

    return made(t)


def values(t: Column) -> Column:
    """The elements as doubles (exact for all types but int64 beyond 2**53)."""

    @F.arrow_udf("array<double>")
    def made(v: pa.Array) -> pa.Array:
        parts = [unpack(d, s, k).astype(np.float64).ravel() for k, s, d in zip(*(v.field(c).to_pylist() for c in ("dtype", "shape", "data")), strict=True)]
        ends = np.cumsum([0, *map(len, parts)])
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([*parts, np.empty(0)])))

    return made(t)


def binary(op: str, a: Column, b: Column) -> Column:
    """add, sub, mul, div, minimum or maximum of two tensors of one type, with broadcasting."""
    if op not in BINARY:
        raise ValueError(f"{op} is not one of {', '.join(BINARY)}")

    @F.pandas_udf(KIND)
    def made(u: pd.DataFrame, v: pd.DataFrame) -> pd.DataFrame:
        out = []
        for (kind, x), (other, y) in zip(_unpacked(u), _unpacked(v), strict=True):
            if kind != other:
                raise ValueError(f"element types {kind} and {other} differ")
            out.append(pack(_ran(BINARY[op](kind), kind, x, y), kind))
        return _each(out)

    return made(a, b)


def reduce(how: str, t: Column, axis: int) -> Column:
    """sum, mean, min or max along a dimension; sums and means stay in the tensor's type."""
    if how not in ("sum", "mean", "min", "max"):
        raise ValueError(f"{how} is not one of sum, mean, min, max")

    @F.pandas_udf(KIND)
    def made(v: pd.DataFrame) -> pd.DataFrame:
        return _each([pack(_reduced(how, x, kind, axis), kind) for kind, x in _unpacked(v)])

    return made(t)
