"""Tensors of nine element types against plain rules."""

import struct
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomtide.functions import typed

RNG = np.random.default_rng(31)


def nearest(x, digits, least):
    """The nearest binary number of so many digits (ties to even) whose last place is at least 2**least."""
    if x == 0:
        return 0.0
    f = Fraction(x)
    e = abs(f).numerator.bit_length() - abs(f).denominator.bit_length()
    e = e if abs(f) >= Fraction(2) ** e else e - 1
    unit = Fraction(2) ** max(e - digits + 1, least)
    return float(round(f / unit) * unit)  # round is to even


def rows(spark, *arrays):
    return spark.createDataFrame([tuple([float(v) for v in a] for a in arrays)], ", ".join(f"{c} array<double>" for c in "abc"[: len(arrays)]))


def test_rounding_to_short_floats(spark):
    x = np.concatenate([RNG.normal(size=300) * 10.0 ** RNG.integers(-6, 4, 300), [0.0, 1.0, 1 + 2.0**-8, 1 + 2.0**-7 + 2.0**-8, 1 + 2.0**-8 + 2.0**-40, 257.0, 65519.0, 3e-8, 2.0**-24]])
    df = rows(spark, x)
    got = {k: df.select(typed.values(typed.tensor(F.col("a"), (len(x),), k)).alias("v")).first()["v"] for k in ("bfloat16", "float16", "float32", "float64")}
    assert got["bfloat16"] == [nearest(v, 8, -133) for v in x] and got["float16"] == [nearest(v, 11, -24) for v in x]
    assert got["float32"] == x.astype(np.float32).astype(float).tolist() and got["float64"] == x.tolist()
    odd = rows(spark, [float("nan"), float("inf"), -float("inf"), 1e39, 70000.0])
    bf, half = (odd.select(typed.values(typed.tensor(F.col("a"), (5,), k)).alias("v")).first()["v"] for k in ("bfloat16", "float16"))
    assert str(bf[:4]) == "[nan, inf, -inf, inf]" and str(half) == "[nan, inf, -inf, inf, inf]"


@pytest.mark.parametrize("kind", typed.INTEGERS)
def test_integers_stop_at_their_ends_and_wrap_in_sums(spark, kind):
    ends = np.iinfo(kind)
    df = rows(spark, [1.9, -1.9, float("nan"), float("inf"), -float("inf"), 1e30, -1e30, 3.0])
    t = typed.tensor(F.col("a"), (8,), kind)
    got = df.select(t.alias("t")).first()["t"]
    low = ends.min
    assert np.frombuffer(got["data"], kind).tolist() == [1, -1 if low else 0, 0, ends.max, low, ends.max, low, 3]
    x = RNG.integers(ends.min, ends.max, 40, dtype=kind, endpoint=True)
    wide = spark.createDataFrame([((kind, [5, 8], bytearray(x.tobytes())),)], f"t struct<{typed.KIND.replace(' ', ':').replace(',:', ',')}>")
    size = 1 << (8 * np.dtype(kind).itemsize)
    wrap = lambda v: (v - low) % size + low
    out = wide.select(typed.reduce("sum", F.col("t"), 0).alias("s"), typed.reduce("max", F.col("t"), -1).alias("m"), typed.binary("mul", F.col("t"), F.col("t")).alias("q"), typed.to_dtype(F.col("t"), "uint8").alias("u")).first()
    grid = x.reshape(5, 8).tolist()
    assert np.frombuffer(out["s"]["data"], kind).tolist() == [wrap(sum(r[k] for r in grid)) for k in range(8)] and out["s"]["shape"] == [8]
    assert np.frombuffer(out["m"]["data"], kind).tolist() == [max(r) for r in grid]
    assert np.frombuffer(out["q"]["data"], kind).tolist() == [wrap(v * v) for r in grid for v in r]
    assert np.frombuffer(out["u"]["data"], np.uint8).tolist() == [v % 256 for r in grid for v in r]


def test_sums_round_after_each_step(spark):
    x = RNG.normal(size=60) * 100
    for kind, digits, least in (("bfloat16", 8, -133), ("float16", 11, -24)):
        short = [nearest(v, digits, least) for v in x]
        want = []
        for k in range(3):
            s = 0.0
            for v in short[k::3]:
                s = nearest(float(np.float32(s) + np.float32(v)), digits, least)
            want.append(s)
        t = typed.tensor(F.col("a"), (20, 3), kind)
        out = rows(spark, x).select(typed.values(typed.reduce("sum", t, 0)).alias("s"), typed.values(typed.reduce("mean", t, 0)).alias("m")).first()
        assert out["s"] == want and out["m"] == [nearest(float(np.float32(v) / np.float32(20)), digits, least) for v in want]


def test_small_cases(spark):
    one = lambda v, shape, kind: typed.tensor(F.col("a"), shape, kind)
    show = lambda df, c: df.select(typed.values(c).alias("v")).first()["v"]
    assert show(rows(spark, [1, 2, 4]), typed.reduce("mean", one(0, (3,), "uint8"), 0)) == [2.0]
    assert show(rows(spark, [200, 100]), typed.reduce("sum", one(0, (2,), "uint8"), 0)) == [44.0]
    assert show(rows(spark, []), typed.reduce("sum", one(0, (2, 0), "float32"), 1)) == [0.0, 0.0]
    df = rows(spark, [-7, 7, -32768], [2, -2, -1])
    a, b = (typed.tensor(F.col(c), (3,), "int16") for c in "ab")
    assert show(df, typed.binary("div", a, b)) == [-3.0, -3.0, -32768.0]
    assert show(df, typed.binary("minimum", a, b)) == [-7.0, -2.0, -32768.0]
    for bad, said in (
        (typed.reduce("min", one(0, (2, 0), "float32"), 1), "no elements"), (typed.reduce("mean", one(0, (2, 0), "float32"), 1), "no elements"), (typed.reduce("sum", one(0, (2, 0), "float32"), 2), "dimension 2"),
    ):
        with pytest.raises(Exception, match=said):
            show(rows(spark, []), bad)
    with pytest.raises(Exception, match="division by zero"):
        show(df, typed.binary("div", a, typed.binary("sub", b, b)))
    with pytest.raises(Exception, match="differ"):
        show(df, typed.binary("add", a, typed.to_dtype(b, "int32")))
    with pytest.raises(ValueError):
        typed.to_dtype(a, "float8")
    bits = df.select(typed.to_dtype(a, "bfloat16").alias("t")).first()["t"]["data"]
    assert struct.unpack("<3H", bytes(bits)) == (0xC0E0, 0x40E0, 0xC700)
