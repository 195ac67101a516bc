"""The order of a sequential Fisher-Yates shuffle, made on Spark at any size.

The sequential rule swaps place i, from the last down to 1, with a drawn place j(i) of 0 to i. Draws count from a state, so every task
makes its own: draw k is the state's k-th number. A number below 2**64 mod (i + 1) is drawn again, which shifts all later steps; only
numbers under n can be such, of which about n * n / 2**64 exist, and these few are looked at one after another.

What stands at place i before its step is what the last step before it put there: step w(i), the least i' > i with j(i') = i, put
what stood at i'. So a place's content is at the end of its chain i, w(i), w(w(i)), ..., found by pointer doubling in as many rounds
as the logarithm of the longest chain (chains are about as long as the logarithm of n). After its step, place i holds what stood at j(i):
the content of the last step before i that drew the same place, or else j(i) itself. Every step of this is a join or a group
of few rows, since a place is drawn about log n times."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .rng import STEP, first_draws, fisher_yates
from .stored import removed, stored

#: Rows up to which one task draws the order by the sequential rule; the order is the same.
ONE_TASK = 1 << 16


def _numbers(state: int, k: np.ndarray) -> np.ndarray:
    """The k-th draws of a state, from 0."""
    with np.errstate(over="ignore"):
        return first_draws(np.uint64(state) + k.astype(np.uint64) * np.uint64(STEP))


def _again(spark: SparkSession, n: int, state: int) -> np.ndarray:
    """The draws that are made again, by their numbers, in order."""
    spare = 64 + (n * n >> 60)

    def small(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            k = b.column("id").to_numpy()
            v = _numbers(state, k)
            at = v < np.uint64(n)
            yield pa.RecordBatch.from_arrays([pa.array(k[at]), pa.array(v[at].astype(np.int64))], ["k", "v"])

    found = spark.range(n + spare).mapInArrow(small, "k long, v long").collect()  # about n * n / 2**64 rows
    out: list[int] = []
    for r in sorted(found):
        i = n - 1 - (r["k"] - len(out))
        if i < 1:
            break
        if r["v"] < (1 << 64) % (i + 1):
            out.append(r["k"])
    if len(out) > spare:
        raise RuntimeError("more draws were made again than can be")
    return np.array(out, np.int64)


def drawn(spark: SparkSession, n: int, state: int) -> DataFrame:
    """(i, j) for every step; place 0 draws itself."""
    # the t-th accepted draw has number t + how many were made again before it
    again = _again(spark, n, state)
    shift = again - np.arange(len(again))

    def steps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            i = b.column("id").to_numpy()
            t = n - 1 - i
            v = _numbers(state, t + np.searchsorted(shift, t, "right"))
            yield pa.RecordBatch.from_arrays([pa.array(i), pa.array((v % (i + 1).astype(np.uint64)).astype(np.int64))], ["i", "j"])

    return spark.range(n).mapInArrow(steps, "i long, j long")


def order(spark: SparkSession, n: int, state: int) -> DataFrame:
    """(pos, new_pos): which row of 0 .. n - 1 comes to each place."""
    if n <= ONE_TASK:

        def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if b.num_rows:
                    at = fisher_yates(n, state) if n else np.empty(0, np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(np.arange(n))], ["pos", "new_pos"])

        return spark.range(0, 1, 1, 1).mapInArrow(whole, "pos long, new_pos long")
    steps = stored(drawn(spark, n, state), "steps")
    chain = stored(steps.where("i > j").groupBy("j").agg(F.min("i").alias("w")).select(F.col("j").alias("i"), "w", F.lit(True).alias("more")), "chain")
    while chain.where("more").limit(1).count():
        on = chain.select(F.col("i").alias("w"), F.col("w").alias("w2"))
        new = stored(chain.join(on, "w", "left").select("i", F.coalesce("w2", "w").alias("w"), F.col("w2").isNotNull().alias("more")), "chain")
        removed(chain)
        chain = new
    before = F.lag("i").over(Window.partitionBy("j").orderBy(F.desc("i")))
    placed = steps.select("i", "j", F.when(F.col("i") == F.col("j"), F.col("i")).otherwise(before).alias("x"))
    placed = placed.join(chain.select(F.col("i").alias("x"), "w"), "x", "left").select(F.coalesce("w", "x", "j").alias("pos"), F.col("i").alias("new_pos"))
    out = stored(placed, "order")
    removed(steps, chain)
    return out
