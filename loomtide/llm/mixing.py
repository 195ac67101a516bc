"""Mixing sources to target weights: token sums per source, repetition rates, whole copies and one hash-seeded coin.

Every document is taken floor(rate) times, and once more if a coin that its id and its source's seed decide falls
below the fraction. The sizes (id, source, number) are settled once as a small table.

Sizes are summed per source with partial aggregation before the shuffle, so a hot source costs no more than others.
The plan has a row per source; it is broadcast only where it has at most ``MAX_BROADCAST`` sources, else it is joined
with the hot sources dealt over salts. A null text has size 0, a null source is a source of its own (the last).
Sources without words have target 0 and none of their documents are taken. Equal rows get equal copies. Texts are whole
however long; an empty table gives no rows. Of sources that are as large for their weight, the first by code point stops
first, which moves no target.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import settled, words

MAX_BROADCAST = 20_000
SALTS = 64
#: A source is taken at most so many times.
MOST = 3
#: Seeds that are tried for each source.
SEEDS = 32


def n_words(text: Column) -> Column:
    return F.size(words(text)).cast("long")


def plan(sizes: DataFrame) -> DataFrame:
    """(source, source_size, weight, target) from rows (source, size).

    Weights go 1, 2, 3, 1, ... by code point, null last; together the targets make the size of all. A target stops at
    MOST times the source's size; the excess goes to the rest by weight. Sorted by size for each unit of weight, the
    sources that stop are a prefix, so sums over that order give the level of the rest at once."""
    s = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    s = s.withColumn("weight", ((F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1) % 3 + 1).cast("long"))
    up = Window.orderBy(F.col("source_size") / F.col("weight"), F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    s = s.withColumns(
        {
            "total": F.sum("source_size").over(every),
            "weights": F.sum("weight").over(every),
            "size_before": F.coalesce(F.sum("source_size").over(up), F.lit(0)),
            "weight_before": F.coalesce(F.sum("weight").over(up), F.lit(0)),
        }
    )
    full = MOST * F.col("source_size") * (F.col("weights") - F.col("weight_before")) <= (F.col("total") - MOST * F.col("size_before")) * F.col("weight")
    s = s.withColumn("full", full).withColumns(
        {
            "full_size": F.sum(F.when(F.col("full"), F.col("source_size")).otherwise(0)).over(every),
            "full_weight": F.sum(F.when(F.col("full"), F.col("weight")).otherwise(0)).over(every),
        }
    )
    rest = ((F.col("total") - MOST * F.col("full_size")) * F.col("weight")).cast("double") / (F.col("weights") - F.col("full_weight")).cast("double")
    return s.select("source", "source_size", "weight", F.when(F.col("full"), (MOST * F.col("source_size")).cast("double")).otherwise(rest).alias("target"))


def coin(doc_id: Column, seed: Column) -> Column:
    """A number in [0, 1) that only the id and the seed decide."""
    told = F.concat(seed.cast("string"), F.lit(":"), F.coalesce(doc_id.cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(told), 1, 12), 16, 10).cast("double") / F.lit(float(1 << 48))


def _with_plan(rows: DataFrame, rates: DataFrame) -> DataFrame:
    """``rows`` with their source's plan, by the column source; null meets null."""
    got = rates.limit(MAX_BROADCAST + 1).collect()
    if len(got) <= MAX_BROADCAST:
        small = rows.sparkSession.createDataFrame(got, rates.schema) if got else rates.limit(0)
        right, on = F.broadcast(small.withColumnRenamed("source", "__source")), F.col("source").eqNullSafe(F.col("__source"))
        return rows.join(right, on).drop("__source")
    salt = F.pmod(F.xxhash64("doc_id"), F.lit(SALTS))
    right = rates.withColumnRenamed("source", "__source").withColumn("__salt2", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    on = F.col("source").eqNullSafe(F.col("__source")) & (F.col("__salt") == F.col("__salt2").cast("long"))
    return rows.withColumn("__salt", salt).join(right, on).drop("__source", "__salt", "__salt2")


def _rate() -> Column:
    return F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))


def seeded(sizes: DataFrame, rates: DataFrame, seeds: int = SEEDS) -> DataFrame:
    """``rates`` with a seed per source: of ``seeds`` seeds the one whose coins bring the source nearest to its target
    (the first of equals). One partial sum per source and seed; long documents make a single seed's sum stray far."""
    rate = _rate()
    tried = _with_plan(sizes, rates).groupBy("source", "source_size", "weight", "target").agg(
        F.array(*[F.sum(F.when(coin(F.col("doc_id"), F.lit(i)) < rate - F.floor(rate), F.col("size")).otherwise(F.lit(0).cast("long"))) for i in range(seeds)]).alias("extra")
    )
    off = F.transform("extra", lambda x: F.abs(F.floor(rate) * F.col("source_size") + x - F.col("target")))
    return tried.select("source", "source_size", "weight", "target", (F.array_position(off, F.array_min(off)) - 1).alias("seed"))


def copies() -> Column:
    rate = _rate()
    return (F.floor(rate) + (coin(F.col("doc_id"), F.col("seed")) < rate - F.floor(rate)).cast("long")).cast("long")


def _sizes(docs: DataFrame) -> DataFrame:
    return settled(docs.select("doc_id", "source", n_words(F.col("text")).alias("size")), "sizes")


def mix_counts(docs: DataFrame) -> DataFrame:
    """Per document: size, source_size, target (of its source), copies and taken = size * copies."""
    sizes = _sizes(docs)
    out = _with_plan(sizes, seeded(sizes, plan(sizes))).withColumn("copies", copies())
    return out.select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("size") * F.col("copies")).alias("taken"))


def mix(docs: DataFrame) -> DataFrame:
    """The rows of ``docs``, each as many times as the mix takes it, with their own columns."""
    sizes = _sizes(docs)
    p = {c: f"__doc_{i}" for i, c in enumerate(docs.columns)}
    held = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in p.items()], F.col("doc_id"), F.col("source"))
    out = _with_plan(held, seeded(sizes, plan(sizes))).withColumn("__n", copies()).where("__n > 0")
    out = out.withColumn("__copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("__n"))))
    return out.select(*[F.col(n).alias(c) for c, n in p.items()])
