"""Order-aware selection. Rows carry a dense ``pos``; skip, take, shuffle and batches are arithmetic on it.

Ranges compose in the order they are declared; a permutation joins by position. Nothing here needs a global sort: places
are counted by blocks of keys or hashes, and no task gathers all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import permutation
from .rng import Sampler

#: Blocks of rows that positions are counted by, at most; their bounds are literals in the plan.
MOST_BLOCKS = 1024


def _bounds(df: DataFrame, key: str, block: int) -> list[int]:
    """Rising keys that cut ``df`` into blocks of about ``block`` rows, MOST_BLOCKS at most, whatever the keys are."""
    n = df.count()
    blocks = min(MOST_BLOCKS, -(-n // block))
    if blocks < 2:
        return []
    shares = F.array(*[F.lit(k / blocks) for k in range(1, blocks)])
    return sorted(set(df.agg(F.percentile_approx(key, shares, F.lit(10 * MOST_BLOCKS)).alias("q")).first()[0]))


def _block(key: Column, bounds: list[int], width: int = 32) -> Column:
    """How many bounds are at or below the key: first by every ``width``-th bound, then inside its run."""
    if not bounds:
        return F.lit(0)
    runs = [bounds[k : k + width] for k in range(0, len(bounds), width)]
    under = lambda b: F.size(F.filter(b, lambda x: x <= key))
    heads = F.array(*[F.lit(r[0]) for r in runs])
    tails = F.array(*[F.array(*[F.lit(x) for x in r]) for r in runs])
    run = F.greatest(under(heads) - 1, F.lit(0))
    return run * width + under(F.get(tails, run))


def with_pos(df: DataFrame, key: str, block: int = 1 << 16, name: str = "pos") -> DataFrame:
    """``df`` with the rank of a distinct integer key from 0. Blocks are cut by quantiles of the key, so that sparse, hashed
    and far-off keys fill them alike; each row adds its rank within its block to the rows before the block."""
    ranked = df.withColumn("__b", _block(F.col(key), _bounds(df, key, block)))
    before = ranked.groupBy("__b").agg(F.count("*").alias("__n"))
    # a row for each block: MOST_BLOCKS at most, in one window and broadcast
    before = before.select("__b", (F.sum("__n").over(Window.orderBy("__b")) - F.col("__n")).alias("__before"))
    ranked = ranked.withColumn("__r", F.row_number().over(Window.partitionBy("__b").orderBy(key)) - 1)
    return ranked.join(F.broadcast(before), "__b").withColumn(name, F.col("__before") + F.col("__r")).drop("__b", "__r", "__before")


def skip(df: DataFrame, n: int) -> DataFrame:
    return df.where(F.col("pos") >= n).withColumn("pos", F.col("pos") - n)


def take(df: DataFrame, n: int) -> DataFrame:
    return df.where(F.col("pos") < n)


def permuted(df: DataFrame, order: DataFrame) -> DataFrame:
    """``order`` has (pos, new_pos), the source row and its place; rows that it leaves out go, rows may repeat."""
    return df.join(order, "pos").withColumn("pos", F.col("new_pos")).drop("new_pos")


def shuffle(df: DataFrame, n: int, seed: int, epoch: int = 0, index: int = 0, op_seed: int = 0) -> DataFrame:
    """``n`` rows in a seeded order, that of a sequential Fisher-Yates shuffle whatever their number."""
    return drawn_shuffle(df, n, Sampler(seed, epoch).shuffle_seed(index, op_seed))


def drawn_shuffle(df: DataFrame, n: int, state: int) -> DataFrame:
    """The Fisher-Yates order of ``n`` rows from a stream's state; Spark makes it."""
    return permuted(df, permutation.order(df.sparkSession, n, state))


def _by_hash(df: DataFrame, h: Column, tie: str, n: int, block: int) -> DataFrame:
    """``df`` with dense places by (hash, tie) as pos."""
    bits = max(0, (n // block).bit_length())
    at = F.shiftright(h, 64 - bits) if bits else F.lit(0).cast("long")
    rows = df.withColumns({"__h": h, "__b": at})
    before = rows.groupBy("__b").agg(F.count("*").alias("__n"))
    before = before.select("__b", (F.sum("__n").over(Window.orderBy("__b")) - F.col("__n")).alias("__before"))
    ranked = rows.withColumn("__r", F.row_number().over(Window.partitionBy("__b").orderBy("__h", tie)) - 1)
    return ranked.join(before, "__b").withColumn("pos", F.col("__before") + F.col("__r")).drop("__h", "__b", "__r", "__before")


def hash_shuffle(df: DataFrame, key: str, seed: int, block: int = 1 << 16) -> DataFrame:
    """An order by a seeded hash of a distinct key, with dense places as the new pos: another order than that of ``shuffle``, and cheaper."""
    return _by_hash(df, F.xxhash64(key, F.lit(seed)), key, df.count(), block)


def indices(df: DataFrame, wanted: DataFrame) -> DataFrame:
    """The rows at ``wanted`` (req, pos), as often as asked, with req as the new pos."""
    return wanted.join(df, "pos").withColumn("pos", F.col("req")).drop("req")


def batch(df: DataFrame, size: int, drop_last: bool = False, n: int | None = None) -> DataFrame:
    """batch_id and batch_pos; the partial tail goes with ``drop_last`` (which needs the number of rows)."""
    if size <= 0:
        raise ValueError("batch size must be positive")
    out = df.withColumns({"batch_id": F.floor(F.col("pos") / size), "batch_pos": (F.col("pos") % size).cast("int")})
    if not drop_last:
        return out
    rows = df.count() if n is None else n
    return out.where(F.col("batch_id") < rows // size)


def previous_in_batch(value: Column) -> Column:
    """A row's predecessor in its batch; the first row's is the last."""
    w = Window.partitionBy("batch_id").orderBy("batch_pos")
    return F.coalesce(F.lag(value).over(w), F.last(value).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))


def uniform_temporal_subsample(frames: Column, n: int) -> Column:
    """n of the frames: a float32 linspace over the places, truncated; repeats when there are fewer."""
    last = (F.size(frames) - 1).cast("float")
    step = (last / F.lit(float(max(1, n - 1)))).cast("float")
    place = lambda k: F.when(k < n / 2, step * k.cast("float")).otherwise(last - step * (n - 1 - k).cast("float"))
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda k: F.get(frames, F.least(F.greatest(place(k).cast("int"), F.lit(0)), F.size(frames) - 1)))


def packed(docs: DataFrame, block_size: int, separator: int, drop_last: bool = True, width: int = 1 << 12) -> DataFrame:
    """(block, ids) from (pos, ids): documents one after another, a separator after each, cut into blocks.

    Offsets are a two-level prefix sum: within runs of ``width`` positions, and over the runs' totals."""
    lengths = docs.select("pos", (F.size("ids") + 1).alias("n"))
    run = F.floor(F.col("pos") / width)
    totals = lengths.groupBy(run.alias("run")).agg(F.sum("n").alias("total"))
    totals = totals.select("run", (F.sum("total").over(Window.orderBy("run")) - F.col("total")).alias("before"))
    within = lengths.withColumn("run", run).withColumn("start", F.sum("n").over(Window.partitionBy("run").orderBy("pos")) - F.col("n"))
    starts = within.join(totals, "run").select("pos", (F.col("before") + F.col("start")).alias("start"))
    # a document goes as one slice to each block that it reaches into, never token by token
    rows = docs.join(starts, "pos").select("start", F.concat("ids", F.array(F.lit(separator))).alias("ids"))
    last = F.floor((F.col("start") + F.size("ids") - 1) / block_size)
    rows = rows.select("start", "ids", F.explode(F.sequence(F.floor(F.col("start") / block_size), last)).alias("block"))
    low = F.greatest(F.col("block") * block_size - F.col("start"), F.lit(0))
    high = F.least((F.col("block") + 1) * block_size - F.col("start"), F.size("ids").cast("long"))
    rows = rows.select("block", "start", F.slice("ids", (low + 1).cast("int"), (high - low).cast("int")).alias("part"))
    cut = rows.groupBy("block").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("start", "part"))), lambda x: x["part"])).alias("ids"))
    return cut.where(F.size("ids") == block_size) if drop_last else cut
