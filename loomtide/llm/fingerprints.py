"""Document fingerprints: a homomorphic multiset hash.

A text is the multiset of its paragraphs (lines, empty ones too). Each paragraph hashes to a wide vector; a fingerprint
is the sum of the vectors, lane by lane modulo a power of two. So paragraphs may come in any order, and inserting or
deleting one is adding or subtracting its vector. A vector has two parts:

* 16 lanes modulo 2**32, the words of the paragraph's SHA-512: for equality;
* 126 lanes modulo 2**20, in which every piece (up to four words) of the paragraph adds the bits of two 64-bit hashes:
  centred by the number of pieces these are random signs, whose products estimate how many pieces two texts share.

All is DataFrame code. Pieces are exploded and summed before the shuffle, three lanes to a long, at most 2**19 pieces
to a partial sum, so no lane runs into the next however long the text is.

Null is the empty text (one empty paragraph, no pieces). Every row has its result. Rows go by descending id, null last, rows
that repeat an id by code points and then by their key; so the next row of one that is repeated may be its equal. Texts are
whole however long.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, Scratch, let, settled

LANES = 21  # longs for each hash; a long has three lanes of 20 bits with a spare bit between
SPARE = (1 << 20) - 1 | ((1 << 20) - 1) << 21 | ((1 << 20) - 1) << 42
ONES = 1 | 1 << 21 | 1 << 42
BLOCK = 1 << 19
PIECE = rf"{WORD}(?:[\x20\x09-\x0D]+{WORD}){{0,3}}"
VECTOR = [f"v{i}" for i in range(2 * LANES)]
#: Rows of a window over neighbours, and how many windows there are at most (their ends are one small table).
ROWS, MOST_RANGES = 1 << 14, 20_000


def paragraphs(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def pieces(text: Column) -> Column:
    """Up to four words each, counted from the start of every paragraph."""
    return F.flatten(F.transform(paragraphs(text), lambda p: F.regexp_extract_all(p, F.lit(PIECE), F.lit(0))))


def exact_lanes(text: Column) -> Column:
    """The 16 equality lanes, as 128 hex digits."""
    part = lambda h, j: F.conv(F.substr(h, j * 8 + 1, F.lit(8)), 16, 10).cast("long")
    lane = lambda hexes, j: F.aggregate(hexes, F.lit(0).cast("long"), lambda a, h: (a + part(h, j)) % F.lit(1 << 32))
    shown = lambda hexes: F.transform(F.sequence(F.lit(0), F.lit(15)), lambda j: F.lower(F.lpad(F.hex(lane(hexes, j)), 8, "0")))
    return F.array_join(let(F.transform(paragraphs(text), lambda p: F.sha2(p, 512)), shown), "")


def added(a: Column, b: Column) -> Column:
    """The piece lanes (packed longs) of two multisets together."""
    return F.zip_with(a, b, lambda x, y: (x + y).bitwiseAND(F.lit(SPARE)))


def removed(a: Column, b: Column) -> Column:
    """The piece lanes of ``a`` without the multiset ``b``. The spare bits lend to each lane."""
    return F.zip_with(a, b, lambda x, y: (x.bitwiseOR(F.lit(ONES << 20)) - y).bitwiseAND(F.lit(SPARE)))


def exact_added(a: Column, b: Column, sign: int = 1) -> Column:
    """The equality lanes (hex) of two multisets together; ``sign`` -1 takes ``b`` out."""
    at = lambda x, j: F.conv(F.substr(x, j * 8 + 1, F.lit(8)), 16, 10).cast("long")
    return F.array_join(F.transform(F.sequence(F.lit(0), F.lit(15)), lambda j: F.lower(F.lpad(F.hex(F.pmod(at(a, j) + sign * at(b, j), F.lit(1 << 32))), 8, "0"))), "")


def sketches(texts: DataFrame, keys: list[str]) -> DataFrame:
    """``keys`` (which tell the rows apart), vector (packed piece lanes) and n_pieces of rows with a column ``text``."""
    rows = texts.select(*keys, F.posexplode_outer(pieces(F.col("text"))).alias("at", "piece"))
    rows = rows.withColumns({"h0": F.xxhash64("piece"), "h1": F.xxhash64("piece", F.lit(1))})
    lane = lambda i: F.shiftrightunsigned(F.col(f"h{i // LANES}"), i % LANES).bitwiseAND(F.lit(ONES))
    part = rows.groupBy(*keys, F.coalesce(F.floor(F.col("at") / BLOCK), F.lit(0)).alias("block")).agg(
        *[F.sum(F.when(F.col("piece").isNotNull(), lane(i)).otherwise(F.lit(0).cast("long"))).alias(c) for i, c in enumerate(VECTOR)],
        F.count("piece").alias("n_pieces"),
    )
    part = part.select(*keys, F.array(*VECTOR).alias("vector"), "n_pieces")
    whole = part.groupBy(*keys).agg(F.collect_list("vector").alias("parts"), F.sum("n_pieces").alias("n_pieces"))
    zero = F.array_repeat(F.lit(0).cast("long"), 2 * LANES)
    return whole.select(*keys, F.aggregate("parts", zero, added).alias("vector"), "n_pieces")


def signs(vector: Column, n: Column) -> Column:
    """The 126 centred sums of a sketch, as doubles."""

    def part(at: int) -> Column:
        lane = lambda x: F.shiftright(x, 21 * at).bitwiseAND(F.lit((1 << 20) - 1))
        centred = lambda x: F.pmod(2 * lane(x) - n + (1 << 20), F.lit(1 << 21)) - (1 << 20)
        return F.transform(vector, lambda x: centred(x).cast("double"))

    return F.concat(part(0), part(1), part(2))


def likeness(a: Column, b: Column, same: Column) -> Column:
    """Cosine of two arrays of signs, 0 to 1; equal fingerprints have 1, an empty text has 0 with all others."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, p: s + p)
    norm = F.sqrt(dot(a, a) * dot(b, b))
    return F.when(same, F.lit(1.0)).when(norm > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), dot(a, b) / norm))).otherwise(F.lit(0.0))


def ring(rows: DataFrame) -> DataFrame:
    """(k, next_k, prev_k, prev_n) of rows (doc_id, n, k) with distinct k: neighbours by descending doc_id, the ends joined.

    Rows are dealt by ranges that a sample makes alike in rows, whatever the ids are; a window is over one range (about
    ROWS rows, more only where there are over MOST_RANGES). Only the ranges' end rows meet in one small table."""
    order = [F.col("doc_id").desc_nulls_last(), F.col("n"), F.col("k")]
    ranges = max(1, min(MOST_RANGES, -(-rows.count() // ROWS)))
    dealt = settled(rows.repartitionByRange(ranges, *order).withColumn("block", F.spark_partition_id()), "ranges")
    w = Window.partitionBy("block").orderBy(*order)
    near = dealt.select("k", "n", "block", F.lead("k").over(w).alias("next_k"), F.lag("k").over(w).alias("prev_k"), F.lag("n").over(w).alias("prev_n"))
    near = settled(near, "ring")
    ends = near.where("prev_k is null").select("block", F.col("k").alias("top")).join(near.where("next_k is null").select("block", F.col("k").alias("low"), F.col("n").alias("low_n")), "block")
    w, every = Window.orderBy("block"), Window.orderBy("block").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ends = ends.select(
        "block",
        F.coalesce(F.lead("top").over(w), F.first("top").over(every)).alias("below"),
        F.coalesce(F.lag("low").over(w), F.last("low").over(every)).alias("above"),
        F.coalesce(F.lag("low_n").over(w), F.last("low_n").over(every)).alias("above_n"),
    )  # a row for each range: at most MOST_RANGES, so that it is broadcast
    return near.join(F.broadcast(ends), "block").select("k", F.coalesce("next_k", "below").alias("next_k"), F.coalesce("prev_k", "above").alias("prev_k"), F.coalesce("prev_n", "above_n").alias("prev_n"))


def fingerprints_with_edits(docs: DataFrame) -> DataFrame:
    """Every row and its edited text (the last third replaced by the head of the next row): doc_id, n_chars, edited_sha256,
    fingerprint, edited_fingerprint, near_edited, near_next.

    Equal rows are worked on once, under the key of their id and text: all but the last of them have an equal one as next."""
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    key = F.unhex(F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.col("text"))))
    base = base.withColumns({"k": key, "n": F.length("text").cast("long")})
    with Scratch(docs.sparkSession) as tables:
        rows = settled(base.groupBy("doc_id", "n", "k").agg((F.count("*") - 1).alias("more")), "rows")
        near = settled(ring(rows).join(rows.select("k", "doc_id", "more"), "k"), "near")
        # both sides below need the same columns of the same rows by k, so one shuffle of the texts serves them
        one = base.withColumn("at", F.row_number().over(Window.partitionBy("k").orderBy("n"))).where("at = 1").select("k", "text", "n")
        own = one.join(near.select("k", "doc_id", "next_k", "more"), "k")
        heads = one.join(near.select("k", "prev_k", "prev_n"), "k").select(F.col("prev_k").alias("k"), F.expr("left(text, cast(prev_n div 3 as int))").alias("head"))
        body = F.expr("left(text, cast(n - n div 3 as int))")
        said = lambda v, text: F.struct(F.lit(v).alias("v"), text.alias("text"))
        texts = [said(0, F.col("text")), said(1, F.concat(body, F.col("head")))]
        again = said(2, F.concat(body, F.expr("left(text, cast(n div 3 as int))")))  # edited by an equal row
        both = own.join(heads, "k").select("k", "doc_id", "n", "next_k", "more", F.explode(F.when(F.col("more") > 0, F.array(*texts, again)).otherwise(F.array(*texts))).alias("x"))
        both = both.select("k", "doc_id", "n", "next_k", "more", F.col("x.v").alias("v"), F.when(F.col("x.v") > 0, F.unhex(F.sha2(F.col("x.text"), 256))).alias("sha"), F.unhex(exact_lanes(F.col("x.text"))).alias("exact"), F.col("x.text").alias("text"))
        held = ["k", "doc_id", "n", "next_k", "more"]
        parts = sketches(both, [*held, "v", "sha", "exact"])
        pick = lambda c, v: F.max_by(c, F.col("v") == v).alias(f"{c}{v}")
        whole = parts.groupBy(*held).agg(*[pick(c, v) for v in (0, 1, 2) for c in ("vector", "n_pieces", "exact", "sha")])
        whole = settled(whole, "fingerprints")
        tables.keep(whole)
    after = whole.select(F.col("k").alias("next_k"), F.col("vector0").alias("nv"), F.col("n_pieces0").alias("nn"), F.col("exact0").alias("ne"))
    digits = lambda c: F.lower(F.hex(c))
    shown = lambda v: F.concat(digits("exact" + v), F.lit("."), F.hex(F.col("n_pieces" + v)), F.lit("."), F.array_join(F.transform("vector" + v, lambda x: F.lower(F.hex(x))), ":"))
    signed = lambda v: signs(F.col("vector" + v), F.col("n_pieces" + v))

    def told(rows: DataFrame, v: str, near_next: Column) -> DataFrame:
        return rows.select(
            "doc_id",
            F.col("n").alias("n_chars"),
            digits("sha" + v).alias("edited_sha256"),
            shown("0").alias("fingerprint"),
            shown(v).alias("edited_fingerprint"),
            likeness(F.col("s0"), F.col("s" + v), F.col("exact0") == F.col("exact" + v)).alias("near_edited"),
            near_next.alias("near_next"),
        )

    last = whole.join(after, "next_k").withColumns({"s0": signed("0"), "s1": signed("1"), "sn": signs(F.col("nv"), F.col("nn"))})
    last = told(last, "1", likeness(F.col("s0"), F.col("sn"), F.col("exact0") == F.col("ne")))
    first = whole.where("more > 0").withColumns({"s0": signed("0"), "s2": signed("2")}).withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("more"))))
    return last.union(told(first, "2", F.lit(1.0)))
