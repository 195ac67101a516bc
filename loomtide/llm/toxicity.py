"""Toxicity: a linear classifier over character n-grams scaled by naive Bayes log-count ratios.

Every distinct 4-, 5- and 6-gram of code points of the lower-cased text is a hashed binary feature. Its value is
log(P(feature | toxic) / P(feature | clean)), and a logistic regression, whose losses and slopes tasks sum over the
sample, learns how far to trust each ratio. All buckets with a ratio take part; a ratio is shrunk smoothly by what chance may give: one of z standard errors
keeps z**2 / (z**2 + CHANCE**2) of itself, so none becomes 0. CHANCE is a parameter of ``fit``. Its default was chosen by threefold
cross-validation inside the learning folds of the table with 10,000 documents (log loss 0.120 at a hard cut of 3, 0.073 with this
rule at 4; held-out rows had no part in it). Ratios and regression are fitted on a bounded sample (at most ``max_toxic`` toxic and
``max_clean`` clean labelled documents, those whose ids hash lowest). The model is one vector of BUCKETS weights,
broadcast; scoring is a pass over the rows.

Null and empty texts have no features and get the intercept's score. Texts are whole however long; each row is scored
by itself, so repeated rows agree. Rows that repeat an id all take that id's label, toxic where labels differ. Without labels
of both classes every score is the share of toxic labels (0 without labels).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, crc32_mod, settled, utf8_blocks

BUCKETS = 1 << 18
ORDERS = (4, 5, 6)
MAX_TOXIC, MAX_CLEAN = 4000, 8000
#: Bytes of text whose features are one row (a longer text is one: 0.5 MB at most), rows of a file, and tasks that sum slopes.
#: Readers and Arrow take a whole file's rows at once, in the JVM and beside it.
ROW_BYTES, FILE_ROWS, SLOPE_TASKS = 1 << 16, 16, 6
#: Documents that are added to the counts of a bucket, dealt to the classes by their sizes.
SMOOTH = 1.0
#: Standard errors at which a ratio keeps half of itself.
CHANCE = 4.0
#: Of the regression: steps at most, and the ridge on coefficients of features of unit mean square.
STEPS, RIDGE = 60, 1e-6
#: What all toxic texts of the sample weigh together, of 1: however few they are, predictions are at a score of 0.3.
TOXIC_SHARE = 0.3


def features(offsets: np.ndarray, data: np.ndarray) -> Iterator[np.ndarray]:
    """The distinct buckets of each text of a block of lower-cased texts, in order of first place."""
    points = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32).astype(np.uint64)
    heads = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))  # code points before each byte
    bounds = heads[offsets]
    n = len(points)
    h, grams = points * np.uint64(0x9E3779B97F4A7C15), {}
    for order in range(2, max(ORDERS) + 1):
        h = (h[: n - order + 1] if n >= order else h[:0]) * np.uint64(0xD6E8FEB86659FD93)
        h = h + points[order - 1 :] * np.uint64(0x9E3779B97F4A7C15) if len(h) else h
        if order in ORDERS:
            x = h ^ (h >> np.uint64(29))
            grams[order] = ((x * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(46)).astype(np.int64)
    last = np.zeros(BUCKETS, np.int32)
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        at = np.concatenate([g[a : max(a, b - order + 1)] for order, g in grams.items()])
        place = np.arange(len(at), dtype=np.int32)
        last[at[::-1]] = place[::-1]
        yield at[last[at] == place]


def _lower(column: pa.Array) -> pa.Array:
    return pc.utf8_lower(column)


def fit(docs: DataFrame, labels: DataFrame, max_toxic: int = MAX_TOXIC, max_clean: int = MAX_CLEAN, folds: int = 4, held: int = 2, chance: float = CHANCE) -> tuple[np.ndarray, float]:
    """(weights by bucket, intercept), from a bounded sample outside the held-out fold."""
    usable = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & (crc32_mod(F.col("doc_id"), folds) != held))
    usable = usable.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    lowest = lambda which, n: usable.where(which).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n)
    some = lowest(F.col("toxic") > 0, max_toxic).union(lowest(F.col("toxic") <= 0, max_clean))
    share = usable.agg(F.avg((F.col("toxic") > 0).cast("double"))).first()[0] or 0.0

    with Scratch(docs.sparkSession):
        rows = docs.select("doc_id", "text").join(F.broadcast(some), "doc_id").select("toxic", F.coalesce("text", F.lit("")).alias("text"))
        rows = settled(rows, "labelled")  # the bounded sample; it is read again
        counted = rows.coalesce(8).mapInArrow(_counted, "p binary, q binary, n long, m long").collect()
        add = lambda k: sum((np.frombuffer(r[k], np.int32) for r in counted), np.zeros(BUCKETS, np.int64))
        toxic, clean = sum(r["n"] for r in counted), sum(r["m"] for r in counted)
        if not toxic or not clean:
            share = min(max(share, 1e-6), 1 - 1e-6)
            return np.zeros(BUCKETS, np.float32), float(np.log(share / (1 - share)))
        p, q = add("p"), add("q")
        ratio = np.where(p + q, ratios(p, q, toxic, clean, chance), 0.0)  # buckets of no text have none
        value = ratio / np.sqrt(max(1e-12, ((p + q) * ratio**2).sum() / (toxic + clean)))  # features of unit mean square
        told = settled(rows.coalesce(SLOPE_TASKS).mapInArrow(_featured, "toxic binary, sizes binary, low binary"), "features", maxRecordsPerFile=FILE_ROWS)
        weigh = (TOXIC_SHARE / toxic, (1 - TOXIC_SHARE) / clean)

        def slope(x: np.ndarray) -> tuple[float, np.ndarray]:
            """Loss and gradient at coefficients ``x`` (the last is the intercept); one row a task comes back."""
            shared = docs.sparkSession.sparkContext.broadcast(((x[:-1] * value).astype(np.float32), x[-1], weigh))
            parts = told.coalesce(SLOPE_TASKS).mapInArrow(lambda batches: _slopes(batches, *shared.value), "loss double, bias double, g binary").collect()
            shared.destroy()
            g = np.append(sum((np.frombuffer(r["g"], np.float32) for r in parts), np.zeros(BUCKETS)) * value, sum(r["bias"] for r in parts))
            g[:-1] += RIDGE * x[:-1]
            return sum(r["loss"] for r in parts) + RIDGE / 2 * float(x[:-1] @ x[:-1]), g

        x = descended(slope, np.zeros(BUCKETS + 1), STEPS)
        return (x[:-1] * value).astype(np.float32), float(x[-1])


def descended(slope: Callable[[np.ndarray], tuple[float, np.ndarray]], x: np.ndarray, steps: int, memory: int = 10) -> np.ndarray:
    """Coefficients after quasi-Newton steps with a limited memory, each halved until the loss falls as its slope promises."""
    loss, g = slope(x)
    past: list[tuple[np.ndarray, np.ndarray, float]] = []
    for _ in range(steps):
        way, rates = g.copy(), []
        for s, y, r in reversed(past):
            rates.append(r * (s @ way))
            way -= rates[-1] * y
        if past:
            s, y, r = past[-1]
            way /= r * (y @ y)
        for (s, y, r), a in zip(past, reversed(rates), strict=True):
            way += s * (a - r * (y @ way))
        size = 1.0 if past else 1 / max(1.0, float(np.linalg.norm(g)))
        while True:
            new, h = slope(x - size * way)
            if new <= loss - 1e-4 * size * (g @ way) or size < 1e-8:
                break
            size /= 2
        s, y = -size * way, h - g
        if s @ y > 1e-14:
            past = [*past, (s, y, 1 / (s @ y))][-memory:]
        if new > loss:
            break
        done = loss - new < 1e-7 * max(1.0, loss)
        x, loss, g = x + s, new, h
        if done:
            break
    return x


def _featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each block of texts, as plain bytes: their labels; by the upper bits of a bucket and then by text, how many
    features there are; the lower 16 bits of all features in that order."""
    for b in batches:
        toxic = b.column("toxic").to_numpy() > 0
        for at, o, d in utf8_blocks(_lower(b.column("text")), ROW_BYTES):
            got = list(features(o, d))
            flat, text = np.concatenate(got), np.repeat(np.arange(len(got)), [len(f) for f in got])
            upper = flat >> 16
            sizes = np.bincount(upper * len(got) + text, minlength=(BUCKETS >> 16) * len(got)).astype(np.int32)
            parts = toxic[at : at + len(got)], sizes, flat[np.argsort(upper, kind="stable")].astype(np.uint16)
            yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in parts], ["toxic", "sizes", "low"])


def _told(b: pa.RecordBatch, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of a row of ``_featured``: the labels, and of every feature the text and the bucket."""
    y, size, low = (np.frombuffer(b.column(c)[k].as_buffer(), t) for c, t in (("toxic", bool), ("sizes", np.int32), ("low", np.uint16)))
    upper, text = np.divmod(np.arange(len(size)), len(y))
    return y, np.repeat(text, size), np.repeat(upper << 16, size) + low


def _slopes(batches: Iterator[pa.RecordBatch], weights: np.ndarray, bias: float, weigh: tuple[float, float]) -> Iterator[pa.RecordBatch]:
    """One row a task: its texts' loss, and the slope by the intercept and by each bucket's weight; a block at a time."""
    loss = by_bias = 0.0
    g = np.zeros(BUCKETS)
    for b in batches:
        for k in range(b.num_rows):
            y, row, flat = _told(b, k)
            z = np.bincount(row, weights[flat], minlength=len(y)) + bias
            w = np.where(y, *weigh)
            d = w * (1 / (1 + np.exp(-np.clip(z, -500, 500))) - y)
            loss += float((w * np.logaddexp(0, np.where(y, -z, z))).sum())
            by_bias += float(d.sum())
            g += np.bincount(flat, d[row], minlength=BUCKETS)
    yield pa.RecordBatch.from_arrays([pa.array([loss]), pa.array([by_bias]), pa.array([g.astype(np.float32).tobytes()], pa.binary())], ["loss", "bias", "g"])


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row a task: in how many toxic and clean texts each bucket is, and how many texts there are."""
    of, n = np.zeros((2, BUCKETS), np.int32), [0, 0]
    for b in batches:
        toxic = b.column("toxic").to_pylist()
        for at, o, d in utf8_blocks(_lower(b.column("text"))):
            for i, f in enumerate(features(o, d)):
                which = int(toxic[at + i] <= 0)
                of[which, f] += 1
                n[which] += 1
    yield pa.RecordBatch.from_arrays([*[pa.array([of[k].tobytes()], pa.binary()) for k in (0, 1)], *[pa.array([k], pa.int64()) for k in n]], ["p", "q", "n", "m"])


def ratios(p: np.ndarray, q: np.ndarray, toxic: int, clean: int, chance: float = CHANCE) -> np.ndarray:
    """Log-count ratios of all buckets, shrunk by what chance alone may give: one of z standard errors keeps
    z**2 / (z**2 + chance**2) of itself."""
    share = toxic / (toxic + clean)
    p, q = p + SMOOTH * share, q + SMOOTH * (1 - share)
    ratio = np.log(p / toxic) - np.log(q / clean)
    z2 = ratio**2 / (1 / p + 1 / q)
    return ratio * z2 / (z2 + chance**2)


def score(docs: DataFrame, model: tuple[np.ndarray, float], folds: int = 4, held: int = 2) -> DataFrame:
    """Per row: doc_id, held_out, score and predicted (score >= 0.3)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def scores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, bias = shared.value
        for b in batches:
            z = np.array([w[f].sum(dtype=np.float64) for _, o, d in utf8_blocks(_lower(b.column("text"))) for f in features(o, d)]) + bias
            s = 1 / (1 + np.exp(-np.clip(z, -500, 500)))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("held_out"), pa.array(s, pa.float64()), pa.array((s >= 0.3).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (crc32_mod(F.col("doc_id"), folds) == held).alias("held_out"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return rows.mapInArrow(scores, "doc_id long, held_out boolean, score double, predicted int")
