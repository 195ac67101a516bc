"""Quality by nearest-neighbour voting in a latent-semantic space.

A text is a vector of hashed byte-pair terms and a few surface terms (repeated, distinct and upper-case words, repeated
lines), square-rooted rates times idf, projected by a truncated SVD. The labelled vectors (at most ``max_fit``, so a
bounded broadcast) are compared with every document's, in blocks, by exact cosines; the ``k`` nearest vote with their
similarity. Labels, language, source and id are not inputs.

Null and empty texts have no vector: their score is the mean label of the fit. Texts are whole however long; each row
is scored by itself, so repeated rows agree. Vectors are rounded to whole steps and their products are exact, so a score doesn't
depend on the rows it is computed with; of equal cosines the smaller doc_id votes first. Without labels every score is 0.5.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc32_mod, range_hashes, utf8_blocks, word_ranges

TERMS = 1024
SURFACE = 6
#: At most so many labelled documents, those whose ids hash lowest, are fitted on.
MAX_FIT = 4000
DIMENSIONS = 48
NEIGHBOURS = 15
#: Steps that terms and unit vectors are rounded to.
COARSE, FINE = 1 << 16, 1 << 20


def _repeats(text: np.ndarray, h: np.ndarray, n: int) -> np.ndarray:
    """By text: how many of its items have an equal item before them."""
    order = np.lexsort((h, text))
    t, x = text[order], h[order]
    return np.bincount(t[1:][(t[1:] == t[:-1]) & (x[1:] == x[:-1])], minlength=n)


def term_rates(offsets: np.ndarray, data: np.ndarray) -> np.ndarray:
    """A row per text of a block: rates of byte-pair terms per byte and of surface terms per word."""
    n = len(offsets) - 1
    out = np.zeros((n, TERMS + SURFACE), np.float32)
    size = np.diff(offsets)
    text = np.repeat(np.arange(n), size)
    if len(data) > 1:
        pair = (data[:-1].astype(np.uint32) << 8 | data[1:]) * np.uint32(2654435761)
        at = text[:-1] * TERMS + (pair >> np.uint32(22)).astype(np.int64)
        out[:, :TERMS] = np.bincount(at[text[:-1] == text[1:]], minlength=n * TERMS).reshape(n, TERMS) / np.maximum(size, 1)[:, None]
    start, end, of = word_ranges(offsets, data)
    words = np.maximum(np.bincount(of, minlength=n), 1)
    if len(start):
        (h,) = range_hashes(data, start, end)
        same = (of[1:] == of[:-1]) & (h[1:] == h[:-1])
        first = data[start]
        upper = (first >= 65) & (first <= 90) & (data[end - 1] != 0)
        second = np.where(end - start > 1, data[np.minimum(start + 1, len(data) - 1)], 0)
        line = np.flatnonzero(data == 10)
        rows = [
            np.bincount(of[1:][same], minlength=n),
            _repeats(of, h, n),
            words - _repeats(of, h, n),
            np.bincount(of[upper & (second >= 65) & (second <= 90)], minlength=n),
            np.bincount(text[line], minlength=n) if len(line) else np.zeros(n),
            np.bincount(of[end - start > 24], minlength=n),
        ]
        out[:, TERMS:] = (np.array(rows, np.float32) / words).T
        out[np.bincount(of, minlength=n) == 0] = 0
    return out


def _fit_rows(docs: DataFrame) -> DataFrame:
    """(doc_id, quality, rates as binary) of the fitting rows."""

    def rates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [r.tobytes() for _, o, d in utf8_blocks(b.column("text")) for r in term_rates(o, d)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("quality"), pa.array(got, pa.binary())], ["doc_id", "quality", "rates"])

    return docs.mapInArrow(rates, "doc_id long, quality int, rates binary")


def fit(docs: DataFrame, labels: DataFrame, max_fit: int = MAX_FIT, folds: int = 5, held: int = 0) -> dict | None:
    """idf, projection, labelled vectors and labels, from a bounded sample outside the held-out fold."""
    some = (
        labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & (crc32_mod(F.col("doc_id"), folds) != held))
        .groupBy("doc_id")
        .agg(F.min("quality").cast("int").alias("quality"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(max_fit)
    )
    rows = _fit_rows(docs.select("doc_id", "text").join(F.broadcast(some), "doc_id").select("doc_id", "quality", "text")).collect()
    rows = sorted({r["doc_id"]: r for r in sorted(rows, key=lambda r: (r["doc_id"], r["rates"]))}.values(), key=lambda r: r["doc_id"])
    if not rows:
        return None
    x = np.sqrt(np.frombuffer(b"".join(r["rates"] for r in rows), np.float32).reshape(len(rows), -1))
    y = np.array([r["quality"] > 0 for r in rows], np.float32)
    idf = np.log((1 + len(x)) / (1 + (x > 0).sum(0))).astype(np.float32) + np.float32(0.2)
    x = x * idf
    _, vectors = np.linalg.eigh((x.T @ x).astype(np.float64))  # of TERMS + SURFACE squared: the right singular vectors
    to = np.rint(vectors[:, ::-1][:, :DIMENSIONS] * FINE)
    z = placed(x, to)
    good = z.any(1)
    return {"idf": idf, "to": to, "z": z[good], "y": y[good], "prior": float(y.mean())}


def placed(x: np.ndarray, to: np.ndarray) -> np.ndarray:
    """Unit vectors in whole steps of 1 / FINE; 0 for those without a direction. All sums are of whole numbers below 2**53."""
    z = np.rint(x.astype(np.float64) * COARSE) @ to
    size = np.sqrt((z * z).sum(1, keepdims=True))
    return np.rint(z / np.where(size == 0, 1.0, size) * FINE)


def vote(x: np.ndarray, model: dict, k: int = NEIGHBOURS) -> np.ndarray:
    """Scores of a block of rate rows."""
    z = placed(np.sqrt(x) * model["idf"], model["to"])
    out = np.full(len(x), model["prior"])
    n = len(model["y"])
    if not n:
        return out
    # whole numbers: the cosine, and below it the place among the labelled, which are sorted by id
    key = (z @ model["z"].T).astype(np.int64) * n + np.arange(n)[::-1]
    k = min(k, n)
    near = np.sort(np.argpartition(-key, k - 1, axis=1)[:, :k], axis=1)  # votes are added in one order
    weight = np.maximum(np.take_along_axis(key, near, 1) // n, 0) / FINE**2
    total = weight.sum(1)
    some = z.any(1) & (total > 0)
    out[some] = (weight * model["y"][near]).sum(1)[some] / total[some]
    return np.clip(out, 0.0, 1.0)


def score(docs: DataFrame, model: dict | None, folds: int = 5, held: int = 0) -> DataFrame:
    """Per row: doc_id, held_out, score and predicted (score >= 0.3)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def scores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            parts = [np.full(len(o) - 1, 0.5) if m is None else vote(term_rates(o, d), m) for _, o, d in utf8_blocks(b.column("text"))]
            s = np.concatenate(parts) if parts else np.empty(0)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("held_out"), pa.array(s, pa.float64()), pa.array((s >= 0.3).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (crc32_mod(F.col("doc_id"), folds) == held).alias("held_out"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(scores, "doc_id long, held_out boolean, score double, predicted int")
