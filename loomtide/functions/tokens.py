"""Token arrays: whitespace encoding by a vocabulary, truncation, padding, positions, labels and decoding."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .core import built, checked


def pieces(text: Column) -> Column:
    """Lower-cased words; a null text is an error."""
    words = F.filter(F.split(F.lower(text), r"\s+"), lambda w: w != "")
    return checked(text.isNotNull(), words, "text is null")


def truncate(ids: Column, n: int, side: str = "right") -> Column:
    return F.slice(ids, 1, n) if side == "right" else F.slice(ids, F.greatest(F.lit(1), F.size(ids) - n + 1), F.lit(n))


def truncate_pair(a: Column, b: Column, n: int) -> tuple[Column, Column]:
    """Longest first: takes from the longer one, from the second on equal lengths, until both fit ``n``."""
    la, lb = F.size(a), F.size(b)
    half = n // 2
    ka = F.when(la + lb <= n, la).when(lb <= half, n - lb).when(la <= n - half, la).otherwise(F.lit(n - half))
    return F.slice(a, F.lit(1), ka), F.slice(b, F.lit(1), F.least(lb, F.lit(n) - F.least(la, ka)))


def pad(ids: Column, width: Column | int, pad_id: int, side: str = "right", multiple: int = 1) -> Column:
    """Padded to ``width`` rounded up to a multiple; never shortened."""
    w = F.lit(width) if isinstance(width, int) else width
    w = F.ceil(w / multiple).cast("int") * multiple
    more = F.array_repeat(F.lit(pad_id), F.greatest(F.lit(0), w - F.size(ids)))
    return F.concat(ids, more) if side == "right" else F.concat(more, ids)


def mask(length: Column, width: Column, side: str = "right") -> Column:
    return built(width, lambda k: ((k < length) if side == "right" else (k >= width - length)).cast("int"))


def positions(attention: Column) -> Column:
    """Active tokens counted from 0; 0 where masked."""
    return F.transform(attention, lambda m, k: F.when(m != 0, F.aggregate(F.slice(attention, F.lit(1), k), F.lit(0), lambda s, x: s + x)).otherwise(F.lit(0)))


def causal_labels(ids: Column, attention: Column, ignore: int = -100) -> Column:
    return F.zip_with(ids, attention, lambda i, m: F.when(m != 0, i).otherwise(F.lit(ignore)))
