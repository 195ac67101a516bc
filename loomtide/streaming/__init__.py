"""An extension: image and text stages over streaming sources. Every stage is per row, so a stream runs it unchanged."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import pixels, tokens


def normalized(stream: DataFrame, column: str, mean: list[float], std: list[float]) -> DataFrame:
    """Pixels of an array<int> column as normalized floats."""
    return stream.withColumn(column, pixels.normalize(F.col(column), mean, std))


def token_rates(stream: DataFrame, text: str, time: str, window: str = "10 minutes", late: str = "10 minutes") -> DataFrame:
    """Rows and tokens by event-time window; state older than the watermark is dropped."""
    rows = stream.withWatermark(time, late).select(F.window(time, window).alias("window"), F.size(tokens.pieces(F.col(text))).alias("n"))
    return rows.groupBy("window").agg(F.count("*").alias("rows"), F.sum("n").alias("tokens"))
