"""Summaries over streams: power sums by event-time windows, kept as a state that merges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quantalake.functions.aggregates import powers


def windowed_powers(stream: DataFrame, time: str, by: list[str], x: str, k: int, window: str, late: str) -> DataFrame:
    """``by``, start and p0, ..., pk of each tumbling window. Rows more than ``late`` behind the newest are dropped,
    and a window is final once the watermark has passed its end."""
    own = stream.withWatermark(time, late) if stream.isStreaming else stream
    sums = own.groupBy(*by, F.window(time, window).alias("w")).agg(*powers(k, x))
    return sums.select(*by, F.col("w.start").alias("start"), *[f"p{i}" for i in range(k + 1)])


def sliding_powers(stream: DataFrame, time: str, by: list[str], x: str, k: int, window: str, slide: str, late: str) -> DataFrame:
    """``by``, start and p0, ..., pk of overlapping windows, one every ``slide``, which must divide ``window``.

    Rows are summed by pane, of one slide each, and panes by window: a row is touched once, not once a window. Both
    sums are states of the stream; a window is final once the watermark has passed its end.
    """
    own = stream.withWatermark(time, late) if stream.isStreaming else stream
    panes = own.groupBy(*by, F.window(time, slide).alias("__pane")).agg(*powers(k, x))
    panes = panes.select(*by, F.window_time("__pane").alias("__at"), *[f"p{i}" for i in range(k + 1)])
    sums = panes.groupBy(*by, F.window("__at", window, slide).alias("__w")).agg(*[F.sum(f"p{i}").alias(f"p{i}") for i in range(k + 1)])
    return sums.select(*by, F.col("__w.start").alias("start"), *[f"p{i}" for i in range(k + 1)])


def session_powers(stream: DataFrame, time: str, by: list[str], x: str, k: int, gap: str, late: str) -> DataFrame:
    """The same by sessions: runs of rows of a key with gaps below ``gap``."""
    own = stream.withWatermark(time, late) if stream.isStreaming else stream
    sums = own.groupBy(*by, F.session_window(time, gap).alias("w")).agg(*powers(k, x))
    return sums.select(*by, F.col("w.start").alias("start"), *[f"p{i}" for i in range(k + 1)])


def summed_stream(stream: DataFrame, by: list[str], x: str, k: int) -> DataFrame:
    """Power sums of all rows so far: for the complete or update mode."""
    return stream.groupBy(*by).agg(*powers(k, x))
