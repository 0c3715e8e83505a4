"""Structured Streaming: progress lines, windowed sample means with late data, and an overlay gate over a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from splicery.operators.overlays import interval_join
from splicery.sources.tables import parse_progress


def progress_stream(lines: DataFrame) -> DataFrame:
    """A stream of lines (value) as progress rows; lines without frame= and time= fall out."""
    return lines.select(parse_progress(F.col("value")).alias("p")).filter("p is not null").select("p.*")


def windowed_means(samples: DataFrame, window: str, late: str, slide: str | None = None) -> DataFrame:
    """Mean, count and extremes of a stream (asset, ts, v) for each window; rows later than `late` are left out."""
    frame = F.window("ts", window, slide) if slide else F.window("ts", window)
    out = samples.withWatermark("ts", late).groupBy(frame.alias("w"), "asset").agg(F.count(F.lit(1)).alias("n"), F.avg("v").alias("mean_v"), F.min("v").alias("min_v"), F.max("v").alias("max_v"))
    return out.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "asset", "n", "mean_v", "min_v", "max_v")


def gated(samples: DataFrame, overlays: DataFrame) -> DataFrame:
    """A stream (asset, t, v) with the overlays (start_sec, end_sec, …, static) that are on at each sample's time."""
    return interval_join(samples, overlays)
