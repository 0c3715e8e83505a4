"""Overlays: rows in an interval, closed at both ends, over a base signal."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def interval_join(samples: DataFrame, intervals: DataFrame, width: float = 1.0, time: str = "t", on: list[str] | None = None) -> DataFrame:
    """samples ⋈ intervals(start_sec, end_sec, …) where start <= t <= end.

    Both sides are cut into cells of `width` seconds: an equality join with a residual test, so that neither side is broadcast
    nor nested loops run over all pairs. An interval goes to every cell that it touches, a sample to one.
    """
    cells = F.sequence(F.floor(F.col("start_sec") / width), F.floor(F.col("end_sec") / width))
    dealt = intervals.filter("start_sec <= end_sec").withColumn("cell", F.explode(cells))
    met = samples.withColumn("cell", F.floor(F.col(time) / width)).join(dealt, [*(on or []), "cell"])
    return met.filter((F.col(time) >= F.col("start_sec")) & (F.col(time) <= F.col("end_sec"))).drop("cell")


def text_alpha(t: Column, start: Column, end: Column, fade_in: Column, fade_out: Column) -> Column:
    """Opacity of a text: ramps at its ends, the first tested first; 1 elsewhere."""
    rising = fade_in.isNotNull() & (t < start + fade_in)
    falling = fade_out.isNotNull() & (t > end - fade_out)
    return F.when(rising, F.try_divide(t - start, fade_in)).when(falling, F.try_divide(end - t, fade_out)).otherwise(F.lit(1.0))


def blend(v: Column, image: Column, opacity: Column) -> Column:
    return v * (1 - opacity) + image * opacity


def cues_of(turns: DataFrame, pace: float) -> DataFrame:
    """Subtitle cues of conversations: each turn begins when the one before has been read at `pace` characters a second."""
    from pyspark.sql import Window

    before = Window.partitionBy("conv_id").orderBy("turn", "role", "text").rowsBetween(Window.unboundedPreceding, -1)
    length = F.char_length(F.coalesce("text", F.lit("")))
    start = F.coalesce(F.sum(length).over(before), F.lit(0)) / F.lit(pace)
    return turns.select("conv_id", "turn", start.alias("start_sec"), (start + length / F.lit(pace)).alias("end_sec"))


def frames_of(intervals: DataFrame, fps: int) -> DataFrame:
    """A row for each frame of each interval(start_sec, end_sec, …), closed at both ends; the clock runs as far as the intervals do."""
    reached = F.sequence(F.floor(F.col("start_sec") * fps), F.ceil(F.col("end_sec") * fps))
    at = F.col("frame") / F.lit(float(fps))
    return intervals.filter("start_sec <= end_sec").withColumn("frame", F.explode(reached)).filter((at >= F.col("start_sec")) & (at <= F.col("end_sec")))
