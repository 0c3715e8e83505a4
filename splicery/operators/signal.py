"""Timeline operators on sampled signals: rows (…, t, v), t in seconds of the clip, v the sample.

Where an operator looks at neighbours it works on frames (one row a key and frame), whose number is bounded by the
length of the timeline, not by the number of samples.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def rebase(samples: DataFrame, start: float | None, end: float | None) -> DataFrame:
    """[start, end) of a signal, from 0 on; either bound may be missing."""
    out = samples
    if start is not None:
        out = out.filter(F.col("t") >= start)
    if end is not None:
        out = out.filter(F.col("t") < end)
    return out.withColumn("t", F.col("t") - (start or 0.0))


def place(samples: DataFrame, segments: DataFrame, *carry: str) -> DataFrame:
    """Samples of each segment's asset between its bounds, on the program's clock.

    segments(program_id, segment_no, asset, from_sec, to_sec, start_sec, …) is the smaller side. It is dealt to whole
    seconds, so that the match is an equality on (asset, second) and no segment meets samples outside it.
    """
    seconds = segments.withColumn("second", F.explode(F.sequence(F.floor("from_sec"), F.greatest(F.floor("from_sec"), F.ceil("to_sec") - 1))))
    met = samples.withColumn("second", F.floor("t")).join(seconds, ["asset", "second"])
    inside = (F.col("t") >= F.col("from_sec")) & (F.col("t") < F.col("to_sec"))
    local = F.col("t") - F.col("from_sec")
    return met.filter(inside).select("program_id", "segment_no", "asset", "event_id", local.alias("t_local"), (F.col("start_sec") + local).alias("t"), "v", *carry)


def rescale(samples: DataFrame, speed: float) -> DataFrame:
    return samples.withColumn("t", F.col("t") / speed)


def backward(samples: DataFrame, length: float) -> DataFrame:
    return samples.withColumn("t", length - F.col("t"))


def repeated(samples: DataFrame, times: int, length: float) -> DataFrame:
    """`times` copies one after another, with their number."""
    out = samples.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(times - 1))))
    return out.withColumn("t", F.col("t") + F.col("copy") * F.lit(length))


def generated(spark, start: float, length: float, fps: int) -> DataFrame:
    """Frames of a gap: value 0."""
    first, last = round(start * fps), round((start + length) * fps)
    return spark.range(first, last).select(F.col("id").alias("frame"), F.lit(0.0).alias("v"))


def gap_filled(frames: DataFrame, keys: DataFrame, first: int, last: int) -> DataFrame:
    """Every frame for each row of keys, from first to last - 1 and on to the last one of `frames`; missing frames are 0."""
    names = keys.columns
    # One row: the end is the same for all keys.
    end = frames.agg(F.greatest(F.max("frame"), F.lit(last - 1)).alias("_end"))
    grid = keys.crossJoin(F.broadcast(end)).withColumn("frame", F.explode(F.sequence(F.lit(first).cast("bigint"), F.col("_end").cast("bigint"))))
    return grid.join(frames, [*names, "frame"], "left").select(*names, "frame", F.coalesce("v", F.lit(0.0)).alias("v"))


def freeze(samples: DataFrame, at: float, length: float, fps: int) -> DataFrame:
    """For each asset its first sample at or after `at` (else its last), on every frame of `length`."""
    late = F.col("t") >= at
    held = samples.groupBy("asset").agg(
        F.min(F.when(late, F.struct("t", "event_id", "v"))).alias("next"), F.max(F.struct("t", "event_id", "v")).alias("last")
    )
    held = held.select("asset", F.coalesce("next", "last")["v"].alias("v"))
    return held.withColumn("frame", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(round(length * fps) - 1).cast("bigint"))))


def crossfaded(outgoing: DataFrame, incoming: DataFrame, offset: float, length: float, fps: int) -> DataFrame:
    """Frames of two signals, the second from `offset` on; in the overlap of `length` their weights are linear and add up to 1."""
    x = lambda: (F.col("frame") / F.lit(float(fps)) - offset) / length
    ramp = F.greatest(F.lit(0.0), F.least(F.lit(1.0), x()))
    a = outgoing.filter(F.col("frame") < (offset + length) * fps).withColumn("w", 1.0 - ramp)
    shift = round(offset * fps)
    b = incoming.withColumn("frame", F.col("frame") + F.lit(shift)).withColumn("w", ramp)
    merged = a.select("frame", (F.col("v") * F.col("w")).alias("wv"), "w", F.lit(0).alias("side")).unionByName(b.select("frame", (F.col("v") * F.col("w")).alias("wv"), "w", F.lit(1).alias("side")))
    both = merged.groupBy("frame").agg(*[F.sum(F.when(F.col("side") == s, F.col(c))).alias(f"{c}{s}") for s in (0, 1) for c in ("wv", "w")])
    total = lambda c: F.coalesce(f"{c}0", F.lit(0.0)) + F.coalesce(f"{c}1", F.lit(0.0))
    return both.select("frame", F.try_divide(total("wv"), total("w")).alias("v"))


def mixed_sound(frames: DataFrame) -> DataFrame:
    """Mean over the clips that sound in a frame; all begin at 0. Sums are decimal: they do not depend on the order of rows."""
    return frames.groupBy("frame").agg((F.sum(F.col("v").cast("decimal(30,12)")).cast("double") / F.count("v")).alias("v"), F.count("v").alias("clips"))


def fade_gain(t: Column, length: float, fade_in: float | None, fade_out: float | None) -> Column:
    gain = F.lit(1.0)
    if fade_in:
        gain = gain * F.least(F.lit(1.0), t / fade_in)
    if fade_out:
        gain = gain * F.greatest(F.lit(0.0), F.least(F.lit(1.0), (length - t) / fade_out))
    return gain


def tempo_steps(factor: Column) -> Column:
    """Factors between 0.5 and 100 whose product is `factor`: halves or hundreds first, then the rest."""
    down = F.when(factor < 0.5, F.ceil(F.log2(0.5 / factor)).cast("int")).otherwise(0)
    up = F.when(factor > 100, F.ceil(F.log10(factor) / 2).cast("int") - 1).otherwise(0)
    rest = factor * F.pow(F.lit(2.0), down) / F.pow(F.lit(100.0), up)
    return F.concat(F.array_repeat(F.lit(0.5), down), F.array_repeat(F.lit(100.0), up), F.array(rest))


def normalised(samples: DataFrame) -> DataFrame:
    """v over the largest |v| of its asset: the peaks are one row an asset."""
    peaks = samples.groupBy("asset").agg(F.max(F.abs("v")).alias("peak"))
    return samples.join(peaks, "asset").withColumn("v", F.try_divide("v", "peak")).drop("peak")


def graded(frames: DataFrame, brightness: float = 0.0, contrast: float = 1.0, saturation: float = 1.0) -> DataFrame:
    """(v / largest - 0.5) * contrast + 0.5 + brightness, for each asset; then mean + (v - mean) * saturation, for each frame."""
    peaks = frames.groupBy("asset").agg(F.max("v").alias("peak"))
    out = frames.join(peaks, "asset").withColumn("v", (F.col("v") / F.col("peak") - 0.5) * contrast + 0.5 + brightness).drop("peak")
    if saturation == 1:
        return out
    means = mixed_sound(out).select("frame", F.col("v").alias("mean"))
    return out.join(means, "frame").withColumn("v", F.col("mean") + (F.col("v") - F.col("mean")) * saturation).select(*out.columns)


def blur_radius(strength: Column) -> Column:
    return F.least(F.greatest(strength / 5, F.lit(1.0)), F.lit(20.0)).cast("int")


def moving_mean(frames: DataFrame, radius: int) -> Column:
    return F.avg("v").over(Window.partitionBy("asset").orderBy("frame").rowsBetween(-radius, radius))


def blurred(frames: DataFrame, radius: int) -> DataFrame:
    return frames.withColumn("v", moving_mean(frames, radius))


def sharpened(frames: DataFrame, amount: float) -> DataFrame:
    return frames.withColumn("v", F.col("v") + amount * (F.col("v") - moving_mean(frames, 2)))


def zoom_at(frame: Column, total: int, peak: float) -> Column:
    """Zoom of a frame: up over the first 30 %, held, and down over the last 30 %."""
    f1, f2 = int(total * 0.30), int(total * 0.70)
    f3 = total - f2
    up = F.lit(1.0) + F.try_divide(frame.cast("double"), F.lit(float(f1))) * (peak - 1.0)
    down = F.lit(peak) - (frame - f2) / F.lit(float(f3)) * (peak - 1.0)
    return F.when(frame < f1, up).when(frame < f2, F.lit(peak)).otherwise(down)
