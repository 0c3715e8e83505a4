"""Tracks and the schedule: an ordered fold over items, written as windows.

A clip after a pending transition merges into what was there, overlapping it by the transition's length; without
anything before, it is dropped. Gaps and freezes are segments of their own and leave a transition pending.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def planned(items: DataFrame, *order: str, kind: str = "kind") -> DataFrame:
    """items with pending, action, offset_sec, start_sec and segment_no, null for what produces nothing; other columns pass through.

    Rows follow by `order` (item_no) inside a program. All windows have that one order: rows are shuffled and sorted once. A row that
    takes no part has a null in `kind`.
    """
    sequence = Window.partitionBy("program_id").orderBy(*(order or ("item_no",)))
    before, so_far = sequence.rowsBetween(Window.unboundedPreceding, -1), sequence.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    clip, length = F.col(kind) == "clip", F.col("length_sec")
    # The last transition since the last clip: a clip ends the wait with an empty mark.
    mark = F.when(clip, F.struct(F.lit(None).cast("double").alias("wait"))).when((F.col(kind) == "transition") & length.isNotNull(), F.struct(length.cast("double").alias("wait")))
    step1 = items.withColumn("pending", F.when(clip, F.last(mark, ignorenulls=True).over(before)["wait"]))
    waits = clip & F.col("pending").isNotNull()
    opens = F.coalesce(F.col(kind).isin("gap", "freeze") | (clip & F.col("pending").isNull()), F.lit(False))
    step2 = step1.withColumn("_x_opened", F.coalesce(F.bool_or(opens).over(before), F.lit(False)))
    step3 = step2.withColumn("action", F.when(waits, F.when(F.col("_x_opened"), "merge").otherwise("drop")).when(opens, "push"))
    delta = F.when(F.col("action") == "push", length).when(F.col("action") == "merge", length - F.col("pending")).otherwise(0.0)
    step4 = step3.withColumns({"_x_sum": F.coalesce(F.sum(delta).over(before), F.lit(0.0)), "_x_pushed": F.sum((F.coalesce("action", F.lit("")) == "push").cast("bigint")).over(so_far) - 1})
    offset = F.when(F.col("action") == "merge", F.greatest(F.col("_x_sum") - F.col("pending"), F.lit(0.0)))
    start = F.when(F.col("action") == "push", F.col("_x_sum")).when(F.col("action") == "merge", offset)
    return step4.select(*items.columns, "pending", "action", offset.alias("offset_sec"), start.alias("start_sec"), F.when(F.col("action") != "drop", F.col("_x_pushed")).alias("segment_no"))


def schedule(items: DataFrame) -> DataFrame:
    """Producing items (clip, gap, freeze) with action, offset_sec, start_sec and segment_no.

    items(program_id, item_no, kind, length_sec), length_sec being a transition's duration too. A loop counts once.
    """
    own = planned(items.select("program_id", "item_no", "kind", "length_sec")).filter("action is not null")
    return own.select("program_id", "item_no", "kind", "length_sec", "pending", "action", "offset_sec", "start_sec", "segment_no")


def totals(scheduled: DataFrame) -> DataFrame:
    """(program_id, total_sec, segments)."""
    delta = F.when(F.col("action") == "push", F.col("length_sec")).when(F.col("action") == "merge", F.col("length_sec") - F.col("pending")).otherwise(0.0)
    return scheduled.groupBy("program_id").agg(F.sum(delta).alias("total_sec"), F.count(F.when(F.col("action") == "push", 1)).alias("segments"))


def with_lengths(items: DataFrame, frozen: float = 3.0, gap: float = 1.0, transition: float = 1.0) -> DataFrame:
    """items with length_sec: of clips (to - from) / speed, of others their duration or its default."""
    told = (F.col("to_sec") - F.col("from_sec")) / F.coalesce("speed", F.lit(1.0))
    rest = F.coalesce("duration_sec", F.when(F.col("kind") == "gap", gap).when(F.col("kind") == "freeze", frozen).otherwise(transition))
    return items.withColumn("length_sec", F.when(F.col("kind") == "clip", told).otherwise(rest))


def keep_by_track(items: DataFrame) -> DataFrame:
    """items(track_kind, kind, …) that a track of their kind takes, with their layer: base, pip, image, subtitle, text."""
    pairs = {"video": None, "audio": ["clip"], "text": ["text"], "overlay": ["image", "pip", "subtitle"]}
    taken = F.lit(False)
    for track, kinds in pairs.items():
        taken = taken | ((F.col("track_kind") == track) & (F.lit(True) if kinds is None else F.col("kind").isin(kinds)))
    layer = F.when(F.col("track_kind") == "text", 4).when(F.col("track_kind") == "overlay", F.when(F.col("kind") == "pip", 1).when(F.col("kind") == "image", 2).otherwise(3)).otherwise(0)
    return items.filter(taken).withColumn("layer", layer.cast("bigint"))


def audio_routing(items: DataFrame) -> DataFrame:
    """items with `discard`: a program with any audio-track clip loses the sound of its video clips."""
    audio = (F.col("track_kind") == "audio") & (F.col("kind") == "clip")
    return items.withColumn("discard", F.bool_or(audio).over(Window.partitionBy("program_id")))
