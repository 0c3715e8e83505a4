"""Sources: sampled signals, programs as item rows, probe reports, parameters, subtitles, progress lines, fonts."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

ORIGIN = "2024-01-01 00:00:00"
#: Bytes of a stored table for each partition that it is dealt into by program.
PIECE_BYTES = 2 << 20
PROBE = "format struct<duration: string>, streams array<struct<codec_type: string, codec_name: string, width: int, height: int>>"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def by_program(spark: SparkSession, sf_dir: str, name: str, key: str) -> DataFrame:
    """The table with `key` as program_id. One of more pieces of PIECE_BYTES than cores is dealt by it into these pieces.

    A task's sorts then do not grow with the table. Left to itself, an adaptive plan merges partitions up to its own size.
    """
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{sf_dir}/{name}.parquet")
    size = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getContentSummary(path).getLength()
    rows, pieces = table(spark, sf_dir, name).withColumnRenamed(key, "program_id"), math.ceil(size / PIECE_BYTES)
    return rows.repartition(pieces, "program_id") if pieces > spark.sparkContext.defaultParallelism else rows


def signal(spark: SparkSession, sf_dir: str, start: float | None = None, end: float | None = None) -> DataFrame:
    """events as samples (asset, event_id, user_id, t, v): a day is a second. Bounds go to the scan as literals on ts."""
    rows = table(spark, sf_dir, "events")
    bound = lambda t: F.expr(f"timestampadd(MICROSECOND, {round(t * 86400 * 1_000_000)}, TIMESTAMP_NTZ '{ORIGIN}')")
    if start is not None:
        rows = rows.filter(F.col("ts") >= bound(start))
    if end is not None:
        rows = rows.filter(F.col("ts") < bound(end))
    t = F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ '{ORIGIN}', ts)") / F.lit(1e6) / F.lit(86400.0)
    return rows.select(F.col("event_type").alias("asset"), "event_id", "user_id", t.alias("t"), F.col("value").alias("v"))


def frames(samples: DataFrame, fps: int, *keys: str) -> DataFrame:
    """Mean sample of each frame. Sums run in whole hundredths, so they do not depend on the order of rows."""
    cents = F.sum(F.round(F.col("v") * 100).cast("bigint"))
    return samples.groupBy(*keys, F.floor(F.col("t") * fps).cast("bigint").alias("frame")).agg((cents / (F.count(F.lit(1)) * F.lit(100.0))).alias("v"))


def line_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A program for each order: its line items, in order, are clips, transitions, gaps and freezes of a video track."""
    k = (F.col("l_partkey") + F.col("l_suppkey") + F.col("l_linenumber")) % 8
    kind = F.when(k < 2, "transition").when(k == 2, "gap").when(k == 3, "freeze").otherwise("clip")
    order = Window.partitionBy("program_id").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_shipdate")
    start = (F.col("l_partkey") % 20) / 2.0
    return by_program(spark, sf_dir, "lineitem", "l_orderkey").select(
        "program_id",
        F.row_number().over(order).cast("bigint").alias("item_no"),
        kind.alias("kind"),
        F.concat(F.lit("a"), (F.col("l_suppkey") % 5).cast("string")).alias("asset"),
        start.alias("from_sec"),
        (start + F.col("l_quantity") / 2).alias("to_sec"),
        F.when(F.col("l_partkey") % 4 == 0, 2.0).when(F.col("l_partkey") % 4 == 1, 0.5).alias("speed"),
        F.when(kind == "transition", F.col("l_linenumber") / 4.0).when(kind == "gap", F.col("l_quantity") / 4).when(kind == "freeze", F.col("l_quantity") / 8).alias("duration_sec"),
    )


def parse_probe(report: Column) -> Column:
    """Struct of a probe's JSON report: duration (0 if unreadable), has_video, has_audio, and the last video stream's size."""
    p = F.from_json(report, PROBE)
    video = F.filter(p["streams"], lambda s: s["codec_type"] == "video")
    last = F.try_element_at(video, F.lit(-1))
    return F.struct(
        F.coalesce(p["format"]["duration"].try_cast("double"), F.lit(0.0)).alias("duration_sec"),
        F.coalesce(F.size(video) > 0, F.lit(False)).alias("has_video"),
        F.coalesce(F.exists(p["streams"], lambda s: s["codec_type"] == "audio"), F.lit(False)).alias("has_audio"),
        last["width"].alias("width"),
        last["height"].alias("height"),
    )


def read_params(spark: SparkSession, path: str) -> DataFrame:
    """Batch parameters: the header names them, values stay strings, a malformed row stops the batch."""
    return spark.read.csv(path, header=True, mode="FAILFAST")


def read_cues(spark: SparkSession, path: str) -> DataFrame:
    """SubRip files as (path, start_sec, end_sec, content), one row a cue."""
    blocks = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.explode(F.split(F.replace(F.col("value"), F.lit("\r")), r"\n\s*\n")).alias("block"))
    clock = r"(\d+):(\d\d):(\d\d)[,.](\d{1,3})"
    line = rf"(?s){clock}\s*-->\s*{clock}[^\n]*\n?(.*)"
    part = lambda k: F.regexp_extract("block", line, k).cast("double")
    seconds = lambda k: part(k) * 3600 + part(k + 1) * 60 + part(k + 2) + part(k + 3) / 1000
    found = blocks.filter(F.col("block").rlike(clock + r"\s*-->"))
    return found.select("path", seconds(1).alias("start_sec"), seconds(5).alias("end_sec"), F.btrim(F.regexp_extract("block", line, 9), F.lit(" \t\n")).alias("content"))


def parse_progress(line: Column) -> Column:
    """Struct (frame, fps, time_sec, speed) of an encoder's progress line; null unless it has frame= and time=."""
    value = lambda key, kind: F.coalesce(F.regexp_extract(line, rf"(?:^|\s){key}=\s*([0-9.:]+)", 1).try_cast(kind), F.lit(0).cast(kind))
    clock = F.split(F.regexp_extract(line, r"(?:^|\s)time=\s*([0-9.:]+)", 1), ":")
    at = lambda i: F.coalesce(F.get(clock, F.lit(i)).try_cast("double"), F.lit(0.0))
    time = F.when(F.size(clock) == 3, at(0) * 3600 + at(1) * 60 + at(2)).otherwise(at(0))
    whole = F.struct(value("frame", "bigint").alias("frame"), value("fps", "double").alias("fps"), time.alias("time_sec"), value("speed", "double").alias("speed"))
    return F.when(line.contains("frame=") & line.contains("time="), whole)


def match_fonts(wanted: DataFrame, fonts: DataFrame) -> DataFrame:
    """wanted(family) with path: of the files of a family an exact or "regular" stem wins, then the shortest stem with the family as its beginning."""
    stem = F.lower(F.regexp_extract("path", r"([^/\\]*)\.(?i:ttf|otf)$", 1))
    files = fonts.select("path", stem.alias("stem")).filter("stem <> ''")
    family = F.lower("family")
    exact = (F.col("stem") == family) | (F.col("stem") == F.concat(family, F.lit(" regular"))) | (F.col("stem") == F.concat(family, F.lit("-regular")))
    # A file goes to every beginning of its stem: an equality join instead of all families against all files.
    starts = files.withColumn("start", F.explode(F.transform(F.sequence(F.lit(1), F.length("stem")), lambda n: F.left("stem", n))))
    near = wanted.select("family").filter("family <> ''").distinct().withColumn("start", family).join(starts, "start")
    best = near.groupBy("family").agg(F.min(F.struct((~exact).alias("far"), F.length("stem").alias("n"), "path")).alias("top"))
    return wanted.join(best.select("family", F.col("top.path").alias("path")), "family", "left")


def probe_with_cache(files: DataFrame, cache: DataFrame) -> DataFrame:
    """files(path, mtime_secs, file_size) with the cached info and whether it is a hit: same path, second and size."""
    known = cache.select("path", F.col("mtime_secs").alias("m"), F.col("file_size").alias("z"), "info")
    hit = (F.col("m") == F.col("mtime_secs")) & (F.col("z") == F.col("file_size"))
    return files.join(known, "path", "left").select("path", F.coalesce(hit, F.lit(False)).alias("hit"), F.when(hit, F.col("info")).alias("info"))
