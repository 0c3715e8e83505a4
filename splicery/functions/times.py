"""Literals to seconds, numbers and sizes, as column expressions over a tagged value.

A value is a struct or columns: tag (string, int, float, bool, s, ms, frames, smpte, color, ident), s, i, d, b.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SMPTE = r"^\d\d:\d\d:\d\d:\d\d$"


def smpte_seconds(text: Column, fps: Column) -> Column:
    """HH:MM:SS:FF; no range check."""
    p = F.split(text, ":")
    n = lambda i: F.get(p, F.lit(i)).cast("double")
    return F.when(text.rlike(SMPTE), n(0) * 3600 + n(1) * 60 + n(2) + F.try_divide(n(3), fps.cast("double")))


def to_seconds(tag: Column, s: Column, i: Column, d: Column, fps: Column) -> Column:
    """Seconds of a time literal; null where the tag is not a time."""
    return (
        F.when(tag == "s", d)
        .when(tag == "ms", d / 1000)
        .when(tag == "frames", F.try_divide(i.cast("double"), fps.cast("double")))
        .when(tag == "smpte", smpte_seconds(s, fps))
        .when(tag == "int", i.cast("double"))
        .when(tag == "float", d)
    )


def to_number(tag: Column, i: Column, d: Column) -> Column:
    return F.when(tag == "float", d).when(tag == "int", i.cast("double"))


def to_count(tag: Column, i: Column) -> Column:
    """A non-negative integer modulo 2**32; null for others."""
    return F.when((tag == "int") & (i >= 0), i % 4294967296)


def resolution(text: Column) -> Column:
    """Struct (width, height) of "WxH": exactly two non-negative integers; else null."""
    return F.when(text.rlike(r"^\+?\d+x\+?\d+$"), F.struct(F.split(text, "x")[0].cast("long").alias("width"), F.split(text, "x")[1].cast("long").alias("height")))


def crop_filter(spec: Column) -> Column:
    """crop=w:h:x:y of "WxH+X+Y"; any other text goes in as it is, at 0:0."""
    whole = r"^([^x]*)x([^+]*)\+([^+]*)\+([^+]*)$"
    parts = [F.regexp_extract(spec, whole, k) for k in (1, 2, 3, 4)]
    return F.when(spec.rlike(whole), F.concat(F.lit("crop="), F.concat_ws(":", *parts))).otherwise(F.concat(F.lit("crop="), spec, F.lit(":0:0")))


def number_text(x: Column) -> Column:
    """A number the shortest way, without a trailing .0; exact for |x| below 1e15 and at least 1e-3 (or 0)."""
    return F.when(x == F.floor(x), F.floor(x).cast("bigint").cast("string")).otherwise(x.cast("string"))
