"""Errors and warnings as relations: what a program's declarations break, in the order in which a compiler would stop."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from splicery.functions.values import violation

# The order of checking, the flip modes, the attributes that must be booleans, and those whose text counts only as a string.
STAGES = {"project": 1, "timeline": 2, "variable": 3, "asset": 5, "item": 6, "output": 7}
FLIPS = ("horizontal", "vertical", "both")
BOOLEANS = ("reverse", "normalize", "stabilize")
STRINGS = ("crop", "flip", "position", "fit", "font", "background", "type")


def string_value(key: Column, tag: Column, text: Column) -> Column:
    """An attribute's text; null, so that the default is kept, where a string is wanted and something else was given."""
    return F.when(key.isin(*STRINGS) & (tag != "string"), F.lit(None)).otherwise(text)


def key_colour(tag: Column, text: Column) -> Column:
    """A chroma key as the filter takes it: a colour literal gets its #; null for other types."""
    return F.when(tag == "color", F.concat(F.lit("#"), text)).when(tag == "string", text)


def truth(tag: Column, text: Column) -> Column:
    """A boolean attribute; null for other types."""
    return F.when(tag == "bool", text == "true")


def attribute_errors(attrs: DataFrame, rules: DataFrame) -> DataFrame:
    """(program_id, item_no, ord, error) of single attributes: attrs(program_id, item_no, kind, ord, key, tag, text, value); rules(kind, key, low, high, low_open)."""
    met = attrs.join(F.broadcast(rules), ["kind", "key"], "left")
    number = F.col("tag").isin("int", "float")
    ruled = F.col("low").isNotNull()
    clip = F.col("kind") == "clip"
    error = (
        F.when(clip & F.col("key").isin(*BOOLEANS) & (F.col("tag") != "bool"), "type_mismatch")
        .when(clip & (F.col("key") == "chromakey") & ~F.col("tag").isin("string", "color"), "type_mismatch")
        .when(clip & (F.col("key") == "flip") & (F.col("tag") == "string") & ~F.col("text").isin(*FLIPS), "invalid_value")
        .when(ruled & ~number, "type_mismatch")
        .when(ruled & violation(F.col("value"), F.col("low"), F.col("high"), F.col("low_open")), "invalid_value")
    )
    return met.select("program_id", "item_no", "ord", error.alias("error")).filter("error is not null")


def range_errors(attrs: DataFrame) -> DataFrame:
    """Clips whose last `from` is not before their last `to`; checked after all of the clip's attributes."""
    bounds = attrs.filter("kind = 'clip' and key in ('from', 'to')").groupBy("program_id", "item_no").agg(
        *[F.max_by(F.when(F.col("key") == k, F.col("value")), F.when(F.col("key") == k, F.col("ord"))).alias(k) for k in ("from", "to")], F.max("ord").alias("ord")
    )
    return bounds.filter(F.col("from") >= F.col("to")).select("program_id", "item_no", (F.col("ord") + 1000).alias("ord"), F.lit("invalid_time_range").alias("error"))


def program_errors(programs: DataFrame, projects: DataFrame, items: DataFrame, attrs: DataFrame, assets: DataFrame, rules: DataFrame) -> DataFrame:
    """(program_id, stage, item_no, ord, error): every error of every program. items(program_id, item_no, kind, asset)."""
    nobody = lambda df, error: df.select("program_id", F.lit(-1).alias("item_no"), F.lit(-1).alias("ord"), F.lit(error).alias("error"))
    staged = lambda df, stage: df.withColumn("stage", F.lit(STAGES[stage]))
    none = staged(nobody(programs.join(projects.select("program_id"), "program_id", "left_anti"), "no_project"), "project")
    bare = staged(nobody(programs.join(items.select("program_id").distinct(), "program_id", "left_anti"), "no_timeline"), "timeline")
    lost = items.filter("asset is not null").join(assets.select("program_id", F.col("name").alias("asset")), ["program_id", "asset"], "left_anti")
    gone = staged(lost.select("program_id", "item_no", F.lit(-1).alias("ord"), F.lit("undefined_asset").alias("error")), "item")
    own = staged(attribute_errors(attrs, rules).unionByName(range_errors(attrs)), "item")
    return none.unionByName(bare).unionByName(gone).unionByName(own).select("program_id", "stage", "item_no", "ord", "error")


def first_errors(errors: DataFrame) -> DataFrame:
    """The error at which each program stops: of the lowest stage the first in item and attribute order."""
    order = Window.partitionBy("program_id").orderBy("stage", "item_no", "ord")
    return errors.withColumn("_n", F.row_number().over(order)).filter("_n = 1").drop("_n")


def warnings(items: DataFrame, probe: DataFrame, fonts: DataFrame) -> DataFrame:
    """(program_id, item_no, warning): one for each asset of a program that no probe could read, at its first item, and one for each text whose font no file has."""
    read = probe.select("asset").distinct()
    unread = items.filter("asset is not null").join(read, "asset", "left_anti").groupBy("program_id", "asset").agg(F.min("item_no").alias("item_no"))
    files = fonts.filter("path is not null").select("family").distinct()
    missing = items.filter("font is not null").withColumn("family", F.col("font")).join(files, "family", "left_anti")
    probed = unread.select("program_id", "item_no", F.concat(F.lit("no probe of "), "asset").alias("warning"))
    return probed.unionByName(missing.select("program_id", "item_no", F.concat(F.lit("no font "), "family").alias("warning")))
