"""Attributes to resolved items: substitution, last value, defaults, rules, references, media lengths."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from splicery.functions.values import UNKNOWN_LENGTH, violation
from splicery.sources.shared import shared_dir, stored


def substitute(attrs: DataFrame, variables: DataFrame) -> DataFrame:
    """attrs(program_id, item_no, ord, key, tag, text) with identifiers replaced, one level; `undefined` marks unknown names."""
    known = variables.select("program_id", F.col("name").alias("ref"), F.col("tag").alias("var_tag"), F.col("text").alias("var_text"))
    ident = F.col("tag") == "ident"
    met = attrs.withColumn("ref", F.when(ident, F.col("text"))).join(known, ["program_id", "ref"], "left")
    found = F.col("var_tag").isNotNull()
    return met.select(
        "program_id", "item_no", "ord", "key", F.when(found, F.col("var_tag")).otherwise(F.col("tag")).alias("tag"),
        F.when(found, F.col("var_text")).otherwise(F.col("text")).alias("text"), (ident & ~found).alias("undefined"),
    )


def last_values(attrs: DataFrame, *keys: str, value: str = "value") -> DataFrame:
    """One row an item with a column for each key: of repeated keys the last counts, unknown keys are skipped."""
    return attrs.groupBy("program_id", "item_no").agg(*[F.max_by(F.when(F.col("key") == k, F.col(value)), F.when(F.col("key") == k, F.col("ord"))).alias(k) for k in keys])


def rule_errors(attrs: DataFrame, rules: DataFrame) -> DataFrame:
    """Attributes (…, key, value) outside their rule."""
    met = attrs.join(F.broadcast(rules), "key")
    return met.filter(violation(F.col("value"), F.col("low"), F.col("high"), F.col("low_open"))).drop("low", "high", "low_open")


def undefined_references(items: DataFrame, assets: DataFrame) -> DataFrame:
    """Items whose asset nobody declares."""
    return items.filter(F.col("asset").isNotNull()).join(assets.select("program_id", F.col("name").alias("asset")), ["program_id", "asset"], "left_anti")


def duplicates(definitions: DataFrame, *keys: str) -> DataFrame:
    """Names that are declared more than once, with the count."""
    return definitions.groupBy(*keys).agg(F.count(F.lit(1)).alias("times")).filter("times > 1")


def raw_length(duration: Column, start: Column, end: Column) -> Column:
    """Length before speed as far as the item tells it: duration, else to - from; `to` alone tells nothing."""
    return F.coalesce(duration, end - start)


def media_lengths(items: DataFrame, probe: DataFrame) -> DataFrame:
    """Clips with has_audio, resolved_sec (null if unknown) and estimate_sec.

    resolved: duration, to - from, probe - from, probe; over speed. estimate: resolved, else duration, to - from or 10, over speed.
    """
    met = items.join(probe.select(F.col("asset"), F.col("probe_sec"), F.col("has_audio").alias("probe_audio")), "asset", "left")
    speed = F.coalesce("speed", F.lit(1.0))
    told = raw_length(F.col("duration_sec"), F.col("from_sec"), F.col("to_sec"))
    resolved = F.coalesce(told, F.col("probe_sec") - F.col("from_sec"), F.col("probe_sec")) / speed
    return met.select(
        *items.columns, F.coalesce("probe_audio", F.lit(True)).alias("has_audio"), resolved.alias("resolved_sec"),
        F.coalesce(resolved, F.coalesce(told, F.lit(UNKNOWN_LENGTH)) / speed).alias("estimate_sec"),
    )


def input_numbers(uses: DataFrame) -> DataFrame:
    """(program_id, asset, input_no): assets by first use. uses(program_id, asset, kind_rank, item_no)."""
    first = uses.groupBy("program_id", "asset").agg(F.min(F.struct("kind_rank", "item_no")).alias("first"))
    return first.select("program_id", "asset", (F.row_number().over(Window.partitionBy("program_id").orderBy("first", "asset")) - 1).cast("bigint").alias("input_no"))


def with_input_numbers(items: DataFrame) -> DataFrame:
    """items with input_no as input_numbers() gives it, null where no use names the asset: rows stay with their program, without a join.

    items(program_id, asset, kind_rank, item_no); rows without a kind_rank are no uses.
    """
    use = F.when(F.col("kind_rank").isNotNull(), F.struct("kind_rank", "item_no"))
    rows = items.withColumn("_x_first", F.min(use).over(Window.partitionBy("program_id", "asset")))
    number = F.dense_rank().over(Window.partitionBy("program_id").orderBy(F.col("_x_first").asc_nulls_last(), "asset"))
    known = F.col("_x_first").isNotNull() & F.col("asset").isNotNull()
    return rows.withColumn("_x_number", number).select(*items.columns, F.when(known, (F.col("_x_number") - 1).cast("bigint")).alias("input_no"))


def merged_fragments(fragments: DataFrame, edges: DataFrame, roots: DataFrame) -> DataFrame:
    """(root, fragment) that a root's includes reach, however long the chain; a fragment that is reached again is skipped.

    Each round's new rows are a written table, and all rows so far are written together every 16 rounds: plans stay short.
    """
    where, turn = shared_dir(edges.sparkSession), 0
    seen = roots.select("root", F.col("root").alias("fragment")).distinct()
    front = seen
    while True:
        front = front.join(edges.select(F.col("source").alias("fragment"), "target"), "fragment").select("root", F.col("target").alias("fragment")).distinct()
        front = front.join(seen, ["root", "fragment"], "left_anti").join(fragments.select("fragment"), "fragment", "left_semi").select("root", "fragment")
        front, turn = stored(front, f"front{turn}", where), turn + 1
        if front.isEmpty():
            return seen
        seen = seen.unionByName(front)
        if turn % 16 == 0:
            seen = stored(seen, f"seen{turn}", where)


def outputs(programs: DataFrame, wanted: DataFrame, default_path: str = "output.mp4") -> DataFrame:
    """A row for each output of a program: its own size, format, codec and quality over the project's; one default without any."""
    own = wanted.select("program_id", "path", *[F.col(c).alias(f"own_{c}") for c in ("width", "height", "format", "codec", "quality")])
    met = programs.join(own, "program_id", "left")
    return met.select(
        "program_id", F.coalesce("path", F.lit(default_path)).alias("path"), "fps", *[F.coalesce(f"own_{c}", c).alias(c) for c in ("width", "height", "format", "codec", "quality")]
    )


def batch_rows(params: DataFrame, attrs: DataFrame) -> DataFrame:
    """The template's attributes for each parameter row: an identifier that names a parameter gets its value.

    params(row_no, name, value) is long; output rows are named row_1.mp4 and on.
    """
    rows = params.select("row_no").distinct()
    values = params.select("row_no", F.col("name").alias("ref"), F.col("value").alias("param"))
    # The template is small by nature: it is repeated for every row.
    many = rows.crossJoin(F.broadcast(attrs)).withColumn("ref", F.when(F.col("tag") == "ident", F.col("text")))
    return many.join(values, ["row_no", "ref"], "left").select(
        "row_no", F.concat(F.lit("row_"), F.col("row_no").cast("string"), F.lit(".mp4")).alias("path"), "item_no", "key",
        F.coalesce("param", "text").alias("text"), ((F.col("tag") == "ident") & F.col("param").isNull()).alias("failed"),
    )
