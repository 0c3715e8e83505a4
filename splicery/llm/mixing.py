"""Mixing sources to target weights as a time-varying curriculum.

Each source has a weight schedule over training time t in [0, 1], a line whose integral is the
source's share. Integrated and scaled to the source's target it is the cumulative token demand D(t);
a document occurrence that begins after c words of its source is placed where D(t) = c. Occurrences
are then range-sorted by position. A source whose target exceeds its size repeats whole passes, up to
`repeats`; the last word of the target may fall inside a document, of which only the first words are
taken there.

The running count of words is a two-level prefix sum over 4096 hash buckets a source, so that no
source, however large, is in one task. Order inside a source is that of MD5(doc_id): reruns agree.

Sources are ranked and weighed in one task: a table of one row a source, taken to have at most some hundred thousand.

Defined results: null text has size 0 and is taken 0 times, without positions; null is a source of its own, the last;
rows that repeat a doc_id are separate documents; an empty table gives no rows. Extra columns pass
through, an input column named like an output column is replaced; the working columns carry a `_x_` prefix.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from splicery.llm.common import WHITE, carried

WEIGHTS = (5.0, 2.0, 1.0)
#: Change of a weight from its mean to the end of training, for each of WEIGHTS: heavy sources fade, light ones grow.
SLOPES = (-0.5, 0.25, 0.75)
REPEATS = 3


def word_count(text):
    """Number of [^\\x20\\x09-\\x0D]+ in the text; null: 0."""
    # Every word but the last ends at a white character that follows a word character.
    t = F.btrim(F.coalesce(text, F.lit("")), F.lit(WHITE))
    return F.when(t == "", F.lit(0)).otherwise(F.regexp_count(t, F.lit("[\\x20\\x09-\\x0D]+")) + 1).cast("long")


def source_targets(sizes: DataFrame, weights=WEIGHTS, slopes=SLOPES, repeats: int = REPEATS) -> DataFrame:
    """(_x_s, source, source_size) with weight, slope and target: 100% of all words shared by weight, none above repeats x size.

    Sharing the excess again until none is above ends at one water level: target = min(repeats * size,
    level * weight). With sources sorted by repeats * size / weight, the level is the first candidate that
    leaves its own source uncapped.
    """
    n = len(weights)
    everything = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    pick = lambda xs, i: F.element_at(F.array(*[F.lit(float(x)) for x in xs]), i)
    ranked = sizes.withColumn("_x_i", (F.pmod(F.row_number().over(by_name) - 1, F.lit(n)) + 1).cast("int"))
    ranked = ranked.withColumns({"weight": pick(weights, F.col("_x_i")), "slope": pick(slopes, F.col("_x_i")), "_x_all": F.sum("source_size").over(everything)})
    by_cap = Window.orderBy((repeats * F.col("source_size") / F.col("weight")).asc(), F.col("source").asc_nulls_last())
    before = by_cap.rowsBetween(Window.unboundedPreceding, -1)
    after = by_cap.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    level = (F.col("_x_all") - F.coalesce(F.sum(repeats * F.col("source_size")).over(before), F.lit(0))) / F.sum("weight").over(after)
    found = ranked.withColumn("_x_level", level)
    fits = F.col("_x_level") * F.col("weight") <= repeats * F.col("source_size")
    found = found.withColumn("_x_water", F.min(F.when(fits, F.struct((repeats * F.col("source_size") / F.col("weight")).alias("k"), F.col("_x_level").alias("level")))).over(everything))
    target = F.least(F.lit(float(repeats)) * F.col("source_size"), F.col("_x_water.level") * F.col("weight"))
    return found.select("_x_s", "source", "source_size", "weight", "slope", F.coalesce(target, F.lit(0.0)).alias("target"))


def mix(docs: DataFrame, weights=WEIGHTS, slopes=SLOPES, repeats: int = REPEATS, text: str = "text", key: str = "doc_id", source: str = "source") -> DataFrame:
    """docs with size, source_size, target, taken, occurrences (an array of (words, position), one entry for each use) and the
    position in training time of the first and the last use."""
    made = ("size", "source_size", "target", "taken", "occurrences", "first_position", "last_position")
    rows = docs.select(*carried(docs, *made)).withColumns(
        {
            "size": word_count(F.col(text)),
            "_x_s": F.coalesce(F.concat(F.lit("="), F.col(source)), F.lit("")),  # never null: the window and the join share one shuffle
            "_x_m": F.md5(F.coalesce(F.col(key).cast("string"), F.lit(""))),
        }
    ).withColumn("_x_b", F.substring("_x_m", 1, 3))
    # Two levels, so that no task holds a source.
    buckets = rows.groupBy("_x_s", "_x_b").agg(F.first(source).alias("source"), F.sum("size").alias("_x_sum"))
    sizes = buckets.groupBy("_x_s").agg(F.first("source").alias("source"), F.sum("_x_sum").alias("source_size"))
    targets = source_targets(sizes, weights, slopes, repeats)
    ahead = Window.partitionBy("_x_s").orderBy("_x_b").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        buckets.withColumn("_x_from", F.coalesce(F.sum("_x_sum").over(ahead), F.lit(0)))
        .drop("source")
        .join(targets, "_x_s")
        .select("_x_s", "_x_b", "_x_from", "source_size", F.col("slope").alias("_x_slope"), "target")
    )
    run = Window.partitionBy("_x_s", "_x_b").orderBy("_x_m", key, "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.withColumn("_x_run", F.coalesce(F.sum("size").over(run), F.lit(0))).join(starts, ["_x_s", "_x_b"])
    whole = F.floor(F.col("target") + 0.5)
    begin = F.col("_x_from") + F.col("_x_run")

    def use(p):
        c = p * F.col("source_size") + begin
        words = F.greatest(F.lit(0), F.least(F.col("size"), whole - c)).cast("long")
        return F.struct(words.alias("words"), position(F.try_divide(c, F.col("target")), F.col("_x_slope")).alias("position"))

    uses = F.filter(F.transform(F.sequence(F.lit(0), F.lit(repeats - 1)), lambda p: use(p)), lambda u: u["words"] > 0)
    out = placed.withColumn("occurrences", uses)
    taken = F.aggregate("occurrences", F.lit(0).cast("long"), lambda a, u: a + u["words"])
    ends = [F.try_element_at("occurrences", F.lit(i))["position"].alias(n) for i, n in ((1, "first_position"), (-1, "last_position"))]
    return out.select(*carried(docs, *made), "size", "source_size", "target", taken.alias("taken"), "occurrences", *ends)


def position(done, slope):
    """The t in [0, 1] where t + slope * (t * t - t), the integral of 1 + slope * (2t - 1), equals `done`."""
    # The stable root of slope * t^2 + (1 - slope) * t - done = 0 for any |slope| < 1, 0 included.
    b = 1 - slope
    return F.try_divide(2 * done, b + F.sqrt(b * b + 4 * slope * done))


def in_training_order(mixed: DataFrame, key: str = "doc_id") -> DataFrame:
    """mix()'s documents range-sorted by the position of their first use; those without a use come last."""
    order = [F.col("first_position").asc_nulls_last(), F.col(key).asc_nulls_last()]
    return mixed.repartitionByRange(*order).sortWithinPartitions(*order)


def mixed_stream(mixed: DataFrame, docs_columns: list[str], text: str = "text", key: str = "doc_id", whole: bool = False) -> DataFrame:
    """One row for each use, in training order: range-sorted by position. A use of fewer words has the text's first ones.

    With `whole` no text is cut: such a use is taken whole if that brings its source no farther from the target than leaving it out.
    """
    used = mixed.withColumn("_x_u", F.explode("occurrences"))
    if whole:
        used = used.filter(2 * F.col("_x_u.words") >= F.col("size")).withColumn("_x_u", F.col("_x_u").withField("words", F.col("size")))
    first_words = F.expr(f"array_join(slice(split(btrim({text}, ' \\t\\n\\u000b\\f\\r'), '[\\\\x20\\\\x09-\\\\x0D]+'), 1, cast(_x_u.words as int)), ' ')")
    body = F.when(F.col("_x_u.words") < F.col("size"), first_words).otherwise(F.col(text))
    return (
        used.withColumn(text, body)
        .repartitionByRange(F.col("_x_u.position"), F.col(key))
        .sortWithinPartitions(F.col("_x_u.position"), F.col(key))
        .select(*docs_columns)
    )
