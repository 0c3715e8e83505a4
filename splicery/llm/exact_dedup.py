"""Exact deduplication by content sort, with DataFrame functions only.

Rows are range-partitioned by sampled splitters over (first characters, hash) of the normalised text,
sorted externally by the whole normalised text inside each range, and compared in full with their
neighbours there. A text that makes up more than 1/HOT_TEXTS of all rows (and more than `hot`) is cut
into slices of that size before the shuffle; each slice elects its own first row, and the slices' winners
meet in a second, small pass. There are fewer than HOT_TEXTS such texts: their hashes and winners are broadcast.

Defined results: null text counts as empty and all empty texts are equal. Repeated rows (same doc_id
and text) form a group of which exactly one row is kept; a null doc_id sorts last. An empty table
gives no rows. Other columns pass through untouched; the working columns carry a `_x_` prefix.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from splicery.llm.common import carried, without_white

#: Copies of a text from which it is cut into slices, at least; and the largest number of such texts.
HOT, HOT_TEXTS = 100, 100_000
PREFIX = 24


def exact_duplicates(docs: DataFrame, text: str = "text", key: str = "doc_id", hot: int = HOT) -> DataFrame:
    """Every row with keep_id, group_size, kept and text_sha256; `text` itself is not carried on.

    Of equal texts the row with the most code points in its original text stays, then the smallest key.
    """
    norm = without_white(F.coalesce(F.col(text), F.lit("")))
    made = (text, "keep_id", "group_size", "kept", "text_sha256")
    rows = docs.select(*carried(docs, *made), norm.alias("_x_norm"), F.char_length(F.coalesce(F.col(text), F.lit(""))).alias("_x_n"))
    rows = rows.withColumn("_x_h", F.xxhash64("_x_norm"))

    limit = max(hot, docs.count() // HOT_TEXTS)
    counts = rows.groupBy("_x_h").agg(F.count(F.lit(1)).alias("_x_c")).filter(F.col("_x_c") > limit)
    slice_of = F.pmod(F.xxhash64(key), F.ceil(F.col("_x_c") / limit))
    sliced = rows.join(F.broadcast(counts), "_x_h", "left").withColumn("_x_slice", F.coalesce(slice_of, F.lit(0)))

    def placed(part: DataFrame) -> DataFrame:
        ranged = part.withColumn("_x_p", F.substring("_x_norm", 1, PREFIX)).repartitionByRange("_x_p", "_x_h", "_x_slice")
        equal = Window.partitionBy("_x_p", "_x_h", "_x_slice", "_x_norm").orderBy(F.col("_x_n").desc(), F.col(key).asc_nulls_last())
        whole = equal.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        return ranged.withColumns(
            {
                "_x_rank": F.row_number().over(equal),
                "_x_first": F.first(F.struct("_x_n", key)).over(equal),
                "_x_size": F.count(F.lit(1)).over(whole),
                "text_sha256": F.sha2(F.col("_x_norm"), 256),
            }
        )

    # A hot text's slices: one row each, joined back by its SHA-256.
    winners = placed(sliced.filter("_x_c is not null")).filter("_x_rank = 1").groupBy("text_sha256").agg(
        F.min(F.struct(-F.col("_x_first._x_n"), F.col(f"_x_first.{key}").isNull(), F.col(f"_x_first.{key}").alias("id"))).alias("_x_top"),
        F.sum("_x_size").alias("_x_total"),
    )
    out = placed(sliced).join(F.broadcast(winners), "text_sha256", "left")
    hot_row = F.col("_x_total").isNotNull()
    return out.select(
        *carried(docs, *made),
        F.when(hot_row, F.col("_x_top.id")).otherwise(F.col(f"_x_first.{key}")).alias("keep_id"),
        F.coalesce("_x_total", "_x_size").alias("group_size"),
        ((F.col("_x_rank") == 1) & (~hot_row | F.col("_x_top.id").eqNullSafe(F.col(key)))).alias("kept"),
        "text_sha256",
    )
