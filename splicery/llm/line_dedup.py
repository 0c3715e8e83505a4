"""Line deduplication across documents.

Normalised lines are exploded, hashed to 128 bits and counted by distinct document; the lines of
frequent keys are dropped everywhere except in the largest doc_id that holds the key, and the
remaining lines are put together by position. Only (hash, row, position) triples are exploded; the
texts are shuffled once, to meet the positions that they lose.

Defined results: null or empty text is one empty line. A null doc_id never counts as a document and
never keeps a frequent line. Rows that repeat a doc_id count as one document. An empty table gives no
rows; extra columns pass through, the working columns carry a `_x_` prefix.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from splicery.llm.common import WHITE, carried, lower_ascii, stored

MIN_CHARS = 20
MIN_DOCS = 3


def dedup_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, text: str = "text", key: str = "doc_id") -> DataFrame:
    """docs with `text` replaced by the kept lines, plus n_lines and n_dropped."""
    body = F.coalesce(F.col(text), F.lit(""))
    lines = (
        docs.select(F.col(key).alias("_x_id"), F.xxhash64(body).alias("_x_t"), F.posexplode(F.split(body, "\n")).alias("_x_pos", "_x_line"))
        .withColumn("_x_line", F.btrim("_x_line", F.lit(WHITE)))
        .filter(F.char_length("_x_line") >= min_chars)
        .withColumn("_x_line", lower_ascii(F.col("_x_line")))
        .select("_x_id", "_x_t", "_x_pos", F.xxhash64("_x_line").alias("_x_a"), F.xxhash64(F.lit(29), "_x_line").alias("_x_b"))
    )
    frequent = (
        lines.groupBy("_x_a", "_x_b")
        .agg(F.countDistinct("_x_id").alias("_x_docs"), F.max("_x_id").alias("_x_keeper"))
        .filter(F.col("_x_docs") >= min_docs)
    )
    # Written, so that the join below has a plain shuffle on either side, which AQE can split for a hot line, or broadcast.
    frequent = stored(frequent, "frequent")
    lost = (
        lines.join(frequent, ["_x_a", "_x_b"])
        .filter(~F.col("_x_id").eqNullSafe(F.col("_x_keeper")))
        .groupBy("_x_id", "_x_t")
        .agg(F.collect_set("_x_pos").alias("_x_lost"))
    )
    rows = docs.withColumns({"_x_t0": F.xxhash64(body), "_x_body": body})
    met = rows.join(lost, F.col(key).eqNullSafe(F.col("_x_id")) & (F.col("_x_t0") == F.col("_x_t")), "left")
    split = met.withColumn("_x_lines", F.split("_x_body", "\n")).withColumn(
        "_x_kept", F.when(F.col("_x_lost").isNotNull(), F.array_except(F.sequence(F.lit(0), F.size("_x_lines") - 1), "_x_lost"))
    )
    kept = F.array_join(F.transform("_x_kept", lambda i: F.get("_x_lines", i)), "\n")
    return split.select(
        *carried(docs, text, "n_lines", "n_dropped"),
        F.coalesce(kept, F.col("_x_body")).alias(text),
        F.size("_x_lines").cast("long").alias("n_lines"),
        F.coalesce(F.size("_x_lines") - F.size("_x_kept"), F.lit(0)).cast("long").alias("n_dropped"),
    )
