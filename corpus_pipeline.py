"""The corpus pipeline: toxicity, line dedup, near-dedup, mixing, pieces.

Each stage is (name, function of (spark, docs, sf_dir)); its result is written as Parquet and read again as the
next stage's docs. Every stage but the last returns the columns of documents. No SQL expresses the first stage
(a trained model) or the last (a search), so ORACLE_SQL is None; tests hold run() against a plain version.

Nulls, empty texts, repeated rows and empty tables are treated as each operator states. n_chars follows the text
where a stage changes it. The mixing stage repeats documents whose source's target exceeds its size; the use in which a
source's target ends is taken whole or left out, whichever is nearer to the target. It writes its rows in training order,
range-sorted over files; the last stage reads each row's place in them and returns it as training_order, from 0 on (null
for docs that are not read from files).
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from splicery.llm.common import discard, scratch, shared_dir, stored
from splicery.llm.line_dedup import dedup_lines
from splicery.llm.mixing import mix, mixed_stream
from splicery.llm.near_dedup import near_duplicates
from splicery.llm.pieces import encode_pieces
from splicery.llm.toxicity import toxicity

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def piece_model() -> str:
    """The vocabulary file of the last stage."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the model does not reject."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity(docs, labels).filter("predicted = 0").select(*COLUMNS)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that others hold too."""
    return dedup_lines(docs).withColumn("n_chars", F.when(F.col("n_dropped") > 0, F.char_length("text").cast("long")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, and every other document."""
    kept = near_duplicates(docs).filter("kept").select(F.col("doc_id").alias("kept_id")).distinct()
    return docs.join(kept, F.col("doc_id").eqNullSafe(F.col("kept_id")), "left_semi").select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, in training order."""
    mixed = mixed_stream(mix(docs), COLUMNS, whole=True)
    return mixed.withColumn("n_chars", F.coalesce(F.char_length("text").cast("long"), F.col("n_chars")))


def training_order(docs: DataFrame) -> DataFrame:
    """docs with the place of each row in the files that they are read from, part by part."""
    try:
        placed = docs.select(*docs.columns, F.col("_metadata.file_path").alias("_x_file"), F.col("_metadata.row_index").alias("_x_row"))
    except AnalysisException:  # rows that come from no file have no place
        return docs.withColumn("training_order", F.lit(None).cast("long"))
    # One row for each written file: bounded by the number of partitions. Files follow by the number of their part, then by name.
    part = F.regexp_extract("_x_file", r"part-(\d+)[^/]*$", 1).try_cast("int")
    before = Window.orderBy(part.asc_nulls_last(), "_x_file").rowsBetween(Window.unboundedPreceding, -1)
    files = placed.groupBy("_x_file").agg(F.count(F.lit(1)).alias("n")).select("_x_file", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_x_base"))
    return placed.join(F.broadcast(files), "_x_file").select(*docs.columns, (F.col("_x_base") + F.col("_x_row")).alias("training_order"))


def to_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with the ids of their best segmentation, the other N-best ones, and their place in training."""
    return encode_pieces(training_order(docs), piece_model())


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_lines),
    ("near_dedup", drop_near_copies),
    ("mixing", mix_sources),
    ("pieces", to_pieces),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    where, before = shared_dir(spark), None
    for name, stage in STAGES[:-1]:
        with scratch(spark):  # a stage's own intermediate tables go once its result is written, its input with the next result
            docs = stored(stage(spark, docs, sf_dir), name, where)
        if before:
            discard(spark, f"{where}/{before}")
        before = name
    return STAGES[-1][1](spark, docs, sf_dir)
