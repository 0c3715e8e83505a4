"""The shared-folder rule for intermediate tables, and how they are taken away again."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

_made: ContextVar[list[str] | None] = ContextVar("made", default=None)


def shared_dir(spark: SparkSession) -> str:
    """A fresh path under spark.checkpoint.dir. Where none is set a local master gets a temporary folder, a cluster an error."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        found = spark.sparkContext._jsc.sc().getCheckpointDir()
        if found.isDefined():
            base = found.get()
        elif spark.sparkContext.master.startswith("local"):
            base = tempfile.mkdtemp(prefix="splicery-")
        else:
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    path = f"{base.rstrip('/')}/splicery-{uuid.uuid4().hex}"
    if (made := _made.get()) is not None:
        made.append(path)
    return path


def stored(df: DataFrame, name: str = "t", where: str | None = None) -> DataFrame:
    """The rows, written to the shared folder and read again: cuts lineage and survives lost executors."""
    path = f"{where or shared_dir(df.sparkSession)}/{name}"
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, path: str) -> None:
    """Delete a folder that shared_dir() named, once nothing reads it any more."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Deletes at its end every intermediate table that was made inside it: results must have been written by then."""
    made: list[str] = []
    token = _made.set(made)
    try:
        yield
    finally:
        _made.reset(token)
        for path in made:
            discard(spark, path)
