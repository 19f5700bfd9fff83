"""Tables that a job writes for itself, in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; a temporary one only where that is unset (local tests)."""
    context = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or context._jsc.sc().getCheckpointDir().getOrElse(None)
    if not found:
        if not context.master.startswith("local[") and context.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="checkpoint-"))
        found = context._jsc.sc().getCheckpointDir().get()
    return found


#: The lists that take the paths of tables written inside `temporary`, by thread: the tables of other threads are not touched.
_collecting: ContextVar[tuple[list[str], ...]] = ContextVar("collecting", default=())


def materialized(df: DataFrame, name: str) -> DataFrame:
    """df written once as Parquet to the shared folder and read back: lineage ends there, and lost executors lose none of it."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    for paths in _collecting.get():
        paths.append(path)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_to = path
    return out


def delete(spark: SparkSession, path: str) -> None:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def discard(df: DataFrame) -> None:
    """Deletes a materialized table that no DataFrame will be read from again."""
    delete(df.sparkSession, df.written_to)


@contextmanager
def temporary(spark: SparkSession) -> Iterator[list[str]]:
    """Deletes at its end the tables that this thread wrote meanwhile, but those whose paths are put into the list it gives."""
    mine, keep = [], []
    token = _collecting.set((*_collecting.get(), mine))
    try:
        yield keep
    finally:
        _collecting.reset(token)
        for path in mine:
            if path not in keep:
                delete(spark, path)
