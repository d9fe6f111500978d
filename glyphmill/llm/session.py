"""What the operators share on the driver's side."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator
from functools import wraps

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which all executors share. Only a local session that hasn't set it (as in tests) gets a folder of its own; a cluster must name one."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="glyphmill-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def stored(df: DataFrame) -> DataFrame:
    """The rows, written once to the shared folder and read back: what follows doesn't compute them again, and no executor's loss takes them away."""
    spark = df.sparkSession
    path = f"{shared(spark).rstrip('/')}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def counted(df: DataFrame, *more: Column) -> tuple[DataFrame, dict]:
    """As stored, with what is counted while the rows are written: n, their number (a task that ran twice may count twice), and more."""
    seen = Observation()
    return stored(df.observe(seen, F.count("*").alias("n"), *more)), seen.get


def texts(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Only the id (as long) and text, so that no other column's name can clash; rows without an id or text are left out."""
    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).where("doc_id is not null and text is not null")


def tidied(f: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """f, which gives its free memory back at the end: workers live on between stages, and what one holds the executor can't use."""

    @wraps(f)
    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from f(batches)
        finally:
            released()

    return apply


def released() -> None:
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)
