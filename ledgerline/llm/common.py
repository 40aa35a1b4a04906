"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerline.session import checkpoint_root

#: A word is a maximal run of characters other than space and the controls 9..13.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession, label: str) -> str:
    """A new folder below the shared checkpoint folder; the file system drops it when the driver ends."""
    path = f"{checkpoint_root(spark)}/llm/{label}-{uuid.uuid4().hex}"
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration())
    fs.mkdirs(hadoop_path)
    fs.deleteOnExit(hadoop_path)
    return path


def save(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{scratch(spark, label)}/t"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def word_count(text: str | Column) -> Column:
    """Number of words of a text, null counting 0."""
    return F.coalesce(F.regexp_count(F.col(text) if isinstance(text, str) else text, F.lit(WORD)), F.lit(0)).cast("long")


def with_schema(df: DataFrame, added: list[tuple[str, T.DataType]]) -> T.StructType:
    """Schema of ``df`` plus the added columns; a column of the same name (in any case) is replaced."""
    names = {n.lower() for n, _ in added}
    kept = [f for f in df.schema.fields if f.name.lower() not in names]
    return T.StructType(kept + [T.StructField(n, t, True) for n, t in added])


def without(df: DataFrame, *names: str) -> DataFrame:
    """``df`` without the named columns, whatever their case."""
    low = {n.lower() for n in names}
    return df.select([F.col(f"`{c}`") for c in df.columns if c.lower() not in low])


def slices(lengths: np.ndarray, most: int) -> list[tuple[int, int]]:
    """Consecutive row ranges whose lengths sum to about ``most``; one row may exceed it."""
    if len(lengths) == 0:
        return []
    step = np.cumsum(lengths, dtype=np.int64) // max(1, most)
    cuts = np.flatnonzero(np.diff(step)) + 1
    edges = [0, *cuts.tolist(), len(lengths)]
    return list(zip(edges[:-1], edges[1:], strict=True))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column and the offsets of its rows; null rows are empty."""
    column = pa.concat_arrays([column.fill_null("")]).cast(pa.large_string())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset: column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0]: at[-1]], at - at[0]


def hinted(df: DataFrame, rows: int, limit: int = 20_000) -> DataFrame:
    """A small saved table with a broadcast hint if it has at most ``limit`` rows; beyond that a shuffle join is planned."""
    return F.broadcast(df) if rows <= limit else df


def tidily(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run`` for mapInArrow; afterwards the worker, which Spark keeps for other tasks, gives freed memory back."""

    def inner(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        give_back()

    return inner


def give_back() -> None:
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except AttributeError:  # another C library
        pass
