"""Helpers shared by the corpus operators: tables, shared folders, Arrow batches."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows whose crc32(doc_id as text) leaves this remainder by 4 are never learned from.
HELD_OUT_REMAINDER = 2


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The parquet table `name` of the data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(doc_id: Column) -> Column:
    """True where crc32(doc_id as text) mod 4 is 2; a null id is not held out, yet `trainable` refuses it."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == HELD_OUT_REMAINDER, F.lit(False))


def trainable(doc_id: Column) -> Column:
    """True where a row's label may be learned from (never for a null id)."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 != HELD_OUT_REMAINDER, F.lit(False))


def shared_dir(spark: SparkSession, purpose: str) -> str:
    """A fresh path below the folder that all executors share.

    The cluster names that folder in spark.checkpoint.dir.  Where it is unset, a
    temporary folder takes its place on a single machine (master local[...]),
    whose driver and executor are one process; anywhere else that is an error.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="quarry-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"


#: Tables that `materialize` has written and nothing has removed yet.
_WRITTEN: list[str] = []


def materialize(df: DataFrame, purpose: str) -> DataFrame:
    """Cut the lineage: write `df` to the shared folder and read it back.

    The table stays until `remove` or `release`: results that are computed
    later read it.
    """
    spark = df.sparkSession
    path = shared_dir(spark, purpose)
    df.write.option("compression", "zstd").parquet(path)
    _WRITTEN.append(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._quarry_path = path
    return out


def remove(df: DataFrame) -> None:
    """Delete the table behind what `materialize` returned, when nothing will read it again."""
    _delete(df.sparkSession, df._quarry_path)


def release(spark: SparkSession) -> None:
    """Delete every table that is left of this process's operators, once their results have been written or dropped."""
    for path in list(_WRITTEN):
        _delete(spark, path)


def _delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
    if path in _WRITTEN:
        _WRITTEN.remove(path)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def utf8_slices(column: pa.Array | pa.ChunkedArray, most: int = 2 << 20) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Cut a string column into runs of whole rows of about `most` bytes.

    Yields (first row, end row, bytes, offsets); offsets has one entry more
    than rows and starts at 0.  Nulls are empty.  No text is copied.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if isinstance(column, pa.ChunkedArray):  # older versions keep one chunk wrapped
        column = column.chunk(0) if column.num_chunks else pa.array([], pa.string())
    n = len(column)
    if n == 0:
        return
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    _, raw, data = column.buffers()
    offsets = np.frombuffer(raw, np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    whole = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    at = 0
    while at < n:
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1)
        end = min(end, n)
        yield at, end, whole[offsets[at] : offsets[end]], offsets[at : end + 1] - offsets[at]
        at = end


def worker_cache() -> dict:
    """A dict that outlives one task in a reused Python worker."""
    import types

    module = sys_modules().setdefault("_quarry_worker_cache", types.ModuleType("_quarry_worker_cache"))
    return module.__dict__.setdefault("store", {})


def sys_modules() -> dict:
    import sys

    return sys.modules
