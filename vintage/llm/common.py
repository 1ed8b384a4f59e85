"""Helpers that the operators share: reading, bounded batches, scratch tables."""

from __future__ import annotations

import ctypes
import sys
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: glibc's; other C libraries have none.
_TRIM = getattr(ctypes.CDLL(None), "malloc_trim", None)
LOCAL_CHECKPOINTS = "/tmp/checkpoints"
#: Bytes of an Arrow batch on its way to Python, where the session allows more; a row that is longer goes alone.
ARROW_BYTES = 4 << 20
#: Rows of a batch from bounded().
MOST_ROWS = 10_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, from spark.checkpoint.dir; without it a local one, where there is no cluster."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return named or LOCAL_CHECKPOINTS


def scratch_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


def written(df: DataFrame, label: str) -> DataFrame:
    """df as a Parquet table in the shared folder: lineage ends there, a lost executor costs one read."""
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete a scratch table that nothing reads any more."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)


def give_back() -> None:
    """Return what this process has freed to the system, so that an idle Python worker holds no more than it uses."""
    pa.default_memory_pool().release_unused()
    if _TRIM is not None:
        _TRIM(0)


def small_batches(spark: SparkSession) -> None:
    """Bound the session's Arrow batches by bytes: by rows alone, one holds 10,000 texts or all stored segments of a partition."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(key))
    if not 0 < now <= ARROW_BYTES:
        spark.conf.set(key, str(ARROW_BYTES))


def drop_encoders() -> None:
    """Drop the token encoders that an earlier task left in this worker, if one did."""
    if tokens := sys.modules.get("vintage.llm.tokens"):
        tokens.forget()


def map_batches(df: DataFrame, rows: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str, encodes: bool = False) -> DataFrame:
    """df.mapInArrow(rows, schema) over small batches; workers give freed memory back after each batch and, unless rows encodes tokens, drop the encoders."""
    small_batches(df.sparkSession)

    def lean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not encodes:
            drop_encoders()
        for found in rows(batches):
            yield found
            del found
            give_back()
        give_back()

    return df.mapInArrow(lean, schema)


def map_groups(left: DataFrame, right: DataFrame, key: str, tables: Callable[[pa.Table, pa.Table], pa.Table], schema: str) -> DataFrame:
    """tables(left, right) of each key's rows, as map_batches."""
    small_batches(left.sparkSession)

    def lean(mine: pa.Table, other: pa.Table) -> pa.Table:
        drop_encoders()
        found = tables(mine, other)
        give_back()
        return found

    return left.groupBy(key).cogroup(right.groupBy(key)).applyInArrow(lean, schema)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def crc_of_id(column: str = "doc_id"):
    """crc32 of the id written as text; null ids count as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary"))


def byte_list(column: pa.Array) -> list[bytes | None]:
    if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type):
        return column.cast(pa.large_binary()).to_pylist()
    return column.cast(pa.binary()).to_pylist()


def bounded(batches: Iterator[pa.RecordBatch], column: str, limit: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """The rows dealt anew: batches whose texts hold at most limit bytes together (one row at least), so that memory doesn't follow the batch size."""
    held: list[pa.RecordBatch] = []
    n, size = 0, 0
    together = lambda: held[0] if len(held) == 1 else pa.concat_batches(held)
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(column))), 0)
        ends = np.cumsum(sizes.to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < batch.num_rows:
            before = int(ends[at - 1]) if at else 0
            stop = min(int(np.searchsorted(ends, before + limit - size, "right")), at + MOST_ROWS - n)
            if stop <= at and held:
                yield together()
                held, n, size = [], 0, 0
                continue
            stop = max(at + 1, stop)
            held.append(batch.slice(at, stop - at))
            n, size, at = n + stop - at, size + int(ends[stop - 1]) - before, stop
        del batch
    if held:
        yield together()


def union_find(n: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The smallest member of each of n nodes' component, given the edges left[i] - right[i]."""
    label = np.arange(n)
    left, right = np.asarray(left, np.int64), np.asarray(right, np.int64)
    while len(left):
        low = np.minimum(label[left], label[right])
        new = label.copy()
        np.minimum.at(new, label[left], low)
        np.minimum.at(new, label[right], low)
        while True:
            hop = new[new]
            if np.array_equal(hop, new):
                break
            new = hop
        label = new[label]
        open_ = label[left] != label[right]
        left, right = left[open_], right[open_]
    return label
