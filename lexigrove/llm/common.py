"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import ctypes
import math
import re
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that one Python step handles at once; bounds the working
#: memory of a task whatever the number of rows in an Arrow batch.
SLICE_BYTES = 2 << 20
#: Rows of an Arrow batch at most, and its bytes (a longer row is a batch of its own).
BATCH_ROWS, BATCH_BYTES = 2000, 2 << 20


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder named by the session; where it is unset, a default on a single machine only."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("on a cluster, spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = "/tmp/checkpoints"
    return root.rstrip("/")


def _fs(spark: SparkSession, place: str) -> tuple:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(place)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), path


def drop_tables(spark: SparkSession, places: list[str]) -> None:
    for place in places:
        fs, path = _fs(spark, place)
        fs.delete(path, True)
    places.clear()


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of at most ``BATCH_ROWS`` rows and ``BATCH_BYTES`` in this session: long texts make large batches."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.sparkContext._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(key)) > BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))


def hand_back() -> None:
    """Freed memory goes back to the system; a worker that waits would else keep what its largest slice took."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


@contextmanager
def shuffles_freed(spark: SparkSession) -> Iterator[None]:
    """Within, the shuffle files of a collected result go as soon as it has been collected."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, "false")
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def materialize(df: DataFrame, name: str, space: list[str] | None = None) -> DataFrame:
    """Write ``df`` once to the shared checkpoint folder and read it back.

    Cuts the lineage, survives lost executors, and keeps a costly stage from
    running again for every action that follows.  ``space``: see scratch(); a
    table without one is a result, and goes when the application ends.
    """
    spark = df.sparkSession
    path = f"{checkpoint_root(spark)}/{name}-{uuid.uuid4().hex}"
    if space is not None:
        space.append(path)
    small_batches(spark)
    df.write.parquet(path)
    if space is None and (outer := _outer.get()) is not None:
        outer.append(path)
    elif space is None:
        fs, place = _fs(spark, path)
        fs.deleteOnExit(place)
    # Shuffle files go when the driver collects the plans that made them, which it else does rarely.
    spark.sparkContext._jvm.System.gc()
    return spark.read.schema(df.schema).parquet(path)


#: Where results written on the way to another result are noted (see passing).
_outer: ContextVar[list[str] | None] = ContextVar("outer", default=None)


@contextmanager
def passing(space: list[str]) -> Iterator[None]:
    """Results written within are noted in ``space``, for drop_tables once they have been read."""
    token = _outer.set(space)
    try:
        yield
    finally:
        _outer.reset(token)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[list[str]]:
    """Collects the tables written for a result that is itself written; they go at the end."""
    space: list[str] = []
    try:
        yield space
    finally:
        drop_tables(spark, space)


#: Bits of a filter for each value, and their power of two at most (128 MB).
FILTER_SPACE, MAX_FILTER = 16, 30


def bit_filter(values: DataFrame, column: str) -> np.ndarray:
    """Bits for the hashes in ``column`` (see may_hold), sized by their number and MAX_FILTER."""
    bits = 1 << min(MAX_FILTER, max(16, math.ceil(math.log2(FILTER_SPACE * max(1, values.count())))))
    marked = values.select(F.pmod(F.col(column), F.lit(bits)).alias("p")).groupBy(F.expr("p div 64").alias("w")).agg(F.expr("bit_or(shiftleft(1L, cast(p % 64 as int)))").alias("bits"))
    got = marked.toArrow()
    table = np.zeros(bits // 64, np.int64)
    table[got.column("w").to_numpy()] = got.column("bits").to_numpy()
    return table


def may_hold(table: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Whether each hash may be among those of the filter; false only where it isn't."""
    p = hashes & np.int64(64 * len(table) - 1)
    return (table[p >> 6] >> (p & 63)) & 1 == 1


def slices(batch: pa.RecordBatch, text_col: int = 1, limit: int = SLICE_BYTES) -> Iterator[tuple[pa.RecordBatch, list]]:
    """Cut a record batch into runs of rows whose texts stay under ``limit`` bytes.

    A single longer text forms a run of its own.  What the batch took is handed back at its end.
    """
    column = batch.column(text_col)
    n = batch.num_rows
    if not n:
        return
    sizes = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
    start, total = 0, 0
    for i in range(n):
        if i > start and total + sizes[i] > limit:
            part = batch.slice(start, i - start)
            yield part, part.column(text_col).to_pylist()
            start, total = i, 0
        total += int(sizes[i])
    part = batch.slice(start, n - start)
    yield part, part.column(text_col).to_pylist()
    hand_back()


def text_bytes(docs: DataFrame, text_col: str = "text") -> int:
    """Bytes of all texts, which buckets are sized by."""
    return docs.agg(F.coalesce(F.sum(F.octet_length(text_col)), F.lit(0))).first()[0]


def ids_and_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", extra: tuple = ()) -> DataFrame:
    """Only the columns an operator reads, with UTF-8 bytes instead of strings."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").cast("binary").alias("text"), *extra)


def sum_blocks(df: DataFrame, dtype: str = "float64", sent: str | None = None) -> DataFrame:
    """Sum binary vectors of ``sent`` (else ``dtype``) by (key, block): columns key string, block int, data binary.

    Rows stream through; a task holds one accumulator for each of its blocks, so
    memory doesn't depend on how many tasks sent partial sums.
    """

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        acc: dict[tuple, np.ndarray] = {}
        for b in batches:
            for key, block, data in zip(*(c.to_pylist() for c in b.columns)):
                v = np.frombuffer(data, dtype=sent or dtype)
                if (key, block) in acc:
                    acc[key, block] += v
                else:
                    acc[key, block] = v.astype(dtype)
        if acc:
            yield pa.RecordBatch.from_arrays(
                [pa.array([k for k, _ in acc], pa.string()), pa.array([b for _, b in acc], pa.int32()), pa.array([v.tobytes() for v in acc.values()], pa.binary())],
                names=["key", "block", "data"],
            )

    return df.select("key", "block", "data").repartition("key", "block").mapInArrow(add, "key string, block int, data binary")


def rows_out(names: list[str], types: list, columns: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=names)


def map_arrow(df: DataFrame, step: Callable[[pa.RecordBatch, list], pa.RecordBatch | None], schema: str) -> DataFrame:
    """Apply ``step(rows, texts)`` to bounded slices of ``df`` (text is column 1)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part, texts in slices(b):
                out = step(part, texts)
                if out is not None and out.num_rows:
                    yield out

    small_batches(df.sparkSession)
    return df.mapInArrow(run, schema)
