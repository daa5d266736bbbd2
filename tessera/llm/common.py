"""What the operators for training data share: folders that all executors see, Arrow stages, documented limits."""

from __future__ import annotations

import contextlib
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession


def _root(spark: SparkSession) -> str:
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="tessera-")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(root)
    return root


def shared_dir(spark: SparkSession, purpose: str) -> str:
    """A new path below spark.checkpoint.dir, which driver and executors share. Only where that setting is unset and all runs
    on this machine, as in tests, a temporary folder becomes the session's checkpoint folder; on a cluster that is an error."""
    return f"{_root(spark).rstrip('/')}/{purpose}-{uuid.uuid4().hex}"


def can_checkpoint(spark: SparkSession) -> None:
    """Make sure that checkpoint() has a folder."""
    _root(spark)


def release(spark: SparkSession, *paths: str) -> None:
    """Delete written tables that nothing reads any more, and have Spark drop the shuffle files of plans that are gone."""
    for path in paths:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    gc.collect()
    spark._jvm.System.gc()


def map_batches(df: DataFrame, ddl: str, make: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch | Iterator[pa.RecordBatch] | None]]) -> DataFrame:
    """Apply a function of one Arrow batch, which may give several, to every batch. make() runs once a task and loads what
    the function needs. A task that ends gives the memory of its batches back, as its worker lives on."""
    schema = ddl

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        apply = None
        for batch in batches:
            if batch.num_rows == 0:
                continue
            apply = apply or make()
            out = apply(batch)
            if isinstance(out, pa.RecordBatch):
                yield out
            elif out is not None:
                yield from out
        del apply
        pa.default_memory_pool().release_unused()

    return df.mapInArrow(run, schema)


@contextlib.contextmanager
def batch_rows(spark: SparkSession, rows: int) -> Iterator[None]:
    """Rows of Arrow batches while an action runs: fewer where rows are long, to bound what a worker holds at once."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def texts(column: pa.Array) -> list[str]:
    """Strings of a column; null counts as empty."""
    return [x or "" for x in column.to_pylist()]


def slices(sizes: list[int], most: int) -> Iterator[tuple[int, int]]:
    """Ranges of consecutive items whose sizes add up to at most `most`; a larger item stands alone."""
    start = total = 0
    for k, size in enumerate(sizes):
        if k > start and total + size > most:
            yield start, k
            start, total = k, 0
        total += size
    if start < len(sizes):
        yield start, len(sizes)
