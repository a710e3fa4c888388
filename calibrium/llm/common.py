"""Helpers that the training-data operators share."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MAX_ARROW_BYTES = 16 << 20
#: Rows under one key from which on a join goes by broadcast, and keys that such a broadcast may hold.
HOT_ROWS, HOT_KEYS = 4_096, 200_000


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; where that is unset on one machine (tests) one of our own."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path
    current = spark.sparkContext._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    path = tempfile.mkdtemp(prefix="calibrium-checkpoints-")
    spark.sparkContext.setCheckpointDir(path)
    return path


def shared_table(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder for a table that a job writes and reads back."""
    return f"{shared_dir(spark).rstrip('/')}/calibrium-{name}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame, files: int | None = None) -> DataFrame:
    """df written to the shared folder and read again: later reads survive the loss of executors.

    files: files at most, where the rows are known to be few. A commit of an almost empty file takes longer than its rows.
    """
    path = shared_table(df.sparkSession, "held")
    (df.coalesce(files) if files else df).write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.held_path = path
    return out


def release(*tables: DataFrame) -> None:
    """Deletes tables of `cut_lineage` that nothing reads any more."""
    for path in filter(None, (getattr(t, "held_path", None) for t in tables)):
        delete(tables[0].sparkSession, path)


def delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def join_counted(big: DataFrame, small: DataFrame, key: list[str], members: str = "members", hot: int | None = None) -> DataFrame:
    """big joined with small, which has one row a key and in `members` the rows of big under it.

    Keys of at least `hot` rows are joined by broadcast, so that no task meets all rows of one: there are few of them, and
    if they were more than HOT_KEYS only hotter ones count. big should be a held table, as it is read twice then.
    """
    hot = hot or HOT_ROWS
    while (found := small.where(F.col(members) >= hot).limit(HOT_KEYS + 1).count()) > HOT_KEYS:
        hot *= 4
    if not found:
        return big.join(small, key)
    hottest = small.where(F.col(members) >= hot)
    rest = big.join(F.broadcast(hottest.select(key)), key, "left_anti").join(small.where(F.col(members) < hot), key)
    return rest.unionByName(big.join(F.broadcast(hottest), key))


_CACHES: list = []


def keeps(cache: dict) -> dict:
    """cache, known as one that a worker keeps from task to task."""
    _CACHES.append(cache)
    return cache


def let_go() -> None:
    """Empties what this worker keeps for other stages. Workers are used again by later stages, which need the memory."""
    if any(_CACHES):
        for cache in _CACHES:
            cache.clear()
        give_back()


def give_back() -> None:
    """Returns this worker's freed memory to the system."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # other C libraries give memory back by themselves
        ctypes.CDLL(None).malloc_trim(0)


def leaves_nothing(task: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """task, whose worker keeps nothing of it. Spark deals tasks to its idle workers in turn, and an executor may have several
    for each core, so what each keeps adds up to far more than what the running tasks need."""

    def run(batches: Iterator) -> Iterator:
        try:
            yield from task(batches)
        finally:
            for cache in _CACHES:
                cache.clear()
            give_back()

    return run


def bounded_batches(spark: SparkSession) -> None:
    """Arrow batches are cut by bytes as well as by rows, so that very long texts don't gather in one batch."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(MAX_ARROW_BYTES))


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
