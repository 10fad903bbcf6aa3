"""What the operators need of the cluster: a shared checkpoint folder and grouped batches."""

from __future__ import annotations

import ctypes
import functools
import tempfile
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession


#: Shuffle files of an execution are removed at its end; none of them is read later.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Most bytes of a batch on its way to a kernel (``BATCH``, unless the session has set it): by default
#: batches have 10,000 rows, whatever the length of texts, and each task holds one several times.
BYTES, BATCH = "spark.sql.execution.arrow.maxBytesPerBatch", 4 << 20


def small_batches(spark: SparkSession) -> None:
    """Batches of bounded bytes for the kernels of this session; no result depends on them."""
    asked = spark.conf._jconf.getAll()
    if asked.get(BYTES).isEmpty():
        spark.conf.set(BYTES, str(BATCH))


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which all executors share; only where that is
    unset and the master is local (tests), a temporary one."""
    context = spark.sparkContext
    return context.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None) or _temporary(spark)


def _temporary(spark: SparkSession) -> str:
    if not spark.sparkContext._jsc.sc().isLocal():
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="textlake-"))
    return spark.sparkContext.getCheckpointDir()


def fresh(taken: list[str], *names: str) -> list[str]:
    """The names, each with as many underscores before it as it takes to differ from all taken ones."""
    lower, out = {t.lower() for t in taken}, []
    for name in names:
        while name.lower() in lower:
            name = "_" + name
        out.append(name)
    return out


def checkpointed(df: DataFrame) -> DataFrame:
    """Cuts lineage by writing ``df`` to the shared folder; the shuffles that made it are
    done with then, and their files go at once."""
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_folder(spark))
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        return df.select("*").checkpoint(eager=True)
    finally:
        spark.conf.set(CLEANUP, before)


def written(df: DataFrame, path: str) -> None:
    """Writes ``df`` to a folder of the shared one; the shuffle files that made it go at once."""
    spark = df.sparkSession
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.option("compression", "none").parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)


def removed(spark: SparkSession, path: str) -> None:
    """Deletes a folder of the shared one."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def tidy(work: Callable[..., Iterator[pa.RecordBatch]]) -> Callable[..., Iterator[pa.RecordBatch]]:
    """A kernel that gives the memory it has freed back to the system when it ends: Python
    workers live on for other kernels."""

    @functools.wraps(work)
    def kernel(*args: object) -> Iterator[pa.RecordBatch]:
        yield from work(*args)
        trimmed()

    return kernel


def trimmed() -> None:
    """Gives freed memory back to the system."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str], work: Callable[[pa.Table], Iterator[pa.RecordBatch]]) -> Iterator[pa.RecordBatch]:
    """Calls ``work`` with tables that hold only whole groups of the keys: the input is
    sorted by them, and the last group of a batch waits for the next one."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if batch.num_rows == 0:
            continue
        last = [batch.column(batch.schema.get_field_index(k))[batch.num_rows - 1].as_py() for k in keys]
        lo, hi = 0, batch.num_rows - 1  # the first row of the last group
        columns = [batch.column(batch.schema.get_field_index(k)) for k in keys]
        while lo < hi:
            mid = (lo + hi) // 2
            if [c[mid].as_py() for c in columns] == last:
                hi = mid
            else:
                lo = mid + 1
        if lo == 0 and held and [held[-1].column(held[-1].schema.get_field_index(k))[held[-1].num_rows - 1].as_py() for k in keys] == last:
            held.append(batch)
            continue
        if lo or held:
            head = pa.Table.from_batches([*held, batch.slice(0, lo)])
            if head.num_rows:
                yield from work(head)
        held = [batch.slice(lo)]
    if held:
        yield from work(pa.Table.from_batches(held))
