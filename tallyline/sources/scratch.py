"""Intermediate tables in the cluster's shared folder."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CLEARED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Bytes of input from which a job is done in slices of its rows, so many a slice, and the most slices: each reads all input.
SLICE_BYTES, MOST_SLICES = 1 << 28, 8

_local_base: str | None = None


def shared_base(spark: SparkSession) -> str:
    """The folder every executor reaches: the session's ``spark.checkpoint.dir``, else the context's checkpoint folder.

    Where neither is set, a local session (all threads in one process) gets a temporary folder that goes with
    the process; on a cluster that is an error, because executors would write to their own disks.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    base = spark.sparkContext.getCheckpointDir()
    if base:
        return base.rstrip("/")
    master = spark.sparkContext.master
    if not (master == "local" or master.startswith("local[")):
        raise RuntimeError(f"set spark.checkpoint.dir to a folder that all executors share (master is {master})")
    global _local_base
    if _local_base is None or not os.path.isdir(_local_base):
        _local_base = tempfile.mkdtemp(prefix="tallyline-")
        atexit.register(shutil.rmtree, _local_base, ignore_errors=True)
    return f"file://{_local_base}"


def scratch_dir(spark: SparkSession, name: str) -> str:
    """A new folder under the shared one, grouped by application so that a finished run can be cleared at once."""
    run = f"tallyline-{spark.sparkContext.applicationId}"
    return f"{shared_base(spark)}/{run}/{name}-{os.urandom(6).hex()}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Compute ``df`` once, write it, and go on from the written table.

    For tables that are read several times (thresholds, ranks, clusters): the source is then scanned once,
    lost executors cost nothing but their own tasks, and the real size is known when joins are planned.
    """
    path = scratch_dir(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def shuffles_cleared(spark: SparkSession) -> Iterator[None]:
    """Within it, each written table clears its shuffle files when it is done, not when the driver collects garbage."""
    before = spark.conf.get(CLEARED, None)
    spark.conf.set(CLEARED, "true")
    try:
        yield
    finally:
        spark.conf.unset(CLEARED) if before is None else spark.conf.set(CLEARED, before)


def input_bytes(df: DataFrame) -> int:
    """Bytes of the tables that ``df`` is made of, as far as Spark knows them: rows handed over by the driver count as none."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size())]
    return sum(n for n in sizes if n < 1 << 62)


def sliced(df: DataFrame, key: str, most: int | None = None) -> list[DataFrame]:
    """``df`` in slices by a hash of ``key``, which together have all its rows; one where the input is small.

    Each slice takes its own joins and shuffles, so with ``shuffles_cleared`` only one slice's files are on disk at a time.
    """
    n = min(most or MOST_SLICES, -(-input_bytes(df) // SLICE_BYTES))
    return [df.where(F.pmod(F.xxhash64(key), F.lit(n)) == i) for i in range(n)] if n > 1 else [df]


def in_slices(
    df: DataFrame, key: str, step: Callable[[DataFrame], DataFrame], name: str, keep: bool = False, most: int | None = None
) -> DataFrame:
    """``step(df)`` for a step that treats the rows of each value of ``key`` apart: where the input is large, slice by slice.

    The slices' results are written. A small input stays one plan, which runs when it is asked for, unless ``keep`` has it
    written as well.
    """
    slices = sliced(df, key, most)
    if len(slices) == 1:
        return written(step(df), name) if keep else step(df)
    path = scratch_dir(df.sparkSession, name)
    with shuffles_cleared(df.sparkSession):
        for part in slices:
            made = step(part)
            made.write.mode("append").option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(made.schema).parquet(path)


def bucketed(df: DataFrame, name: str, key: str, buckets: int) -> tuple[str, str]:
    """Write ``df`` in ``buckets`` of ``key``; the name of the session's table of it, and its folder.

    Tables in as many buckets of a key are joined and aggregated by it where they lie. Drop the name with ``dropped``.
    """
    return _bucketed([df], name, key, buckets)


def dealt_in_slices(df: DataFrame, name: str, key: str, buckets: int) -> tuple[str, str]:
    """``bucketed`` for rows that lie anywhere: dealt to the buckets by a shuffle, slice by slice where the input is large."""
    with shuffles_cleared(df.sparkSession):
        return _bucketed([part.repartition(buckets, key) for part in sliced(df, key)], name, key, buckets)


def _bucketed(parts: list[DataFrame], name: str, key: str, buckets: int) -> tuple[str, str]:
    path = scratch_dir(parts[0].sparkSession, name)
    table = f"{name.replace('-', '_')}_{path[-12:]}"
    for part in parts:
        out = part.write.mode("append").bucketBy(buckets, key).option("compression", "zstd")
        out.option("path", path).format("parquet").saveAsTable(table)
    return table, path


def removed(spark: SparkSession, path: str) -> None:
    """Delete a written table that nothing reads any more."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def dropped(spark: SparkSession, tables: Iterable[str]) -> None:
    """Forget the names of ``bucketed`` tables; their files stay as long as the other written ones."""
    for table in tables:
        spark.sql(f"DROP TABLE IF EXISTS {table}")
