"""Tables between steps: frames written to the cluster's shared folder, so that a lost executor changes nothing that was used already."""

from __future__ import annotations

import atexit
import os
import tempfile
import threading
import uuid
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; a temporary one where it is unset in local mode."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="graphloom-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


#: Rows of a task that sorts or groups, up to 200 tasks; these write a shuffle without buffering rows (spark.shuffle.sort.bypassMergeThreshold).
TASK_ROWS = 250_000
#: Beyond 200 tasks, rows of a task.
MOST_TASK_ROWS = 2_000_000


def tasks_for(rows: int) -> int:
    """In how many parts so many rows are sorted.  Parts of a given number aren't merged by adaptive execution, so a task's memory has a bound."""
    return max(1, min(200, -(-rows // TASK_ROWS)), -(-rows // MOST_TASK_ROWS))


#: Rows of a slice: steps over more rows are done in slices one after another, so that one slice's shuffle is on disk at a time; the most slices.
SLICE_ROWS, MOST_SLICES = 20_000_000, 4


def slices_for(rows: int) -> int:
    """In how many slices so many rows are joined.  Each reads its input again, so there are a few at most."""
    return max(1, min(MOST_SLICES, -(-rows // SLICE_ROWS)))


_written: list[tuple[SparkSession, str]] = []
_scopes = threading.local()


def new_path(spark: SparkSession) -> str:
    """A path in the shared folder that drop_temporary() removes."""
    path = f"{shared_dir(spark)}/graphloom-{os.getpid()}/{uuid.uuid4().hex}"
    _written.append((spark, path))
    if inner := getattr(_scopes, "inner", None):
        inner[-1].append(path)
    return path


@contextmanager
def sparing(spark: SparkSession, parts: int | None = None) -> Iterator[None]:
    """What runs inside removes its shuffle files as it ends, not when the driver happens to collect garbage.  parts: how many a shuffle has."""
    wanted = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"} | ({"spark.sql.shuffle.partitions": str(parts)} if parts else {})
    before = {k: spark.conf.get(k, None) for k in wanted}
    try:
        for k, v in wanted.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


@contextmanager
def passing(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """What frozen() writes inside is removed at the end, but for what the function given writes."""

    def keep(df: DataFrame) -> DataFrame:
        out = frozen(df)
        _scopes.inner[-1].pop()
        return out

    _scopes.inner = [*getattr(_scopes, "inner", []), []]
    try:
        yield keep
    finally:
        for path in _scopes.inner.pop():
            discard(spark, path)


def written(parts: Iterable[DataFrame]) -> tuple[DataFrame, str]:
    """Frames of the same columns written one after another to a folder in the shared one and read again as one; and that folder."""
    path = ""
    for df in parts:
        path = path or new_path(df.sparkSession)
        df.write.mode("append").option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def frozen(df: DataFrame) -> DataFrame:
    """df written to the shared folder and read again: a cut in the lineage that a lost executor can't undo."""
    return written([df])[0]


def discard(spark: SparkSession, path: str) -> None:
    """Remove one table that frozen() wrote, or that was written to a new_path()."""
    _written[:] = [x for x in _written if x[1] != path]
    try:
        jvm = spark.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
    except Exception:  # the session has ended
        pass


def drop_temporary() -> None:
    """Remove what frozen() wrote in this process; call it when no result that builds on it is needed any more."""
    while _written:
        discard(*_written[-1])


atexit.register(drop_temporary)
