"""Intermediate tables in the folder that driver and executors share.

A cluster names that folder in ``spark.checkpoint.dir``, which is read from the session. Where it
is unset a temporary folder of this machine is used, but only if all of Spark runs in this process
(a local master): elsewhere executors would write to disks that nobody else sees.
"""

from __future__ import annotations

import atexit
import contextlib
import contextvars
import functools
import tempfile
import uuid
from collections.abc import Iterable, Iterator

from pyspark.sql import DataFrame, SparkSession

_made: dict[str, SparkSession] = {}
#: The set that takes the paths made in this thread's innermost ``scope``.
_scope: contextvars.ContextVar[set[str] | None] = contextvars.ContextVar("scope", default=None)


@functools.cache
def _local_root() -> str:
    return "file://" + tempfile.mkdtemp(prefix="kilnwork-")


def shared_root(spark: SparkSession) -> str:
    """The shared folder of this session, without a slash at its end."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and spark.sparkContext.master.partition("[")[0] != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return (named or _local_root()).rstrip("/")


def _forget(path: str) -> None:
    spark = _made.pop(path, None)
    try:
        jvm = spark.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # the session may have ended already; the folder is scratch space
        pass


@atexit.register
def _forget_all() -> None:
    for path in list(_made):
        _forget(path)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder, removed when this Python process ends at the latest."""
    path = f"{shared_root(spark)}/kilnwork-{name}-{uuid.uuid4().hex}"
    _made[path] = spark
    if (paths := _scope.get()) is not None:
        paths.add(path)
    return path


def saved(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: it cuts the lineage, and a lost
    executor costs only the tasks that ran there."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._kilnwork_path = path
    return out


def release(*tables: DataFrame) -> None:
    """Remove what ``saved`` wrote for these tables, as nothing reads them any more."""
    for df in tables:
        if path := getattr(df, "_kilnwork_path", None):
            _forget(path)


@contextlib.contextmanager
def scope() -> Iterator[set[str]]:
    """The paths of the scratch tables that this thread makes inside of it; what other threads make
    meanwhile, or other code of this thread before and after, is not among them."""
    paths: set[str] = set()
    token = _scope.set(paths)
    try:
        yield paths
    finally:
        _scope.reset(token)


def forget(paths: Iterable[str]) -> None:
    """Remove these scratch tables, as nothing reads them any more."""
    for path in set(paths) & set(_made):
        _forget(path)
