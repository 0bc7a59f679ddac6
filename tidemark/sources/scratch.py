"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark import SparkContext
from pyspark.sql import DataFrame, SparkSession

_folders: dict[str, str] = {}
_conf: dict[str, object] = {}
#: Tables written inside the innermost open ``temporary_tables``.
_open: ContextVar[list[str] | None] = ContextVar("open_tables", default=None)


def shared_dir(spark: SparkSession) -> str:
    """The folder for intermediate tables that all executors can read.

    It lies below ``spark.checkpoint.dir``. Only a local master may run
    without that setting; then a temporary folder of this machine is used. The
    folder is removed at the end of the program, also when the session was
    stopped before.
    """
    app = spark.sparkContext.applicationId
    if app not in _folders:
        base = spark.conf.get("spark.checkpoint.dir", None)
        if not base:
            if not spark.sparkContext.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            base = f"file://{tempfile.mkdtemp(prefix='tidemark-')}"
        _folders[app] = f"{base.rstrip('/')}/tidemark-{uuid.uuid4().hex}"
        _conf[_folders[app]] = spark.sparkContext._jsc.hadoopConfiguration()
        atexit.register(_remove, _folders[app], _folders[app])
    return _folders[app]


def _remove(path: str, folder: str) -> None:
    # The JVM and its file systems outlive a stopped session.
    jvm = SparkContext._jvm
    if jvm is None:
        return
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(_conf[folder]).delete(where, True)


def remove_table(spark: SparkSession, path: str) -> None:
    _remove(path, shared_dir(spark))


def stage_table(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts the lineage,
    and a lost executor costs no recomputation of what lies before."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if (tables := _open.get()) is not None:
        tables.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def temporary_tables(spark: SparkSession) -> Iterator[None]:
    """What is staged inside is removed at the end; nothing may be read from it afterwards."""
    tables: list[str] = []
    token = _open.set(tables)
    try:
        yield
    finally:
        _open.reset(token)
        for path in tables:
            remove_table(spark, path)


def settled(spark: SparkSession, name: str, build: Callable[[], DataFrame]) -> DataFrame:
    """The table that ``build`` gives, written; all that it staged on the way is removed."""
    outer = _open.get()
    with temporary_tables(spark):
        made = build()
        token = _open.set(outer)
        try:
            return stage_table(made, name)
        finally:
            _open.reset(token)
