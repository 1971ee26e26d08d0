"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where that is unset, a session in one process gets a temporary folder; on a cluster it is an error.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = f"file://{tempfile.mkdtemp(prefix='twinlens-')}"
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


#: Folders written in each open :func:`scratch` block.
_scratch: list[list[str]] = []


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing else uses."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    for folders in _scratch:
        folders.append(path)
    return path


def exists(spark: SparkSession, path: str) -> bool:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder in whatever file system it is."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[list[str]]:
    """Delete at the block's end the folders that operators wrote in it, but for those that the block takes off the list.

    What the block returns must be written by then, as frames that read these folders no longer can.
    """
    folders: list[str] = []
    _scratch.append(folders)
    try:
        yield folders
    finally:
        _scratch[:] = [f for f in _scratch if f is not folders]
        for path in folders:
            remove(spark, path)


def discard(*tables: DataFrame) -> None:
    """Delete what :func:`materialize` wrote for tables that nothing reads any more."""
    for table in tables:
        remove(table.sparkSession, table.written_to)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back, which cuts its lineage and survives lost executors."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    table.written_to = path
    return table


#: Rows of a narrow table that are broadcast at most; beyond that Spark joins by shuffling.
BROADCAST_ROWS = 500_000


def fresh(df: DataFrame, name: str) -> str:
    """A name for a helper column that no column of ``df`` has, in either case."""
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name += "_"
    return name
