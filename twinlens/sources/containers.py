"""Many small files as few large rows: contents one after another, with an index of where each one lies."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes of a container, unless one file has more.
CONTAINER = 32 << 20
_FILES = "array<struct<image_key:string,path:string,at:long,size:long>>"
_PACKED = f"container long, files {_FILES}, data binary"


def pack_files(files: DataFrame, container_bytes: int = CONTAINER) -> DataFrame:
    """Containers (container, files, data) of ``files`` (image_key, path, content); ``files`` has each one's offset and size in ``data``. A null content is empty.

    Each task packs what it reads, so nothing is shuffled. Write the containers before they are read by parts: a container's number is that of its task.
    """
    kind = pa.list_(pa.struct([("image_key", pa.string()), ("path", pa.string()), ("at", pa.int64()), ("size", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number, files, data = TaskContext.get().partitionId() << 33, [], bytearray()
        out = lambda: pa.RecordBatch.from_arrays([pa.array([number]), pa.array([files], kind), pa.array([bytes(data)], pa.binary())], ["container", "files", "data"])
        for batch in batches:
            for key, path, content in zip(*(batch.column(c) for c in ("image_key", "path", "content")), strict=True):
                one = content.as_py() or b""
                if files and len(data) + len(one) > container_bytes:
                    yield out()
                    number, files, data = number + 1, [], bytearray()
                files.append({"image_key": key.as_py(), "path": path.as_py(), "at": len(data), "size": len(one)})
                data += one
        if files:
            yield out()

    return files.select("image_key", "path", "content").mapInArrow(run, _PACKED)


def packed_index(containers: DataFrame) -> DataFrame:
    """image_key, path, container, at and size of every packed file; the data aren't read."""
    return containers.select("container", F.explode("files").alias("f")).select("f.image_key", "f.path", "container", "f.at", "f.size")


def read_packed(containers: DataFrame, wanted: DataFrame | None = None) -> DataFrame:
    """image_key, path and content of the packed files whose key is in ``wanted`` (image_key), or of all.

    Ranges of the data are cut where the containers are read; only the index meets the wanted keys, and containers without any are left out before their data are.
    """
    if wanted is None:
        asked = containers.withColumn("asked", F.col("files"))
    else:
        # a container's files at most meet in a group
        met = packed_index(containers).join(wanted.select("image_key").distinct(), "image_key", "left_semi")
        asked = containers.select("container", "data").join(met.groupBy("container").agg(F.collect_list(F.struct("image_key", "path", "at", "size")).alias("asked")), "container")
    cut = F.transform("asked", lambda f: F.struct(f["image_key"].alias("image_key"), f["path"].alias("path"), F.substring(F.col("data"), (f["at"] + 1).cast("int"), f["size"].cast("int")).alias("content")))
    return asked.select(F.explode(cut).alias("f")).select("f.*")
