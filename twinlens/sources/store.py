"""A table of encodes that grows by appended parts: the newest row of a key counts, and a part counts once its commit is written."""

from __future__ import annotations

import json
import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .stored import remove


class EncodeStore:
    """Rows by ``key`` with a boolean ``found``, in ``path``.

    ``path/parts`` has a folder for each append, in ``buckets`` files by the key's hash. ``path/commits`` has a small file for each version that lists the parts of that version; it is created
    only after its parts are complete and never changed, so a run that dies before leaves the old version, and its folder is removed by :meth:`vacuum`. Of two writers
    one gets the next version; the other's append fails and may be tried again. Compaction rewrites all parts as one, the base. Joins with the base don't shuffle it.
    """

    def __init__(self, spark: SparkSession, path: str, key: str = "image_key", buckets: int = 16):
        self.spark, self.path, self.key, self.buckets = spark, path.rstrip("/"), key, buckets
        jvm = spark._jvm
        self._folder = lambda name: jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        self._fs = self._folder("").getFileSystem(spark._jsc.hadoopConfiguration())

    def _listed(self, name: str) -> list[str]:
        folder = self._folder(name)
        return sorted(s.getPath().getName() for s in self._fs.listStatus(folder)) if self._fs.exists(folder) else []

    def _commit(self, name: str) -> dict | None:
        stream = self._fs.open(self._folder(f"commits/{name}"))
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        except ValueError:
            return None  # its writer died while writing it
        finally:
            stream.close()

    def latest(self) -> tuple[int, list[dict]]:
        """The last complete version and its parts, the base first; 0 and none before the first append."""
        names = self._listed("commits")
        for name in reversed(names):
            found = self._commit(name)
            if found:
                return int(name.split(".")[0]), found["parts"]
        return 0, []

    def _next_name(self) -> str:
        names = self._listed("commits")
        return f"{int(names[-1].split('.')[0]) + 1 if names else 1:010d}.json"

    def _write(self, rows: DataFrame) -> dict:
        """A new folder of ``rows``, which nobody reads before it is committed."""
        part, table = uuid.uuid4().hex, f"encode_store_{uuid.uuid4().hex}"
        dealt = rows.repartition(self.buckets, self.key)
        dealt.write.bucketBy(self.buckets, self.key).sortBy(self.key).options(path=f"{self.path}/parts/{part}").saveAsTable(table)
        self.spark.sql(f"DROP TABLE {table}")  # its files stay
        return {"part": part, "schema": rows.schema.json(), "buckets": self.buckets}

    def _publish(self, parts: list[dict], name: str) -> int:
        text = json.dumps({"parts": parts}).encode()
        stream = self._fs.create(self._folder(f"commits/{name}"), False)  # fails if another writer was first
        try:
            stream.write(text)
        finally:
            stream.close()
        return int(name.split(".")[0])

    def _read(self, part: dict) -> DataFrame:
        schema, table = StructType.fromJson(json.loads(part["schema"])), f"encode_store_{uuid.uuid4().hex}"
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
        self.spark.sql(f"CREATE TABLE {table} ({columns}) USING parquet CLUSTERED BY (`{self.key}`) SORTED BY (`{self.key}`) INTO {part['buckets']} BUCKETS LOCATION '{self.path}/parts/{part['part']}'")
        rows = self.spark.table(table)
        self.spark.sql(f"DROP TABLE {table}")
        return rows

    def _recent(self, parts: list[dict]) -> DataFrame | None:
        """The newest row of each key in the parts after the base."""
        if len(parts) < 2:
            return None
        rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), (self._read(p).withColumn("_seq", F.lit(i)) for i, p in enumerate(parts[1:])))
        columns = [c for c in rows.columns if c not in ("_seq", self.key)]
        newest = rows.groupBy(self.key).agg(F.max_by(F.struct(*columns), "_seq").alias("_r"))
        return newest.select(self.key, *(F.col(f"_r.{c}").alias(c) for c in columns))

    def rows(self) -> DataFrame | None:
        """The newest row of every key; None before the first append. The base is only joined where it lies."""
        _, parts = self.latest()
        if not parts:
            return None
        base, recent = self._read(parts[0]), self._recent(parts)
        if recent is None:
            return base
        return base.join(recent.select(self.key), self.key, "left_anti").unionByName(recent, allowMissingColumns=True)

    def missing(self, keys: DataFrame) -> DataFrame:
        """Those of the distinct ``keys`` (one column, the key) whose newest row isn't found, or that have none."""
        _, parts = self.latest()
        if not parts:
            return keys.select(self.key)
        left, recent = keys.select(self.key).withColumn("_f", F.lit(None).cast("boolean")), self._recent(parts)
        if recent is not None:
            left = keys.select(self.key).join(recent.select(self.key, F.coalesce("found", F.lit(False)).alias("_f")), self.key, "left").where("_f is null or not _f")
        usable = self._read(parts[0]).where("found").select(self.key, F.lit(True).alias("_b"))
        return left.join(usable, self.key, "left").where("_b is null or _f is not null").select(self.key)

    def append(self, rows: DataFrame) -> int:
        """Add ``rows``, at most one for each key, and return the new version. An empty append makes no version."""
        name = self._next_name()
        version, parts = self.latest()
        part = self._write(rows)
        if self._read(part).isEmpty():
            remove(self.spark, f"{self.path}/parts/{part['part']}")
            return version
        return self._publish([*parts, part], name)

    def compact(self) -> int:
        """One part instead of all; the old ones stay for their readers until :meth:`vacuum`."""
        name = self._next_name()
        version, parts = self.latest()
        return version if len(parts) < 2 else self._publish([self._write(self.rows())], name)

    def vacuum(self) -> int:
        """Delete parts that the last version doesn't list, those of runs that died included; how many. Not while others write or read older versions."""
        listed = {p["part"] for p in self.latest()[1]}
        old = [p for p in self._listed("parts") if p not in listed]
        for part in old:
            remove(self.spark, f"{self.path}/parts/{part}")
        return len(old)


