"""Versioned tables in a folder: every commit writes new files first and then one manifest.

The manifest names the folders that a table consists of. New rows alone are one more folder; other changes write the
table anew, and so does a table that has come to MOST_FOLDERS.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from ..model import Model, Relation, Type
from ..sources.binding import Binding, table_type

MOST_FOLDERS = 64
EDGE = T.StructType([T.StructField("_from", T.StringType()), T.StructField("_to", T.StringType())])


class Store:
    """Tables of a model under ``path``, on any file system that Spark reads. One writer at a time."""

    def __init__(self, spark: SparkSession, model: Model, path: str):
        self.spark, self.model, self.path = spark, model, path.rstrip("/")
        jvm = spark._jvm
        self.jpath = jvm.org.apache.hadoop.fs.Path
        self.fs = self.jpath(self.path).getFileSystem(spark._jsc.hadoopConfiguration())
        self.fs.mkdirs(self.jpath(self.path))

    # ---- manifest: the newest file of its folder counts

    def _number(self) -> int:
        folder = self.jpath(f"{self.path}/_manifests")
        if not self.fs.exists(folder):
            return 0
        names = [s.getPath().getName() for s in self.fs.listStatus(folder)]
        return max([int(n[:-5]) for n in names if n.endswith(".json")], default=0)

    def manifest(self) -> dict[str, list[str]]:
        n = self._number()
        if not n:
            return {}
        stream = self.fs.open(self.jpath(f"{self.path}/_manifests/{n:012d}.json"))
        try:
            found = json.loads(bytes(stream.readAllBytes()).decode())
            return {k: [v] if isinstance(v, str) else v for k, v in found.items()}
        finally:
            stream.close()

    def version(self) -> int:
        return self._number()

    def _publish(self, manifest: dict[str, list[str]]) -> None:
        n = self._number() + 1
        temp = self.jpath(f"{self.path}/_manifests/_{uuid.uuid4().hex}")
        stream = self.fs.create(temp)
        stream.write(bytearray(json.dumps(manifest).encode()))
        stream.close()
        if not self.fs.rename(temp, self.jpath(f"{self.path}/_manifests/{n:012d}.json")):
            raise RuntimeError("another writer committed first")

    # ---- tables

    def read(self, name: str, schema: T.StructType) -> DataFrame:
        at = self.manifest().get(name)
        return self.spark.createDataFrame([], schema) if at is None else self.spark.read.schema(schema).parquet(*[f"{self.path}/{x}" for x in at])

    def table(self, t: Type) -> DataFrame:
        return self.read(t.collection, table_type(self.model, t))

    def edges(self, r: Relation) -> DataFrame:
        return self.read(f"_edges/{r.name}", EDGE)

    def commit(self, changed: dict[str, DataFrame], added: dict[str, DataFrame] | None = None) -> None:
        """Writes changed tables and added rows, then publishes them together; what isn't published is never read."""
        manifest, stamp = self.manifest(), uuid.uuid4().hex
        for name, df in changed.items():
            df.write.parquet(f"{self.path}/{name}/{stamp}")
            manifest[name] = [f"{name}/{stamp}"]
        for name, df in (added or {}).items():
            at = manifest.get(name, [])
            if len(at) >= MOST_FOLDERS:
                df, at = self.read(name, df.schema).unionByName(df), []
            df.write.parquet(f"{self.path}/{name}/{stamp}")
            manifest[name] = [*at, f"{name}/{stamp}"]
        if changed or added:
            self._publish(manifest)

    def sync_schema(self) -> list[str]:
        """Creates tables for root entities and relations that have none; returns their names."""
        have = self.manifest()
        new = {t.collection: self.spark.createDataFrame([], table_type(self.model, t)) for t in self.model.roots() if t.collection not in have}
        new |= {f"_edges/{r.name}": self.spark.createDataFrame([], EDGE) for r in self.model.relations() if f"_edges/{r.name}" not in have}
        self.commit(new)
        return sorted(new)

    def binding(self) -> Binding:
        b = Binding(self.spark, self.model)
        for t in self.model.roots():
            b.bind(t.name, lambda t=t: self.table(t))
        for r in self.model.relations():
            b.bind_edges(f"{r.from_type}.{r.field}", lambda r=r: self.edges(r))
        return b
