"""Tables that grow by deltas: written under an attempt of their own, published all at once by one manifest."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from tidemark.session import remove_path


class Attempt:
    """Tables of one delta on their way; nobody else sees them before ``publish``."""

    def __init__(self, store: DeltaStore):
        self.store, self.base = store, store.manifest()
        self.number, self.name = self.base["number"] + 1, uuid.uuid4().hex[:12]
        self.tables: dict[str, tuple[str, str]] = {}

    def write(self, df: DataFrame, table: str) -> DataFrame:
        """Write ``df`` as this delta of ``table`` and read it back: the plan ends here and isn't run again."""
        path = f"{self.store.path}/{table}/delta={self.number:06d}-{self.name}"
        df.write.mode("overwrite").parquet(path)
        self.tables[table] = (path, df.schema.json())
        return self.store.spark.read.schema(df.schema).parquet(path)

    def read(self, table: str) -> DataFrame | None:
        """The published deltas of ``table`` with this one; null if there is none."""
        paths = list(self.base["tables"].get(table, {}).get("paths", []))
        schema = self.base["tables"].get(table, {}).get("schema")
        if table in self.tables:
            path, schema = self.tables[table]
            paths.append(path)
        return self.store.spark.read.schema(StructType.fromJson(json.loads(schema))).parquet(*paths) if paths else None

    def publish(self) -> None:
        """Make the delta visible: one new manifest names the old deltas and this one."""
        tables = {name: {"schema": entry["schema"], "paths": list(entry["paths"])} for name, entry in self.base["tables"].items()}
        for name, (path, schema) in self.tables.items():
            tables.setdefault(name, {"schema": schema, "paths": []})["paths"].append(path)
        self.store.put({"number": self.number, "tables": tables})


class DeltaStore:
    """Delta tables under ``path``, for one writer and any number of readers.

    ``manifest-N.json`` names the deltas of version N; the highest number is the current one. A job that
    ends before its manifest is written leaves folders that no version names, so it can be run again, and
    a reader sees whole versions only. ``compact`` rewrites the deltas of a table as one.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _fs(self):
        jvm = self.spark.sparkContext._jvm
        root = jvm.org.apache.hadoop.fs.Path(self.path)
        return jvm, root, root.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def manifest(self) -> dict:
        """The current version; number 0 without tables if there is none."""
        jvm, root, fs = self._fs()
        if fs.exists(root):
            names = sorted((f.getPath().getName() for f in fs.listStatus(root) if f.getPath().getName().startswith("manifest-")), reverse=True)
            for name in names:
                stream = fs.open(jvm.org.apache.hadoop.fs.Path(root, name))
                text = bytes(stream.readAllBytes()).decode()
                stream.close()
                try:
                    return {**json.loads(text), "number": int(names[0].removeprefix("manifest-").removesuffix(".json"))}
                except ValueError:  # its writer died: the version before holds, and the next number is free
                    continue
        return {"number": 0, "tables": {}}

    def put(self, manifest: dict) -> None:
        """Write a manifest beside its place and move it there; an existing one is never replaced."""
        jvm, root, fs = self._fs()
        fs.mkdirs(root)
        own, place = jvm.org.apache.hadoop.fs.Path(root, f"_{uuid.uuid4().hex}"), jvm.org.apache.hadoop.fs.Path(root, f"manifest-{manifest['number']:09d}.json")
        out = fs.create(own, True)
        out.write(bytearray(json.dumps(manifest), "utf-8"))
        out.close()
        if fs.exists(place) or not fs.rename(own, place):
            fs.delete(own, False)
            raise RuntimeError(f"version {manifest['number']} was published by another writer")

    def attempt(self) -> Attempt:
        return Attempt(self)

    def read(self, table: str) -> DataFrame | None:
        """All published rows of ``table``; null if it has none."""
        return self.attempt().read(table)

    def compact(self, table: str, partitions: int | None = None) -> None:
        """Rewrite the deltas of ``table`` as one delta of a new version; older versions stay readable until ``vacuum``."""
        attempt = self.attempt()
        df = attempt.read(table)
        if df is None:
            return
        attempt.write(df.coalesce(partitions) if partitions else df, table)
        manifest = {"number": attempt.number, "tables": {**attempt.base["tables"], table: {"schema": attempt.tables[table][1], "paths": [attempt.tables[table][0]]}}}
        self.put(manifest)

    def vacuum(self) -> int:
        """Remove the folders that the current version doesn't name; how many there were."""
        jvm, root, fs = self._fs()
        kept = {p for entry in self.manifest()["tables"].values() for p in entry["paths"]}
        gone = 0
        for table in fs.listStatus(root) if fs.exists(root) else []:
            if table.isDirectory():
                for delta in fs.listStatus(table.getPath()):
                    name = f"{self.path}/{table.getPath().getName()}/{delta.getPath().getName()}"
                    if name not in kept:
                        remove_path(self.spark, name)
                        gone += 1
        return gone
