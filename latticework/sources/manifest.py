"""Numbered snapshots of a folder: small JSON documents, each made visible by one rename, through Hadoop's file system (any that Spark can write to)."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import SparkSession


class Manifests:
    """The snapshots in ``folder``: 0, 1, .. One writer at a time; of two that commit the same number, one gets an error and nothing is lost."""

    def __init__(self, spark: SparkSession, folder: str):
        self.jvm = spark.sparkContext._jvm
        self.folder = folder.rstrip("/")
        self.system = self._path(self.folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _path(self, where: str):
        return self.jvm.org.apache.hadoop.fs.Path(where)

    def versions(self) -> list[int]:
        if not self.system.exists(self._path(self.folder)):
            return []
        names = [s.getPath().getName() for s in self.system.listStatus(self._path(self.folder))]
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())

    def read(self, version: int | None = None) -> dict:
        """A snapshot, the last by default; {} where there is none yet."""
        there = self.versions()
        if not there and version is None:
            return {}
        version = there[-1] if version is None else version
        if version not in there:
            raise ValueError(f"there is no snapshot {version} in {self.folder}")
        stream = self.system.open(self._path(f"{self.folder}/{version}.json"))
        try:
            return json.loads(bytes(stream.readAllBytes())) | {"version": version}
        finally:
            stream.close()

    def commit(self, content: dict, after: int) -> int:
        """Makes content the snapshot after number ``after`` (-1: the first)."""
        target, draft = self._path(f"{self.folder}/{after + 1}.json"), self._path(f"{self.folder}/.{uuid.uuid4().hex}")
        stream = self.system.create(draft, False)
        try:
            stream.write(json.dumps(content).encode())
        finally:
            stream.close()
        if self.system.exists(target) or not self.system.rename(draft, target):
            self.system.delete(draft, False)
            raise ValueError(f"snapshot {after + 1} in {self.folder} has been committed by another writer")
        return after + 1

    def forget(self, version: int) -> None:
        self.system.delete(self._path(f"{self.folder}/{version}.json"), False)

    def children(self, folder: str) -> list[str]:
        where = self._path(folder)
        return sorted(s.getPath().getName() for s in self.system.listStatus(where)) if self.system.exists(where) else []

    def delete(self, where: str) -> None:
        self.system.delete(self._path(where), True)
