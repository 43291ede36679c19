"""Versioned registries of tables by name, with an audit log: one for a session, and one that outlives the process."""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Mapping
from dataclasses import dataclass, field
from datetime import datetime, timezone

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


@dataclass
class Registry:
    """name -> table. A table of the same name is replaced, and its version goes up; plans are immutable, so old ones stay usable."""

    tables: dict[str, DataFrame] = field(default_factory=dict)
    versions: dict[str, int] = field(default_factory=dict)
    log: list[str] = field(default_factory=list)

    def note(self, message: str) -> None:
        self.log.append(f"{datetime.now():%H:%M:%S}: {message}")

    def put(self, name: str, df: DataFrame, why: str = "loaded") -> int:
        self.versions[name] = self.versions.get(name, 0) + 1
        self.tables[name] = df
        df.createOrReplaceTempView(self.view(name))
        self.note(f"{name} version {self.versions[name]}: {why}")
        return self.versions[name]

    def get(self, name: str) -> DataFrame | None:
        return self.tables.get(name)

    @staticmethod
    def view(name: str) -> str:
        return "t_" + re.sub(r"\W", "_", name)


class Conflict(RuntimeError):
    """Another session has committed the same version meanwhile."""


class StoredRegistry:
    """Tables in a folder that all sessions share: root/tables/<name>/<version>.json is a manifest, beside the folders of rows that manifests name.

    A version's rows are written to a folder of their own first; then its manifest, written aside, is renamed to the version's number, which fails
    where that is taken. So readers see whole versions only, a version never changes, and what a lost job leaves is in no manifest. The log is a table that each
    event appends to. Paths may be in any store that Spark's file systems open.
    """

    LOG = "at timestamp, name string, version long, rows long, message string"

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._files = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    def _folder(self, name: str) -> str:
        if not name:
            raise ValueError("a table needs a name")
        safe = re.sub(r"[^A-Za-z0-9._-]", lambda m: "".join(f"~{b:02x}" for b in m[0].encode()), name)
        return f"{self.root}/tables/{safe}"

    def names(self) -> list[str]:
        """Of the tables that have a version."""
        top = self._path(f"{self.root}/tables")
        found = [x.getPath().getName() for x in self._files.listStatus(top)] if self._files.exists(top) else []
        plain = [re.sub(r"(?:~[0-9a-f]{2})+", lambda m: bytes.fromhex(m[0].replace("~", "")).decode(), x) for x in found]
        return sorted(x for x in plain if self.history(x))

    def history(self, name: str) -> list[int]:
        """The versions that are committed, ascending."""
        folder = self._path(self._folder(name))
        found = [x.getPath().getName() for x in self._files.listStatus(folder)] if self._files.exists(folder) else []
        return sorted(int(m[1]) for x in found if (m := re.fullmatch(r"(\d+)\.json", x)))

    @property
    def versions(self) -> Mapping[str, int]:
        """The latest version of each table."""
        return {n: self.history(n)[-1] for n in self.names()}

    def _manifest(self, name: str, version: int) -> dict:
        path = f"{self._folder(name)}/{version}.json"
        return json.loads(self.spark.read.text(path, wholetext=True).first()[0])

    def put(self, name: str, df: DataFrame, why: str = "loaded", after: int | None = None) -> int:
        """Writes a new version and returns its number. after: the version it was made from; an error if that is not the latest any more."""
        folder, seen = self._folder(name), Observation()
        latest = (self.history(name) or [0])[-1]
        if after is not None and after != latest:
            raise Conflict(f"{name} is at version {latest}, not {after}")
        rows = f"rows-{uuid.uuid4().hex}"
        df.observe(seen, F.count(F.lit(1)).alias("rows")).write.parquet(f"{folder}/{rows}")
        version, n = latest + 1, seen.get["rows"]
        manifest = {"rows": rows, "n": n, "why": why, "schema": df.schema.json()}
        aside = self._path(f"{folder}/.{uuid.uuid4().hex}.json")
        out = self._files.create(aside, False)
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()
        target = self._path(f"{folder}/{version}.json")
        if self._files.exists(target) or not self._files.rename(aside, target):
            self._files.delete(aside, False)
            raise Conflict(f"version {version} of {name} was committed by another session")
        self.note(f"{name} version {version}: {why}", name, version, n)
        return version

    def get(self, name: str, version: int | None = None) -> DataFrame | None:
        """A version's rows, the latest if none is given; None if there is no such table or version. The plan stays with that version."""
        known = self.history(name)
        if not known or version is not None and version not in known:
            return None
        manifest = self._manifest(name, version or known[-1])
        return self.spark.read.schema(self._schema(manifest)).parquet(f"{self._folder(name)}/{manifest['rows']}")

    @staticmethod
    def _schema(manifest: dict):
        from pyspark.sql.types import StructType

        return StructType.fromJson(json.loads(manifest["schema"]))

    def note(self, message: str, name: str | None = None, version: int | None = None, rows: int | None = None) -> None:
        event = [(datetime.now(timezone.utc), name, version, rows, message)]
        self.spark.createDataFrame(event, self.LOG).coalesce(1).write.mode("append").parquet(f"{self.root}/log")

    def log(self) -> DataFrame:
        """(at, name, version, rows, message) of all events."""
        path = f"{self.root}/log"
        if not self._files.exists(self._path(path)):
            return self.spark.createDataFrame([], self.LOG)
        return self.spark.read.schema(self.LOG).parquet(path)
