"""Versioned snapshots: files are written once, a manifest names the current ones, and it changes by compare-and-swap.

A base lives under ``<root>/<kb_id>``: ``snapshots/<id>/<table>`` holds Parquet, ``manifests/<n>.json`` one manifest a
version.  A version is published by creating its file, which fails if another writer has created it: readers see the
old version or the new one.  All access goes through Hadoop's FileSystem, so any store that Spark reads will do; the
guarantee needs a store that refuses to create a file that exists.
"""

from __future__ import annotations

import contextlib
import hashlib
import json
import re
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..policy import manifest_backoff, safe_identifier, with_retry

FORMAT, FORMAT_VERSION = "tessera_parquet_sharded", 3
#: The table of shards, a row each; every other table with a ``shard_id`` is partitioned by it.
SHARDS = "shards"


class VersionMismatch(RuntimeError):
    """Another writer published first."""


class UnsupportedFormat(RuntimeError):
    """A manifest of another format or version."""


class NotFound(KeyError):
    """No such object."""


class BlobStore:
    """Objects by key under a root path: head, get, put if unchanged, delete, list, copy."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._jvm = spark.sparkContext._jvm
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()

    def path(self, key: str):
        if ".." in key.split("/"):
            raise ValueError(f"unsafe key {key!r}")
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{key}")

    def _fs(self, path):
        return path.getFileSystem(self._conf)

    def exists(self, key: str) -> bool:
        p = self.path(key)
        return self._fs(p).exists(p)

    def get(self, key: str) -> bytes:
        p = self.path(key)
        if not self._fs(p).exists(p):
            raise NotFound(key)
        stream = self._fs(p).open(p)
        try:
            return bytes(self._jvm.org.apache.commons.io.IOUtils.toByteArray(stream))
        finally:
            stream.close()

    def head(self, key: str) -> str:
        """The version of an object: the hash of its bytes."""
        return hashlib.sha256(self.get(key)).hexdigest()

    def create(self, key: str, data: bytes) -> None:
        """Write an object that must not exist."""
        p = self.path(key)
        try:
            stream = self._fs(p).create(p, False)
        except Exception as e:
            raise VersionMismatch(key) from e
        try:
            stream.write(bytearray(data))
        finally:
            stream.close()

    def _rename(self, source: str, target: str, over: bool) -> None:
        """Atomic where the store's rename is: fails if the target exists, or takes its place."""
        a, b = self.path(source), self.path(target)
        how = getattr(self._jvm.org.apache.hadoop.fs, "Options$Rename")
        options = self.spark.sparkContext._gateway.new_array(how, 1)
        options[0] = how.OVERWRITE if over else how.NONE
        self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs(a).getUri(), self._conf).rename(self._fs(a).makeQualified(a), self._fs(b).makeQualified(b), options)

    def put_if(self, key: str, data: bytes, expected: str) -> str:
        """Replace an object if its version is ``expected``; empty: it must not exist.

        The new bytes take a name made of the key and the expected version, which only one writer can get, and move
        from there over the object.  The object is there at all times; a move that a lost writer left undone is
        finished by the next, who then fails as having come second.
        """
        if not expected:
            self.create(key, data)
            return hashlib.sha256(data).hexdigest()
        if self.head(key) != expected:
            raise VersionMismatch(key)
        claim, temporary, version = f"{key}.{expected}.next", f"{key}.{uuid.uuid4().hex}.tmp", hashlib.sha256(data).hexdigest()
        self.create(temporary, data)
        try:
            self._rename(temporary, claim, over=False)
        except Exception as e:
            self.delete(temporary)
            with contextlib.suppress(Exception):
                if self.head(key) == expected:
                    self._rename(claim, key, over=True)
            raise VersionMismatch(key) from e
        if self.head(key) != expected:
            self.delete(claim)
            raise VersionMismatch(key)
        try:
            self._rename(claim, key, over=True)
        except Exception as e:  # another writer may have finished this move
            if self.head(key) != version:
                raise VersionMismatch(key) from e
        return version

    def delete(self, key: str) -> bool:
        p = self.path(key)
        return self._fs(p).delete(p, True)

    def list(self, prefix: str) -> list[tuple[str, int]]:
        """(key, size) of the files below a folder, by key."""
        p = self.path(prefix)
        if not self._fs(p).exists(p):
            return []
        found, out = self._fs(p).listFiles(p, True), []
        base = self._fs(p).makeQualified(self.path("")).toUri().getPath().rstrip("/")
        while found.hasNext():
            f = found.next()
            out.append((f.getPath().toUri().getPath()[len(base) + 1 :], f.getLen()))
        return sorted(x for x in out if not re.search(r"(^|/)\.[^/]*\.crc$", x[0]))


@dataclass(frozen=True)
class Snapshot:
    version: int
    manifest: dict

    def names(self) -> list[str]:
        return sorted(self.manifest["tables"])


class SnapshotStore:
    """Versioned tables of knowledge bases."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.blobs = spark, BlobStore(spark, root)

    def _versions(self, kb_id: str) -> list[int]:
        keys = self.blobs.list(f"{safe_identifier(kb_id)}/manifests")
        return sorted(int(m[1]) for k, _ in keys if (m := re.search(r"/(\d+)\.json$", k)))

    def current(self, kb_id: str) -> Snapshot | None:
        """The newest published version.  A manifest file never changes, so one stable read is enough; a listing may lag, so it is tried again."""

        def read() -> Snapshot | None:
            versions = self._versions(kb_id)
            if not versions:
                return None
            manifest = json.loads(self.blobs.get(f"{kb_id}/manifests/{versions[-1]:020d}.json"))
            if (manifest.get("format_kind"), manifest.get("format_version", 1)) != (FORMAT, FORMAT_VERSION):
                raise UnsupportedFormat(f"{manifest.get('format_kind')} {manifest.get('format_version', 1)}")
            return Snapshot(versions[-1], manifest)

        return with_retry(read, 4, (NotFound, json.JSONDecodeError), manifest_backoff)

    def read(self, kb_id: str, table: str, snapshot: Snapshot | None = None) -> DataFrame:
        snapshot = snapshot or self.current(kb_id)
        if snapshot is None or table not in snapshot.manifest["tables"]:
            raise NotFound(f"{kb_id}/{table}")
        return self._read(snapshot.manifest["tables"][table], snapshot.manifest["schemas"][table])

    def _read(self, key: str, schema: dict) -> DataFrame:
        """A table by its schema of record: an empty one has no file to tell it."""
        return self.spark.read.schema(StructType.fromJson(schema)).parquet(f"{self.blobs.root}/{key}")

    def has(self, kb_id: str, table: str) -> bool:
        snapshot = self.current(kb_id)
        return snapshot is not None and table in snapshot.manifest["tables"]

    def staged(self, kb_id: str, df: DataFrame) -> tuple[DataFrame, str]:
        """``df`` written once, and the key to delete it by: for what several tables of a version are made of."""
        key = f"{safe_identifier(kb_id)}/staging/{uuid.uuid4().hex}"
        df.write.parquet(f"{self.blobs.root}/{key}")
        return self.spark.read.schema(df.schema).parquet(f"{self.blobs.root}/{key}"), key

    def publish(self, kb_id: str, tables: dict[str, DataFrame | Callable[[Callable[[str], DataFrame]], DataFrame]], expected: int | None) -> Snapshot:
        """Stage the tables, check what was staged, and make them the version after ``expected`` (None: the first).

        Tables that are not given stay as they were.  A table given as a function is made from those before it, which
        the function reads by name as they were written.  Fails with VersionMismatch, changing nothing, if another
        version has been published meanwhile.
        """
        safe_identifier(kb_id)
        before = self.current(kb_id)
        if (before.version if before else None) != expected:
            raise VersionMismatch(f"{kb_id}: expected {expected}, found {before and before.version}")
        snapshot_id, placed, schemas = uuid.uuid4().hex, *(dict(before.manifest[n]) if before else {} for n in ("tables", "schemas"))
        for name, df in tables.items():
            if not isinstance(df, DataFrame):
                df = df(lambda other: self._read(placed[other], schemas[other]))
            key = f"{kb_id}/snapshots/{snapshot_id}/{safe_identifier(name)}"
            writer = df.write
            if "shard_id" in df.columns and name != SHARDS:
                writer = df.repartition("shard_id").write.partitionBy("shard_id")
            writer.parquet(f"{self.blobs.root}/{key}")
            if not self.blobs.exists(f"{key}/_SUCCESS"):
                raise NotFound(key)
            placed[name], schemas[name] = key, df.schema.jsonValue()
        version = (expected or 0) + 1
        total = sum(size for key in placed.values() for _, size in self.blobs.list(key))
        manifest = {
            "schema_version": 1, "layout": "sharded", "format_kind": FORMAT, "format_version": FORMAT_VERSION, "kb_id": kb_id, "total_size_bytes": total, "tables": placed, "schemas": schemas,
        }
        self.blobs.create(f"{kb_id}/manifests/{version:020d}.json", json.dumps(manifest, indent=1).encode())
        return Snapshot(version, manifest)

    def unreferenced(self, kb_id: str) -> list[str]:
        """Snapshot folders that the current manifest no longer names."""
        snapshot = self.current(kb_id)
        live = {"/".join(p.split("/")[:3]) for p in (snapshot.manifest["tables"].values() if snapshot else [])}
        return sorted({"/".join(k.split("/")[:3]) for k, _ in self.blobs.list(f"{kb_id}/snapshots")} - live)

    def collect_garbage(self, kb_id: str) -> list[str]:
        """Delete unreferenced snapshot folders; call it a grace time after they were replaced."""
        gone = self.unreferenced(kb_id)
        for key in gone:
            self.blobs.delete(key)
        return gone

    def drop(self, kb_id: str) -> None:
        """Delete a base, its manifests first."""
        self.blobs.delete(f"{safe_identifier(kb_id)}/manifests")
        self.blobs.delete(kb_id)

    def export(self, kb_id: str, path: str) -> None:
        """One plain dataset a table, without shards."""
        snapshot = self.current(kb_id)
        if snapshot is None:
            raise NotFound(kb_id)
        for name in snapshot.names():
            self.read(kb_id, name, snapshot).write.mode("overwrite").parquet(f"{path}/{name}")


def integrity(spark: SparkSession, path: str) -> DataFrame:
    """``path, size, sha256`` of the files below a path, hashed where they are read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select("path", F.col("length").alias("size"), F.sha2("content", 256).alias("sha256"))
