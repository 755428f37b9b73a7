"""A store of documents with versions: put, replace and delete by document, and readers that stay at a version.

A version is a manifest that lists folders of changes; a change puts a document's rows or deletes the document. A writer
adds a folder and then the next manifest, which only one writer can create, so that a version is there as a whole or not
at all, and a reader that took a version never sees a later one. The last change of a document counts. Batches have names:
one that is in the store already changes nothing, so that a batch may be sent again after a failure.

Changes are written by bucket of the document's id and read by an aggregate over it; `compact` writes a version's rows as
one folder of puts, and `clean` removes folders that no kept version lists.

Defined results: rows of a document stand together: a batch that puts a document replaces all of its rows; a null id is a
document; documents that are both put and deleted in a batch are put; an unknown document can be deleted; an empty batch
makes a version; a store without versions has no rows and no columns but the id.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Conflict(RuntimeError):
    """Other writers made versions faster than this one could."""


@dataclass(frozen=True)
class Store:
    """Documents below a folder that all machines see; `key` names the document of a row."""

    spark: SparkSession
    path: str
    key: str = "doc_id"
    buckets: int = 64

    def _place(self, *parts: str):
        sc = self.spark.sparkContext
        where = sc._jvm.org.apache.hadoop.fs.Path("/".join([self.path.rstrip("/"), *parts]))
        return where.getFileSystem(sc._jsc.hadoopConfiguration()), where

    def versions(self) -> list[int]:
        """The numbers of all versions, rising."""
        store, where = self._place("versions")
        if not store.exists(where):
            return []
        names = [s.getPath().getName() for s in store.listStatus(where)]
        return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json") and not n.startswith("."))

    def manifest(self, version: int | None = None) -> dict:
        """What a version lists, the newest unless one is named: folders of changes from old to new, and batches."""
        if version is None:
            every = self.versions()
            if not every:
                return {"version": 0, "folders": [], "batches": [], "schema": None}
            version = every[-1]
        _, where = self._place("versions", f"{version:012d}.json")
        return json.loads("".join(r.value for r in self.spark.read.text(where.toString()).collect()))

    def _commit(self, manifest: dict) -> bool:
        """Make a version; False if its number was taken meanwhile."""
        store, where = self._place("versions", f"{manifest['version']:012d}.json")
        _, draft = self._place("versions", f".{uuid.uuid4().hex}.draft")
        out = store.create(draft, False)
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()
        # a rename never replaces a file in Hadoop's file systems; where it may, the check before it makes that unlikely
        done = not store.exists(where) and store.rename(draft, where)
        if not done:
            store.delete(draft, False)
        return bool(done)

    def write(self, batch: str, put: DataFrame | None = None, delete: DataFrame | None = None, attempts: int = 10) -> int:
        """A version with the documents of `put` put in place of what they were, and those of `delete` (its key column)
        gone. Returns its number, or that of the newest one if the batch is in it already."""
        now = self.manifest()
        if batch in now["batches"]:
            return now["version"]
        parts = []
        if put is not None:
            if {"_deleted", "_bucket", "_change"} & set(put.columns):
                raise ValueError("the names _deleted, _bucket and _change are taken")
            parts.append(put.withColumn("_deleted", F.lit(False)))
        if delete is not None:
            gone = delete.select(self.key).distinct()
            if put is not None:
                gone = gone.join(put.select(F.col(self.key).alias("_put")).distinct(), F.col(self.key).eqNullSafe(F.col("_put")), "left_anti")
            parts.append(gone.withColumn("_deleted", F.lit(True)))
        if not parts:
            raise ValueError("a batch puts or deletes something")
        changes = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1], allowMissingColumns=True)
        folder = f"changes/{uuid.uuid4().hex}"
        bucket = F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int")
        changes.withColumn("_bucket", bucket).repartition("_bucket").sortWithinPartitions("_bucket", self.key).write.parquet(f"{self.path}/{folder}")
        schema = put.schema.jsonValue() if put is not None else None
        return self._next(batch, folder, schema, attempts)

    def _next(self, batch: str, folder: str, schema: dict | None, attempts: int) -> int:
        for _ in range(attempts):
            now = self.manifest()
            if batch in now["batches"]:  # the same batch, by another writer
                return now["version"]
            new = {"version": now["version"] + 1, "folders": [*now["folders"], folder], "batches": [*now["batches"], batch], "schema": _wider(now["schema"], schema)}
            if self._commit(new):
                return new["version"]
        raise Conflict(f"{attempts} versions were taken by others")

    def read(self, version: int | None = None) -> DataFrame:
        """All documents as of a version, the newest unless one is named. The frame stays at that version."""
        m = self.manifest(version)
        from pyspark.sql.types import StructType

        if not m["schema"]:
            return self.spark.createDataFrame([], f"`{self.key}` string")
        wanted = StructType.fromJson(m["schema"])
        full = StructType([*wanted.fields]).add("_deleted", "boolean")
        every = None
        for n, folder in enumerate(m["folders"]):
            part = self.spark.read.schema(full).parquet(f"{self.path}/{folder}").withColumn("_change", F.lit(n))
            every = part if every is None else every.unionByName(part)
        if len(m["folders"]) > 1:
            # one row for each document: its last change
            last = every.groupBy(F.col(self.key).alias("_key")).agg(F.max("_change").alias("_last"))
            every = every.join(last, F.col(self.key).eqNullSafe(F.col("_key")) & (F.col("_change") == F.col("_last")))
        return every.filter(~F.col("_deleted")).select(*wanted.names)

    def compact(self, attempts: int = 10) -> int:
        """A version with the same documents in one folder. Fails if another version came meanwhile and attempts run out."""
        for _ in range(attempts):
            now = self.manifest()
            if len(now["folders"]) < 2:
                return now["version"]
            folder = f"changes/{uuid.uuid4().hex}"
            bucket = F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int")
            self.read(now["version"]).withColumn("_deleted", F.lit(False)).withColumn("_bucket", bucket).repartition("_bucket").sortWithinPartitions("_bucket", self.key).write.parquet(f"{self.path}/{folder}")
            if self._commit(now | {"version": now["version"] + 1, "folders": [folder]}):
                return now["version"] + 1
        raise Conflict(f"{attempts} versions were taken by others")

    def clean(self, keep: int) -> list[str]:
        """Forget all but the newest `keep` versions, and delete the folders that none of those lists. Not while writers
        are at work: a folder whose version isn't made yet is in no list."""
        every = self.versions()
        kept = every[-keep:]
        used = {f for v in kept for f in self.manifest(v)["folders"]}
        store, where = self._place("changes")
        gone = [f"changes/{s.getPath().getName()}" for s in store.listStatus(where)] if store.exists(where) else []
        gone = sorted(f for f in gone if f not in used)
        for v in every[: len(every) - len(kept)]:
            store.delete(self._place("versions", f"{v:012d}.json")[1], False)
        for f in gone:
            store.delete(self._place(f)[1], True)
        return gone


def _wider(old: dict | None, new: dict | None) -> dict | None:
    """Both schemas' columns; a column keeps its type."""
    if old is None or new is None:
        return new or old
    fields = {f["name"]: f for f in old["fields"]}
    for f in new["fields"]:
        if f["name"] in fields and fields[f["name"]]["type"] != f["type"]:
            raise ValueError(f"column {f['name']!r} is {fields[f['name']]['type']} in the store, not {f['type']}")
        fields.setdefault(f["name"], f)
    return old | {"fields": list(fields.values())}
