"""Keyed tables that are really written: Parquet in hash buckets, with one manifest for each snapshot.

A merge rewrites only the buckets that its rows fall into, under folders of its own, and then adds one manifest: a small JSON file
that names each bucket's folder and the last batch of each writer. Readers see a snapshot as a whole or not at all; a writer that fails before its
manifest leaves the table as it was, and a batch that is given again changes nothing.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from brindle.operators import upserts
from brindle.operators.ranking import top_per_group

Merge = Callable[[DataFrame, DataFrame], DataFrame]


class Conflict(Exception):
    """Another writer added the snapshot that this one was about to add; read again and repeat."""


class KeyedTable:
    """One row for each key, in a folder that all executors share."""

    def __init__(self, spark: SparkSession, folder: str, schema: StructType | str, keys: list[str], buckets: int = 16):
        self.spark, self.folder, self.keys, self.buckets = spark, folder.rstrip("/"), keys, buckets
        self.schema = spark.createDataFrame([], schema).schema
        jvm = spark.sparkContext._jvm
        self._path = lambda p: jvm.org.apache.hadoop.fs.Path(p)
        self._fs = self._path(folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _manifests(self) -> list[int]:
        where = self._path(f"{self.folder}/_manifests")
        if not self._fs.exists(where):
            return []
        return sorted(int(s.getPath().getName().split(".")[0]) for s in self._fs.listStatus(where) if s.getPath().getName().endswith(".json"))

    def manifest(self, version: int | None = None) -> dict:
        """The newest snapshot, or that of ``version``; of an empty table, one without buckets."""
        found = self._manifests()
        if version is None and not found:
            return {"version": -1, "buckets": {}, "batches": {}}
        stream = self._fs.open(self._path(f"{self.folder}/_manifests/{found[-1] if version is None else version:010d}.json"))
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def _commit(self, manifest: dict) -> None:
        """Write aside, then rename: a file system that does not rename over a file lets only one writer have a version."""
        target = self._path(f"{self.folder}/_manifests/{manifest['version']:010d}.json")
        aside = self._path(f"{self.folder}/_manifests/.{uuid.uuid4().hex}")
        out = self._fs.create(aside, False)
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()
        if self._fs.exists(target) or not self._fs.rename(aside, target):
            self._fs.delete(aside, False)
            raise Conflict(f"version {manifest['version']} of {self.folder} is there already")

    def read(self, version: int | None = None) -> DataFrame:
        """A snapshot's rows; older ones stay readable."""
        folders = sorted(set(self.manifest(version)["buckets"].values()))
        return self._rows(folders)

    def _rows(self, folders: list[str]) -> DataFrame:
        if not folders:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*[f"{self.folder}/{f}" for f in folders])

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")

    def merge(self, rows: DataFrame, merge: Merge, *, writer: str = "", batch: int | None = None) -> bool:
        """Apply ``merge(target, rows)``, a function to the new target such as those of ``upserts``, to the buckets that ``rows`` fall into.

        ``batch`` numbers a writer's batches in rising order, as ``foreachBatch`` does: one that the table has already is left out (False).
        ``merge`` sees the rows of whole buckets and must keep keys in place. Rows with a null key part are an error of the caller's and
        fall into a bucket like others. Without rows nothing is written.
        """
        old = self.manifest()
        if batch is not None and old["batches"].get(writer, -1) >= batch:
            return False
        rows = rows.withColumn("_bucket", self._bucket()).persist()
        try:
            touched = sorted(r[0] for r in rows.select("_bucket").distinct().collect())  # at most ``buckets`` numbers
            snapshot = f"data/{old['version'] + 1:010d}-{uuid.uuid4().hex[:8]}"
            target = self._rows(sorted({old["buckets"][str(b)] for b in touched if str(b) in old["buckets"]}))
            new = merge(target, rows.drop("_bucket")).select(*self.schema.names)
            if touched:
                new.withColumn("_bucket", self._bucket()).repartition("_bucket").write.partitionBy("_bucket").parquet(f"{self.folder}/{snapshot}")
        finally:
            rows.unpersist()
        there = {f"_bucket={b}" for b in touched if self._fs.exists(self._path(f"{self.folder}/{snapshot}/_bucket={b}"))}
        buckets = {**{b: f for b, f in old["buckets"].items() if int(b) not in touched}, **{str(b): f"{snapshot}/_bucket={b}" for b in touched if f"_bucket={b}" in there}}
        batches = old["batches"] if batch is None else {**old["batches"], writer: batch}
        self._commit({"version": old["version"] + 1, "buckets": buckets, "batches": batches})
        return True

    def upsert(self, rows: DataFrame, order: list[Column] | None = None, fill_only: tuple[str, ...] = (), **batch) -> bool:
        """:func:`upserts.upsert` as a merge; ``order`` says which of a batch's rows of a key counts."""
        return self.merge(rows, lambda old, new: upserts.upsert(old, new, self.keys, order, fill_only), **batch)

    def insert(self, rows: DataFrame, order: list[Column], **batch) -> bool:
        """Rows whose key is not there yet, the first of each key by ``order``."""
        return self.merge(rows, lambda old, new: upserts.insert_absent(old, top_per_group(new, self.keys, order), self.keys), **batch)

    def delete(self, keys: DataFrame, **batch) -> bool:
        return self.merge(keys, lambda old, gone: upserts.remove_keys(old, gone, self.keys), **batch)


def in_batches(rows: DataFrame, number: Column, n: int) -> list[DataFrame]:
    """Rows as ``n`` batches by a number of theirs, for replays of recorded writes."""
    return [rows.where(F.pmod(number, F.lit(n)) == b) for b in range(n)]
