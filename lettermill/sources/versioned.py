"""Parquet tables that several writers update: copy on write, and a manifest for each version."""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lettermill.session import durable

BUCKETS = 64
#: A bucket of more folders is written anew.
PARTS = 8


@dataclass(frozen=True)
class Manifest:
    """A version: the folder that holds each bucket (several, joined by ``+``, once
    rows have been appended), and the runs it contains."""

    version: int
    schema: str
    keys: list[str]
    n_buckets: int
    buckets: dict[str, str] = field(default_factory=dict)
    runs: list[str] = field(default_factory=list)
    by: list[str] | None = None


class Conflict(Exception):
    """Another writer has made the next version."""


class VersionedTable:
    """A table below ``path``, dealt by a hash of its keys into buckets.

    ``data/<uuid>/bucket=<k>`` holds Parquet files, which never change;
    ``versions/<number>`` is the manifest of a version, which appears at once
    and only if no other writer has made that version. Readers see the rows of
    one manifest, whatever is written meanwhile. On HDFS and on a local disk
    the claim of a version is atomic; an object store must offer a rename that
    does not replace.
    """

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")

    # Files, by Spark's own file systems.

    def _fs(self, path: str):
        place = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return place.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), place

    def _versions(self) -> list[int]:
        store, place = self._fs(f"{self.path}/versions")
        if not store.exists(place):
            return []
        return sorted(int(name) for f in store.listStatus(place) if (name := f.getPath().getName()).isdigit())

    def manifest(self, version: int | None = None) -> Manifest:
        """That of a version, or of the last."""
        store, place = self._fs(f"{self.path}/versions/{max(self._versions()) if version is None else version:020d}")
        source = store.open(place)
        try:
            return Manifest(**json.loads(self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(source, "UTF-8")))
        finally:
            source.close()

    def _claim(self, manifest: Manifest) -> Manifest:
        """Make a version; raises ``Conflict`` if there is one of its number."""
        final = f"{self.path}/versions/{manifest.version:020d}"
        store, draft = self._fs(f"{self.path}/versions/_{uuid.uuid4().hex}")
        out = store.create(draft, True)
        out.write(bytearray(json.dumps(manifest.__dict__).encode()))
        out.close()
        place = self._fs(final)[1]
        try:
            if store.getScheme() == "file":  # a local rename replaces, a link does not
                local = lambda p: p.toUri().getPath()
                os.link(local(draft), local(place))
            elif store.exists(place) or not store.rename(draft, place):
                raise Conflict(final)
        except FileExistsError as e:
            raise Conflict(final) from e
        finally:
            store.delete(draft, False)
        return manifest

    # Rows.

    def _bucket(self, manifest: Manifest) -> Column:
        return F.pmod(F.xxhash64(*(manifest.by or manifest.keys)), F.lit(manifest.n_buckets)).cast("int")

    def _touched(self, manifest: Manifest, rows: DataFrame) -> set[str]:
        """The buckets that the keys of ``rows`` lie in: n_buckets at most."""
        return {str(r["bucket"]) for r in rows.select(self._bucket(manifest).alias("bucket")).distinct().collect()}

    def _write(self, rows: DataFrame, manifest: Manifest) -> dict[str, str]:
        """The rows as a new folder; the folder of each bucket that has any."""
        folder = uuid.uuid4().hex
        rows.withColumn("bucket", self._bucket(manifest)).repartition("bucket").write.partitionBy("bucket").parquet(f"{self.path}/data/{folder}")
        store, place = self._fs(f"{self.path}/data/{folder}")
        names = [f.getPath().getName() for f in store.listStatus(place)]
        return {n.removeprefix("bucket="): folder for n in names if n.startswith("bucket=")}

    def exists(self) -> bool:
        return bool(self._versions())

    def create(self, rows: DataFrame, keys: list[str], n_buckets: int = BUCKETS, by: list[str] | None = None) -> VersionedTable:
        """Version 0, of ``rows`` with distinct keys, dealt by some of these (all,
        if not told). Raises ``Conflict`` if there is a table."""
        if self.exists():
            raise Conflict(self.path)
        first = Manifest(0, rows.schema.json(), keys, n_buckets, by=by)
        self._claim(replace(first, buckets=self._write(rows, first)))
        return self

    def read(self, manifest: Manifest | None = None, only: Iterable[str] | None = None) -> DataFrame:
        """The rows of a version (the last, if none is given), or of some of its buckets."""
        manifest = manifest or self.manifest()
        schema = StructType.fromJson(json.loads(manifest.schema))
        wanted = set(manifest.buckets if only is None else only)
        paths = [f"{self.path}/data/{folder}/bucket={k}" for k, folders in manifest.buckets.items() if k in wanted for folder in folders.split("+")]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def near(self, rows: DataFrame) -> DataFrame:
        """The rows of the buckets that keys of ``rows`` lie in; the others are not read."""
        at = self.manifest()
        return self.read(at, self._touched(at, rows))

    def update(self, run: str, changes: DataFrame, merge: Callable[[DataFrame, DataFrame], DataFrame], attempts: int = 20) -> Manifest:
        """The version after ``merge(rows, changes)``, which gets and returns
        the rows of the buckets that hold keys of ``changes``; the others are
        not read. ``run`` names this update: once it is in the table, another
        update of that name changes nothing. If another writer has changed one
        of these buckets meanwhile, the merge is made again on what it left; if
        it changed others only, its version is taken over with ours added.
        """
        changes = durable(changes, "changes")
        at = self.manifest()
        touched = self._touched(at, changes)
        based, written = None, {}
        for _ in range(attempts):
            if run in at.runs:
                return at
            if based is None or any(based.buckets.get(k) != at.buckets.get(k) for k in touched):
                based, written = at, self._write(merge(self.read(at, touched), changes), at) if touched else {}
            kept = {k: f for k, f in at.buckets.items() if k not in touched}
            try:
                return self._claim(replace(at, version=at.version + 1, buckets=kept | written, runs=[*at.runs, run]))
            except Conflict:
                at = self.manifest()
        raise Conflict(f"{self.path} is changed too often")

    def append(self, run: str, rows: DataFrame, attempts: int = 20) -> Manifest:
        """The version with ``rows`` added, whose keys the table must not have:
        nothing is read or written anew, but for buckets of over ``PARTS`` folders.
        ``run`` is as in ``update``."""
        at, written = self.manifest(), None
        for _ in range(attempts):
            if run in at.runs:
                return at
            if any(folders.count("+") + 1 >= PARTS for folders in at.buckets.values()):
                return self.update(run, rows, DataFrame.unionByName, attempts)
            written = self._write(rows, at) if written is None else written
            both = at.buckets | {k: f"{at.buckets[k]}+{f}" if k in at.buckets else f for k, f in written.items()}
            try:
                return self._claim(replace(at, version=at.version + 1, buckets=both, runs=[*at.runs, run]))
            except Conflict:
                at = self.manifest()
        raise Conflict(f"{self.path} is changed too often")

    def vacuum(self, keep: int = 10) -> int:
        """Remove data that none of the last ``keep`` versions holds, and the
        versions before these; no writer may be at work. The number of folders removed."""
        versions = self._versions()
        used = {f for v in versions[-keep:] for folders in self.manifest(v).buckets.values() for f in folders.split("+")}
        store, place = self._fs(f"{self.path}/data")
        gone = [f.getPath() for f in store.listStatus(place) if f.getPath().getName() not in used]
        for path in [*(self._fs(f"{self.path}/versions/{v:020d}")[1] for v in versions[:-keep]), *gone]:
            store.delete(path, True)
        return len(gone)


def upsert(keys: list[str]) -> Callable[[DataFrame, DataFrame], DataFrame]:
    """A merge that puts the changes in place of the rows with their keys."""
    return lambda rows, changes: rows.join(changes.select(*keys), keys, "left_anti").unionByName(changes.select(*rows.columns))
