"""Writers: the catalogue store, lanes, ordered output and run logs."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gearledger.plans.ingest import KEYS, TABLES, CatalogTables
from gearledger.session import Scratch

# Rows of a bucket are sorted by these columns, so that lookups skip most row groups.
CLUSTERING = {
    "components": ("category", "component_id"),
    "fields": ("component_id",),
    "sources": ("source_key", "source_record_id"),
    "identifiers": ("type", "value"),
}


class Conflict(Exception):
    """Another writer committed first, again and again."""


class CatalogStore:
    """Keyed upserts into a folder of catalogue tables.

    Rows are dealt by their key into ``buckets`` (see ``plans.ingest.KEYS``). A version is a manifest, a small JSON file that names the folder of every
    bucket of every table; a commit writes the touched buckets into new folders and then publishes the next manifest by one atomic,
    exclusive step. Two writers can't both publish a version: the one that comes second works its change out again on what
    the first left. Readers see whole versions only, and a batch that is repeated finds its writer in the manifest.

        path/data/<id>/<table>/bucket=<n>/*.parquet      path/manifests/v000000000007.json
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int = 64, attempts: int = 20):
        self.spark, self.path, self.buckets, self.attempts = spark, path.rstrip("/"), buckets, attempts

    def _fs(self, name: str):
        target = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return target, target.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def versions(self) -> list[str]:
        """Committed versions, oldest first."""
        root, fs = self._fs("manifests")
        if not fs.exists(root):
            return []
        names = [status.getPath().getName() for status in fs.listStatus(root)]
        return sorted(n[:-5] for n in names if n.startswith("v") and n.endswith(".json"))

    def manifest(self, version: str | None = None) -> dict | None:
        """The manifest of a version, by default the last one; None before the first commit."""
        version = version or next(reversed(self.versions()), None)
        if version is None:
            return None
        path, fs = self._fs(f"manifests/{version}.json")
        stream = fs.open(path)
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def committed(self, writer: str) -> bool:
        """Whether the batch that ``writer`` names ("stream/number", or any name) is in the catalogue already."""
        return _taken(self.manifest(), writer)

    def read(self, version: str | None = None) -> CatalogTables | None:
        found = self.manifest(version)
        return None if found is None else CatalogTables(**{t: self._table(found, t) for t in TABLES})

    def _table(self, manifest: dict, table: str, buckets: list[str] | None = None) -> DataFrame:
        entry = manifest["tables"][table]
        schema = T.StructType.fromJson(entry["schema"])
        folders = [f"{self.path}/data/{f}/{table}/bucket={b}" for b, f in sorted(entry["buckets"].items()) if buckets is None or b in buckets]
        return self.spark.read.schema(schema).parquet(*folders) if folders else self.spark.createDataFrame([], schema)

    def upsert(self, change: Callable[[CatalogTables | None], CatalogTables], writer: str | None = None) -> str | None:
        """Commit the rows that ``change`` makes of the present catalogue, replacing all rows of their keys; the version, or None where ``writer`` committed before.

        ``change`` runs again on the newer catalogue if another writer was faster. Only buckets that hold a changed key are read and written.
        """
        return self._commit(change, writer, False)

    def write(self, tables: CatalogTables, writer: str | None = None) -> str | None:
        """Commit whole tables as the next version, whatever was there before."""
        return self._commit(lambda _: tables, writer, True)

    def _commit(self, change, writer: str | None, replace: bool) -> str | None:
        for _ in range(self.attempts):
            base = self.manifest()
            if writer is not None and _taken(base, writer):
                return None
            changed = change(None if base is None else self.read(base["version"]))
            version = self._publish(self._next(base, changed, writer, replace))
            if version is not None:
                return version
        raise Conflict(f"no version could be committed in {self.attempts} attempts")

    def _next(self, base: dict | None, changed: CatalogTables, writer: str | None, replace: bool) -> dict:
        """Write the touched buckets and draw up the manifest that names them."""
        buckets = base["buckets"] if base else self.buckets
        folder, number = uuid.uuid4().hex, int(base["version"][1:]) + 1 if base else 1
        made = {"version": f"v{number:012d}", "buckets": buckets, "tables": {}, "writers": dict(base["writers"]) if base else {}}
        if writer is not None:
            stream, batch = _named(writer)
            made["writers"][stream] = batch
        with Scratch(self.spark) as scratch:
            for table, rows in changed.as_dict().items():
                keys = KEYS[table]
                bucket = F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")
                rows = scratch.cut(rows.withColumn("bucket", bucket))
                touched = sorted(str(r["bucket"]) for r in rows.select("bucket").distinct().collect())
                kept = {} if base is None or replace else base["tables"][table]["buckets"]
                again = [b for b in touched if b in kept]
                out = rows
                if again:
                    before = self._table(base, table, again).withColumn("bucket", bucket)
                    out = before.join(rows.select(*keys).distinct(), list(keys), "left_anti").unionByName(rows)
                out = out.repartition("bucket").sortWithinPartitions("bucket", *CLUSTERING[table])
                out.write.partitionBy("bucket").parquet(f"{self.path}/data/{folder}/{table}")
                schema = T.StructType([f for f in rows.schema.fields if f.name != "bucket"])
                made["tables"][table] = {"schema": schema.jsonValue(), "buckets": kept | {b: folder for b in touched}}
        return made

    def _publish(self, manifest: dict) -> str | None:
        """Make the manifest that of its version, in one step that fails if there is one; the version or None."""
        draft, fs = self._fs(f"manifests/.{uuid.uuid4().hex}")
        target, _ = self._fs(f"manifests/{manifest['version']}.json")
        stream = fs.create(draft, True)
        stream.write(bytearray(json.dumps(manifest).encode()))
        stream.close()
        try:
            if fs.getScheme() == "file":
                # A rename would replace a local file; a hard link is made only if its name is free.
                link, existing = (self.spark._jvm.java.io.File(p.toUri().getPath()).toPath() for p in (target, draft))
                self.spark._jvm.java.nio.file.Files.createLink(link, existing)
                return manifest["version"]
            return manifest["version"] if fs.rename(draft, target) else None
        except Exception as error:
            if "FileAlreadyExists" in str(error):
                return None
            raise
        finally:
            fs.delete(draft, False)

    def vacuum(self, keep: int = 2) -> list[str]:
        """Delete all but the last ``keep`` versions and the data only they name; the deleted folders. Not for use beside a running writer."""
        versions = self.versions()
        for version in versions[:-keep]:
            path, fs = self._fs(f"manifests/{version}.json")
            fs.delete(path, False)
        used = {f for v in versions[-keep:] for t in self.manifest(v)["tables"].values() for f in t["buckets"].values()}
        root, fs = self._fs("data")
        gone = [s.getPath().getName() for s in (fs.listStatus(root) if fs.exists(root) else [])]
        gone = [n for n in gone if n not in used]
        for name in gone:
            fs.delete(self._fs(f"data/{name}")[0], True)
        return gone


def _named(writer: str) -> tuple[str, int]:
    stream, _, number = writer.rpartition("/")
    return (stream, int(number)) if stream and number.isdigit() else (writer, 0)


def _taken(manifest: dict | None, writer: str) -> bool:
    stream, number = _named(writer)
    return manifest is not None and manifest["writers"].get(stream, -1) >= number


def write_lanes(df: DataFrame, path: str, lane: str = "lane") -> None:
    """One pass, one folder per lane; rows are rebalanced so a hot lane is split over files."""
    df.hint("rebalance", lane).write.mode("overwrite").partitionBy(lane).parquet(path)


def write_sorted(df: DataFrame, path: str, keys: Sequence[str], form: str = "parquet") -> None:
    """Globally ordered files through a range exchange."""
    df.orderBy(*keys).write.mode("overwrite").format(form).save(path)


def log_run(report: DataFrame, path: str, run_id: str, status: str) -> None:
    report.withColumns({"run_id": F.lit(run_id), "status": F.lit(status)}).write.mode("append").parquet(path)


def log_errors(errors: DataFrame, path: str, run_id: str) -> None:
    errors.withColumn("run_id", F.lit(run_id)).write.mode("append").parquet(path)
