"""Tables with upsert: snapshots in Parquet, each named by a manifest that is put in place last."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from acrelight.sources.shared import stage


class VersionedTable:
    """Rows by ``keys``, the newest of each, in versions that readers see as a whole or not at all.

    Rows lie in ``buckets`` by the first key, so what shares that key lies
    together, and an upsert rewrites only the buckets that it touches. Its files
    go to a folder of its own; then a manifest that lists every bucket's folder
    is renamed into place. A writer that fails before that leaves the former
    version as it was, and of two writers of one version the second fails.
    ``buckets`` is fixed for a table and sets how many rows one holds; a large
    bucket is written by several tasks.
    """

    def __init__(self, spark: SparkSession, path: str, schema: str | T.StructType, keys: list[str], buckets: int = 64):
        self.spark, self.path, self.keys, self.buckets = spark, path.rstrip("/"), keys, buckets
        self.schema = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema

    def _hadoop(self, path: str):
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration()), at

    def versions(self) -> list[int]:
        """The numbers of the versions that have a manifest, in order."""
        files, folder = self._hadoop(f"{self.path}/manifests")
        if not files.exists(folder):
            return []
        names = [status.getPath().getName() for status in files.listStatus(folder)]
        return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json"))

    def manifest(self, version: int | None = None) -> dict:
        """The manifest of a version, or of the newest; of an empty table one without buckets."""
        known = self.versions()
        if not known:
            return {"version": 0, "applied": {}, "buckets": {}}
        files, at = self._hadoop(f"{self.path}/manifests/{known[-1] if version is None else version:012d}.json")
        stream = files.open(at)
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _publish(self, manifest: dict) -> None:
        files, final = self._hadoop(f"{self.path}/manifests/{manifest['version']:012d}.json")
        _, draft = self._hadoop(f"{self.path}/manifests/{uuid.uuid4().hex}.draft")
        out = files.create(draft, True)
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()
        jvm = self.spark._jvm
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(files.getUri(), self.spark._jsc.hadoopConfiguration())
        context.rename(draft, final, self.spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0))

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(self.keys[0]), F.lit(self.buckets)).cast("int")

    def _folders(self, manifest: dict, of: list[int] | None) -> list[str]:
        return [f"{self.path}/{folder}" for b, folder in manifest["buckets"].items() if of is None or int(b) in of]

    def _read(self, folders: list[str]) -> DataFrame:
        if not folders:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*folders)

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of a version, or of the newest."""
        return self._read(self._folders(self.manifest(version), None))

    def touched(self, rows: DataFrame) -> list[int]:
        """The buckets of ``rows``; no more than the table has."""
        return [r[0] for r in rows.select(self.bucket().alias("b")).distinct().collect()]

    def read_beside(self, rows: DataFrame) -> DataFrame:
        """The table's rows whose first key is in ``rows``; only their buckets are read."""
        key = self.keys[0]
        return self._read(self._folders(self.manifest(), self.touched(rows))).join(rows.select(key).distinct(), key, "left_semi")

    def upsert(self, rows: DataFrame, newest: list[str], source: str | None = None, batch: int | None = None) -> int:
        """Put ``rows`` into a new version, which replace those of their keys unless these are newer by ``newest``; its number.

        Of equally new rows the incoming one stays. A ``batch`` of a ``source``
        that was put in before, or whose successor was, changes nothing, so a
        batch may be sent again. Keys may be missing; missing ones are equal.
        """
        now = self.manifest()
        if batch is not None and now["applied"].get(source or "", -1) >= batch:
            return now["version"]
        names = self.schema.names
        fresh = stage(rows.select(*names).repartition(*self.keys))
        touched = self.touched(fresh)
        if not touched and batch is None:
            return now["version"]
        both = self._read(self._folders(now, touched)).withColumn("_fresh", F.lit(0)).unionByName(fresh.withColumn("_fresh", F.lit(1)))
        rest = [n for n in names if n not in self.keys]
        merged = both.groupBy(*self.keys).agg(F.max_by(F.struct(*rest), F.struct(*newest, "_fresh")).alias("_row")).select(*self.keys, "_row.*").select(*names)
        folder = f"data/{now['version'] + 1:012d}-{uuid.uuid4().hex}"
        if touched:
            merged.withColumn("_bucket", self.bucket()).hint("rebalance", "_bucket").write.partitionBy("_bucket").parquet(f"{self.path}/{folder}")
        applied = now["applied"] | ({source or "": batch} if batch is not None else {})
        self._publish({"version": now["version"] + 1, "applied": applied, "buckets": now["buckets"] | {str(b): f"{folder}/_bucket={b}" for b in touched}})
        return now["version"] + 1

    def compact(self, keep: int = 2) -> list[int]:
        """Remove all but the newest ``keep`` versions, and folders that no kept one names; the numbers that stay.

        Also removes what failed writers left; call it while none is writing.
        """
        known = self.versions()
        kept = known[-keep:]
        named = {folder.split("/")[1] for v in kept for folder in self.manifest(v)["buckets"].values()}
        files, data = self._hadoop(f"{self.path}/data")
        for status in files.listStatus(data) if files.exists(data) else []:
            if status.getPath().getName() not in named:
                files.delete(status.getPath(), True)
        for v in known[:-keep]:
            files.delete(self._hadoop(f"{self.path}/manifests/{v:012d}.json")[1], False)
        return kept
