"""A keyed table in hash buckets: a batch reads and rewrites the buckets that it touches, and a manifest per version says which files are current."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BUCKETS = 64
#: Column of a batch that marks rows to be deleted; in the files, rows that are.
DELETED = "_deleted"


class BucketTable:
    """Rows by key, of which the greatest seq counts, whatever the order of batches; deletions are rows too, so that an older answer that comes late doesn't
    bring a deleted one back.

    path/data/v<version>/bucket=<k> holds a bucket as of the version that last touched it, path/manifests/<version> a row (bucket, version) for each. A
    version exists once its manifest is complete, so a batch that fails halfway leaves the table as it was, and one that is replayed does nothing. The
    last `keep` versions can be read; files that none of them names are deleted. The driver sees buckets and versions only, never rows.
    """

    def __init__(self, spark: SparkSession, path: str, keys: list[str], buckets: int = BUCKETS, keep: int = 2):
        self.spark, self.path, self.keys, self.buckets, self.keep = spark, path.rstrip("/"), keys, buckets, keep

    def versions(self) -> list[int]:
        """The versions that can be read, in order."""
        fs, top = self._fs(f"{self.path}/manifests")
        found = fs.listStatus(top) if fs.exists(top) else []
        jvm = self.spark._jvm
        return sorted(int(x.getPath().getName()) for x in found if fs.exists(jvm.org.apache.hadoop.fs.Path(x.getPath(), "_SUCCESS")))

    def manifest(self, version: int | None = None) -> dict[int, int]:
        """Bucket to the version that wrote it, as of a version (None: the latest)."""
        known = self.versions()
        version = max(known, default=None) if version is None else version
        if version not in known:
            return {}
        return dict(map(tuple, self.spark.read.schema("bucket int, version long").parquet(f"{self.path}/manifests/{version}").collect()))

    def _paths(self, manifest: dict[int, int]) -> list[str]:
        return [f"{self.path}/data/v{v}/bucket={b}" for b, v in sorted(manifest.items())]

    def read(self, version: int | None = None) -> DataFrame | None:
        """The table as of a version, without deleted rows; None before the first."""
        manifest = self.manifest(version)
        if not manifest:
            return None
        return self.spark.read.parquet(*self._paths(manifest)).filter(~F.col(DELETED)).drop(DELETED)

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")

    def merge(self, batch: DataFrame, version: int) -> None:
        """Makes a version of the last one and a batch (keys, seq, ..., and _deleted if it deletes); nothing if there is that version already."""
        last = max(self.versions(), default=None)
        if last is not None and last >= version:
            return
        rows = batch if DELETED in batch.columns else batch.withColumn(DELETED, F.lit(False))
        columns, schema = rows.columns, rows.schema
        # the batch is read twice, for its buckets and for its rows
        batch = rows = rows.withColumn("bucket", self.bucket()).persist()
        try:
            touched = [r[0] for r in rows.select("bucket").distinct().collect()]
            manifest = self.manifest(last)
            old = self._paths({b: v for b, v in manifest.items() if b in touched})
            if old:
                rows = rows.unionByName(self.spark.read.schema(schema).parquet(*old).select(*columns).withColumn("bucket", self.bucket()))
            rest = F.struct("seq", *[c for c in columns if c not in self.keys and c != "seq"])
            merged = rows.groupBy("bucket", *self.keys).agg(F.max(rest).alias("r")).select("bucket", *self.keys, "r.*").select(*columns, "bucket")
            merged.repartition(max(1, len(touched)), "bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/data/v{version}")
        finally:
            batch.unpersist()
        now = manifest | {b: version for b in touched}
        self.spark.createDataFrame(sorted(now.items()), "bucket int, version long").coalesce(1).write.mode("overwrite").parquet(f"{self.path}/manifests/{version}")
        self._expire()

    def sink(self):
        """A foreachBatch function that merges each batch under its id."""
        return lambda batch, batch_id: self.merge(batch, batch_id)

    def _expire(self) -> None:
        """Deletes versions beyond the last `keep`, and what only they name."""
        known = self.versions()
        kept = {p for v in known[-self.keep :] for p in self._paths(self.manifest(v))}
        for v in known[: -self.keep]:
            for p in set(self._paths(self.manifest(v))) - kept:
                self._delete(p)
            self._delete(f"{self.path}/manifests/{v}")

    def _fs(self, name: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(name)
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def _delete(self, name: str) -> None:
        fs, path = self._fs(name)
        fs.delete(path, True)


def apply_changes(table: BucketTable, upserts: DataFrame | None, deletes: DataFrame | None, version: int) -> None:
    """Rows to insert or replace, and keys to delete with the seq of the deletion, as one version. A key that both have goes by its greatest seq."""
    parts = []
    if upserts is not None:
        parts.append(upserts.withColumn(DELETED, F.lit(False)))
    if deletes is not None:
        parts.append(deletes.withColumn(DELETED, F.lit(True)))
    batch = parts[0]
    for p in parts[1:]:
        batch = batch.unionByName(p, allowMissingColumns=True)
    table.merge(batch, version)
