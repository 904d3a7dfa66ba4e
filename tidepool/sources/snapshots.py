"""Tables as immutable snapshots: a new version is written beside the old ones, then a rename makes it the current one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


class SnapshotTable:
    """A table in a folder with versions v-000001, v-000002 ...; the highest is current. One writer at a time.

    A writer that dies leaves only a folder whose name begins with a dot; readers keep the version they began with.
    """

    def __init__(self, spark: SparkSession, folder: str, partition_by: list[str] | None = None, keep: int = 3):
        self.spark, self.folder, self.partition_by, self.keep = spark, folder.rstrip("/"), partition_by or [], keep
        self._fs = self._path("").getFileSystem(spark._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}" if name else self.folder)

    def versions(self) -> list[str]:
        if not self._fs.exists(self._path("")):
            return []
        names = [s.getPath().getName() for s in self._fs.listStatus(self._path(""))]
        return sorted(n for n in names if n.startswith("v-"))

    def exists(self) -> bool:
        return bool(self.versions())

    def read(self) -> DataFrame:
        versions = self.versions()
        if not versions:
            raise FileNotFoundError(f"{self.folder} has no version")
        return self.spark.read.parquet(f"{self.folder}/{versions[-1]}")

    def write(self, df: DataFrame) -> DataFrame:
        """Make df the current version, and return it as read from there. df may depend on the current version."""
        versions = self.versions()
        name = f"v-{int(versions[-1][2:]) + 1 if versions else 1:06d}"
        staged = f".staged-{name}"
        writer = df.write.mode("overwrite")
        (writer.partitionBy(*self.partition_by) if self.partition_by else writer).parquet(f"{self.folder}/{staged}")
        if not self._fs.rename(self._path(staged), self._path(name)):
            raise RuntimeError(f"{self.folder}/{name} could not be published")
        for old in versions[: -self.keep + 1] if self.keep > 1 else versions:
            self._fs.delete(self._path(old), True)
        return self.read()
