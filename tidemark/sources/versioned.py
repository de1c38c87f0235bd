"""Small state tables with replace semantics on any file system that Spark writes to: each write is a new version."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


class VersionedTable:
    """A table at a path whose writes make a new version; readers see the last whole one. Old versions stay until
    `vacuum`, so that a reader of one isn't cut off. A write that fails leaves a folder that readers pass over and no later
    version takes."""

    def __init__(self, spark: SparkSession, path: str, schema: str):
        self.spark, self.path, self.schema = spark, path.rstrip("/"), schema

    def _files(self):
        jvm = self.spark.sparkContext._jvm
        folder = jvm.org.apache.hadoop.fs.Path(self.path)
        return jvm, folder, folder.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _folders(self) -> dict[str, bool]:
        """All versions by name, and whether each is whole."""
        jvm, folder, files = self._files()
        if not files.exists(folder):
            return {}
        return {s.getPath().getName(): files.exists(jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS")) for s in files.listStatus(folder)}

    def versions(self) -> list[str]:
        return sorted(name for name, whole in self._folders().items() if whole)

    def read(self) -> DataFrame:
        versions = self.versions()
        if not versions:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(f"{self.path}/{versions[-1]}")

    def write(self, df: DataFrame) -> None:
        number = max((int(name[1:]) for name in self._folders()), default=-1) + 1
        df.write.parquet(f"{self.path}/v{number:08d}")

    def upsert(self, rows: DataFrame, *key: str) -> None:
        """Rows take the place of those with equal keys."""
        self.write(self.read().join(rows.select(*key), list(key), "left_anti").unionByName(rows))

    def vacuum(self) -> None:
        """Delete all versions before the last whole one, and what failed writes left there."""
        jvm, _, files = self._files()
        last = max(self.versions(), default="")
        for name in (n for n in self._folders() if n < last):
            files.delete(jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}"), True)

    def drop(self) -> None:
        _, folder, files = self._files()
        files.delete(folder, True)
