"""Tables in versions: each run reads the version before its own and writes the next."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


class Versions:
    """Versions 1, 2, .. of a table below a folder that all executors share. A version is whole
    once its writer has ended; a run that is repeated writes its version anew."""

    def __init__(self, spark: SparkSession, folder: str, schema: str):
        self.spark, self.folder, self.schema = spark, folder.rstrip("/"), schema

    def _path(self, version: int) -> str:
        return f"{self.folder}/version={version}"

    def _there(self, path: str) -> bool:
        place = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return place.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(place)

    def newest(self) -> int:
        """The number of the last whole version, 0 before the first."""
        version = 0
        while self._there(f"{self._path(version + 1)}/_SUCCESS"):
            version += 1
        return version

    def read(self, version: int | None = None) -> DataFrame:
        """A version, the newest unless told; version 0 is empty."""
        version = self.newest() if version is None else version
        if version == 0:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(self._path(version))

    def write(self, rows: DataFrame, version: int) -> DataFrame:
        """Write a version and read it back. A version needs the one before it."""
        if version < 1 or version > self.newest() + 1:
            raise ValueError(f"version {version} of {self.folder} has no version before it")
        rows.write.mode("overwrite").parquet(self._path(version))
        return self.read(version)


def changes(before: DataFrame, after: DataFrame, keys: list[str], value: str, least: float) -> DataFrame:
    """What became of each key from one version to the next: (keys, change, old and new value);
    change is added, removed or revised, if the value moved by `least` or more, or from or
    to null; keys that stay as they are give no row. Keys tell rows apart and may be null."""
    there, here = F.col("b.there").isNotNull(), F.col("a.there").isNotNull()
    old, new = F.col(f"b.{value}"), F.col(f"a.{value}")
    moved = (F.abs(new - old) >= least) | (old.isNull() != new.isNull())
    change = F.when(~there, "added").when(~here, "removed").when(moved, "revised")
    met: Column = reduce(lambda x, y: x & y, [F.col(f"b.{k}").eqNullSafe(F.col(f"a.{k}")) for k in keys])
    both = before.withColumn("there", F.lit(1)).alias("b").join(after.withColumn("there", F.lit(1)).alias("a"), met, "full")
    key = [F.when(here, F.col(f"a.{k}")).otherwise(F.col(f"b.{k}")).alias(k) for k in keys]
    return both.select(*key, change.alias("change"), old.alias(f"old_{value}"), new.alias(f"new_{value}")).where("change IS NOT NULL")
