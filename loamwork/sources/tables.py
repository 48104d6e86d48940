"""Parquet tables of a directory, one file or folder each, and tables that are replaced as a whole."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, directory: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{directory}/{name}.parquet")


class VersionedTable:
    """A table of which each state is a folder of its own, named by its number; the highest complete one counts.

    Spark marks a folder complete when all files are in it, so a failed write is never read,
    and a micro-batch that is run again writes the same state once more.
    """

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path

    def _fs(self, path: str):  # noqa: ANN202
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def versions(self) -> list[int]:
        fs, p = self._fs(self.path)
        if not fs.exists(p):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(p)]
        return sorted(int(n) for n in names if n.isdigit() and self._fs(f"{self.path}/{n}/_SUCCESS")[0].exists(self._fs(f"{self.path}/{n}/_SUCCESS")[1]))

    def read(self, below: int | None = None) -> DataFrame:
        """The last state, or the last one before the number ``below``."""
        return self.spark.read.parquet(f"{self.path}/{max(v for v in self.versions() if below is None or v < below)}")

    def write(self, df: DataFrame, version: int) -> None:
        df.write.mode("overwrite").parquet(f"{self.path}/{version}")

    def forget(self, keep: int = 3) -> None:
        """Delete all but the last states."""
        for v in self.versions()[:-keep]:
            fs, p = self._fs(f"{self.path}/{v}")
            fs.delete(p, True)
