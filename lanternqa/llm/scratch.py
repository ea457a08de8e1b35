"""Intermediate tables in the shared folder, whose shuffle files go as soon as the table is written."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lanternqa.session import scratch_path

CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


class Scratch:
    """Tables of one run. Each cuts the lineage; `drop` deletes those that nothing reads any more."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark = spark
        self.paths: dict[str, str] = {}

    def write(self, df: DataFrame, name: str) -> DataFrame:
        path = scratch_path(self.spark, name)
        before = self.spark.conf.get(CLEANUP, "false")
        self.spark.conf.set(CLEANUP, "true")
        try:
            df.write.parquet(path)
        finally:
            self.spark.conf.set(CLEANUP, before)
        self.paths[name] = path
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        for name in names:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(self.paths.pop(name))
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def shuffle_parts(df: DataFrame) -> int:
    """Partitions for a shuffle of `df`'s derived rows: the session's number, or four for each input split."""
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), 4 * df.rdd.getNumPartitions())
