"""Session set-up, the shared scratch folder and size checks."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

BROADCAST_BYTES = 32 << 20
_LOCAL: list[str] = []


def local_session(cpus: int | str = 8, name: str = "lanternqa") -> SparkSession:
    """A session for tests and benchmarks; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "12g")
        .getOrCreate()
    )


def scratch_root(spark: SparkSession) -> str:
    """The shared folder that `spark.checkpoint.dir` names, or the one given to the context instead.

    Only a single-machine session may fall back to a temporary folder, one for
    each process: on a cluster the other machines would not see it.
    """
    named, given = spark.conf.get("spark.checkpoint.dir", None), spark.sparkContext.getCheckpointDir()
    if given and not (named and named.split(":")[-1].rstrip("/") in given):
        return given
    if named:
        return named
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder all executors share")
    if not _LOCAL:
        _LOCAL.append(tempfile.mkdtemp(prefix="lanternqa-"))
    return _LOCAL[0]


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path under the shared folder."""
    return os.path.join(scratch_root(spark), "lanternqa", f"{name}-{uuid.uuid4().hex}")


def _folder(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path exists in whatever store it names."""
    store, at = _folder(spark, path)
    return store.exists(at)


def release(*tables: DataFrame) -> None:
    """Delete written tables that nothing reads any more; tables outside the scratch folder stay."""
    for table in tables:
        spark = table.sparkSession
        for folder in {os.path.dirname(file) for file in table.inputFiles()}:
            if re.search(r"/lanternqa/[^/]+-[0-9a-f]{32}$", folder):
                store, at = _folder(spark, folder)
                store.delete(at, True)


def fan_out(df: DataFrame, *key: str) -> DataFrame:
    """Spread a plain file read over all cores if its files are too few to do so.

    Pattern matching costs far more than moving the text, and one small file
    is one task. A table of many files is left as it is: no shuffle.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores, *key)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write `df` to the shared folder and read it back.

    Cuts the lineage, so a lost executor costs a re-read and not a recompute,
    and gives the planner real sizes.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def fits_broadcast(df: DataFrame, max_bytes: int = BROADCAST_BYTES) -> bool:
    """Measure `df` (one aggregated row comes back) against a broadcast limit."""
    width = F.lit(0).cast("long")
    for field in df.schema.fields:
        if isinstance(field.dataType, (T.StringType, T.BinaryType)):
            width = width + F.coalesce(F.octet_length(field.name), F.lit(0)) + 16
        elif isinstance(field.dataType, (T.ArrayType, T.StructType, T.MapType)):
            width = width + F.coalesce(F.octet_length(F.to_json(field.name)), F.lit(0)) + 16
        else:
            width = width + 16
    total = df.agg(F.sum(width).alias("bytes")).first()["bytes"]
    return (total or 0) <= max_bytes
