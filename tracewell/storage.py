"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir, else the folder that the session's checkpoints have; a new local one only where the driver runs all tasks (tests)."""
    context = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if found is None:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='tracewell-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def _fs(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def stash(df: DataFrame, name: str) -> DataFrame:
    """df written to the shared folder and read again: lineage ends there, sizes are known, executors can go."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tracewell/{name}-{uuid.uuid4().hex}"
    fs, p = _fs(spark, path)
    fs.deleteOnExit(p)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._tracewell_path = path
    return out


def bucketed_stash(df: DataFrame, name: str, key: str, buckets: int) -> DataFrame:
    """As :func:`stash`, in buckets by ``key``: joins and groups on it take the table as it lies."""
    spark = df.sparkSession
    table = f"tracewell_{name}_{uuid.uuid4().hex}"
    path = f"{shared_dir(spark)}/tracewell/{table}"
    fs, p = _fs(spark, path)
    fs.deleteOnExit(p)
    buckets = min(max(buckets, int(spark.conf.get("spark.sql.shuffle.partitions"))), 65_536)
    df.write.format("parquet").option("path", path).option("compression", "zstd").bucketBy(buckets, key).saveAsTable(table)
    out = spark.table(table)
    out._tracewell_path = path
    return out


def drop_stash(df: DataFrame) -> None:
    """Removes the files of a :func:`stash` that nothing reads any more."""
    if path := getattr(df, "_tracewell_path", None):
        fs, p = _fs(df.sparkSession, path)
        fs.delete(p, True)
