"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}  # by application, where a local session names no folder
_kept: dict[str, list[str]] = {}  # tables written, by application


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, else the one set by setCheckpointDir. Without either a local
    session gets a temporary folder (tests); on a cluster that would lose rows, so it is an error."""
    sc = spark.sparkContext
    base = sc.getConf().get("spark.checkpoint.dir", None)
    if not base and (given := sc._jsc.sc().getCheckpointDir()).isDefined():
        base = given.get()
    if not base:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        base = _own.setdefault(sc.applicationId, "") or tempfile.mkdtemp(prefix="loom-")
        _own[sc.applicationId] = base
    return base.rstrip("/")


def _file_system(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def shared_table(df: DataFrame, tag: str) -> DataFrame:
    """df written as a table and read again: lineage is cut, and a lost executor costs a re-read. The
    table goes with the session, or with ``drop_tables`` when nothing reads it any more."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/loom-{tag}-{uuid.uuid4().hex[:12]}"
    df.write.option("compression", "zstd").parquet(path)
    fs, at = _file_system(spark, path)
    fs.deleteOnExit(at)
    _kept.setdefault(spark.sparkContext.applicationId, []).append(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_tables(spark: SparkSession) -> int:
    """Deletes the intermediate tables of this application, once its results are written; how many."""
    paths = _kept.pop(spark.sparkContext.applicationId, [])
    for path in paths:
        fs, at = _file_system(spark, path)
        fs.delete(at, True)
    return len(paths)
