"""Intermediate tables in the shared folder.

A reduced table that several later steps read is written once as Parquet and read back, so the
balls behind it are scanned once, each reader takes only its columns, and a lost executor costs
a re-read and not a recomputation of everything before.
"""

from __future__ import annotations

import atexit
import contextlib
import uuid

from pyspark.sql import DataFrame, SparkSession

_used: dict[str, SparkSession] = {}


def work_dir(spark: SparkSession) -> str:
    """Shared folder of this session: ``spark.checkpoint.dir``, else the session's warehouse, which is shared too."""
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    return (shared or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/work").rstrip("/")


def _stage_root(spark: SparkSession) -> str:
    return f"{work_dir(spark)}/staged-{spark.sparkContext.applicationId}"


def staged(df: DataFrame, compression: str = "snappy") -> DataFrame:
    """Write ``df`` now and return the written table."""
    spark = df.sparkSession
    root = _stage_root(spark)
    path = f"{root}/{uuid.uuid4().hex}"
    df.write.option("compression", compression).parquet(path)
    if root not in _used:
        _used[root] = spark
        atexit.register(_drop_at_exit, root)
    return spark.read.schema(df.schema).parquet(path)


def _drop_at_exit(root: str) -> None:
    """Staged tables end with the session that made them; a session that is gone already can't drop them."""
    with contextlib.suppress(Exception):
        _drop(_used.pop(root), root)


def _drop(spark: SparkSession, path: str) -> None:
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def drop_table(df: DataFrame) -> None:
    """Remove one staged table that nothing reads any more."""
    for folder in {file.rsplit("/", 1)[0] for file in df.inputFiles()}:
        if "/staged-" in folder:
            _drop(df.sparkSession, folder)


def drop_staged(spark: SparkSession) -> None:
    """Remove this session's staged tables once their results are stored elsewhere."""
    _drop(spark, _stage_root(spark))
