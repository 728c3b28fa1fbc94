"""Cutting lineage through the folder that the cluster shares."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir. Only a local master, where driver and tasks are one machine, may go without: it gets a
    folder of its own. On a cluster a missing setting is an error, as executors don't see each other's disks."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir is not set: it has to name a folder that driver and executors share")
        path = tempfile.mkdtemp(prefix="lattice-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path


def own_dir(spark: SparkSession) -> str:
    """This application's folder in the shared one."""
    return f"{shared_dir(spark).rstrip('/')}/lattice-{spark.sparkContext.applicationId}"


def stored(df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
    """df as a written table; a lost executor loses none of it. clear() removes it."""
    path = f"{own_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path, compression=compression)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def _delete(spark: SparkSession, name: str) -> bool:
    path = spark._jvm.org.apache.hadoop.fs.Path(name)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def drop(*tables: DataFrame) -> None:
    """Removes stored tables that nothing reads any more."""
    for df in tables:
        _delete(df.sparkSession, df.stored_at)


def clear(spark: SparkSession) -> bool:
    """Removes all tables that this application has stored; DataFrames that read them can't be used any more."""
    return _delete(spark, own_dir(spark))
