"""Tables and lineage cuts in the folder that every executor shares.

The cluster names the folder in ``spark.checkpoint.dir``; only a local session
that names none (tests, a laptop) gets a folder of its own.
"""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession

LOCAL_SHARED_DIR = "/tmp/checkpoints/codeloom"


def shared_dir(spark: SparkSession) -> str:
    """The shared folder: the session's own setting, else its checkpoint folder, else, in one JVM alone, a local default."""
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not named and not re.fullmatch(r"local(\[.*\])?", context.master):
        raise ValueError("name a folder that all executors share in spark.checkpoint.dir")
    return (named or LOCAL_SHARED_DIR).rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that no other call gets."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str, partition_by: tuple[str, ...] = ()) -> DataFrame:
    """Write ``df`` to a table in the shared folder and read it again.

    The result's lineage is a scan: a lost executor costs one reread, and no
    later job repeats what made the rows.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.option("compression", "zstd").partitionBy(*partition_by).parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table._scratch_path = path
    return table


def remove(spark: SparkSession, path: str) -> None:
    """Delete a scratch table that nothing reads any more."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def remove_table(*tables: DataFrame) -> None:
    """Delete the files behind frames that :func:`materialize` returned, when nothing reads them any more.

    The shuffles that made them go as well: Spark deletes a shuffle's files
    when the driver has collected its plan, which is asked for here.
    """
    for df in tables:
        remove(df.sparkSession, df._scratch_path)
    if tables:
        tables[0].sparkSession._jvm.System.gc()
