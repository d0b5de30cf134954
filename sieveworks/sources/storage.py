"""Tables written to the shared folder of the cluster, to cut lineage.

A written table is read back from storage when an executor is lost, so nothing
upstream of it runs again and no executor-local copy is relied on.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: The setting that deletes the shuffle files of a query at its end.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names. Where it is unset, a temporary one is set for a local master; on a cluster, whose machines don't share one, that is an error."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="sieveworks-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def written(df: DataFrame) -> DataFrame:
    """``df`` written as Parquet in the shared folder and read back."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_path = path
    return out


def settled(df: DataFrame) -> DataFrame:
    """:func:`written`, and the shuffle files that it took are deleted at once and not when the driver collects garbage; another job on ``df`` itself makes them again."""
    spark = df.sparkSession
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        return written(df)
    finally:
        spark.conf.set(CLEANUP, before)


def forget(*tables: DataFrame) -> None:
    """Delete tables that :func:`written` made and nothing reads any more."""
    for df in tables:
        if path := getattr(df, "_written_path", None):
            spark = df.sparkSession
            target = spark._jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
