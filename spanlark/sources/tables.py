"""Intermediate tables in the shared folder: they cut the lineage, and an executor that is lost costs a reread."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """A new folder below ``spark.checkpoint.dir``; where that is unset and driver and tasks share a machine, below a temporary one."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError(f"spark.checkpoint.dir has to name a shared folder when the master is {master}")
        root = tempfile.mkdtemp(prefix="spanlark-")
        atexit.register(shutil.rmtree, root, True)
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """``df`` as a table that was written to the shared folder and is read back."""
    path = shared_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, key: str) -> DataFrame:
    """``df`` dealt by key into as many parts as a shuffle has: few bytes of a table that was written may be long texts, which are much work."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200")), key)


def shuffled(df: DataFrame) -> DataFrame:
    """A side of a join that grows with the rows: it is never sent to the driver to be broadcast, however small its files are."""
    return df.hint("merge")


def discard(*tables: DataFrame) -> None:
    """Delete tables that ``written`` made and nothing reads any more."""
    for table in tables:
        if files := table.inputFiles():
            spark = table.sparkSession
            folder = spark._jvm.org.apache.hadoop.fs.Path(files[0]).getParent()
            folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
