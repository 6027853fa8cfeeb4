"""Tables in the folder that the driver and all executors share, cut loose from the lineage that made them."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


#: Tables with whole texts by the ten thousand: they take less disk so, for a little more time.
DENSE = {"samples", "sides", "texts"}


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, or the context's own. Where neither is set, a local session gets one; others fail."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-shared-"))
        found = spark.sparkContext.getCheckpointDir()
    return found.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder: read many times, computed once, safe when executors go."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path, compression="zstd" if name in DENSE else None)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove(*tables: DataFrame) -> None:
    """Deletes tables that written() made, or all that a table is made of if each is one, and that no later plan reads, through the file system that holds them."""
    for df in tables:
        spark = df.sparkSession
        for folder in {file.rpartition("/")[0] for file in df.inputFiles()}:
            path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
