"""Tables and folders in the storage that the driver and all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession


def shared_root(spark: SparkSession) -> str:
    """The session's spark.checkpoint.dir. Only a local master may do without it and gets a temporary folder; a cluster raises, as each executor would write to a disk of its own."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="proofline-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def shared_dir(spark: SparkSession, kind: str = "table") -> str:
    """The name of a new folder in shared_root()."""
    return f"{shared_root(spark)}/{kind}-{uuid.uuid4().hex}"


def settle(df: DataFrame) -> DataFrame:
    """Writes a table to the shared folder and rereads it: the lineage ends there, and the loss of an executor costs no recomputation."""
    path = shared_dir(df.sparkSession)
    df.write.parquet(path)
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    table.settled_at = path
    return table


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder, if there is one."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def discard(*tables: DataFrame | None) -> None:
    """Removes the folders of tables that settle() wrote and nothing will read again; other tables are left as they are."""
    for table in tables:
        if path := getattr(table, "settled_at", None):
            remove(table.sparkSession, path)


def parquet_if_any(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The table at a path, or one without rows if nothing is there yet; whatever else is wrong with the path raises."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)
