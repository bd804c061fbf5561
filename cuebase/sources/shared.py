"""The folder that driver and executors share for intermediate tables."""

from __future__ import annotations

import tempfile
import uuid

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession

_OWN: dict[str, str] = {}
#: Spark's setting for removing a query's shuffle files when it ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; only where it is unset, and the master is local, a folder of this machine for each application."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    context = spark.sparkContext
    if context.master.split("[")[0] != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if context.applicationId not in _OWN:
        _OWN[context.applicationId] = f"file://{tempfile.mkdtemp(prefix='spark-')}"
    return _OWN[context.applicationId]


def materialise(df: DataFrame, kind: str = "t") -> DataFrame:
    """Write df to the shared folder and read it back: the lineage ends in files that outlive executors.

    The shuffle files of the write go as soon as it is done.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{kind}-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def release(*tables: DataFrame) -> None:
    """Empty tables of materialise() that nothing reads any more."""
    for table in tables:
        files = table.inputFiles()
        if files:
            table.sparkSession.createDataFrame([], table.schema).write.mode("overwrite").parquet(files[0].rsplit("/", 1)[0])


def open_folder(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path (a local one if it names none) and the path in it."""
    return fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")
