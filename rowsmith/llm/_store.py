"""Intermediate tables in the folder that all executors share.

A table written here survives the loss of any executor and cuts the lineage, as
``DataFrame.checkpoint`` does, but stays columnar and compressed.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``; where that is unset a temporary folder, if all executors are on this machine."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        if not _own:
            _own.append("file://" + tempfile.mkdtemp(prefix="rowsmith-"))
        folder = _own[0]
    return folder.rstrip("/")


def delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


class Store:
    """Names tables under one fresh folder, which goes when Python ends."""

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.root = f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"
        atexit.register(self._end)

    def _end(self) -> None:
        try:
            delete(self.spark, self.root)
        except Exception:  # the session has ended: the folder's owner clears it
            pass

    def put(self, df: DataFrame, name: str, *by: str) -> DataFrame:
        """The table as stored, in a folder for each value of the columns ``by``."""
        path = f"{self.root}/{name}"
        df.write.option("compression", "zstd").mode("overwrite").partitionBy(*by).parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        for name in names:
            delete(self.spark, f"{self.root}/{name}")
