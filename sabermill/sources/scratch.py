"""The folder that driver and executors share, and tables written there to cut lineage."""

from __future__ import annotations

import atexit
import contextlib
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The cluster's ``spark.checkpoint.dir``; only a local master may fall back to a folder of its own."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder shared by the driver and the executors")
    path = os.path.join(tempfile.gettempdir(), "sabermill-checkpoints")
    os.makedirs(path, exist_ok=True)
    return path


class Scratch:
    """Tables written to the shared folder; dropped on request, the rest when the driver ends."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark = spark
        self.root = f"{shared_dir(spark)}/sabermill-{uuid.uuid4().hex}"
        self.paths: dict[str, None] = {}
        self.written = 0
        atexit.register(self.close)

    def write(self, df: DataFrame, name: str) -> DataFrame:
        """``df`` written once as Parquet and read again: its lineage is then the files."""
        self.written += 1
        path = f"{self.root}/{name}-{self.written}"
        df.write.option("compression", "zstd").parquet(path)
        self.paths[path] = None
        out = self.spark.read.schema(df.schema).parquet(path)
        out._sabermill_path = path
        return out

    def drop(self, df: DataFrame) -> None:
        path = getattr(df, "_sabermill_path", None)
        if path in self.paths:
            self._delete(path)
            del self.paths[path]

    def _delete(self, path: str) -> None:
        jvm = self.spark.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)

    def close(self) -> None:
        with contextlib.suppress(Exception):  # the session may have ended
            self._delete(self.root)
