"""Shared-storage checkpoints: a plan is cut by writing it as a table.

Written parquet survives the loss of executors, is computed once, and gives the
next stage exact sizes and column pruning.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_LOCAL: list[tempfile.TemporaryDirectory] = []


def shared_dir(spark: SparkSession) -> str:
    """The cluster's checkpoint folder; a private one only for local masters."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        found = spark.sparkContext.getCheckpointDir()
    if found:
        return found
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder all executors share")
    if not _LOCAL:
        _LOCAL.append(tempfile.TemporaryDirectory(prefix="jobweave-"))
    return _LOCAL[0].name


class Scratch:
    """One folder of intermediate tables under the shared checkpoint folder."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark = spark
        self.root = f"{shared_dir(spark).rstrip('/')}/jobweave-{uuid.uuid4().hex}"
        self._n = 0

    def keep(self, df: DataFrame, name: str, codec: str | None = None) -> DataFrame:
        """Write ``df`` and return a DataFrame that reads it back."""
        return self._keep(df, name, codec)[0]

    def _keep(self, df: DataFrame, name: str, codec: str | None = None) -> tuple[DataFrame, str]:
        self._n += 1
        path = f"{self.root}/{self._n:03d}-{name}"
        df.write.mode("errorifexists").parquet(path, compression=codec)
        return self.spark.read.schema(df.schema).parquet(path), path

    def _delete(self, folder: str) -> None:
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(folder)
        conf = self.spark.sparkContext._jsc.hadoopConfiguration()
        path.getFileSystem(conf).delete(path, True)

    def close(self) -> None:
        """Delete the folder; call it when no result reads from it any more."""
        self._delete(self.root)

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *exc: object) -> None:
        self.close()


class Rolling:
    """A table that is replaced round by round: only the latest version is left."""

    def __init__(self, scratch: Scratch, name: str) -> None:
        self.scratch, self.name = scratch, name
        self._path: str | None = None

    def keep(self, df: DataFrame) -> DataFrame:
        """Write the next version, which may read the one before, and drop that."""
        new, path = self.scratch._keep(df, self.name)
        if self._path is not None:
            self.scratch._delete(self._path)
        self._path = path
        return new
