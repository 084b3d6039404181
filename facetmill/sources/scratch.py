"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import contextlib
import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

LOCAL_SHARED = "/tmp/checkpoints"


def shared_dir(spark: SparkSession) -> str:
    """The folder named in ``spark.checkpoint.dir``; one of our own only where that is unset (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise RuntimeError("spark.checkpoint.dir is unset: on a cluster it has to name a folder that all executors share")
    base = LOCAL_SHARED if os.path.isdir(LOCAL_SHARED) and os.access(LOCAL_SHARED, os.W_OK) else tempfile.gettempdir()
    return f"file://{base}"


def hadoop_path(spark: SparkSession, path: str):
    """The Hadoop Path of a text, and the FileSystem that holds it."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


class Scratch:
    """Parquet tables that cut lineage: a lost executor re-reads them instead of recomputing.

    Used as a context manager, it drops its tables at the end, so what leaves the block has to be
    written by ``keep`` (or read no scratch table).
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/facetmill/{name}-{uuid.uuid4().hex[:12]}"
        self.count = 0

    def _write(self, df: DataFrame, path: str) -> DataFrame:
        df.write.mode("overwrite").option("compression", "zstd").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def table(self, df: DataFrame, name: str = "t") -> DataFrame:
        self.count += 1
        return self._write(df, f"{self.root}/{self.count:03d}-{name}")

    def keep(self, df: DataFrame, name: str = "result") -> DataFrame:
        """A table that outlives the block; it holds results, not texts."""
        return self._write(df, f"{self.root}-{name}")

    def drop_table(self, df: DataFrame) -> None:
        for f in {os.path.dirname(x) for x in df.inputFiles()}:
            if f.startswith(self.root.split("://")[-1]) or f.startswith(self.root) or self.root.split("://")[-1] in f:
                p, fs = hadoop_path(self.spark, f)
                fs.delete(p, True)

    def drop(self) -> None:
        with contextlib.suppress(Exception):  # left-overs cost disk, never results
            p, fs = hadoop_path(self.spark, self.root)
            fs.delete(p, True)

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_) -> None:
        self.drop()


def small_batches(spark: SparkSession, most: str = "4m") -> None:
    """From now on Arrow batches of the session hold so many bytes at most (64 MB by default), so that workers stay
    small whatever the texts' lengths. Results don't depend on it."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", most)


@contextlib.contextmanager
def arrow_rows(spark: SparkSession, rows: int):
    """Arrow batches of fewer rows for what runs inside, and of fewer bytes."""
    small_batches(spark)
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    old = spark.conf.get(key, "10000")
    spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        spark.conf.set(key, old)
