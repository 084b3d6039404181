"""Stage tables that are reused while neither their inputs nor their settings have changed."""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from facetmill.sources.scratch import hadoop_path


class Stages:
    """Each stage is a Parquet table named by a fingerprint of its settings, of its inputs' contents and of the stages before it."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    @staticmethod
    def content(df: DataFrame) -> str:
        """What a table holds, whatever the order of its rows: their number and the sum of their hashes, from one scan."""
        r = df.agg(F.count("*").alias("n"), F.sum(F.xxhash64(*[F.col(f"`{c}`") for c in df.columns]).cast("decimal(38,0)")).alias("s")).first()
        return f"{df.schema.simpleString()}:{r.n}:{r.s}"

    def fingerprint(self, name: str, settings: dict, after: tuple[str, ...] = ()) -> str:
        said = json.dumps([name, settings, list(after)], sort_keys=True, default=str)
        return f"{name}-{hashlib.sha256(said.encode()).hexdigest()[:16]}"

    def get(self, name: str, settings: dict, make: Callable[[], DataFrame], after: tuple[str, ...] = (), inputs: tuple[DataFrame, ...] = ()) -> tuple[DataFrame, str]:
        """(table, fingerprint). It is made again if settings, stages before it or the contents of inputs have changed, and if
        its writer broke off. It is written beside its place and then moved there."""
        key = self.fingerprint(name, settings, (*after, *[self.content(t) for t in inputs]))
        path = f"{self.folder}/{key}"
        done, fs = hadoop_path(self.spark, f"{path}/_SUCCESS")
        if not fs.exists(done):
            temp = f"{self.folder}/_{key}-{uuid.uuid4().hex[:8]}"
            make().write.parquet(temp)
            final = hadoop_path(self.spark, path)[0]
            fs.delete(final, True)
            if not fs.rename(hadoop_path(self.spark, temp)[0], final):
                raise OSError(f"{path} can't be put in place")
        return self.spark.read.parquet(path), key
