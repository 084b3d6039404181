"""Sources of conversations. Record ids follow the order of files, then of rows in them, so equal rows have ids of their own."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ROWS_MOST = 1 << 40  # rows of a file


def _numbered(rows: DataFrame, turns: Column, last_first: bool) -> DataFrame:
    """record_id, turns: the place of each row among all, by file name and row."""
    names = sorted({os.path.basename(f) for f in rows.inputFiles()}, reverse=last_first)  # the listing that the driver has made anyway
    rank = rows.sparkSession.createDataFrame(list(enumerate(names)), "_rank long, _file string")
    read = rows.select(turns.alias("turns"), F.col("_metadata.file_name").alias("_name"), F.col("_metadata.row_index").alias("_row"))
    return read.join(rank, F.col("_name") == F.col("_file")).select((F.col("_rank") * ROWS_MOST + F.col("_row")).alias("record_id"), "turns")


def wide_turns(spark: SparkSession, path: str) -> DataFrame:
    """Parquet of one turn struct a column, nulls at the end of short rows -> record_id, turns."""
    rows = spark.read.parquet(path)
    return _numbered(rows, F.filter(F.array(*[F.col(f"`{c}`") for c in rows.columns]), lambda t: t.isNotNull()), last_first=False)


def conversation_files(spark: SparkSession, folder: str, pattern: str = "train-000*", language: str | None = "English") -> DataFrame:
    """Parquet files with a column ``conversation``, the last file names first -> record_id (rising in that order), turns; with a
    language, those wholly in it."""
    rows = spark.read.option("pathGlobFilter", pattern).parquet(folder)
    out = _numbered(rows, F.col("conversation"), last_first=True)
    return out.where(F.forall("turns", lambda t: F.coalesce(t["language"] == language, F.lit(False)))) if language else out
