"""Questions of a viewer, as functions of saved tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from facetmill.functions import text as T

PAGE = 50
TOP = 100


def box_select(points: DataFrame, x0: float, x1: float, y0: float, y1: float) -> DataFrame:
    return points.where(F.col("x").between(x0, x1) & F.col("y").between(y0, y1))


def page(rows: DataFrame, number: int, key: str = "record_id", size: int = PAGE) -> DataFrame:
    """The rows of one page in order of key; pages count from 0."""
    return rows.orderBy(key).offset(number * size).limit(size)


def top_values(values: DataFrame, value: str = "value", most: int = TOP) -> DataFrame:
    n = values.groupBy(value).agg(F.count("*").alias("n"))
    return n.orderBy(F.col("n").desc(), value).limit(most)


def word_cloud(rows: DataFrame, text: str, least: int = 1) -> DataFrame:
    n = rows.select(F.explode(T.tokens(F.col(text))).alias("token")).groupBy("token").agg(F.count("*").alias("n"))
    return n.where(F.col("n") >= least)


def children_of(clusters: DataFrame, parent: int | None) -> DataFrame:
    return clusters.where(F.col("parent").isNull() if parent is None else F.col("parent") == parent)


def histogram(values: DataFrame, value: str) -> DataFrame:
    """Counts of values that read as whole numbers."""
    return values.select(F.expr(f"try_cast(trim(cast({value} AS string)) AS int)").alias("bucket")).where("bucket IS NOT NULL").groupBy("bucket").agg(F.count("*").alias("n"))


def rank_in_group(rows: DataFrame, by: str, order: list) -> DataFrame:
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy(*order)))
