"""Records: assembling, truncating, deduplicating and filtering conversations and documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from facetmill.functions import text as T
from facetmill.sources.scratch import Scratch


def conversations(turns: DataFrame, language: str | None = None) -> DataFrame:
    """(conv_id, turn, role, text) -> (record_id, turns ARRAY<STRUCT<turn, role, content>>) in turn order."""
    parts = [F.col("turn"), F.col("role"), F.col("text").alias("content")] + ([F.col(language).alias("language")] if language else [])
    return turns.groupBy(F.col("conv_id").alias("record_id")).agg(F.array_sort(F.collect_list(F.struct(*parts))).alias("turns"))


def truncated(turns: DataFrame, max_tokens: int, token_count: Column | None = None) -> DataFrame:
    """record_id, text: each conversation rendered within a token budget.

    A budget below 0 keeps all, and so does a text of fewer than 1.5 * budget characters or of fewer
    tokens than the budget. Else the longest run of turns from the start that ends after an
    assistant's and fits is kept; if already the first such run is too long, its tokens are cut; without an
    assistant's turn nothing is left. token_count counts a rendered turn's tokens (words by default).
    """
    line = F.concat(F.col("role"), F.lit(":\n"), F.col("text"))
    count = F.size(F.filter(F.split(line, r"\s+"), lambda x: x != "")) if token_count is None else token_count
    order = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    t = turns.select("conv_id", "turn", "role", line.alias("line"), count.cast("long").alias("n")).withColumn("upto", F.sum("n").over(order))
    speaks = F.col("role") == "assistant"
    t = t.groupBy("conv_id").agg(
        F.array_sort(F.collect_list(F.struct("turn", "line"))).alias("lines"),
        F.max("upto").alias("total"),
        F.max(F.when(speaks & (F.col("upto") <= max_tokens), F.col("turn"))).alias("last"),
        F.min(F.when(speaks, F.col("turn"))).alias("first"),
    )
    full = F.array_join(F.transform("lines", lambda x: x["line"]), "\n")
    upto = lambda turn: F.array_join(F.transform(F.filter("lines", lambda x: x["turn"] <= turn), lambda x: x["line"]), "\n")
    words = F.filter(F.split(upto(F.col("first")), r"\s+"), lambda x: x != "")
    cut = F.array_join(F.slice(words, 1, max(max_tokens, 0)), " ") if max_tokens > 0 else F.lit("")
    whole = F.lit(max_tokens < 0) | (F.length(full) < F.lit(1.5 * max_tokens)) | (F.col("total") < max_tokens)
    kept = F.when(F.col("last").isNotNull(), upto(F.col("last"))).when(F.col("first").isNotNull(), cut).otherwise("")
    return t.select(F.col("conv_id").alias("record_id"), F.when(whole, full).otherwise(kept).alias("text"))


def dedup(rows: DataFrame, key: Column, order: str) -> DataFrame:
    """The first row, by order, of each key (null is one key), whatever repeats among orders: one shuffle of rows, thinned before it."""
    row = F.struct("*")
    first = rows.select(key.alias("_k"), F.col(order).alias("_o"), row.alias("_row")).groupBy("_k").agg(F.min_by("_row", "_o").alias("_row"))
    return first.select("_row.*")


def dedup_mapping(rows: DataFrame, key: Column, order: str) -> DataFrame:
    """(old, survivor, position): for each row the row that stands for it, and that one's place among survivors."""
    k = rows.select(F.col(order).alias("old"), key.alias("_k"))
    first = k.groupBy("_k").agg(F.min("old").alias("survivor"))
    position = survivor_positions(first.select("survivor"))
    out = k.join(first, k["_k"].eqNullSafe(first["_k"])).select("old", "survivor")
    return out.join(position, "survivor").select("old", "survivor", "position")


RANGE_ROWS = 200_000  # ids of a sorted range


def survivor_positions(ids: DataFrame, parts: int | None = None) -> DataFrame:
    """0-based rank of each distinct id, from sorted ranges that are counted first, so no task holds all ids.

    The ranges are a written table, for both the counts and the ranks must see the same ones.
    """
    c = ids.columns[0]
    scratch = Scratch(ids.sparkSession, "ranges")
    ids = scratch.table(ids, "ids") if parts is None else ids
    parts = ids.count() // RANGE_ROWS + 1 if parts is None else parts
    ranged = scratch.table(ids.repartitionByRange(parts, c).withColumn("_p", F.spark_partition_id()), "ranged")
    lows = ranged.groupBy("_p").agg(F.count("*").alias("_n"))
    base = lows.withColumn("_base", F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1))).select("_p", F.coalesce("_base", F.lit(0)).alias("_base"))
    rank = F.row_number().over(Window.partitionBy("_p").orderBy(c)) - 1
    return ranged.withColumn("_r", rank).join(F.broadcast(base), "_p").select(c, (F.col("_r") + F.col("_base")).cast("long").alias("position"))  # a row a range


def all_turns_in(records: DataFrame, language: str = "English") -> DataFrame:
    """Records whose every turn is in a language; records without turns stay."""
    return records.where(F.forall("turns", lambda t: F.coalesce(t["language"] == language, F.lit(False))))


def facet_is(records: DataFrame, values: DataFrame, facet: str = "Language", value: str = "english") -> DataFrame:
    """Records with a value of a facet, whatever its case."""
    hit = values.where((F.col("facet") == facet) & (F.lower(T.strip(F.col("value"))) == value)).select("record_id")
    return records.join(hit, "record_id", "left_semi")


def duplicate_values(values: DataFrame) -> DataFrame:
    """value, n, record_ids (distinct, ascending) of values that several records have, most frequent first."""
    g = values.groupBy("value").agg(F.count("*").alias("n"), F.array_sort(F.collect_set("record_id")).alias("record_ids"))
    return g.where("n > 1").orderBy(F.col("n").desc(), "value")


def duplicate_rows(values: DataFrame) -> DataFrame:
    """value, n, record_id: the same with a row a record, for values that more records have than a list should hold."""
    n = values.groupBy("value").agg(F.count("*").alias("n")).where("n > 1")
    return values.join(n, "value").select("value", "n", "record_id").distinct()


def most_common(values: DataFrame, by: str, value: str) -> DataFrame:
    """Per group the value that occurs most, ties to the smaller text."""
    n = values.groupBy(by, value).agg(F.count("*").alias("n"))
    return n.groupBy(by).agg(F.min(F.struct((-F.col("n")).alias("m"), F.col(value).alias("v"))).alias("b")).select(by, F.col("b.v").alias("mode_value"), (-F.col("b.m")).alias("n"))


def merge_sources(names: DataFrame) -> DataFrame:
    """(name, sources ARRAY) -> one row a name with the sorted union of its sources, by name."""
    flat = names.select("name", F.explode_outer("sources").alias("s")).distinct()
    return flat.groupBy("name").agg(F.array_sort(F.collect_list("s")).alias("sources")).orderBy("name")


def hash_sample(rows: DataFrame, by: str, key: str, most: int, seed: int = 27) -> DataFrame:
    """At most so many rows of each group, those of the smallest digest of seed and key."""
    order = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string")))
    return rows.withColumn("_r", F.row_number().over(Window.partitionBy(by).orderBy(order, key))).where(F.col("_r") <= most).drop("_r")
