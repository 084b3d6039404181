"""Mixing sources to target weights: Efraimidis-Spirakis order, whole epochs, then a fractional pass.

Every document gets the exponential key ``-ln(u) / quality`` (u hashed from its id), so the order by
key within a source is a weighted sample without replacement. A source's target is split in whole
epochs and a remainder; the remainder takes documents in key order while their prefix sum of words
stays nearest the target. Only DataFrame functions are used.

A source is never sorted as a whole: keys fall in buckets of equal width in the logarithm of the key
(600 a unit; keys of any one quality spread over some units, whatever the quality), the words of each bucket
are summed first, and only the bucket in which the target is crossed is sorted. Rows of equal id and
size in it are one entry with a count, so no number of repeated rows makes a large group; of the entry at
the cut as many rows are taken as it takes to come nearest the target, told apart by the place where they are stored.

Edge cases: null and empty texts have size 0 and take 0 words; a null source is a source of its own,
last in order; repeated rows are separate documents with equal keys, of which just so many are taken as
the target needs; an empty table gives no rows; other columns, whatever their names, pass through untouched.
Sources themselves (one row each) are ranked and shared out by one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from facetmill.sources.scratch import Scratch

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (1, 2, 3)
MAX_EPOCHS = 3
BUCKETS_A_UNIT = 600  # of the logarithm of the key
SEED = "mix-27"


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def quality(text: Column, size: Column) -> Column:
    """Weight in (0, 1]: near 1 for texts of usual word length that aren't very short."""
    mean = F.coalesce(F.length(text), F.lit(0)).cast("double") / F.greatest(size, F.lit(1)).cast("double")
    usual = F.lit(1.0) / (F.lit(1.0) + F.abs(mean - 6.0) / 6.0)
    return F.greatest(usual * (size.cast("double") / (size.cast("double") + 50.0)), F.lit(1e-6))


def uniform(doc_id: Column) -> Column:
    """In (0, 1), from the document's id alone, so reruns agree."""
    digest = F.md5(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(SEED)))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 0.5) / float(2**52)


def keyed(docs: DataFrame) -> DataFrame:
    """row (a struct of all columns of docs), source, doc_id, size, key and bucket (which rises with the key)."""
    rows = docs.select(F.struct("*").alias("row"))
    rows = rows.select("row", F.col("row.source").alias("source"), F.col("row.doc_id").alias("doc_id"), n_words(F.col("row.text")).alias("size"))
    rows = rows.withColumn("key", -F.log(uniform(F.col("doc_id"))) / quality(F.col("row.text"), F.col("size")))
    return rows.withColumn("bucket", F.floor(F.log("key") * BUCKETS_A_UNIT).cast("int"))


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MAX_EPOCHS) -> DataFrame:
    """(source, source_size) -> plus ``target``: the words of all sources shared out by weight.

    A target above ``most`` times its source is cut and the excess reshared by weight; the fixed
    point of that is one level L with target = min(most * size, L * weight), found by prefix sums
    over the sources in order of most * size / weight. One row per source meets in one task.
    """
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), ((rank - 1) % len(weights) + 1).cast("int"))
    s = sizes.withColumn("_rank", rank).withColumn("_w", weight.cast("double"))
    s = s.withColumn("_cap", (F.col("source_size") * most).cast("double")).withColumn("_r", F.col("_cap") / F.col("_w"))
    every = Window.orderBy("_r", "_rank").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    so_far = Window.orderBy("_r", "_rank").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    left = F.sum(F.col("source_size").cast("double")).over(every) - (F.sum("_cap").over(so_far) - F.col("_cap"))
    s = s.withColumn("_level", left / (F.sum("_w").over(every) - (F.sum("_w").over(so_far) - F.col("_w"))))
    level = F.max(F.when(F.col("_level") <= F.col("_r"), F.col("_level"))).over(every)
    return s.withColumn("_l", level).select("source", "source_size", F.least(F.col("_cap"), F.col("_l") * F.col("_w")).alias("target"))


def plan(keys: DataFrame, scratch: Scratch, weights: tuple[int, ...] = WEIGHTS, most: int = MAX_EPOCHS) -> DataFrame:
    """Per source (named _source): source_size, target, epochs, and the cut: cut_bucket and in it the last entry
    (key, id, size) of which rows are taken, and how many of its rows are: n of all.

    keys: source, doc_id, size, key, bucket of every document.
    """
    filled = scratch.table(keys.groupBy("source", "bucket").agg(F.sum("size").alias("words")), "buckets")
    sizes = filled.groupBy("source").agg(F.sum("words").alias("source_size"))
    goal = targets(sizes, weights, most)
    goal = goal.withColumn("epochs", F.when(F.col("source_size") > 0, F.least(F.floor(F.col("target") / F.col("source_size")), F.lit(most))).otherwise(0).cast("int"))
    goal = scratch.table(goal.withColumn("rest", F.col("target") - F.col("epochs") * F.col("source_size")), "targets")
    w = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    b = filled.withColumn("upto", F.sum("words").over(w)).withColumn("before", F.col("upto") - F.col("words"))
    g = goal.select(F.col("source").alias("_s"), "rest")
    cross = b.join(g, b.source.eqNullSafe(g._s)).where((F.col("before") < F.col("rest")) & (F.col("rest") <= F.col("upto")))
    cross = scratch.table(cross.select("_s", F.col("bucket").alias("cut_bucket"), "before", "rest"), "cross")
    inside = keys.join(cross, keys.source.eqNullSafe(cross._s) & (keys.bucket == cross.cut_bucket))
    entries = inside.groupBy("_s", "cut_bucket", "before", "rest", "key", "doc_id", "size").agg(F.count("*").alias("all"))
    words = F.col("all") * F.col("size")
    order = Window.partitionBy("_s", "cut_bucket").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    entries = entries.withColumn("start", F.sum(words).over(order) - words + F.col("before"))
    # row i of an entry ends at start + i * size; it is taken up to rest, and if it passes rest but lies nearer than the row before
    whole = F.when(F.col("size") > 0, F.floor((F.col("rest") - F.col("start")) / F.col("size"))).otherwise(F.col("all"))
    end = F.col("start") + whole * F.col("size")
    nearer = (end < F.col("rest")) & (end + F.col("size") - F.col("rest") < F.col("rest") - end)
    n = F.least(F.col("all"), whole + F.when(nearer, 1).otherwise(0)).cast("long")
    reached = F.col("start") <= F.col("rest")
    cut = entries.where(reached).withColumn("n", n).where("n > 0").groupBy("_s").agg(F.max(F.struct(F.struct("key", F.col("doc_id").alias("id"), "size").alias("last"), "n", "all")).alias("c"))
    cut = cut.select(F.col("_s").alias("_c"), F.col("c.last").alias("cut"), "c.n", "c.all")
    out = goal.join(cross.drop("rest", "before"), goal.source.eqNullSafe(cross._s), "left").drop("_s")
    out = out.join(cut, out.source.eqNullSafe(cut._c), "left").drop("_c")
    return out.select(F.col("source").alias("_source"), "source_size", "target", "epochs", "cut_bucket", "cut", "n", "all")


def with_copies(keys: DataFrame, chosen: DataFrame, scratch: Scratch) -> DataFrame:
    """keys with source_size, target and ``copies``, how often the mix takes each document, by its source's row of the plan.

    The plan is a written table of one row per source, so Catalyst broadcasts it only while its
    size is under spark.sql.autoBroadcastJoinThreshold and else joins by sort with skew handling. Only where
    some, not all, of the equal rows at a cut are taken, are these rows written and numbered, part by part.
    """
    mine = F.struct("key", F.col("doc_id").alias("id"), "size")
    at_cut = (F.col("bucket") == F.col("cut_bucket")) & F.coalesce(mine.eqNullSafe(F.col("cut")), F.lit(False))
    below = (F.col("bucket") < F.col("cut_bucket")) | ((F.col("bucket") == F.col("cut_bucket")) & (mine <= F.col("cut")))
    joined = keys.join(chosen, keys.source.eqNullSafe(chosen._source))
    some = F.coalesce(at_cut & (F.col("n") < F.col("all")), F.lit(False))
    columns = [*keys.columns, "source_size", "target"]
    copies = lambda more: (F.col("epochs") + F.when(more, 1).otherwise(0)).alias("copies")
    if not chosen.where("n < all").head(1):
        return joined.select(*columns, copies(below))
    equal = scratch.keep(joined.where(some).withColumn("_at", F.monotonically_increasing_id()), "equal")
    part = F.shiftright("_at", 33)
    so_far = Window.partitionBy("_source").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = equal.groupBy("_source", part.alias("_part")).agg(F.count("*").alias("_rows"))
    parts = parts.withColumn("_before", F.coalesce(F.sum("_rows").over(so_far), F.lit(0))).select(F.col("_source").alias("_p"), "_part", "_before")
    numbered = equal.withColumn("_part", part).withColumn("_i", F.row_number().over(Window.partitionBy("_source", "_part").orderBy("_at")))
    numbered = numbered.join(parts.withColumnRenamed("_part", "_q"), numbered._source.eqNullSafe(F.col("_p")) & (numbered._part == F.col("_q")))
    numbered = numbered.select(*columns, copies(F.col("_i") + F.col("_before") <= F.col("n")))
    return joined.where(~some).select(*columns, copies(below)).unionByName(numbered)


def mix(spark: SparkSession, docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MAX_EPOCHS) -> DataFrame:
    """doc_id, source, size, source_size, target, copies, taken for each row of docs."""
    with Scratch(spark, "mix") as scratch:
        keys = scratch.keep(keyed(docs.select("doc_id", "source", "text")).drop("row"), "keys")
        chosen = scratch.keep(plan(keys, scratch, weights, most), "plan")
        out = with_copies(keys, chosen, scratch)
    return out.select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("size") * F.col("copies")).alias("taken"))


def apply_mix(spark: SparkSession, docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MAX_EPOCHS) -> DataFrame:
    """The mix itself: each row of docs as often as it is taken, with the columns of docs."""
    with Scratch(spark, "mixed") as scratch:
        keys = scratch.table(keyed(docs.select("doc_id", "source", "text")).drop("row"), "keys")
        chosen = scratch.keep(plan(keys, scratch, weights, most), "plan")
        out = with_copies(keyed(docs), chosen, scratch).where(F.col("copies") > 0)
    return out.select("row", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("i")).select("row.*")


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return mix(spark, docs).select("doc_id", "size", "source_size", "target", "taken")


ORACLE_SQL = r"""
WITH d AS (
  SELECT doc_id, source, length(coalesce(text, ''))::DOUBLE AS n,
         coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents),
q AS (
  SELECT *, ((('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || 'mix-27'), 1, 13))::BIGINT)::DOUBLE + 0.5) / 4503599627370496.0 AS u,
         greatest(1.0::DOUBLE / (1.0::DOUBLE + abs(n / greatest(size, 1)::DOUBLE - 6.0::DOUBLE) / 6.0::DOUBLE) * (size::DOUBLE / (size::DOUBLE + 50.0::DOUBLE)), 1e-6::DOUBLE) AS w FROM d),
k AS (SELECT *, -ln(u) / w AS key FROM q),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
r AS (SELECT *, ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::DOUBLE AS wt, row_number() OVER (ORDER BY source NULLS LAST) AS rk FROM s),
c AS (SELECT *, (source_size * 3)::DOUBLE AS cap, (source_size * 3)::DOUBLE / wt AS ratio FROM r),
l AS (SELECT *, (sum(source_size::DOUBLE) OVER () - (sum(cap) OVER (ORDER BY ratio, rk) - cap)) / (sum(wt) OVER () - (sum(wt) OVER (ORDER BY ratio, rk) - wt)) AS lev FROM c),
m AS (SELECT *, max(CASE WHEN lev <= ratio THEN lev END) OVER () AS level FROM l),
t AS (SELECT source, source_size, least(cap, level * wt) AS target FROM m),
e AS (SELECT *, CASE WHEN source_size > 0 THEN least(floor(target / source_size), 3) ELSE 0 END::BIGINT AS ep FROM t),
f AS (SELECT *, target - ep * source_size AS rest FROM e),
j AS (
  SELECT k.*, f.source_size, f.target, f.ep, f.rest,
         sum(k.size) OVER (PARTITION BY k.source ORDER BY key, doc_id, k.size ROWS UNBOUNDED PRECEDING) AS upto
  FROM k JOIN f ON k.source IS NOT DISTINCT FROM f.source)
SELECT doc_id, size, source_size, target,
       (size * (ep + CASE WHEN upto <= rest OR (upto - size < rest AND upto - rest < rest - (upto - size)) THEN 1 ELSE 0 END))::BIGINT AS taken
FROM j
"""
