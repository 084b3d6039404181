"""URL filter: host and path rules, else a ratio of two character language models.

URLs that the rules decide are the examples: one variable-order Markov model is counted on the
allowed, one on the blocked. A model predicts each character from the longest context of up to ORDER
characters that it keeps, smoothed by Witten-Bell interpolation down to a uniform base; contexts
seen fewer than CONTEXT_LEAST times are left out, all others are kept whole, so models grow with the
examples. Models of up to BROADCAST_ROWS entries are sent to all tasks, larger ones stay a table that
the urls' contexts are joined with. A url's score is the difference of the two log-likelihoods
over its length. The threshold is calibrated on a fifth of the examples that the models did not see: the
cut of the score's histogram with the greatest mean of both classes' hit rates.

Counts are gathered over all examples, summed within tasks before the shuffle.

Edge cases: null urls and urls without :// have an empty host and path, fit no rule and score 0;
without examples of both classes every score is 0 and the threshold 0, so the verdict is allow; repeated
rows get equal verdicts; urls of any length are scored whole; other columns are not read.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from facetmill.sources.memory import tidy
from facetmill.sources.scratch import Scratch, small_batches

#: Fixed by the contract: (verdict, host, path).
RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))
ORDER = 5
CONTEXT_LEAST = 4
BROADCAST_ROWS = 300_000  # entries of both models, about 60 MB; beyond it they are joined
ALPHABET = 4096.0
START = "\x02"
END = "\x03"
BIN = 0.01
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def host_path(url: Column) -> tuple[Column, Column]:
    at = F.coalesce(F.instr(url, "://"), F.lit(0))
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), _UPPER, _UPPER.lower())
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def matched(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, or nulls."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for said, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule, verdict = F.when(fits, F.lit(h + p)).otherwise(rule), F.when(fits, F.lit(said)).otherwise(verdict)
    return rule, verdict


@dataclass
class Markov:
    """log p of a string by counts of characters after contexts: n of all, kinds of different ones, = and the character of each."""

    after: dict[str, dict[str, int]]

    def log(self, text: str) -> float:
        total, s = 0.0, START + text + END
        for i in range(1, len(s)):
            p, c = 1.0 / ALPHABET, s[i]
            for k in range(min(ORDER, i) + 1):
                seen = self.after.get(s[i - k : i])
                if seen is None:
                    break
                kinds, n = seen["kinds"], seen["n"]
                p = (seen.get("=" + c, 0) + kinds * p) / (n + kinds)
            total += math.log(p)
        return total


def _grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(accepted, context, character, count) of every order, summed as far as memory goes."""
    n: Counter = Counter()

    def out() -> pa.RecordBatch:
        keys = list(n)
        b = pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.bool_()), pa.array([k[1] for k in keys], pa.string()), pa.array([k[2] for k in keys], pa.string()), pa.array(list(n.values()), pa.int64())], names=["accepted", "context", "next", "n"])
        n.clear()
        return b

    for b in batches:
        for url, yes in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            s = START + url + END
            for i in range(1, len(s)):
                for k in range(min(ORDER, i) + 1):
                    n[yes, s[i - k : i], s[i]] += 1
        if len(n) > 300_000:
            yield out()
    yield out()


def entries(examples: DataFrame) -> DataFrame:
    """(accepted, context, next, n, total, kinds): both models, from examples (url, accepted)."""
    grams = examples.mapInArrow(tidy(_grams), "accepted boolean, context string, next string, n long")
    grams = grams.groupBy("accepted", "context", "next").agg(F.sum("n").alias("n"))
    whole = grams.groupBy("accepted", "context").agg(F.sum("n").alias("total"), F.count("*").alias("kinds")).where(F.col("total") >= CONTEXT_LEAST)
    return grams.join(whole, ["accepted", "context"])


def train(examples: DataFrame) -> dict[bool, Markov]:
    """Models in memory, from examples (url, accepted)."""
    return loaded(entries(examples))


def loaded(kept: DataFrame) -> dict[bool, Markov]:
    models: dict[bool, dict[str, dict[str, int]]] = {True: {}, False: {}}
    for r in kept.toLocalIterator():
        models[r.accepted].setdefault(r.context, {"n": r.total, "kinds": r.kinds})["=" + r.next] = r.n
    return {yes: Markov(after) for yes, after in models.items()}


def _lookups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(url, i, k, context, next): each character of a url with each of its contexts."""
    for b in batches:
        for url in b.column(0).to_pylist():
            s = START + url + END
            for low in range(1, len(s), 10_000):
                at = [(i, k) for i in range(low, min(low + 10_000, len(s))) for k in range(min(ORDER, i) + 1)]
                yield pa.RecordBatch.from_arrays([pa.array([_hash(url)] * len(at), pa.int64()), pa.array([i for i, _ in at], pa.int32()), pa.array([k for _, k in at], pa.int32()), pa.array([s[i - k : i] for i, k in at], pa.string()), pa.array([s[i] for i, _ in at], pa.string())], names=["url_id", "i", "k", "context", "next"])


def _hash(url: str) -> int:
    return xxhash.xxh64_intdigest(url.encode("utf-8", "surrogatepass")) - (1 << 63)


def joined_scores(kept: DataFrame, urls: DataFrame) -> DataFrame:
    """(url, score): what ``ratio`` gives for each distinct url of (url), with the models as a table."""
    urls = urls.where("url IS NOT NULL").select("url").distinct()
    asked = urls.mapInArrow(tidy(_lookups), "url_id long, i int, k int, context string, next string")
    seen = kept.select("accepted", "context", "next", "n")
    whole = kept.select("accepted", "context", "total", "kinds").distinct()
    both = F.explode(F.array(F.lit(True), F.lit(False))).alias("accepted")
    every = asked.select("context", "next").distinct().select("context", "next", both)
    known = every.join(whole, ["accepted", "context"]).join(seen, ["accepted", "context", "next"], "left")
    known = known.groupBy("context", "next").agg(*[F.max(F.when(F.col("accepted") == yes, F.struct(F.coalesce("n", F.lit(0)).alias("n"), "total", "kinds"))).alias(name) for yes, name in ((True, "t"), (False, "f"))])
    rows = asked.join(known, ["context", "next"], "left").groupBy("url_id", "i").agg(F.array_sort(F.collect_list(F.struct("k", "t", "f"))).alias("c"))

    def log(name: str) -> Column:
        steps = F.filter(F.col("c"), lambda x: x[name].isNotNull())
        return F.log(F.aggregate(steps, F.lit(1.0 / ALPHABET), lambda p, x: (x[name]["n"] + x[name]["kinds"] * p) / (x[name]["total"] + x[name]["kinds"])))

    rows = rows.select("url_id", "i", log("t").alias("t"), log("f").alias("f")).groupBy("url_id").agg(F.array_sort(F.collect_list(F.struct("i", "t", "f"))).alias("c"))
    total = lambda name: F.aggregate(F.col("c"), F.lit(0.0), lambda s, x: s + x[name])
    scores = rows.select("url_id", ((total("t") - total("f")) / F.size("c")).alias("score"))
    own = F.pandas_udf(lambda u: u.map(_hash), "long")
    return urls.withColumn("url_id", own("url")).join(scores, "url_id").select("url", "score")


def ratio(models: dict[bool, Markov], url: str | None) -> float:
    if url is None or not models[True].after or not models[False].after:
        return 0.0
    return (models[True].log(url) - models[False].log(url)) / (len(url) + 1)


def calibrate(scores: DataFrame) -> float:
    """Threshold over (accepted, score), from counts in bins of BIN."""
    bins = scores.groupBy(F.floor(F.col("score") / BIN).alias("bin"), "accepted").count().collect()  # a score is within log(ALPHABET) * 2, so bins are bounded
    of = {True: Counter(), False: Counter()}
    for r in bins:
        of[r.accepted][r.bin] += r["count"]
    yes, no = sum(of[True].values()), sum(of[False].values())
    if not yes or not no:
        return 0.0
    cuts = sorted({0, *of[True], *of[False], *(b + 1 for b in of[True]), *(b + 1 for b in of[False])})
    best, below_yes, below_no, at = (-1.0, 0.0, 0), 0, 0, 0
    order = sorted({*of[True], *of[False]})
    for c in cuts:
        while at < len(order) and order[at] < c:
            below_yes += of[True][order[at]]
            below_no += of[False][order[at]]
            at += 1
        hit = ((yes - below_yes) / yes + below_no / no) / 2
        best = max(best, (round(hit, 9), -abs(c), c))
    return best[2] * BIN


def judged(pages: DataFrame, rules=RULES) -> DataFrame:
    """page_id, host, path, rule, verdict, score (null where a rule decides) for each row."""
    host, path = host_path(F.col("url"))
    rule, verdict = matched(F.col("host"), F.col("path"), rules)
    known = pages.select("page_id", "url", host.alias("host"), path.alias("path"))
    known = known.select("*", rule.alias("rule"), verdict.alias("said"))
    text = F.when(F.instr("url", "://") > 0, F.concat("host", F.substring(F.col("url"), F.instr("url", "://") + 3 + F.length("host"), F.length("url"))))
    examples = known.where("rule IS NOT NULL").select(text.alias("url"), (F.col("said") == "allow").alias("accepted"))
    apart = F.pmod(F.xxhash64("url"), F.lit(5)) == 0
    small_batches(pages.sparkSession)
    with Scratch(pages.sparkSession, "urls") as scratch:
        kept = scratch.table(entries(examples.where(~apart)), "model")
        sizes = {r.accepted: r["count"] for r in kept.groupBy("accepted").count().collect()}
        if sum(sizes.values()) <= BROADCAST_ROWS or len(sizes) < 2:
            models = loaded(kept) if len(sizes) == 2 else {True: Markov({}), False: Markov({})}
            shared = pages.sparkSession.sparkContext.broadcast(models)

            def run(urls: pd.Series) -> pd.Series:
                return pd.Series([ratio(shared.value, u) for u in urls], dtype="float64")

            score = F.pandas_udf(run, "double")
            cut = calibrate(examples.where(apart).select("accepted", score("url").alias("score")))
            open_ = known.withColumn("score", F.when(F.col("rule").isNull(), score(F.when(F.col("rule").isNull(), text))))
        else:
            held, rest = examples.where(apart), known.where("rule IS NULL").select(text.alias("url"))
            scores = scratch.keep(joined_scores(kept, held.select("url").union(rest)), "scores")
            cut = calibrate(held.join(scores, "url").select("accepted", "score"))
            found = known.withColumn("_text", F.when(F.col("rule").isNull(), text)).join(scores.withColumnRenamed("url", "_text"), "_text", "left")
            open_ = found.withColumn("score", F.when(F.col("rule").isNull(), F.coalesce("score", F.lit(0.0))))
    decided = F.when(F.col("rule").isNotNull(), F.col("said")).when(F.col("score") >= cut, "allow").otherwise("block")
    return open_.select("page_id", "host", "path", "rule", decided.alias("verdict"), "score")


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url"))
