"""Toxicity by weak supervision.

Voters are small rules that fire on a text or stay silent: words of a general lexicon, words and
word beginnings mined from labelled rows, the same words under digit-for-letter folding. Mined are all
that a G-test finds at a false discovery rate of FALSE_SHARE (Benjamini-Hochberg), so their number follows
from the bounded sample and isn't capped. A
generative label model treats the true class as hidden and every voter, and the given label itself,
as a noisy witness: EM estimates each one's rates per class; correlations are what the whole
corpus's joint firing counts show beyond independence given the class, kept as a maximum spanning
forest in which a voter's rates also depend on its parent. A ridge logistic regression trained on
the posterior labels scores texts.

Copies would make chance words look telling, so of labelled rows whose word triples have the same smallest
hash (near copies do with the chance of their similarity) one of each label is learned from.

Labels are learned from rows whose crc32(doc_id as text) mod 3 is not 1, at most TRAIN_MOST of them
(those of smallest hash); voters' joint firing is counted over all documents. doc_id, lang, source
and labels are no inputs of a score.

Edge cases: null and empty texts score as texts on which no voter fires; without usable labels
the general lexicon alone decides; a null doc_id is never held out; repeated rows score alike; an
empty table gives no rows; further columns pass through ``keep_clean`` and are else not read.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from facetmill.sources.memory import give_back, tidy
from facetmill.sources.scratch import Scratch, small_batches

TRAIN_MOST = 20_000  # labelled rows that the models are fitted on
FALSE_SHARE = 0.1  # of the mined voters that may be chance finds
ROW_BLOCK = 1_000  # training rows that the models hold as floats at once
THRESHOLD = 0.7
#: A general lexicon of abuse; the voters that need no labels.
LEXICON = ("stupid", "idiot", "idiots", "idiotic", "moron", "morons", "dumb", "dumbass", "imbecile", "loser", "losers", "scum", "trash", "worthless", "pathetic", "disgusting", "clown", "jerk", "bastard", "bitch", "asshole", "shit", "fuck", "fucking", "whore", "slut", "retard", "vermin", "filth", "creep")
_TOKEN = re.compile(r"[^\W_]+")
_FOLD = str.maketrans("013457", "oieast")


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(3)) == 1, F.lit(False))


def terms(text: str | None) -> set[str]:
    """What voters look at: distinct words, their first 4 and 5 letters (with a star), folded words (with a tilde)."""
    words = set(_TOKEN.findall(text.lower())) if text else set()
    out = set(words)
    for w in words:
        if len(w) > 4:
            out.add(w[:4] + "*")
            if len(w) > 5:
                out.add(w[:5] + "*")
        if not w.isalpha() and not w.isdigit():
            out.add("~" + w.translate(_FOLD))
    return out


@dataclass
class Model:
    vocabulary: dict[str, int]
    weights: np.ndarray  # one per voter, then of log(1 + fired voters), then the intercept

    def score(self, fired: set[str]) -> float:
        hit = [self.vocabulary[t] for t in fired & self.vocabulary.keys()]
        z = self.weights[-1] + (self.weights[hit].sum() + self.weights[-2] * np.log1p(len(hit)) if hit else 0.0)
        return float(1.0 / (1.0 + np.exp(-z)))


def _triple(text: str | None) -> int:
    """The smallest hash of three words in a row; of shorter texts, of all words."""
    words = _TOKEN.findall(text.lower()) if text else []
    return min(xxhash.xxh64_intdigest(" ".join(words[i : i + 3])) for i in range(max(1, len(words) - 2))) - (1 << 63)


def training_rows(docs: DataFrame, labels: DataFrame, scratch: Scratch) -> DataFrame:
    """(text, toxic) of at most TRAIN_MOST labelled ids outside the held-out fold, near copies once."""
    usable = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    usable = usable.groupBy(F.col("doc_id").alias("_l")).agg(F.max("toxic").cast("int").alias("toxic"))
    few = scratch.table(usable.orderBy(F.xxhash64("_l"), "_l").limit(TRAIN_MOST), "labels")
    rows = docs.select("doc_id", "text").join(F.broadcast(few), F.col("doc_id") == F.col("_l"))
    key = F.pandas_udf(lambda s: s.map(_triple), "long")
    return scratch.table(rows.groupBy(key("text").alias("key"), "toxic").agg(F.min("text").alias("text")).select("text", "toxic"), "train")


def mine(train: DataFrame) -> list[str]:
    """The terms that tell the classes apart, strongest first: in three toxic rows or more, 60 % of their rows toxic, and
    found by a G-test (p is about exp of minus the gain in log likelihood) at a false discovery rate of FALSE_SHARE."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        every, toxic = Counter(), Counter()
        rows = [0, 0]
        for b in batches:
            for text, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                t = terms(text)
                every.update(t)
                rows[0] += 1
                if y:
                    toxic.update(t)
                    rows[1] += 1
        every[""], toxic[""] = rows
        yield pa.RecordBatch.from_arrays([pa.array(list(every)), pa.array(list(every.values()), pa.int64()), pa.array([toxic[t] for t in every], pa.int64())], names=["term", "n", "t"])

    got = train.select("text", F.col("toxic").cast("int")).mapInArrow(tidy(count), "term string, n long, t long")
    got = got.groupBy("term").agg(F.sum("n").alias("n"), F.sum("t").alias("t"))
    whole = got.agg(F.max(F.when(F.col("term") == "", F.col("n"))).alias("n"), F.max(F.when(F.col("term") == "", F.col("t"))).alias("t"), F.count("*").alias("terms")).first()
    if not whole.t or whole.t == whole.n:
        return []
    base = whole.t / whole.n
    got = got.where((F.col("term") != "") & (F.col("t") >= 3) & (F.col("t") >= 0.6 * F.col("n")))
    gain = F.col("t") * F.log(F.col("t") / (F.col("n") * base)) + F.when(F.col("n") > F.col("t"), (F.col("n") - F.col("t")) * F.log((F.col("n") - F.col("t")) / (F.col("n") * (1 - base)))).otherwise(0.0)
    found = got.withColumn("g", gain).orderBy(F.col("g").desc(), "term").collect()  # bounded by TRAIN_MOST rows
    last = max((k for k, r in enumerate(found, 1) if r.g >= np.log(whole.terms / (FALSE_SHARE * k))), default=0)
    return [r.term for r in found[:last]]


def joint_counts(docs: DataFrame, vocabulary: dict[str, int]) -> tuple[np.ndarray, int]:
    """How often each two voters fire in one text, over all documents, and the number of documents."""
    size = len(vocabulary)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        joint, rows = np.zeros((size, size), np.int64), 0
        for b in batches:
            for text in b.column(0).to_pylist():
                rows += 1
                if hit := [vocabulary[t] for t in terms(text) & vocabulary.keys()]:
                    joint[np.ix_(hit, hit)] += 1
        i, j = np.nonzero(np.triu(joint))
        yield pa.RecordBatch.from_arrays([pa.array([*i.tolist(), -1], pa.int32()), pa.array([*j.tolist(), -1], pa.int32()), pa.array([*joint[i, j].tolist(), rows])], names=["i", "j", "n"])

    got = docs.select("text").mapInArrow(tidy(count), "i int, j int, n long").groupBy("i", "j").agg(F.sum("n").alias("n")).toArrow()  # half of the voters squared at most
    i, j, n = (got.column(c).to_numpy() for c in ("i", "j", "n"))
    joint, pair = np.zeros((size, size)), i >= 0
    joint[i[pair], j[pair]] = joint[j[pair], i[pair]] = n[pair]
    return joint, int(n[~pair].sum())


def _forest(strength: np.ndarray) -> np.ndarray:
    """Parent of each node in a maximum spanning forest of positive strengths (-1: none), by Prim's rule."""
    n = len(strength)
    parent, best, best_from = np.full(n, -1), np.zeros(n), np.full(n, -1)
    inside = np.zeros(n, bool)
    for _ in range(n):
        x = int(np.argmax(np.where(inside, -1.0, best)))
        inside[x] = True
        parent[x] = best_from[x] if best[x] > 0 else -1
        better = (strength[x] > best) & ~inside
        best[better], best_from[better] = strength[x][better], x
    return parent


def _in_blocks(votes: np.ndarray) -> Iterator[tuple[slice, np.ndarray]]:
    for i in range(0, len(votes), ROW_BLOCK):
        yield slice(i, i + ROW_BLOCK), votes[i : i + ROW_BLOCK].astype(np.float64)


def label_model(votes: np.ndarray, gold: np.ndarray, joint: np.ndarray, rows: int, rounds: int = 12, weight: np.ndarray | None = None) -> np.ndarray:
    """Posterior probability of the toxic class for each row of votes (0/1, rows x voters) with noisy labels gold; a row counts weight times."""
    n, v = votes.shape
    weight = np.ones(n) if weight is None else weight
    q = np.where(gold == 1, 0.9, 0.1)
    parent = np.full(v, -1)
    for step in range(rounds):
        w = np.stack([1 - q, q]) * weight  # class x row
        total = w.sum(1)
        prior = (total + 1) / (weight.sum() + 2)
        right = (np.array([(w[0] * (gold == 0)).sum(), (w[1] * (gold == 1)).sum()]) + 9) / (total + 10)
        log = np.log(prior)[:, None] + np.stack([np.where(gold == 0, np.log(right[0]), np.log(1 - right[0])), np.where(gold == 1, np.log(right[1]), np.log(1 - right[1]))])
        fired = sum((w[:, at] @ x for at, x in _in_blocks(votes)), np.zeros((2, v)))
        alone = (fired + 0.05) / (total[:, None] + 1.0)
        if step == rounds // 2 and rows:  # what joint firing over the corpus shows beyond the classes
            p = joint / rows
            excess = p - sum(prior[y] * np.outer(alone[y], alone[y]) for y in (0, 1))
            sd = np.sqrt(np.maximum(np.diag(p) * (1 - np.diag(p)), 1e-12))
            strength = np.where(joint >= 5, excess / np.outer(sd, sd), 0.0)
            np.fill_diagonal(strength, 0.0)
            parent = _forest(np.maximum(strength - 0.05, 0.0))
        has = parent >= 0
        both, ups = np.zeros((2, v)), np.zeros((2, v))
        for at, x in _in_blocks(votes):
            up = np.where(has, x[:, parent], 0.0)
            both += w[:, at] @ (x * up)
            ups += w[:, at] @ up
        # rates while the parent fires and while it is silent, shrunk to the voter's own
        rates = [np.clip(r, 1e-6, 1 - 1e-6) for r in ((fired - both + alone) / (total[:, None] - ups + 1.0), (both + alone) / (ups + 1.0))]
        yes, no = ([np.log(r) for r in rates], [np.log1p(-r) for r in rates])
        for at, x in _in_blocks(votes):
            up = has & (x[:, parent] > 0)
            for y in (0, 1):
                log[y, at] += np.where(x > 0, np.where(up, yes[1][y], yes[0][y]), np.where(up, no[1][y], no[0][y])).sum(1)
        q = 1 / (1 + np.exp(np.clip(log[0] - log[1], -500, 500)))
    return q


def _features(x: np.ndarray) -> np.ndarray:
    return np.column_stack([x, np.log1p(x.sum(1)), np.ones(len(x))])


def logistic(votes: np.ndarray, target: np.ndarray, weight: np.ndarray, ridge: float = 1.0, rounds: int = 25) -> np.ndarray:
    """Ridge logistic regression on soft targets by Newton steps: weights of the voters, of log(1 + fired voters), and the intercept."""
    w = np.zeros(votes.shape[1] + 2)
    penalty = np.full(len(w), ridge)
    penalty[-1] = 1e-6
    for _ in range(rounds):
        slope, curve = -penalty * w, np.diag(penalty)
        for at, x in _in_blocks(votes):
            a = _features(x)
            p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
            slope += a.T @ (weight[at] * (target[at] - p))
            curve += (a * (weight[at] * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ a
        step = np.linalg.solve(curve, slope)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return w


def learn(spark: SparkSession, docs: DataFrame, labels: DataFrame) -> Model:
    small_batches(spark)
    with Scratch(spark, "toxicity") as scratch:
        train = training_rows(docs, labels, scratch)
        mined = mine(train)
        vocabulary = {t: i for i, t in enumerate(dict.fromkeys([*mined, *LEXICON, *("~" + w for w in LEXICON)]))}
        if not mined:
            return Model(vocabulary, np.array([2.5] * len(vocabulary) + [1.0, -3.0]))
        joint, rows = joint_counts(docs, vocabulary)

        def fire(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                hit = [sorted(vocabulary[t] for t in terms(text) & vocabulary.keys()) for text in b.column(0).to_pylist()]
                yield pa.RecordBatch.from_arrays([pa.array(hit, pa.list_(pa.int32())), b.column(1)], names=["hit", "toxic"])

        fired = train.select("text", F.col("toxic").cast("int")).mapInArrow(tidy(fire), "hit array<int>, toxic int")
        got = fired.groupBy("hit", "toxic").agg(F.count("*").alias("n")).toArrow()  # TRAIN_MOST rows at most
    got = sorted((tuple(h), y, n) for h, y, n in zip(*(got.column(c).to_pylist() for c in ("hit", "toxic", "n")), strict=True))
    votes = np.zeros((len(got), len(vocabulary)), np.uint8)
    for i, (hit, _, _) in enumerate(got):
        votes[i, list(hit)] = 1
    weight = np.array([n for _, _, n in got], np.float64)
    posterior = label_model(votes, np.array([y for _, y, _ in got]), joint, rows, weight=weight)
    return Model(vocabulary, logistic(votes, posterior, weight))


def scored(docs: DataFrame, model: Model, to: str = "score") -> DataFrame:
    """docs with the score in a column; the text is the only input."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(text: pd.Series) -> pd.Series:
        m = shared.value
        out = pd.Series([m.score(terms(t)) for t in text], dtype="float64")
        give_back()
        return out

    return docs.withColumn(to, F.pandas_udf(run, "double")(F.col("text")))


def keep_clean(spark: SparkSession, docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """docs without those that score threshold or more."""
    to = "_score"
    while to in docs.columns:
        to += "_"
    return scored(docs, learn(spark, docs, labels), to).where(F.col(to) < threshold).drop(to)


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    out = scored(docs.select("doc_id", "text"), learn(spark, docs, labels))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
