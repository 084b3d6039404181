"""Repeated passages by sparse suffix arrays.

Of a text's words, the positions kept are the minimisers: in every SPAN words, the one whose
GRAM-word gram has the smallest hash. Each passage of SPAN words so holds a position chosen by its
content alone, the same wherever the passage stands. The suffixes at those positions are sorted by
their gram and the words that follow; neighbours are compared word by word, which gives the lengths of
their common beginnings and so the runs of suffixes that agree over any number of words to the right.
Within a run, the same is done to the left: suffixes in order of the words before them, neighbours
compared. Suffixes that agree over m words before the gram and SPAN - m from it on share a passage.
The result is whole: a word is marked exactly if some SPAN words around it stand in another document
too. Words are 64-bit hashes, so two that differ are taken for equal with a chance of 2**-64.

Grams that stand in one document only are dropped before words travel: the others set bits of a
bitmap (8 a gram, 32 MB at most), which is broadcast; beyond that size suffixes are joined with
the table of grams. A false bit costs a row, never a result. Suffixes of one gram are compared in one
task, so a gram in over HOT suffixes takes another exact way: the passages of SPAN words whose smallest
gram it is are aggregated by two 64-bit hashes, in part before the shuffle, so that no task holds the
group. Hot grams are those of over 1 / HOT_MOST of all suffixes, too, so their list is bounded.

Edge cases: null and empty texts and texts under SPAN words have no passages; repeated rows (equal
id and words) count as one document; a null doc_id is a document of its own by its words; of a text
of any length all words count; an empty table gives no rows; further columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from facetmill.llm.bitmap import among, bitmap, hit
from facetmill.llm.wordhash import mix, shingle_hashes, text_words
from facetmill.sources.memory import tidy
from facetmill.sources.scratch import Scratch, arrow_rows

SPAN = 50
GRAM = 8
HOT = 4096
HOT_MOST = 1 << 20  # hot grams at most, 8 MB
CHUNK = 10_000  # suffixes compared at once
NO_ID = np.iinfo(np.int64).max
_U = np.uint64


def _sliding(a: np.ndarray, window: int, f) -> np.ndarray:
    """f (minimum or maximum) over each window of a, by doubling."""
    size = 1
    while 2 * size <= window:
        a = f(a[:-size], a[size:])
        size *= 2
    return f(a[: len(a) - (window - size)], a[window - size :]) if window > size else a


def _smallest(grams: np.ndarray, window: int) -> np.ndarray:
    return _sliding(grams, window, np.minimum)


def minimisers(grams: np.ndarray, window: int) -> np.ndarray:
    """Positions that are smallest in some window of grams; of equal neighbours only the first, each window-th and the last."""
    n = len(grams)
    if n < window:
        return np.empty(0, np.int64)

    low = _smallest(grams, window)  # of the windows by their starts
    padded = np.concatenate((np.zeros(window - 1, _U), low, np.zeros(window - 1, _U)))
    chosen = _sliding(padded, window, np.maximum) == grams
    same = np.concatenate(([False], grams[1:] == grams[:-1]))
    since = np.arange(n) - np.maximum.accumulate(np.where(same, 0, np.arange(n)))
    last = np.concatenate((~same[1:], [True]))
    return np.flatnonzero(chosen & ((since % window == 0) | last))


def _documents(batch: pa.RecordBatch) -> Iterator[tuple[int, int | None, np.ndarray]]:
    """(key, doc_id, word hashes) of each row of (doc_id, text); the key is a hash of id and words."""
    for doc_id, words in zip(batch.column(0).to_pylist(), text_words(batch.column(1)), strict=True):
        h = _U(len(words)) if not len(words) else np.bitwise_xor.reduce(mix(words + np.arange(len(words), dtype=_U) * _U(0x9E3779B97F4A7C15)))
        own = _U(0xA5A5) if doc_id is None else mix(np.array([doc_id], dtype=np.int64).view(_U))[0]
        yield int(mix(np.array([h ^ own], dtype=_U)).view(np.int64)[0]), doc_id, words


def _grams(span: int, gram: int):
    """(h, rows, key): the kept grams of each document and how many positions each has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys, found, rows = [], [], []
            for key, _, words in _documents(b):
                g = shingle_hashes(words, gram) if len(words) >= span else words[:0]
                at = minimisers(g, span - gram + 1)
                if len(at):
                    h, n = np.unique(g[at], return_counts=True)
                    keys.append(np.full(len(h), key, np.int64))
                    found.append(h.view(np.int64))
                    rows.append(n.astype(np.int64))
            cat = lambda x: pa.array(np.concatenate(x) if x else np.empty(0, np.int64))
            yield pa.RecordBatch.from_arrays([cat(found), cat(rows), cat(keys)], names=["h", "rows", "key"])

    return run


def shared_grams(docs: DataFrame, span: int, gram: int) -> DataFrame:
    """(h, rows): grams that stand in several documents, with their number of suffixes."""
    found = docs.mapInArrow(tidy(_grams(span, gram)), "h long, rows long, key long")
    found = found.groupBy("h").agg(F.sum("rows").alias("rows"), F.min("key").alias("a"), F.max("key").alias("b"))
    return found.where("a <> b").select("h", "rows")


def _binary(parts: list[tuple[np.ndarray, np.ndarray]]) -> pa.Array:
    """Rows of big-endian words from (flat words, words a row) of several documents."""
    size = np.concatenate([n for _, n in parts]) if parts else np.empty(0, np.int64)
    flat = np.concatenate([w for w, _ in parts]) if parts else np.empty(0, _U)
    edges = np.concatenate(([0], np.cumsum(8 * size))).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(size), [None, pa.py_buffer(edges.tobytes()), pa.py_buffer(flat.astype(">u8").tobytes())])


def _suffixes(span: int, gram: int, shared):
    """Per kept position of a shared gram that isn't hot: gram, document, place, the words from it on, and those before it, nearest first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, hot = shared.value
        back = span - gram

        def out(rows: list[list]) -> pa.RecordBatch:
            h, key, doc, at, have, suffix, before = rows
            cat = lambda x: pa.array(np.concatenate(x) if x else np.empty(0, np.int64))
            return pa.RecordBatch.from_arrays([cat(h), cat(key), pa.array(doc, pa.int64()), cat(at), cat(have), _binary(suffix), _binary(before)], names=["h", "key", "doc_id", "at", "have", "suffix", "before"])

        for b in batches:
            rows: list[list] = [[] for _ in range(7)]
            size = 0
            for key, doc_id, words in _documents(b):
                if len(words) < span:
                    continue
                g = shingle_hashes(words, gram)
                every = minimisers(g, back + 1)
                for low in range(0, len(every), CHUNK):
                    at = every[low : low + CHUNK]
                    at = at[hit(bits, g[at]) & ~among(hot, g[at])]
                    if not len(at):
                        continue
                    after, left = np.minimum(len(words) - at, span), np.minimum(at, back)
                    rows[0].append(g[at].view(np.int64))
                    rows[1].append(np.full(len(at), key, np.int64))
                    rows[2].extend([doc_id] * len(at))
                    rows[3].append(at)
                    rows[4].append(left * 256 + after)
                    for where, n, step in ((rows[5], after, np.arange(span)), (rows[6], left, -1 - np.arange(back))):
                        spot = at[:, None] + step
                        where.append((words[spot[np.arange(len(step)) < n[:, None]]], n))
                    size += len(at)
                    if size > CHUNK:
                        yield out(rows)
                        rows, size = [[] for _ in range(7)], 0
            yield out(rows)

    return run


def _matrix(column: pa.ChunkedArray, width: int) -> np.ndarray:
    """Words of each row, zeros after the last."""
    a = column.combine_chunks()
    a = pa.concat_arrays(a.chunks) if isinstance(a, pa.ChunkedArray) else a
    out = np.zeros((len(a), width), _U)
    if len(a):
        edges = np.frombuffer(a.buffers()[1], np.int32, len(a) + 1, 4 * a.offset)
        flat = np.frombuffer(a.buffers()[2], ">u8", (edges[-1] - edges[0]) // 8, edges[0]) if edges[-1] > edges[0] else np.empty(0, ">u8")
        out[np.arange(width) < (np.diff(edges) // 8)[:, None]] = flat
    return out


def _common(x: np.ndarray, y: np.ndarray, most: np.ndarray) -> np.ndarray:
    """How many words two rows have in common from the first on, most at most."""
    differ = np.concatenate((x != y, np.ones((len(x), 1), bool)), axis=1)
    return np.minimum(differ.argmax(axis=1), most).astype(np.int64)


def _lows(a: np.ndarray):
    """A function that gives the smallest of a[i:j] for arrays i < j."""
    levels = [a]
    while 2 << (len(levels) - 1) <= len(a):
        half = 1 << (len(levels) - 1)
        levels.append(np.minimum(levels[-1][:-half], levels[-1][half:]))
    flat = np.concatenate(levels) if len(a) else a
    starts = np.concatenate(([0], np.cumsum([len(x) for x in levels])))[:-1]

    def low(i: np.ndarray, j: np.ndarray) -> np.ndarray:
        k = np.log2(j - i).astype(np.int64)
        return np.minimum(flat[starts[k] + i], flat[starts[k] + j - (1 << k)])

    return low


def _matches(span: int, gram: int):
    """In suffixes sorted by (h, suffix): the range of words of each whose SPAN-word passages stand in another document, the
    range that an earlier document holds, and another document."""
    back = span - gram

    def solve(t: pa.Table) -> pa.RecordBatch:
        h, key, at, have = (t.column(c).to_numpy() for c in ("h", "key", "at", "have"))
        doc = t.column("doc_id").fill_null(NO_ID).to_numpy()
        n = len(h)
        before, after = have // 256, have % 256
        right, left = _matrix(t.column("suffix"), span), _matrix(t.column("before"), back)
        ahead = np.where(h[1:] == h[:-1], _common(right[:-1], right[1:], np.minimum(after[:-1], after[1:])), 0)
        raw = np.concatenate((h.view(_U)[:, None], left), axis=1).astype(">u8")
        order = np.argsort(raw.view(f"S{8 * (back + 1)}").reshape(-1), kind="stable")
        behind = np.where(h[order[1:]] == h[order[:-1]], _common(left[order[:-1]], left[order[1:]], np.minimum(before[order[:-1]], before[order[1:]])), -1)
        rank = np.empty(n, np.int64)
        rank[order] = np.arange(n)
        low = _lows(behind)
        # documents by (id, key)
        by = np.lexsort((key, doc))
        new = np.concatenate(([True], (key[by][1:] != key[by][:-1]) | (doc[by][1:] != doc[by][:-1])))
        number = np.empty(n, np.int64)
        number[by] = np.cumsum(new) - 1
        id_of = doc[by][new]
        least, most = (np.full((2, n), v, np.int64) for v in (back + 1, -1))  # offsets of repeated passages, and of those an earlier document holds
        other = np.full(n, NO_ID)
        for m in range(back + 1):  # passages that start m words before the gram
            run = np.concatenate(([0], np.cumsum(ahead < span - m)))
            rows = np.flatnonzero((before >= m) & (after >= span - m))
            rows = rows[np.bincount(run[rows], minlength=1)[run[rows]] > 1] if len(rows) else rows
            if not len(rows):
                continue
            rows = rows[np.argsort(run[rows] * n + rank[rows])]
            a, b = rows[:-1], rows[1:]
            apart = run[a] != run[b]
            apart[~apart] = low(rank[a[~apart]], rank[b[~apart]]) < m
            first = np.flatnonzero(np.concatenate(([True], apart)))
            group = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(rows))))
            own = number[rows]
            lead, last = np.minimum.reduceat(own, first)[group], np.maximum.reduceat(own, first)[group]
            for k, hit in ((0, lead != last), (1, own != lead)):
                at_ = rows[hit]
                least[k, at_], most[k, at_] = np.minimum(least[k, at_], m), m
            several = lead != last
            mine = id_of[np.where(own == lead, last, lead)]
            other[rows[several]] = np.minimum(other[rows[several]], mine[several])
        # passages of one suffix overlap, for they all hold its gram, so each range is one
        found = [(np.flatnonzero(most[k] >= 0), bool(k)) for k in (0, 1)]
        i = np.concatenate([f for f, _ in found])
        k = np.concatenate([np.full(len(f), int(e)) for f, e in found])
        return pa.RecordBatch.from_arrays(
            [pa.array(key[i]), pa.array(at[i] - most[k, i]), pa.array(at[i] - least[k, i] + span), pa.array(k == 1), pa.array(other[i], mask=other[i] == NO_ID)],
            names=["key", "start", "end", "extra", "partner"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0
        for b in batches:
            held.append(b)
            size += b.num_rows
            if size >= CHUNK:
                t = pa.Table.from_batches(held)
                h = t.column("h").to_numpy()
                whole = int(np.searchsorted(h, h[-1]))
                if whole:
                    yield solve(t.slice(0, whole))
                    t = t.slice(whole).combine_chunks()
                    held, size = t.to_batches(), t.num_rows
        if size:
            yield solve(pa.Table.from_batches(held))

    return run


def _passages(span: int, gram: int, shared):
    """(w, x, key, doc_id, start): passages whose smallest gram is hot, by two hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot = shared.value[1]
        window = span - gram + 1
        for b in batches:
            for key, doc_id, words in _documents(b):
                if len(words) < span:
                    continue
                g = shingle_hashes(words, gram)
                low = _smallest(g, window)
                start = np.flatnonzero(among(hot, low))
                for i in range(0, len(start), CHUNK):
                    at = start[i : i + CHUNK]
                    two = []
                    for salt in (0x243F6A8885A308D3, 0x13198A2E03707344):
                        x = np.full(len(at), _U(salt))
                        with np.errstate(over="ignore"):
                            for k in range(span):
                                x = mix(x * _U(0x9E3779B97F4A7C15) + words[at + k])
                        two.append(pa.array(x.view(np.int64)))
                    yield pa.RecordBatch.from_arrays([*two, pa.array(np.full(len(at), key, np.int64)), pa.array([doc_id] * len(at), pa.int64()), pa.array(at)], names=["w", "x", "key", "doc_id", "start"])

    return run


def _of_hot(docs: DataFrame, span: int, gram: int, shared, scratch: Scratch) -> DataFrame:
    """The same as ``_matches`` for passages of hot grams. Documents of one passage are aggregated to the first and the last,
    in part before the shuffle; back on the passages' rows they are joined, where a hot key is split by skew handling."""
    rows = docs.mapInArrow(tidy(_passages(span, gram, shared)), "w long, x long, key long, doc_id long, start long")
    rows = scratch.table(rows.withColumn("doc_id", F.coalesce("doc_id", F.lit(int(NO_ID)))), "passages")
    who = F.struct("doc_id", "key")
    both = rows.groupBy("w", "x").agg(F.min(who).alias("lead"), F.max(who).alias("last")).where("lead <> last")
    hit = rows.join(scratch.table(both, "shared"), ["w", "x"])
    other = F.when(who == F.col("lead"), F.col("last.doc_id")).otherwise(F.col("lead.doc_id"))
    extra = F.explode(F.when(who == F.col("lead"), F.array(F.lit(False))).otherwise(F.array(F.lit(False), F.lit(True)))).alias("extra")
    return hit.select("key", "start", (F.col("start") + span).alias("end"), extra, F.nullif(other, F.lit(int(NO_ID))).alias("partner"))


def _merged(spans) -> str:
    out: list[list[int]] = []
    for a, b in sorted((int(s["start"]), int(s["end"])) for s in spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return ",".join(f"{a}-{b}" for a, b in out)


def repeats(spark: SparkSession, docs: DataFrame, span: int = SPAN, gram: int = GRAM) -> DataFrame:
    """doc_id, n_words, repeated (word ranges, ends exclusive, that stand in other documents), extra (those
    that an earlier document, by doc_id, holds), and partner (another document), for each row of docs."""
    with Scratch(spark, "suffixes") as scratch, arrow_rows(spark, 2000):
        docs = docs.select(F.col("doc_id").cast("long"), "text")
        grams = scratch.table(shared_grams(docs, span, gram), "grams")
        size = grams.agg(F.count("*").alias("n"), F.sum("rows").alias("rows")).first()
        bits = bitmap(grams, "h", size.n)
        hot = grams.where(F.col("rows") > max(HOT, (size.rows or 0) // HOT_MOST)).select("h").toArrow().column("h").to_numpy()  # HOT_MOST at most
        shared = spark.sparkContext.broadcast((bits, np.sort(hot.view(_U))))
        rows = docs.mapInArrow(tidy(_suffixes(span, gram, shared)), "h long, key long, doc_id long, at long, have long, suffix binary, before binary")
        rows = rows if bits is not None else rows.join(grams.select("h"), "h", "left_semi")
        rows = rows.repartition("h").sortWithinPartitions("h", "suffix")
        found = rows.mapInArrow(tidy(_matches(span, gram)), "key long, start long, end long, extra boolean, partner long")
        if len(hot):
            found = found.unionByName(_of_hot(docs, span, gram, shared, scratch))
        join = F.pandas_udf(lambda s: s.map(_merged), "string")
        pick = lambda extra: F.collect_list(F.when(F.col("extra") == extra, F.struct("start", "end")))
        found = found.distinct().groupBy("key").agg(pick(False).alias("a"), pick(True).alias("b"), F.min("partner").alias("partner"))
        found = found.select("key", join("a").alias("repeated"), join("b").alias("extra"), "partner")

        def lengths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                t = [(d, k, len(w)) for k, d, w in _documents(b)]
                yield pa.RecordBatch.from_pandas(pd.DataFrame(t, columns=["doc_id", "key", "n_words"]).astype({"doc_id": "Int64", "key": "int64", "n_words": "int64"}), preserve_index=False)

        every = docs.mapInArrow(tidy(lengths), "doc_id long, key long, n_words long")
        out = every.join(found, "key", "left").select("doc_id", "n_words", F.coalesce("repeated", F.lit("")).alias("repeated"), F.coalesce("extra", F.lit("")).alias("extra"), "partner")
        return scratch.keep(out)


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"))
