"""N-gram Jaccard join by grouped prefixes.

Documents are sets of hashed word shingles. Two sets with Jaccard similarity of at least
``percent`` / 100 share a shingle within a short prefix of either, under any one order of all
shingles. The order here puts shingles seen often last (by document counts gathered in all parts of
the corpus), the rest by hash; it decides cost only, never results.

1. Documents with equal sets form a class; classes with equal size and prefix form a group, which a
   representative and a radius (how far members' signatures are from its own) stand for.
2. The groups' prefix shingles make an inverted index. Shingles of one group alone are dropped by a
   bitmap before entries travel; those of two give that pair of groups at once. Group pairs in the entries of one shingle are filtered by size,
   position and parity signatures of about a bit a shingle, a strict bound: two sets that differ in d
   shingles have signatures that differ in at most d bits, so members of two groups differ in at least
   the representatives' distance less both radii. Large sets are held against each other once more by
   signatures that grow with them.
3. First pass: of the group pairs left in one shingle's entries, a spanning forest of the nearest is kept,
   and each member's pair with its own representative; of these, each class's nearest pair, then
   the nearest pair between any two components, is verified against the full sets. Second pass: shingles whose
   entries lost a pair to the forest, or hold groups of several classes, and groups of over two classes, are
   expanded to classes if these are in several components, and every pair left between different components
   is verified. Links within a component need no check, so no group of copies is expanded into all its pairs,
   and no link between components is lost.

Entries of a frequent shingle are cut in blocks, one task a pair of blocks, so that no task holds an
unbounded group. Full sets travel only for pairs to be verified.

Edge cases: null and empty texts, or texts of separators only, have an empty set, are linked with
nothing and are their own component; fewer words than a shingle make one shingle of the whole
sequence; rows with equal texts are one class whatever their ids; the component's id is its smallest
doc_id (null only if all are null); an empty table gives no rows; further columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from facetmill.llm.bitmap import bitmap, hit
from facetmill.llm.names import free
from facetmill.llm.wordhash import mix, shingle_set, text_words
from facetmill.operators.graph import connected_components
from facetmill.sources.memory import tidy
from facetmill.sources.scratch import Scratch, arrow_rows

HEAVY_MOST = 65_536  # entries of the list that orders frequent shingles last; it decides cost only
HEAVY_LEAST = 8
BLOCK = 1024
BROADCAST_IDS = 400_000  # about 10 MB; beyond it the same join is shuffled
SIGNATURE_MOST = 2048  # bits
ENTRIES = 20_000  # index rows of an Arrow batch
WIDE_FROM = 1600
SHORT_RUN = 24  # entries of one shingle that are compared by shifts, many shingles at once
ROWS = 2_000  # of an Arrow batch
_U = np.uint64


def prefix_sizes(n, percent: int):
    """(own, low): the prefix that any partner of at least percent of n meets, and the shorter one that suffices against partners of n or more."""
    own = n - (percent * n + 99) // 100 + 1
    low = n - (2 * percent * n + 99 + percent) // (100 + percent) + 1
    return own, low


def _parity(s: np.ndarray, size: int) -> bytes:
    """Parity signature of size (a power of two) bits, indexed by low bits, so that halves add up to that of half the size."""
    bits = np.bincount((mix(s) & _U(size - 1)).astype(np.int64), minlength=size) & 1
    return np.packbits(bits.astype(np.uint8)).tobytes()


def _signature(s: np.ndarray) -> bytes:
    """One to two bits an element, SIGNATURE_MOST at most."""
    return _parity(s, min(SIGNATURE_MOST, 1 << max(6, int(len(s)).bit_length())))


def _wide(s: np.ndarray) -> bytes | None:
    """For large sets, the same kind of signature with 2 to 4 bits an element."""
    return _parity(s, 1 << int(2 * len(s) - 1).bit_length()) if len(s) > WIDE_FROM else None


def _wide_distance(x: bytes, y: bytes) -> int:
    a, b = np.frombuffer(x, dtype=np.uint8), np.frombuffer(y, dtype=np.uint8)
    while len(a) > len(b):
        a = a[: len(a) // 2] ^ a[len(a) // 2 :]
    while len(b) > len(a):
        b = b[: len(b) // 2] ^ b[len(b) // 2 :]
    return int(np.bitwise_count(a ^ b).sum())


def _set_id(s: np.ndarray) -> int:
    """A hash of the whole set; 64 bits, so that equal ids mean equal sets but for a chance of about 2**-64 a pair."""
    with np.errstate(over="ignore"):
        x = np.bitwise_xor.reduce(mix(s)) * _U(0x9E3779B97F4A7C15) + np.add.reduce(mix(s ^ _U(0xA5A5A5A5A5A5A5A5)), dtype=_U)
        return int(mix(np.array([x + _U(len(s))], dtype=_U)).view(np.int64)[0])


def frequent(docs: DataFrame, k: int) -> DataFrame:
    """(h, n): shingles found in HEAVY_LEAST documents or more of one batch, with their summed counts."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def flush() -> pa.RecordBatch:
            h, n = np.unique(np.concatenate(held), return_counts=True) if held else (np.empty(0, _U), np.empty(0, np.int64))
            keep = n >= HEAVY_LEAST
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(h[keep].view(np.int64)), pa.array(n[keep].astype(np.int64))], names=["h", "n"])

        size = 0
        for b in batches:
            for words in text_words(b.column(0)):
                held.append(shingle_set(words, k))
                size += len(held[-1])
                if size > 3_000_000:
                    yield flush()
                    size = 0
        if held:
            yield flush()

    found = docs.select("text").mapInArrow(tidy(count), "h long, n long")
    return found.groupBy("h").agg(F.sum("n").alias("n")).orderBy(F.col("n").desc(), "h").limit(HEAVY_MOST)


def _order(s: np.ndarray, heavy: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """The set in the global order: by hash, then the frequent ones from rarer to more frequent."""
    if not len(heavy):
        return s
    at = np.minimum(np.searchsorted(heavy, s), len(heavy) - 1)
    hot = heavy[at] == s
    return np.concatenate((s[~hot], s[hot][np.argsort(rank[at[hot]], kind="stable")]))


SETS = "doc_id long, n long, cid long, gid long, bits binary, wide binary, prefix array<long>"


def signatures(docs: DataFrame, k: int, percent: int, scratch: Scratch) -> DataFrame:
    """Per document: size and id of its set, id of its group, parity signature, prefix."""
    top = frequent(docs, k).toPandas()  # bounded by HEAVY_MOST
    h = top["h"].to_numpy(dtype=np.int64).view(_U)
    by = np.argsort(h)
    shared = docs.sparkSession.sparkContext.broadcast((h[by], -np.arange(len(h))[by]))

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heavy, rank = shared.value
        for b in batches:
            n, cid, gid, bits, wide, prefix = [], [], [], [], [], []
            for words in text_words(b.column(1)):
                s = shingle_set(words, k)
                n.append(len(s))
                if not len(s):
                    cid.append(None), gid.append(None), bits.append(None), wide.append(None), prefix.append(None)
                    continue
                p = _order(s, heavy, rank)[: prefix_sizes(len(s), percent)[0]]
                cid.append(_set_id(s))
                gid.append(int(mix(np.array([_U(_set_id(p) & (2**64 - 1)) ^ _U(len(s))], dtype=_U)).view(np.int64)[0]))
                bits.append(_signature(s))
                wide.append(_wide(s))
                prefix.append(p.view(np.int64))
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), pa.array(n, pa.int64()), pa.array(cid, pa.int64()), pa.array(gid, pa.int64()), pa.array(bits, pa.binary()), pa.array(wide, pa.binary()), pa.array(prefix, pa.list_(pa.int64()))], names=["doc_id", "n", "cid", "gid", "bits", "wide", "prefix"])

    return scratch.table(docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(tidy(sign), SETS), "sets")


KEYS = ("own", "token", "lo", "hi")
COLUMNS = (*KEYS, "block", "gid", "n", "pos", "cid", "comp", "radius", "many", "bits")


def _folded(column: pa.ChunkedArray) -> tuple[np.ndarray, dict[int, np.ndarray]]:
    """Bytes of each signature, and for each such number all that are as long or longer, folded to it."""
    raw = column.to_pylist()
    size = np.array([len(x) for x in raw], np.int64)
    out: dict[int, np.ndarray] = {}
    above = None
    for w in sorted(set(size.tolist()), reverse=True):
        m = np.zeros((len(raw), w // 8), _U)
        if above is not None:
            x = above
            while x.shape[1] > w // 8:
                x = x[:, : x.shape[1] // 2] ^ x[:, x.shape[1] // 2 :]
            m |= x
        own = np.flatnonzero(size == w)
        m[own] = np.frombuffer(b"".join([raw[i] for i in own.tolist()]), _U).reshape(len(own), -1)
        out[w] = above = m
    return size, out


def _compare(percent: int, forest: bool):
    """Pairs of classes left in each run of equal KEYS, with the bits in which their signatures differ at least.
    With forest, only a spanning forest of them, nearest first, and a row (token, own, -1) for each run that lost
    a pair or holds one of groups of several classes."""

    def fits(t: dict, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of the entry pairs (a, b) of one run pass every filter, as positions in a, and their signatures' distance."""
        na, nb, pa_, pb = t["n"][a], t["n"][b], t["pos"][a], t["pos"][b]
        need = (percent * (na + nb) + 99 + percent) // (100 + percent)
        same = t["gid"][a] == t["gid"][b]
        lowest = np.where(na <= nb, pa_ < prefix_sizes(na, percent)[1], pb < prefix_sizes(nb, percent)[1])
        fit = np.where(t["own"][a] == 1, same, ~same & lowest & (np.minimum(pa_, pb) + np.minimum(na - pa_, nb - pb) >= need))
        fit &= (100 * np.minimum(na, nb) >= percent * np.maximum(na, nb)) & (t["comp"][a] != t["comp"][b])
        fit &= (t["lo"][a] == t["hi"][a]) | (t["block"][a] != t["block"][b])
        at = np.flatnonzero(fit)
        i, j = a[at], b[at]
        width = np.minimum(t["size"][i], t["size"][j])
        differ = np.zeros(len(at), np.int64)
        for w in np.unique(width).tolist():
            k = np.flatnonzero(width == w)
            differ[k] = np.bitwise_count(t["bits"][w][i[k]] ^ t["bits"][w][j[k]]).sum(axis=1)
        differ = np.maximum(differ - t["radius"][i] - t["radius"][j], 0)
        near = differ <= (na + nb - 2 * need)[at]
        return at[near], differ[near]

    def pairs(t: dict, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        left, right, far = [], [], []
        size = np.diff(edges)
        run = np.repeat(np.arange(len(size)), size)
        short = np.repeat(size <= SHORT_RUN, size)
        for shift in range(1, SHORT_RUN):
            a = np.flatnonzero((run[:-shift] == run[shift:]) & short[:-shift]) if shift < len(run) else np.empty(0, np.int64)
            if not len(a):
                break
            at, d = fits(t, a, a + shift)
            left.append(a[at]), right.append(a[at] + shift), far.append(d)
        for r in np.flatnonzero(size > SHORT_RUN):
            x, y = edges[r], edges[r + 1]
            step = max(1, (1 << 16) // (y - x))
            for i in range(x, y, step):
                a, b = np.meshgrid(np.arange(i, min(y, i + step)), np.arange(i + 1, y), indexing="ij")
                upper = a < b
                a, b = a[upper], b[upper]
                at, d = fits(t, a, b)
                left.append(a[at]), right.append(b[at]), far.append(d)
        if not left:
            return (np.empty(0, np.int64),) * 4
        a, b, d = np.concatenate(left), np.concatenate(right), np.concatenate(far)
        open_ = np.empty(0, np.int64)
        if forest:  # an entry belongs to one run, so one forest over entries holds those of all runs
            parent: dict[int, int] = {}

            def root(x: int) -> int:
                while (up := parent.get(x, x)) != x:
                    parent[x] = parent.get(up, up)
                    x = up
                return x

            keep = []
            order = np.argsort(d, kind="stable")
            for e, i, j in zip(order.tolist(), a[order].tolist(), b[order].tolist(), strict=True):
                x, y = root(i), root(j)
                if x != y:
                    parent[x] = y
                    keep.append(e)
            lost = np.ones(len(a), bool)
            lost[keep] = False
            open_ = np.unique(run[a[lost | (t["many"][a] == 1) | (t["many"][b] == 1)]])
            a, b, d = a[keep], b[keep], d[keep]
        return t["cid"][a], t["cid"][b], d, edges[open_]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: pa.Table | None = None

        def solve(table: pa.Table) -> pa.RecordBatch:
            t = {c: table.column(c).to_numpy() for c in COLUMNS if c != "bits"}
            t["size"], t["bits"] = _folded(table.column("bits"))
            keys = np.stack([t[c] for c in KEYS])
            cut = np.flatnonzero(np.any(keys[:, 1:] != keys[:, :-1], axis=0)) + 1
            a, b, d, open_ = pairs(t, np.concatenate(([0], cut, [table.num_rows])))
            if len(a):
                lo, hi = np.minimum(a, b), np.maximum(a, b)
                _, at = np.unique(np.stack([lo, hi]), axis=1, return_index=True)
                a, b, d = lo[at], hi[at], d[at]
            a, b, d = np.concatenate((a, t["token"][open_])), np.concatenate((b, t["own"][open_])), np.concatenate((d, np.full(len(open_), -1)))
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(d)], names=["a", "b", "d"])

        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch])
            table = pa.concat_tables([rest, table]) if rest is not None else table
            same = np.ones(table.num_rows, dtype=bool)
            for c in KEYS:
                v = table.column(c).to_numpy()
                same &= v == v[-1]
            whole = int(np.argmax(same))  # sorted, so the last run is the tail
            if whole:
                yield solve(table.slice(0, whole))
            rest = table.slice(whole)
        if rest is not None:
            yield solve(rest)

    return run


def candidates(rows: DataFrame, percent: int, forest: bool) -> DataFrame:
    """(a, b, d): pairs of class ids with a < b that pass every filter, and the least distance of their signatures; with forest,
    also the rows of ``_compare`` with d = -1. rows: token, gid, n, pos, own, members, cid, comp, radius, many, bits."""
    size = F.greatest(F.lit(1), F.ceil(F.col("members") / BLOCK)).cast("int")
    rows = rows.withColumn("block", F.pmod(F.xxhash64("cid"), size).cast("int")).withColumn("_other", F.explode(F.sequence(F.lit(0), size - 1)))
    rows = rows.withColumn("lo", F.least("block", "_other")).withColumn("hi", F.greatest("block", "_other"))
    rows = rows.select(*COLUMNS).repartition(*KEYS).sortWithinPartitions(*KEYS)
    return rows.mapInArrow(tidy(_compare(percent, forest)), "a long, b long, d long").groupBy("a", "b").agg(F.min("d").alias("d"))


def _index(bits: np.ndarray | None):
    """(token, pos and the group's columns) for each prefix shingle of groups (gid, n, prefix, ...) that the bitmap holds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            prefix = b.column("prefix")
            token, edges = prefix.flatten().to_numpy(), prefix.offsets.to_numpy()
            edges = edges - edges[0]
            at = np.flatnonzero(hit(bits, token.view(_U)))
            row = np.searchsorted(edges, at, side="right") - 1
            rest = [c for c in b.schema.names if c != "prefix"]
            for i in range(0, len(at), ENTRIES):
                k, r = at[i : i + ENTRIES], row[i : i + ENTRIES]
                yield pa.RecordBatch.from_arrays([pa.array(token[k]), pa.array(k - edges[r]), *[b.column(c).take(pa.array(r)) for c in rest]], names=["token", "pos", *rest])

    return run


def index(groups: DataFrame, tokens: DataFrame, scratch: Scratch) -> DataFrame:
    """Entries of groups (gid, prefix, further columns) for tokens (token, members): token, pos, members (1 unless blocks are
    needed) and all columns but the prefix. Entries of a few other tokens may be among them."""
    fields = {f.name: f"{f.name} {f.dataType.simpleString()}" for f in groups.schema if f.name != "prefix"}
    bits = bitmap(tokens, "token", tokens.count())
    hot = scratch.table(tokens.where(F.col("members") > BLOCK).select("token", "members"), "hot")
    if bits is None:  # only numbers travel to meet the tokens
        rows = groups.select("gid", "prefix").mapInArrow(tidy(_index(None)), f"token long, pos long, {fields['gid']}")
        rows = rows.join(tokens.select("token"), "token", "left_semi").join(groups.drop("prefix"), "gid")
    else:
        rows = groups.mapInArrow(tidy(_index(bits)), ", ".join(["token long, pos long", *(fields[c] for c in groups.columns if c != "prefix")]))
    return rows.join(hot, "token", "left").withColumn("members", F.coalesce("members", F.lit(1)))


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(gid, a, b, d) of members b of a group and its representative a."""
    for t in batches:
        d = [_wide_distance(x, y) for x, y in zip(t.column("x").to_pylist(), t.column("y").to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays([t.column("gid"), t.column("a"), t.column("b"), pa.array(d, pa.int64())], names=["gid", "a", "b", "d"])


def couples_of(pairs: DataFrame, groups: DataFrame, percent: int) -> DataFrame:
    """(x, y, n, m, many, a, b, d): of pairs (x, y) of groups, those that pass the filters of size and signatures, their sizes,
    whether either has several classes, their representatives a < b and the least distance. For shingles that two groups
    alone share, so signatures travel once a pair and not once a shingle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in batches:
            n, m, far = (t.column(c).to_numpy() for c in ("n", "m", "far"))
            need = (percent * (n + m) + 99 + percent) // (100 + percent)
            d = np.array([_wide_distance(x, y) for x, y in zip(t.column("u").to_pylist(), t.column("v").to_pylist(), strict=True)], np.int64)
            d = np.maximum(d - far, 0)
            keep = pa.array((100 * np.minimum(n, m) >= percent * np.maximum(n, m)) & (d <= n + m - 2 * need))
            rest = [t.column(c) for c in ("x", "y", "n", "m", "many", "a", "b")]
            yield pa.RecordBatch.from_arrays([c.filter(keep) for c in (*rest, pa.array(d))], names=["x", "y", "n", "m", "many", "a", "b", "d"])

    x = groups.select(F.col("gid").alias("x"), "n", F.col("cid").alias("p"), F.col("bits").alias("u"), F.col("radius").alias("r"), F.col("size").alias("i"))
    y = groups.select(F.col("gid").alias("y"), F.col("n").alias("m"), F.col("cid").alias("q"), F.col("bits").alias("v"), F.col("radius").alias("s"), F.col("size").alias("j"))
    rows = pairs.join(x, "x").join(y, "y").where(100 * F.least("n", "m") >= percent * F.greatest("n", "m"))
    rows = rows.select("x", "y", "n", "m", ((F.col("i") > 1) | (F.col("j") > 1)).cast("int").alias("many"), F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b"), (F.col("r") + F.col("s")).alias("far"), "u", "v")
    return rows.mapInArrow(tidy(run), "x long, y long, n long, m long, many int, a long, b long, d long")


def near_enough(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """Drops pairs of large sets that their wide signatures exclude; d becomes the distance of those."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            t = {c: batch.column(c).to_numpy(zero_copy_only=False) for c in ("a", "b", "d", "n", "m")}
            need = (percent * (t["n"] + t["m"]) + 99 + percent) // (100 + percent)
            d = np.array([old if x is None or y is None else _wide_distance(x, y) for old, x, y in zip(t["d"], batch.column("x").to_pylist(), batch.column("y").to_pylist(), strict=True)], dtype=np.int64)
            keep = d <= t["n"] + t["m"] - 2 * need
            yield pa.RecordBatch.from_arrays([pa.array(t["a"][keep]), pa.array(t["b"][keep]), pa.array(d[keep])], names=["a", "b", "d"])

    x = classes.select(F.col("cid").alias("a"), "n", F.col("wide").alias("x"))
    y = classes.select(F.col("cid").alias("b"), F.col("n").alias("m"), F.col("wide").alias("y"))
    return pairs.join(x, "a").join(y, "b").select("a", "b", "d", "n", "m", "x", "y").mapInArrow(tidy(run), "a long, b long, d long")


def nearest(pairs: DataFrame, by: tuple[str, str] = ("a", "b")) -> DataFrame:
    """Of pairs with d, those that are nearest for one of their ends."""
    best = F.min(F.struct("d", "a", "b")).alias("p")
    ends = pairs.groupBy(by[0]).agg(best).select("p").union(pairs.groupBy(by[1]).agg(best).select("p"))
    return ends.select("p.a", "p.b").distinct()


def _verify(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            keep = np.zeros(len(a), dtype=bool)
            for i, (x, y) in enumerate(zip(batch.column(2), batch.column(3), strict=True)):
                x, y = np.frombuffer(x.as_buffer(), dtype=_U), np.frombuffer(y.as_buffer(), dtype=_U)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep[i] = 100 * both >= percent * (len(x) + len(y) - both)
            yield pa.RecordBatch.from_arrays([pa.array(a[keep]), pa.array(b[keep])], names=["a", "b"])

    return run


def verified(docs: DataFrame, pairs: DataFrame, classes: DataFrame, k: int, percent: int, scratch: Scratch) -> DataFrame:
    """The pairs that are links, by their full sets, which are made again from one text of each class."""
    pairs = scratch.table(pairs.select("a", "b"), "pairs")
    needed = pairs.select(F.col("a").alias("cid")).union(pairs.select("b")).distinct()
    ids = scratch.table(classes.join(needed, "cid", "left_semi").select(F.col("rep").alias("_rep")).distinct(), "ids")
    few = ids.count() <= BROADCAST_IDS
    texts = docs.select(F.col("doc_id").cast("long").alias("_id"), "text")
    texts = texts.join(F.broadcast(ids) if few else ids, F.col("_id").eqNullSafe(F.col("_rep")), "left_semi").select("text")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cid, full, size = [], [], 0
            for words in text_words(b.column(0)):
                s = shingle_set(words, k)
                if len(s):
                    cid.append(_set_id(s))
                    full.append(s.tobytes())
                    size += len(full[-1])
                if size > 8_000_000:
                    yield pa.RecordBatch.from_arrays([pa.array(cid, pa.int64()), pa.array(full, pa.binary())], names=["cid", "full"])
                    cid, full, size = [], [], 0
            yield pa.RecordBatch.from_arrays([pa.array(cid, pa.int64()), pa.array(full, pa.binary())], names=["cid", "full"])

    full = texts.mapInArrow(tidy(sets), "cid long, full binary").dropDuplicates(["cid"])
    x = full.select(F.col("cid").alias("a"), F.col("full").alias("x"))
    y = full.select(F.col("cid").alias("b"), F.col("full").alias("y"))
    return pairs.join(x, "a").join(y, "b").select("a", "b", "x", "y").mapInArrow(tidy(_verify(percent)), "a long, b long")


def jaccard_components(spark: SparkSession, docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id reachable by links) for each row of docs."""
    with Scratch(spark, "jaccard") as scratch, arrow_rows(spark, ROWS):
        sets = signatures(docs, k, percent, scratch)
        some = sets.where("n > 0")
        of_class = F.struct("gid", "n", "bits", "wide")
        classes = some.groupBy("cid").agg(F.min("doc_id").alias("rep"), F.first(of_class).alias("s"))
        classes = scratch.table(classes.select("cid", "rep", "s.*"), "classes")
        groups = some.groupBy("gid").agg(F.first(F.struct("n", "prefix")).alias("s"), F.min(F.struct("cid", "bits")).alias("r"))
        groups = scratch.table(groups.select("gid", "s.n", "s.prefix", F.col("r.cid").alias("cid"), F.col("r.bits").alias("bits")), "groups")
        several = scratch.table(classes.groupBy("gid").agg(F.count("*").alias("size")).where("size > 1"), "several")
        members = classes.join(several, "gid").select("gid", F.col("cid").alias("b"), F.col("bits").alias("y"))
        lead = groups.join(several, "gid").select("gid", F.col("cid").alias("a"), F.col("bits").alias("x"))
        stars = scratch.table(members.join(lead, "gid").where("a <> b").mapInArrow(tidy(_stars), "gid long, a long, b long, d long"), "stars")
        several = scratch.table(several.join(stars.groupBy("gid").agg(F.max("d").alias("radius")), "gid"), "several")
        sized = groups.join(several, "gid", "left").withColumn("size", F.coalesce("size", F.lit(1))).withColumn("radius", F.coalesce("radius", F.lit(0)))
        shared = groups.select("gid", F.explode("prefix").alias("token")).groupBy("token").agg(F.count("*").alias("members"), F.min("gid").alias("x"), F.max("gid").alias("y"))
        shared = scratch.table(shared.where("members > 1"), "shared")
        tokens = scratch.table(shared.where("members > 2").select("token", "members"), "tokens")
        couples = scratch.table(couples_of(shared.where("members = 2").select("x", "y").distinct(), sized, percent), "couples")
        entries = index(sized, tokens, scratch)
        entries = entries.withColumn("own", F.lit(0)).withColumn("comp", F.col("cid")).withColumn("many", F.when(F.col("size") > 1, 1).otherwise(0))
        found = scratch.table(candidates(entries, percent, forest=True), "found")
        open_tokens = found.where("d < 0").select(F.col("a").alias("token")).distinct()
        narrow = classes.select("gid", "cid", "bits")
        pairs = found.where("d >= 0").unionByName(stars.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "d"))
        pairs = pairs.unionByName(couples.select("a", "b", "d")).groupBy("a", "b").agg(F.min("d").alias("d"))
        first = scratch.table(near_enough(pairs, classes, percent), "forest")

        def components(links: DataFrame) -> DataFrame:
            return scratch.table(connected_components(links, scratch), "parts")

        def between(pairs: DataFrame, parts: DataFrame) -> DataFrame:
            """pairs whose ends are in different components x < y."""
            x = parts.select(F.col("node").alias("a"), F.col("component").alias("x"))
            y = parts.select(F.col("node").alias("b"), F.col("component").alias("y"))
            out = pairs.join(x, "a", "left").join(y, "b", "left").withColumn("x", F.coalesce("x", "a")).withColumn("y", F.coalesce("y", "b"))
            return out.where("x <> y").select("a", "b", "d", F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y"))

        tried = scratch.table(nearest(first), "tried")
        links = scratch.table(verified(docs, tried, classes, k, percent, scratch), "links")
        rest = scratch.table(first.join(tried, ["a", "b"], "left_anti"), "rest")
        open_pairs = between(rest, components(links))
        again = scratch.table(open_pairs.groupBy("x", "y").agg(F.min(F.struct("d", "a", "b")).alias("p")).select("p.a", "p.b"), "again")
        links = scratch.table(links.union(verified(docs, again, classes, k, percent, scratch)), "links")
        parts = components(links)
        labelled = narrow.join(parts.withColumnRenamed("node", "cid"), "cid", "left").withColumn("comp", F.coalesce("component", "cid")).drop("component")
        labelled = scratch.table(labelled, "labelled")
        columns = ("token", "gid", "n", "pos", "own")
        across = index(groups.select("gid", "n", "prefix"), scratch.table(open_tokens.withColumn("members", F.lit(1)), "open"), scratch).withColumn("own", F.lit(0)).select(*columns)
        inside = groups.join(several.where("size > 2"), "gid").select(F.col("gid").alias("token"), "gid", "n", F.lit(0).cast("long").alias("pos"), F.lit(1).alias("own"))
        both = couples.where("many = 1").select(F.xxhash64("x", "y").alias("token"), F.explode(F.array(F.struct(F.col("x").alias("gid"), F.col("n")), F.struct(F.col("y").alias("gid"), F.col("m").alias("n")))).alias("g"))
        both = both.select("token", "g.gid", "g.n", F.lit(0).cast("long").alias("pos"), F.lit(2).alias("own"))
        entries = scratch.table(across.unionByName(inside).unionByName(both), "entries")
        mixed = entries.join(labelled.groupBy("gid").agg(F.min("comp").alias("x"), F.max("comp").alias("y")), "gid").groupBy("own", "token").agg(F.min("x").alias("x"), F.max("y").alias("y")).where("x <> y").select("own", "token")
        hot = entries.join(several.select("gid", "size"), "gid", "left").groupBy("own", "token").agg(F.sum(F.coalesce("size", F.lit(1))).alias("members"))
        hot = scratch.table(hot.where(F.col("members") > BLOCK), "hot")
        rows = entries.join(mixed, ["own", "token"], "left_semi").join(hot, ["own", "token"], "left").withColumn("members", F.coalesce("members", F.lit(1)))
        rows = rows.join(labelled, "gid").withColumn("radius", F.lit(0).cast("long")).withColumn("many", F.lit(0))
        second = candidates(rows, percent, forest=False)
        second = near_enough(second.join(tried.union(again), ["a", "b"], "left_anti"), classes, percent).select("a", "b")
        second = second.union(between(rest, parts).join(again, ["a", "b"], "left_anti").select("a", "b")).distinct()
        more = scratch.table(verified(docs, second, classes, k, percent, scratch), "more")
        parts = components(links.union(more))
        whole = classes.select("cid", "rep").join(parts.withColumnRenamed("node", "cid"), "cid", "left").withColumn("comp", F.coalesce("component", "cid"))
        smallest = whole.groupBy("comp").agg(F.min("rep").alias("component_id"))
        of = whole.join(smallest, "comp").select("cid", "component_id")
        out = sets.select("doc_id", F.col("n").alias("n_shingles"), "cid").join(of, "cid", "left")
        return scratch.keep(out.select("doc_id", "n_shingles", F.when(F.col("cid").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id")))


def one_of_each(spark: SparkSession, docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """docs without near copies: of each component the row of its smallest doc_id stays.

    Rows that share an id and a text stay once. Rows of empty sets and of null ids stay as they are.
    """
    found = jaccard_components(spark, docs, k, percent)
    gone, again = free("_gone", docs), free("_again", docs)
    out = docs.join(found.where("doc_id <> component_id").select(F.col("doc_id").alias(gone)).distinct(), docs["doc_id"] == F.col(gone), "left_anti")
    twice = found.where("doc_id IS NOT NULL AND n_shingles > 0").groupBy(F.col("doc_id").alias(again)).agg(F.count("*").alias("n")).where("n > 1").select(again)
    if not twice.head(1):
        return out
    once = out.join(twice, out["doc_id"] == F.col(again), "left_semi").dropDuplicates(["doc_id", "text"])
    return out.join(twice, out["doc_id"] == F.col(again), "left_anti").unionByName(once)


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"), k=4, percent=85)


ORACLE_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
g AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN []::VARCHAR[] WHEN len(ws) < 4 THEN [array_to_string(ws, ' ')]
    ELSE list_transform(range(1, len(ws) - 2), lambda i: array_to_string(ws[i:i + 3], ' ')) END) AS s FROM w WHERE ws IS NOT NULL),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM g a JOIN g b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * shared >= 85 * (x.n + y.n - shared)),
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r AS (SELECT doc_id, doc_id AS c FROM documents UNION SELECT r.doc_id, e.b FROM r JOIN e ON e.a = r.c)
SELECT d.doc_id, coalesce(max(n.n), 0)::BIGINT AS n_shingles, min(r.c)::BIGINT AS component_id
FROM documents d LEFT JOIN n USING (doc_id) JOIN r USING (doc_id) GROUP BY d.doc_id
"""
