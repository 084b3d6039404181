"""SentencePiece encoding and decoding: unigram Viterbi over a double-array trie.

The model file gives pieces with scores; the segmentation of a text is the sequence of pieces with
the greatest sum of scores, found left to right over the matches of a double-array trie of the pieces'
UTF-8 bytes. A character that no piece covers costs the least score less UNKNOWN_PENALTY and is
written as its byte pieces. Spaces (U+0020, no other white space) become the marker U+2581, with one marker put in front.
Decoding joins pieces and bytes, turns markers to spaces and drops the one in front.

Decoding what was encoded gives the text back exactly: a literal U+2581 is written as bytes, so it
doesn't become a space. In the models used, the marker only begins a piece, so a text may be cut before
each run of spaces and the parts encoded on their own; equal parts of a batch are encoded once. For a
model with markers elsewhere the text is encoded whole.

Edge cases: a null text has null ids, an empty one none; very long texts and words are linear in time
and memory; repeated rows are encoded alike; an empty table gives no rows; other columns stay as they are, but for those with the names of the new ones.
"""

from __future__ import annotations

import math
import re
import struct
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from facetmill.llm.names import free
from facetmill.sources.memory import give_back
from facetmill.sources.scratch import small_batches

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARKER = "▁"
UNKNOWN_PENALTY = 10.0
LONGEST = 200  # letters of a word that is encoded with others
BATCH_BYTES = 6_000_000  # of text that is encoded together, so that equal words are once
BLOCK_BYTES = 200_000  # of different words that are searched together
BPE = 2
ZIPF = 10.0
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
_PART = re.compile(r" *[^ ]+| +")


def _fields(data: bytes) -> Iterator[tuple[int, bytes | int]]:
    """(number, value) of each field of a protocol buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            b = data[at]
            at += 1
            value |= (b & 127) << shift
            if b < 128:
                return value
            shift += 7

    while at < len(data):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, varint()
            continue
        size = {1: 8, 5: 4}.get(kind)
        size = varint() if size is None else size
        yield tag >> 3, data[at : at + size]
        at += size


def read_model(path: str) -> list[tuple[str, float, int]]:
    """(piece, log score, type) of each piece of a model file.

    A unigram model's scores are taken as they are. A BPE model's are ranks of merges, less than 0;
    by Zipf's law the piece of rank r gets the log of a probability in proportion to 1 / (r + ZIPF).
    """
    with open(path, "rb") as f:
        data = f.read()
    out, kind = [], 1
    for number, value in _fields(data):
        if number == 1:
            got = dict(_fields(value))
            out.append((got.get(1, b"").decode("utf-8"), struct.unpack("<f", got[2])[0] if 2 in got else 0.0, int(got.get(3, NORMAL))))
        elif number == 2:
            kind = dict(_fields(value)).get(3, kind)
    if kind == BPE:
        total = sum(1 / (ZIPF - s) for _, s, t in out if t == NORMAL)
        out = [(p, -math.log((ZIPF - s) * total) if t == NORMAL else s, t) for p, s, t in out]
    return out


@dataclass
class DoubleArray:
    """Child of node s by byte c: t = base[s] + c + 1, if check[t] == s. value[t] is the key's id or -1."""

    base: list[int]
    check: list[int]
    value: list[int]

    @classmethod
    def build(cls, keys: dict[bytes, int]) -> DoubleArray:
        base, check, value = [0] * 1024, [-1] * 1024, [-1] * 1024
        check[0] = 0
        ordered = sorted(keys)
        free = cursor = 257  # lowest free cell; where cells for several children are looked for

        def grow(to: int) -> None:
            if to >= len(check):
                more = max(to + 1 - len(check), len(check))
                base.extend([0] * more), check.extend([-1] * more), value.extend([-1] * more)

        todo = [(0, 0, len(ordered), 0)]  # node, its keys, depth
        while todo:
            node, lo, hi, depth = todo.pop()
            if lo < hi and len(ordered[lo]) == depth:
                value[node] = keys[ordered[lo]]
                lo += 1
            if lo == hi:
                continue
            starts = [lo] + [i for i in range(lo + 1, hi) if ordered[i][depth] != ordered[i - 1][depth]]
            codes = [ordered[i][depth] + 1 for i in starts]
            if len(codes) == 1:
                while free < len(check) and check[free] >= 0:
                    free += 1
                grow(free)
                b = free - codes[0]
            else:
                b, tries = cursor - codes[0], 0
                grow(b + 257)
                while any(check[b + c] >= 0 for c in codes):
                    b, tries = b + 1, tries + 1
                    grow(b + 257)
                if tries > 16:
                    cursor = b + codes[0]
            base[node] = b
            for c, i, j in zip(codes, starts, [*starts[1:], hi], strict=True):
                check[b + c] = node
                todo.append((b + c, i, j, depth + 1))
        return cls(base, check, value)


@dataclass
class Tokenizer:
    pieces: list[tuple[str, float, int]]
    trie: DoubleArray = field(init=False)

    def __post_init__(self) -> None:
        scores = [s for _, s, t in self.pieces if t == NORMAL]
        low, high = min(scores), max(scores)
        usable = {p.encode("utf-8"): i for i, (p, _, t) in enumerate(self.pieces) if t in (NORMAL, USER) and p}
        self.trie = DoubleArray.build(usable)
        self.score = [len(p.encode("utf-8")) * high - 0.1 if t == USER else s for p, s, t in self.pieces]
        self.unknown = low - UNKNOWN_PENALTY
        self.byte_id = [-1] * 256
        self.out: list[bytes] = []
        for i, (p, _, t) in enumerate(self.pieces):
            if t == BYTE:
                self.byte_id[int(p[3:5], 16)] = i
            self.out.append(bytes([int(p[3:5], 16)]) if t == BYTE else b"" if t in (CONTROL, UNKNOWN) else p.replace(MARKER, " ").encode("utf-8"))
        if min(self.byte_id) < 0:
            raise ValueError("the model has no full set of byte pieces")
        node = np.array([self.trie.base, self.trie.check, self.trie.value], dtype=np.int32)
        self._base, self._check, self._value = np.pad(node, ((0, 0), (0, 512)), constant_values=-1)
        self._score = np.array(self.score)
        self._bytes = np.array(self.byte_id)
        self._width = np.array([len(b) for b in self.out])
        self._pool = np.frombuffer(b"".join(self.out), dtype=np.uint8)
        self._at = np.concatenate(([0], np.cumsum(self._width)))
        self.parts = all(MARKER not in p.lstrip(MARKER) for p, _, t in self.pieces if t in (NORMAL, USER))

    def __getstate__(self) -> dict:
        return {"pieces": self.pieces}

    def __setstate__(self, state: dict) -> None:
        self.pieces = state["pieces"]
        self.__post_init__()

    def viterbi(self, data: bytes) -> list[int]:
        """Best ids for data, the UTF-8 of a text whose spaces are markers. On ties the path of earlier starts, so of longer last pieces, stays."""
        n = len(data)
        best = [-np.inf] * (n + 1)
        start, piece = [0] * (n + 1), [-1] * (n + 1)
        best[0] = 0.0
        base, check, value, score = self.trie.base, self.trie.check, self.trie.value, self.score
        top, i = len(check), 0
        while i < n:
            c = data[i]
            width = 1 if c < 0x80 else 2 if c < 0xE0 else 3 if c < 0xF0 else 4
            here, node, single = best[i], 0, False
            for j in range(i, n):
                t = base[node] + data[j] + 1
                if t >= top or check[t] != node:
                    break
                node = t
                v = value[t]
                if v >= 0:
                    if j + 1 == i + width:
                        single = True
                    s = here + score[v]
                    if s > best[j + 1]:
                        best[j + 1], start[j + 1], piece[j + 1] = s, i, v
            if not single and here + self.unknown > best[i + width]:
                best[i + width], start[i + width], piece[i + width] = here + self.unknown, i, -1
            i += width
        out, at = [], n
        while at > 0:
            a = start[at]
            if piece[at] >= 0:
                out.append(piece[at])
            else:
                out.extend(self.byte_id[b] for b in reversed(data[a:at]))
            at = a
        out.reverse()
        return out

    def _part(self, part: str) -> list[int]:
        """Ids of a part; spaces are markers, literal markers are bytes."""
        if MARKER not in part:
            return self.viterbi(part.replace(" ", MARKER).encode("utf-8"))
        out: list[int] = []
        for i, x in enumerate(part.split(MARKER)):
            if i:
                out.extend(self.byte_id[b] for b in MARKER.encode("utf-8"))
            if x:
                out.extend(self.viterbi(x.replace(" ", MARKER).encode("utf-8")))
        return out

    def encode(self, text: str) -> list[int]:
        if not text:
            return []
        if not self.parts:
            return self._part(" " + text)
        return [i for part in _PART.findall(" " + text) for i in self._part(part)]

    def decode(self, ids: list[int]) -> str:
        text = b"".join(map(self.out.__getitem__, ids)).decode("utf-8", errors="replace")
        return text[1:] if text[:1] == " " else text


    def viterbi_all(self, data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, how many of each unit) of many units: data is their bytes in a row, ends where each ends. Done in blocks of about BLOCK_BYTES."""
        if not len(ends):
            return np.empty(0, np.int32), np.empty(0, np.int64)
        cut = np.flatnonzero(np.diff(ends // BLOCK_BYTES)) + 1
        out = []
        for a, b in zip(np.concatenate(([0], cut)), np.append(cut, len(ends)), strict=True):
            lo = int(ends[a - 1]) if a else 0
            out.append(self._viterbi_block(data[lo : int(ends[b - 1])], ends[a:b] - lo))
        return np.concatenate([x for x, _ in out]), np.concatenate([x for _, x in out])

    def _viterbi_block(self, data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of one block's units.

        The same search as ``viterbi``: the trie is walked from all characters together, then the matches are
        taken by their start's place within its unit and their length, so that no two of a step end alike.
        """
        n, units = len(data), len(ends)
        first = np.concatenate(([0], ends[:-1]))
        unit = np.repeat(np.arange(units), ends - first)
        starts = np.flatnonzero((data & 0xC0) != 0x80)
        lead = data[starts]
        width = np.where(lead < 0x80, 1, np.where(lead < 0xE0, 2, np.where(lead < 0xF0, 3, 4)))
        single = np.zeros(n, bool)
        at, node, found = starts, np.zeros(len(starts), np.int64), []
        wide = width
        for depth in range(n):
            inside = at + depth < ends[unit[at]]
            at, node, wide = at[inside], node[inside], wide[inside]
            if not len(at):
                break
            to = self._base[node] + data[at + depth] + 1
            ok = self._check[to] == node
            at, node, wide = at[ok], to[ok], wide[ok]
            hit = self._value[node] >= 0
            found.append((at[hit], np.full(int(hit.sum()), depth + 1), self._value[node[hit]]))
            single[at[hit & (wide == depth + 1)]] = True
        lost = ~single[starts]
        found.append((starts[lost], width[lost], np.full(int(lost.sum()), -1)))
        start, length, piece = (np.concatenate(x) for x in zip(*found, strict=True))
        score = np.where(piece >= 0, self._score[piece], self.unknown)
        step = (start - first[unit[start]]) * (int(length.max()) + 1) + length
        order = np.argsort(step.astype(np.uint16) if step.max() < 1 << 16 else step, kind="stable")
        start, length, piece, score, step = start[order], length[order], piece[order], score[order], step[order]
        cut = np.flatnonzero(np.diff(step)) + 1
        best = np.full(n + units, -np.inf)
        back = np.zeros(n + units, np.int64)
        by = np.full(n + units, -1, np.int64)
        best[first + np.arange(units)] = 0.0
        for x, y in zip(np.concatenate(([0], cut)), np.append(cut, len(step)), strict=True):
            a = start[x:y] + unit[start[x:y]]
            b = a + length[x:y]
            s = best[a] + score[x:y]
            up = s > best[b]
            b = b[up]
            best[b], back[b], by[b] = s[up], length[x:y][up], piece[x:y][up]
        here = ends + np.arange(units)
        floor = first + np.arange(units)
        live = np.flatnonzero(here > floor)
        steps = []
        while len(live):
            e = here[live]
            steps.append((e - back[e] - live, by[e], back[e], live))
            here[live] = e - back[e]
            live = live[here[live] > floor[live]]
        if not steps:
            return np.empty(0, np.int32), np.zeros(units, np.int64)
        spot, piece, size, of = (np.concatenate(x) for x in zip(*steps, strict=True))
        order = np.argsort(spot.astype(np.int32))
        spot, piece, size, of = spot[order], piece[order], size[order], of[order]
        times = np.where(piece >= 0, 1, size)
        ids = np.repeat(piece, times)
        inner = np.arange(len(ids)) - np.repeat(np.cumsum(times) - times, times)
        fall = ids < 0
        ids[fall] = self._bytes[data[(np.repeat(spot, times) + inner)[fall]]]
        return ids.astype(np.int32), np.bincount(of, weights=times, minlength=units).astype(np.int64)

    def encode_all(self, texts: pa.Array) -> pa.ListArray:
        """Ids of each text. Different words are encoded once a batch; texts with runs of spaces, markers or very long words one by one."""
        texts = texts.cast(pa.large_string())
        usual = pc.fill_null(pc.and_(pc.invert(pc.match_substring_regex(texts, f"  |^ |{MARKER}|[^ ]{{{LONGEST}}}")), pc.greater(pc.binary_length(texts), 0)), False) if self.parts else pa.array([False] * len(texts))
        usual_at = np.flatnonzero(np.asarray(usual))
        lengths = np.zeros(len(texts), np.int64)
        words = pc.split_pattern(texts.filter(usual), " ")
        coded = words.flatten().dictionary_encode()
        index, distinct = np.asarray(coded.indices), coded.dictionary
        marked = pc.binary_join_element_wise(pa.scalar(MARKER, pa.large_string()), distinct, pa.scalar("", pa.large_string())).cast(pa.large_binary())
        raw = np.frombuffer(b"".join(marked.to_pylist()), dtype=np.uint8)
        ids, sizes = self.viterbi_all(raw, np.cumsum(np.asarray(pc.binary_length(marked)).astype(np.int64)))
        begin = np.cumsum(sizes) - sizes
        each = sizes[index]
        total = np.cumsum(each)
        flat = ids[np.repeat(begin[index] - (total - each), each) + np.arange(int(total[-1]) if len(total) else 0)]
        ends = np.asarray(words.offsets)[1:]
        before = np.concatenate(([0], total))
        upto = before[ends]
        lengths[usual_at] = np.diff(np.concatenate(([0], upto)))
        other = {int(i): np.array(self.encode(t), dtype=np.int32) for i in np.flatnonzero(~np.asarray(usual)) if (t := texts[int(i)].as_py())}
        for i, x in other.items():
            lengths[i] = len(x)
        offsets = np.concatenate(([0], np.cumsum(lengths)))
        if other:
            out = np.empty(int(offsets[-1]), np.int32)
            own = np.repeat(np.isin(np.arange(len(texts)), usual_at), lengths)
            out[own] = flat
            for i, x in other.items():
                out[offsets[i] : offsets[i + 1]] = x
            flat = out
        missing = np.append(np.asarray(texts.is_null()), False) if texts.null_count else None
        return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32), mask=missing), pa.array(flat, pa.int32()))

    def decode_all(self, ids: pa.ListArray) -> pa.Array:
        """Text of each list of ids."""
        flat, offsets = np.asarray(ids.flatten()), np.concatenate(([0], np.cumsum(np.asarray(pc.fill_null(pc.list_value_length(ids), 0)).astype(np.int64))))
        width = self._width[flat]
        total = np.concatenate(([0], np.cumsum(width)))
        data = self._pool[np.repeat(self._at[flat] - total[:-1], width) + np.arange(total[-1])]
        cut = total[offsets]
        filled = np.flatnonzero(np.diff(cut) > 0)
        spaced = filled[data[cut[filled]] == 0x20]
        keep = np.ones(len(data), bool)
        keep[cut[spaced]] = False
        size = np.diff(cut)
        size[spaced] -= 1
        ends = np.concatenate(([0], np.cumsum(size)))
        buffers = [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(data[keep])]
        out = pa.Array.from_buffers(pa.large_string(), len(ids), buffers)
        try:
            out.validate(full=True)
        except pa.ArrowInvalid:
            out = pa.array([self.decode(x.as_py() or []) for x in ids], pa.large_string())
        return pc.if_else(ids.is_null(), pa.scalar(None, pa.large_string()), out) if ids.null_count else out


def tokenizer(path: str = MODEL) -> Tokenizer:
    return Tokenizer(read_model(path))


def _in_pieces(column: pa.Array, weight: np.ndarray, most: int, f) -> pa.Array:
    """f over runs of rows of about most weight, joined."""
    if not len(column):
        return f(column)
    give_back()
    group = np.cumsum(weight) // most
    cut = np.flatnonzero(np.diff(group)) + 1
    parts = [f(column.slice(a, b - a)) for a, b in zip(np.concatenate(([0], cut)), np.append(cut, len(column)), strict=True)]
    return pa.concat_arrays(parts)


def encoded(docs: DataFrame, path: str = MODEL, column: str = "text", to: str = "ids") -> DataFrame:
    """docs with the ids of a text column. The model file is read by the driver alone."""
    shared = docs.sparkSession.sparkContext.broadcast(tokenizer(path))

    def run(texts: pa.Array) -> pa.Array:
        return _in_pieces(texts, np.asarray(pc.fill_null(pc.binary_length(texts), 0)).astype(np.int64), BATCH_BYTES, shared.value.encode_all)

    return docs.withColumn(to, F.arrow_udf(run, "array<int>")(F.col(column)))


def decoded(docs: DataFrame, path: str = MODEL, column: str = "ids", to: str = "text") -> DataFrame:
    """docs with the text of an ids column; ids that the model lacks are an error."""
    shared = docs.sparkSession.sparkContext.broadcast(tokenizer(path))

    def run(ids: pa.Array) -> pa.Array:
        return _in_pieces(ids, np.asarray(pc.fill_null(pc.list_value_length(ids), 0)).astype(np.int64), BATCH_BYTES // 2, shared.value.decode_all).cast(pa.string())

    return docs.withColumn(to, F.arrow_udf(run, "string")(F.col(column)))


def with_tokens(docs: DataFrame, path: str = MODEL) -> DataFrame:
    """docs with ids, n_tokens and exact (whether decoding gives the text back; null for null), in place of columns of these names."""
    small_batches(docs.sparkSession, "6m")
    again = free("_again", docs)
    out = decoded(encoded(docs, path), path, to=again)
    return out.withColumn("n_tokens", F.size("ids").cast("long")).withColumn("exact", F.col(again) == F.col("text")).drop(again)


def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return with_tokens(docs).select("doc_id", "n_tokens", "exact", "ids")
