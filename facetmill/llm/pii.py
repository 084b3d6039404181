"""Personal data: fixed patterns, then information-theoretic sanitisation.

Four patterns give the base spans (email, ip, card, phone), leftmost and non-overlapping per kind;
matches that fail their test are dropped without another try. Each distinct value found so is a
protected entity. Over the whole corpus the method counts, by distinct texts, in how many texts an
entity e occurs, in how many a term t occurs, and in how many both do, wherever they stand.
With p from those counts, t discloses the share PMI(t; e) / IC(e) of e's information, where
PMI = log p(t, e) / (p(t) p(e)) and IC = -log p(e). A term whose share is at least DISCLOSURE, seen
with e in SUPPORT texts or more, is a span of kind ``term`` in every text that holds it: removed when the
share is 1 (it stands with nothing else), else generalised to a placeholder of its shape.

A term in over n(e) * (N / n(e)) ** (1 - DISCLOSURE) of N texts can't tell of e. The number of different
texts that hold it in one task is a lower bound of its count, so the first pass lists the terms that are
frequent in some task, and pairs that this strict bound excludes are never counted or shuffled.

Edge cases: null and empty texts have no spans; copies of one text count once, so no group of
copies makes its common words look telling; offsets are code points, ends exclusive; repeated rows get
equal results; null ids stay null; an empty table gives no rows; further columns pass through
``sanitised`` and are else not read.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from facetmill.llm.names import free
from facetmill.sources.memory import give_back, tidy
from facetmill.sources.scratch import Scratch, small_batches

KINDS = ("email", "ip", "card", "phone", "term")
DISCLOSURE = 0.8
SUPPORT = 3
FREQUENT_MOST = 65_536  # terms on the list of frequent ones; it decides cost only
FREQUENT_LEAST = 8
BROADCAST_ROWS = 200_000  # of entities, terms or telling terms, about 10 MB; beyond it they are joined

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A digit run that fails from its first digit fails from any other, so starts inside a run are skipped.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_WORD = re.compile(r"[^\W_]+")

Span = tuple[str, int, int]


def _emails(text: str) -> Iterator[Span]:
    """Every @ with the longest run of local characters before it (after the last match) and a dotted domain after it."""
    low, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > low and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            yield "email", start, m.end()
            low = m.end()
        at = text.find("@", max(at + 1, low))


def _luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def base_spans(text: str | None) -> list[Span]:
    """Spans of the four patterns, by start, then kind as listed."""
    if not text:
        return []
    out = list(_emails(text)) if "@" in text else []
    for m in _IP.finditer(text):
        if all(len(p := part.lstrip("0")) <= 3 and int(p or "0") <= 255 for part in m[0].split(".")):
            out.append(("ip", m.start(), m.end()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 12 and 12 <= len(digits := m[0].replace(" ", "").replace("-", "")) <= 19 and _luhn(digits):
            out.append(("card", m.start(), m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
                out.append(("phone", m.start(), m.end()))
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0])))


def joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def _hash(s: str) -> int:
    return xxhash.xxh64_intdigest(s.encode("utf-8", "surrogatepass")) - (1 << 63)


def _entity(text: str, span: Span) -> int:
    k, a, b = span
    value = text[a:b].lower() if k == "email" else "".join(c for c in text[a:b] if c.isdigit() or (c == "." and k == "ip"))
    return _hash(f"{k}:{value}")


def _terms(text: str, spans: list[Span]) -> set[str]:
    """Different words of a text; words that touch a span don't count."""
    taken, i, out = sorted((a, b) for _, a, b in spans), 0, set()
    for m in _WORD.finditer(text):
        while i < len(taken) and taken[i][1] <= m.start():
            i += 1
        if not any(a < m.end() and m.start() < b for a, b in taken[i : i + len(KINDS)]):
            out.add(m[0].lower())
    return out


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per text and entity; and, for terms of many different texts of the task, how many these are."""
    n: Counter = Counter()
    seen: set[int] = set()

    def out(text_id: list, entity: list) -> pa.RecordBatch:
        terms = [(t, k) for t, k in n.items() if k >= FREQUENT_LEAST] if text_id is None else []
        none = [None] * len(terms)
        return pa.RecordBatch.from_arrays([pa.array(text_id or none, pa.int64()), pa.array(entity or none, pa.int64()), pa.array([t for t, _ in terms] or [None] * len(text_id or ()), pa.string()), pa.array([k for _, k in terms] or [None] * len(text_id or ()), pa.int64())], names=["text_id", "entity", "term", "n"])

    for b in batches:
        text_id, entity = [], []
        for text in b.column(0).to_pylist():
            if not text or (key := _hash(text)) in seen:
                continue
            seen.add(key)
            spans = base_spans(text)
            found = {_entity(text, s) for s in spans}
            text_id.extend([key] * len(found)), entity.extend(found)
            n.update({w.lower() for w in _WORD.findall(text)} if not spans else _terms(text, spans))
        yield out(text_id, entity)
        if len(n) > 200_000 or len(seen) > 200_000:  # a part of the task gives a lower bound as well
            yield out(None, None)
            n.clear(), seen.clear()
    yield out(None, None)


class _Bound:
    """Which terms may tell of an entity: those not known to stand in more than ``most(n(e))`` texts."""

    def __init__(self, known: dict[int, int] | None, largest: int, frequent: dict[str, int], total: int, disclosure: float):
        self.known, self.largest, self.frequent, self.total, self.disclosure = known, largest, frequent, total, disclosure

    def most(self, n: int) -> float:
        return n * (max(self.total, 1) / n) ** (1 - self.disclosure) * (1 + 1e-9)

    def entities(self, found: set[int]) -> list[int]:
        return list(found) if self.known is None else [e for e in found if e in self.known]

    def terms(self, terms, entities: list[int]) -> list[str]:
        most = self.most(self.largest if self.known is None else max(self.known[e] for e in entities))
        return [t for t in terms if self.frequent.get(t, 0) <= most]


def _contexts(bound: _Bound):
    """(text_id, entities, terms) of each text that holds wanted entities, with the terms that may tell of one of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows: tuple[list, list, list] = ([], [], [])
            for text in b.column(0).to_pylist():
                spans = base_spans(text)
                found = bound.entities({_entity(text, s) for s in spans})
                if found and (terms := bound.terms(_terms(text, spans), found)):
                    for column, v in zip(rows, (_hash(text), found, terms), strict=True):
                        column.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(rows[0], pa.int64()), pa.array(rows[1], pa.list_(pa.int64())), pa.array(rows[2], pa.list_(pa.string()))], names=["text_id", "entities", "terms"])

    return run


def _pairs(bound: _Bound):
    """In how many rows each entity and term stand, summed within the task as far as memory goes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n: Counter = Counter()

        def out() -> pa.RecordBatch:
            b = pa.RecordBatch.from_arrays([pa.array([e for e, _ in n], pa.int64()), pa.array([t for _, t in n], pa.string()), pa.array(list(n.values()), pa.int64())], names=["entity", "term", "n"])
            n.clear()
            return b

        for b in batches:
            for entities, terms in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                for e in entities:
                    n.update((e, t) for t in (terms if bound.known is None else bound.terms(terms, [e])))
                    if len(n) > 150_000:
                        yield out()
        yield out()

    return run


def telling_terms(docs: DataFrame, scratch: Scratch, disclosure: float = DISCLOSURE, support: int = SUPPORT) -> DataFrame:
    """(entity, term, share): the pairs whose disclosed share of the entity's information reaches the threshold."""
    scan = scratch.table(docs.select("text").mapInArrow(tidy(_scan), "text_id long, entity long, term string, n long"), "scan")
    entities = scan.where("entity IS NOT NULL").select("text_id", "entity").distinct().groupBy("entity").agg(F.count("*").alias("n_entity"))
    entities = scratch.table(entities.where(F.col("n_entity") >= int(support)), "entities")  # a pair stands in no more texts than its entity
    frequent = scan.where("term IS NOT NULL").groupBy("term").agg(F.max("n").alias("n")).orderBy(F.col("n").desc(), "term").limit(FREQUENT_MOST)
    texts = docs.where(F.length("text") > 0).select("text", F.xxhash64("text").alias("_h"))
    total = texts.select("_h").distinct().count()
    size = entities.agg(F.count("*").alias("n"), F.max("n_entity").alias("largest")).first()
    known = None if size.n > BROADCAST_ROWS else {r.entity: r.n_entity for r in entities.toLocalIterator()}
    bound = _Bound(known, size.largest or 1, {r.term: r.n for r in frequent.toLocalIterator()}, total, disclosure)
    contexts = docs.select("text").mapInArrow(tidy(_contexts(bound)), "text_id long, entities array<long>, terms array<string>").dropDuplicates(["text_id"])
    both = contexts.select("entities", "terms").mapInArrow(tidy(_pairs(bound)), "entity long, term string, n long").groupBy("entity", "term").agg(F.sum("n").alias("n"))
    both = scratch.table(both.where(F.col("n") >= int(support)), "pairs")
    wanted = scratch.table(both.select("term").distinct(), "terms")
    count = wanted.count()
    if not count:
        return both.select("entity", "term", F.lit(1.0).alias("share")).limit(0)
    words = None if count > BROADCAST_ROWS else {r.term for r in wanted.toLocalIterator()}
    # One row a text with its wanted terms, one of each text, then counts that are summed before the shuffle.
    found = texts.select("text", "_h").mapInArrow(tidy(_holders(words)), "h long, terms array<string>").dropDuplicates(["h"])
    seen = found.select("terms").mapInArrow(tidy(_counts), "term string, n long").groupBy("term").agg(F.sum("n").alias("n_term"))
    out = both.join(seen, "term").join(entities, "entity")
    pmi = F.log(F.col("n") * float(total) / (F.col("n_term") * F.col("n_entity")))
    information = F.log(float(total) / F.col("n_entity"))
    share = F.when(information > 0, pmi / information)
    return out.select("entity", "term", share.alias("share")).where(F.col("share") >= disclosure - 1e-12)


def _holders(words: set[str] | None):
    """(h, terms): the wanted terms of each text that has any; without words, all of its terms."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            h, terms = [], []
            for text, key in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                found = {w.lower() for w in _WORD.findall(text)}
                found = found if words is None else found & words
                if found:
                    h.append(key)
                    terms.append(list(found))
            yield pa.RecordBatch.from_arrays([pa.array(h, pa.int64()), pa.array(terms, pa.list_(pa.string()))], names=["h", "terms"])

    return run


def _words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(text_id, term): the different words of each text."""
    for b in batches:
        for text in b.column(0).to_pylist():
            if text:
                found = list({w.lower() for w in _WORD.findall(text)})
                yield pa.RecordBatch.from_arrays([pa.array([_hash(text)] * len(found), pa.int64()), pa.array(found, pa.string())], names=["text_id", "term"])


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many rows hold each term, summed within the task as far as memory goes."""
    n: Counter = Counter()
    for b in batches:
        for x in b.column(0).flatten().value_counts().to_pylist():
            n[x["values"]] += x["counts"]
        if len(n) > 150_000:
            yield pa.RecordBatch.from_arrays([pa.array(list(n), pa.string()), pa.array(list(n.values()), pa.int64())], names=["term", "n"])
            n.clear()
    yield pa.RecordBatch.from_arrays([pa.array(list(n), pa.string()), pa.array(list(n.values()), pa.int64())], names=["term", "n"])


def all_spans(text: str | None, words: dict[str, float]) -> tuple[list[Span], list[Span], dict[Span, float]]:
    """Base spans, all spans, and the share of each term span; words are the telling terms."""
    base = base_spans(text)
    if not words or not text:
        return base, base, {}
    extra: dict[Span, float] = {}
    taken = sorted((a, b) for _, a, b in base)
    i = 0
    for m in _WORD.finditer(text):
        while i < len(taken) and taken[i][1] <= m.start():
            i += 1
        if not (i < len(taken) and taken[i][0] < m.end()) and (share := words.get(m[0].lower())) is not None:
            extra["term", m.start(), m.end()] = share
    return base, sorted([*base, *extra], key=lambda s: (s[1], KINDS.index(s[0]))), extra


def redact(text: str | None, spans: list[Span], shares: dict[Span, float]) -> str | None:
    """The text with base spans named, full disclosures removed and partial ones generalised; overlaps go as one."""
    if not spans:
        return text
    out, at = [], 0
    for s in spans:
        k, a, b = s
        if b <= at:
            continue
        if a >= at:
            out.append(text[at:a])
            out.append(f"[{k.upper()}]" if k != "term" else "" if shares[s] >= 1 - 1e-12 else "[NUMBER]" if text[a:b].isdigit() else "[TERM]")
        at = b
    out.append(text[at:])
    return "".join(out)


FOUND = "n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, clean string"


def _finder(telling: dict[str, float] | None, clean: bool):
    def one(text: str | None, words: dict[str, float]) -> tuple:
        base, spans, shares = all_spans(text, words)
        n = Counter(k for k, _, _ in base)
        return n["email"], n["ip"], n["card"], n["phone"], hashlib.sha256(joined(base).encode()).hexdigest(), joined(spans), redact(text, spans, shares) if clean else None

    columns = [c.split()[0] for c in FOUND.split(", ")]
    if telling is not None:

        def run(text: pd.Series) -> pd.DataFrame:
            out = pd.DataFrame([one(t, telling) for t in text], columns=columns)
            give_back()
            return out
    else:

        def run(text: pd.Series, found: pd.Series) -> pd.DataFrame:
            return pd.DataFrame([one(t, {x["term"]: x["share"] for x in f} if f is not None else {}) for t, f in zip(text, found, strict=True)], columns=columns)

    return F.pandas_udf(run, FOUND)


def with_spans(spark: SparkSession, docs: DataFrame, clean: bool = False, to: str = "_pii") -> DataFrame:
    """docs with a struct column ``to`` (none of its own): counts, digest and spans, and with clean the sanitised text."""
    small_batches(spark)
    with Scratch(spark, "pii") as scratch:
        telling = scratch.table(telling_terms(docs, scratch).groupBy("term").agg(F.max("share").alias("share")), "telling")
        if telling.count() <= BROADCAST_ROWS:
            return docs.withColumn(to, _finder({r.term: r.share for r in telling.toLocalIterator()}, clean)(F.col("text")))
        telling = scratch.keep(telling)
    pairs = docs.select("text").mapInArrow(tidy(_words), "text_id long, term string").distinct()
    of = pairs.join(telling, "term").groupBy("text_id").agg(F.collect_list(F.struct("term", "share")).alias("found"))

    def keys(text: pd.Series) -> pd.Series:
        return pd.Series([_hash(t) if t else None for t in text], dtype="Int64")  # a float column would round the hashes

    rows = docs.select(F.struct("*").alias("row")).withColumn("own", F.pandas_udf(keys, "long")(F.col("row.text")))
    rows = rows.join(of, F.col("own") == F.col("text_id"), "left").withColumn("pii", _finder(None, clean)(F.col("row.text"), F.col("found")))
    return rows.select("row.*", F.col("pii").alias(to))


def sanitised(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """docs with every span redacted in ``text`` and ``n_chars`` (if there) brought up to date; other columns, whatever their names, stay."""
    to = free("_pii", docs)
    out = with_spans(spark, docs, clean=True, to=to)
    text = F.col(f"{to}.clean")
    new = {"text": text}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(text.isNull(), F.col("n_chars")).otherwise(F.length(text).cast("long"))
    return out.select(*[new[c].alias(c) if c in new else F.col(f"`{c}`") for c in docs.columns])


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return with_spans(spark, docs).select("doc_id", *[f"_pii.{c}" for c in ("n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans")])
