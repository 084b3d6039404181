"""The pipeline against the same stages in plain Python, over all documents of the smallest table."""

import hashlib
import math
import re
from collections import Counter, defaultdict

import corpus_pipeline
from facetmill.llm import pii, sentencepiece, toxicity

UPPER = re.compile("[A-Z]")
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def near_copies(docs):
    """The smallest id of each component of documents that share four fifths of their shingles of five words."""
    sets = []
    for d in docs:
        w = WORD.findall(UPPER.sub(lambda m: m[0].lower(), d["text"]))
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set()))
    part = list(range(len(docs)))

    def root(i):
        while part[i] != i:
            i = part[i]
        return i

    for i in range(len(docs)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                a, b = sorted((root(i), root(j)), key=lambda k: docs[k]["doc_id"])
                part[b] = a
    return [d for i, d in enumerate(docs) if root(i) == i or not sets[i]]


PATTERNS = (("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"))


def valid(kind, s):
    digits = re.sub("[^0-9]", "", s)
    if kind == "ip":
        return all(int(x) <= 255 for x in s.split("."))
    if kind == "card":
        return 12 <= len(digits) <= 19 and sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(digits))) % 10 == 0
    return kind == "email" or 9 <= len(digits) <= 15


def base(text):
    return sorted((m.start(), k, m.end()) for k, (kind, p) in enumerate(PATTERNS) for m in re.finditer(p, text) if valid(kind, m[0]))


def words_outside(text, spans):
    return [(m[0].lower(), m.start(), m.end()) for m in re.finditer(r"[^\W_]+", text) if not any(a < m.end() and m.start() < b for a, _, b in spans)]


def value(text, span):
    a, k, b = span
    kind = PATTERNS[k][0]
    return kind, text[a:b].lower() if kind == "email" else "".join(c for c in text[a:b] if c.isdigit() or c == "." and kind == "ip")


def telling(texts):
    texts = {t for t in texts if t}
    n_entity, n_term, both = Counter(), Counter(), Counter()
    for t in texts:
        spans = base(t)
        entities, terms = {value(t, s) for s in spans}, {w for w, _, _ in words_outside(t, spans)}
        n_entity.update(entities)
        n_term.update({m.lower() for m in re.findall(r"[^\W_]+", t)})
        both.update((e, w) for e in entities for w in terms)
    out = defaultdict(float)
    for (e, w), n in both.items():
        information = math.log(len(texts) / n_entity[e])
        if n >= pii.SUPPORT and information > 0 and (share := math.log(n * len(texts) / (n_term[w] * n_entity[e])) / information) >= pii.DISCLOSURE - 1e-12:
            out[w] = max(out[w], share)
    return out


def redacted(text, shares):
    spans = base(text)
    said = [(a, k, b, f"[{PATTERNS[k][0].upper()}]") for a, k, b in spans]
    for w, a, b in words_outside(text, spans):
        if w in shares:
            said.append((a, len(PATTERNS), b, "" if shares[w] >= 1 - 1e-12 else "[NUMBER]" if text[a:b].isdigit() else "[TERM]"))
    out, at = "", 0
    for a, _, b, name in sorted(said):
        if b > at:
            out, at = out + (text[at:a] + name if a >= at else ""), b
    return out + text[at:]


def mixed(docs):
    for d in docs:
        d["size"] = len(WORD.findall(d["text"]))
        u = (int(hashlib.md5(f"{d['doc_id']}mix-27".encode()).hexdigest()[:13], 16) + 0.5) / 2**52
        mean = len(d["text"]) / max(d["size"], 1)
        d["key"] = -math.log(u) / max(1 / (1 + abs(mean - 6) / 6) * (d["size"] / (d["size"] + 50)), 1e-6)
    size = Counter()
    for d in docs:
        size[d["source"]] += d["size"]
    weight = {s: i % 3 + 1 for i, s in enumerate(sorted(size))}
    target, free, left = {}, set(size), float(sum(size.values()))
    while free:
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s for s in free if share[s] > 3 * size[s]}
        target |= share if not over else {s: 3.0 * size[s] for s in over}
        left -= sum(target[s] for s in over)
        free = free - over if over else set()
    copies = Counter()
    for s in size:
        epochs = min(3, int(target[s] // size[s])) if size[s] else 0
        rest, upto = target[s] - epochs * size[s], 0
        for d in sorted((d for d in docs if d["source"] == s), key=lambda d: (d["key"], d["doc_id"])):
            start, upto = upto, upto + d["size"]
            copies[d["doc_id"]] += epochs + (upto <= rest or (start < rest and upto - rest < rest - start))
    return copies


def test_pipeline_equals_plain_python(spark, sf):
    table = spark.read.parquet(f"{sf}/documents.parquet")
    docs = [r.asDict() for r in table.collect()]
    model = toxicity.learn(spark, table, spark.read.parquet(f"{sf}/labels.parquet"))
    docs = [d for d in docs if model.score(toxicity.terms(d["text"])) < 0.7]
    docs = near_copies(docs)
    shares = telling(d["text"] for d in docs)
    for d in docs:
        d["text"] = redacted(d["text"], shares)
    copies = mixed(docs)
    tokens = sentencepiece.tokenizer()
    want = Counter()
    for d in docs:
        want[d["doc_id"], d["source"], tuple(tokens.encode(d["text"]))] += copies[d["doc_id"]]
    got = corpus_pipeline.run(spark, sf).collect()
    assert all(r.exact and r.n_tokens == len(r.ids) for r in got)
    assert Counter((r.doc_id, r.source, tuple(r.ids)) for r in got) == +want
