"""Models behind small interfaces, with deterministic stand-ins that need no files."""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from facetmill.sources.scratch import Scratch, hadoop_path


class TextGenerator(Protocol):
    """Made once a worker; several prompts a call."""

    name: str

    def generate(self, prompts: list[str]) -> list[str]: ...


class Embedder(Protocol):
    name: str
    size: int

    def encode(self, texts: list[str]) -> np.ndarray: ...


class FrequentWords:
    """Answers any prompt with the most frequent longer words of its data, in the tags it asks for."""

    name = "frequent-words-1"
    _word = re.compile(r"[^\W\d_]{4,}")

    def generate(self, prompts: list[str]) -> list[str]:
        out = []
        for p in prompts:
            data = re.findall(r"(?s)<data>(.*?)</data>", p)
            n = Counter(w.lower() for w in self._word.findall(data[-1] if data else p))
            words = [w for w, _ in sorted(n.items(), key=lambda x: (-x[1], x[0]))[:6]] or ["nothing"]
            if "<choices>" in p:
                choices = [c for c in re.findall(r"(?s)<choices>(.*?)</choices>", p)[-1].split("\n") if c.strip()]
                score = [sum(n[w.lower()] for w in self._word.findall(c)) for c in choices]
                out.append(f"<answer>{choices[int(np.argmax(score))]}</answer>" if choices else "<answer></answer>")
            elif "<summary>" in p:
                out.append(f"<summary>Texts about {', '.join(words)}.</summary> <name>{' '.join(words[:3])}.</name>")
            elif "numbered list" in p:
                k = int(m[1]) if (m := re.search(r"exactly (\d+)", p)) else 2
                out.append("<answer>\n" + "\n".join(f"{i + 1}. {' '.join(words[i : i + 2])}" for i in range(min(k, len(words)))) + "\n</answer>")
            else:
                out.append(f"{' '.join(words)}</answer>")
        return out


class HashedWords:
    """Unit vectors of hashed word counts."""

    def __init__(self, size: int = 64):
        self.size, self.name = size, f"hashed-words-{size}"

    def encode(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.size))
        for i, t in enumerate(texts):
            for w in re.findall(r"[^\W_]+", (t or "").lower()):
                h = int(hashlib.md5(w.encode()).hexdigest()[:8], 16)
                out[i, h % self.size] += 1 if h & (1 << 20) else -1
        return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)


def _ask(asked: DataFrame, model: TextGenerator, batch: int) -> DataFrame:
    """prompt_key, output, error of (prompt_key, _p). Of a batch that fails, prompts are asked one by one; those that fail have an error."""

    def answers(prompts: list[str]) -> list[tuple[str | None, str | None]]:
        try:
            return [(x, None) for x in model.generate(prompts)]
        except Exception as e:  # noqa: BLE001  a model may raise anything
            if len(prompts) == 1:
                return [(None, f"{type(e).__name__}: {e}")]
            return [x for p in prompts for x in answers([p])]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for i in range(0, len(b), batch):
                part = b.iloc[i : i + batch]
                got = answers(part["_p"].tolist())
                yield pd.DataFrame({"prompt_key": part["prompt_key"], "output": [x for x, _ in got], "error": [e for _, e in got]})

    return asked.mapInPandas(run, "prompt_key string, output string, error string")


def _keyed(prompts: DataFrame, prompt: str) -> tuple[DataFrame, DataFrame]:
    keyed = prompts.withColumn("prompt_key", F.sha2(F.col(prompt), 256))
    return keyed, keyed.select("prompt_key", F.col(prompt).alias("_p")).dropDuplicates(["prompt_key"])


def generated(prompts: DataFrame, model: TextGenerator, prompt: str = "prompt", batch: int = 1000, cache: DataFrame | None = None) -> DataFrame:
    """prompts with ``output``, null where the model failed. Each different prompt is asked once; those in cache (prompt_key, model, output) not at all."""
    keyed, asked = _keyed(prompts, prompt)
    known = cache.where(F.col("model") == model.name).select("prompt_key", "output") if cache is not None else None
    asked = asked.join(known, "prompt_key", "left_anti") if known is not None else asked
    answers = _ask(asked, model, batch).select("prompt_key", "output")
    answers = answers.unionByName(known) if known is not None else answers
    return keyed.join(answers, "prompt_key", "left").drop("prompt_key")


class Responses:
    """Answers kept between runs in a folder: a table of (prompt_key, model, output), and one of the prompts that failed."""

    ANSWERS = "prompt_key string, model string, output string"
    FAILED = "prompt_key string, model string, prompt string, error string"

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _read(self, name: str, schema: str) -> DataFrame:
        p, fs = hadoop_path(self.spark, f"{self.folder}/{name}")
        return self.spark.read.schema(schema).parquet(f"{self.folder}/{name}") if fs.exists(p) else self.spark.createDataFrame([], schema)

    def known(self) -> DataFrame:
        return self._read("answers", self.ANSWERS).dropDuplicates(["prompt_key", "model"])

    def failed(self) -> DataFrame:
        return self._read("failed", self.FAILED)

    def add(self, answers: DataFrame, model: str) -> None:
        """Of (prompt_key, _p, output, error): answers to the one table, failures to the other."""
        named = answers.withColumn("model", F.lit(model))
        named.where("error IS NULL").select("prompt_key", "model", "output").write.mode("append").parquet(f"{self.folder}/answers")
        failed = named.where("error IS NOT NULL").select("prompt_key", "model", F.col("_p").alias("prompt"), "error")
        if failed.head(1):
            failed.write.mode("append").parquet(f"{self.folder}/failed")


def answered(prompts: DataFrame, model: TextGenerator, scratch: Scratch, responses: Responses | None = None, prompt: str = "prompt", batch: int = 1000) -> DataFrame:
    """The same, as a written table: answers are kept in responses and not asked for again, failed prompts are put aside there."""
    keyed, asked = _keyed(prompts, prompt)
    known = None
    if responses is not None:
        known = responses.known().where(F.col("model") == model.name).select("prompt_key", "output")
        asked = asked.join(known, "prompt_key", "left_anti")
    new = scratch.table(asked.join(_ask(asked, model, batch), "prompt_key") if responses is not None else _ask(asked, model, batch), "answers")
    answers = new.select("prompt_key", "output")
    if responses is not None:
        answers = scratch.table(answers.unionByName(known), "known")  # read before it is added to
        responses.add(new, model.name)
    return scratch.table(keyed.join(answers, "prompt_key", "left").drop("prompt_key"), "answered")


def embedded(rows: DataFrame, model: Embedder, text: str, to: str = "vec") -> DataFrame:
    """rows with the vector of a text column; each different text is encoded once."""
    distinct = rows.select(F.col(text).alias("_t")).distinct()

    def run(t: pd.Series) -> pd.Series:
        return pd.Series(list(np.asarray(model.encode(t.tolist()), dtype=np.float32)))

    vectors = distinct.withColumn(to, F.pandas_udf(run, "array<float>")("_t"))
    return rows.join(vectors, rows[text].eqNullSafe(vectors["_t"]), "left").drop("_t")
