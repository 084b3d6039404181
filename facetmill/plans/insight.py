"""The pipeline from records to a named, multi-level map.

Stages: dedup, facet values (one generated answer a record and facet), embeddings of distinct values, base
clusters by spherical k-means, names from members and near outsiders, levels of broader names
until few are left, two dimensions for each record. Each stage is a table, so a lost executor or a stopped
run starts from the last. Models are passed in; the defaults are deterministic and need no files.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import asdict, dataclass, field, replace

from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from facetmill.functions import text as T
from facetmill.functions import vectors as V
from facetmill.operators import prompts, records, similarity
from facetmill.operators.providers import Embedder, FrequentWords, HashedWords, Responses, TextGenerator, answered, embedded
from facetmill.sources.scratch import Scratch
from facetmill.sources.stages import Stages


@dataclass(frozen=True)
class Facet:
    name: str
    question: str
    prefill: str = ""
    summary_criteria: str | None = None
    numeric: tuple[int, int] | None = None
    of_record: bool = False  # asks for a summary of the record instead of the question


@dataclass
class Config:
    seed: int = 27
    dedup: bool = True
    max_tokens: int = 8000
    per_cluster: int = 10
    outside: int = 10
    name_samples: int = 5
    shown_members: int = 50
    least_top: int = 5
    outside_neighborhood: int = 5
    max_levels: int = 12
    name_tau: float = 0.1
    name_tries: int = 4  # prompts for broader names, in different orders, before the clusters' own names are taken
    token_count: Callable[[Column], Column] | None = None  # of a rendered turn; words by default
    dedup_key: Callable[[DataFrame], Column] | None = None  # of (record_id, text); the text by default
    projector: Callable[[DataFrame], DataFrame] | None = None  # (record_id, vec) -> record_id, x, y; principal components by default
    responses: Responses | None = None  # answers kept between runs
    generator: TextGenerator = field(default_factory=FrequentWords)
    embedder: Embedder = field(default_factory=HashedWords)

    def with_options(self, **options) -> Config:
        """A copy with other values; unknown names are an error."""
        return replace(self, **options)

    def settings(self) -> dict:
        """What results depend on, for fingerprints of stages."""
        plain = {k: v for k, v in self.__dict__.items() if isinstance(v, (int, float, str, bool))}
        named = {k: getattr(v, "__qualname__", None) for k, v in self.__dict__.items() if callable(v)}
        return plain | named | {"generator": self.generator.name, "embedder": self.embedder.name}

    def clusters(self, n: int) -> int:
        return max(1, n // self.per_cluster)


MAIN_FACETS = [
    Facet("Request", "What does the user ask for?", "The user asked", "Name the kind of request."),
    Facet("Language", "In which language is it?", ""),
    Facet("Task", "What is the assistant to do?", "The task is to", "Name the kind of task."),
    Facet("Concerning", "How concerning is it from 1 to 5?", "", None, (1, 5)),
]
SUMMARY = Facet("Summary", "", "", "Name what the records are about.", of_record=True)


def facet_table(spark: SparkSession, facets: list[Facet]) -> DataFrame:
    rows = [(i, f.name, f.question, f.prefill, f.summary_criteria, f.numeric, f.of_record) for i, f in enumerate(facets)]
    return spark.createDataFrame(rows, "facet_id int, name string, question string, prefill string, summary_criteria string, numeric struct<lo:int,hi:int>, of_record boolean")


def clusterable(values: DataFrame, facets: DataFrame) -> DataFrame:
    """Values (facet_id, ...) of the facets that have criteria for naming clusters, with the facet's name."""
    return values.join(F.broadcast(facets.where("summary_criteria IS NOT NULL").select("facet_id", "name")), "facet_id")  # from the driver's list


def unique_children(kids: DataFrame) -> DataFrame:
    """parent_id, n (different names and summaries of its children, whatever their case), name and summary of the first."""
    return kids.groupBy("parent_id").agg(F.countDistinct(F.lower("name"), F.lower("summary")).alias("n"), F.min_by("name", "cluster_id").alias("name"), F.min_by("summary", "cluster_id").alias("summary"))


def text_records(rows: DataFrame) -> DataFrame:
    """(record_id, text) as records."""
    return rows.select("record_id", "text")


def conversation_records(turns: DataFrame, config: Config) -> DataFrame:
    """record_id, text of (conv_id, turn, role, text): conversations rendered within config.max_tokens."""
    line = F.concat(F.col("role"), F.lit(":\n"), F.col("text"))
    return records.truncated(turns, config.max_tokens, config.token_count(line) if config.token_count else None)


def facet_values(recs: DataFrame, facets: DataFrame, config: Config, scratch: Scratch) -> DataFrame:
    """record_id, facet_id, value."""
    p = recs.crossJoin(F.broadcast(facets.select("facet_id", "question", "prefill", "of_record")))  # one row a facet, from the driver's list
    prompt = F.when(F.col("of_record"), prompts.record(F.col("text"))).otherwise(prompts.facet(F.col("text"), F.col("question"), F.col("prefill")))
    out = answered(p.select("record_id", "facet_id", prompt.alias("prompt")), config.generator, scratch, config.responses)
    output = F.coalesce("output", F.lit(""))  # of a prompt that failed
    value = F.coalesce(F.nullif(T.summary_name(F.concat(F.lit("<summary>"), output))["summary"], F.lit(T.NO_SUMMARY)), T.facet_value(output))
    return out.select("record_id", "facet_id", F.regexp_replace(value, r"(?s)^<summary>", "").alias("value"))


def _picked(rows: DataFrame, by: list[str], text: str, most: int, config: Config, to: str) -> DataFrame:
    """At most so many texts of each group, by seeded hash, sorted."""
    w = Window.partitionBy(*by).orderBy(F.md5(F.concat(F.lit(f"{config.seed}:"), F.col(text))), text)
    few = rows.select(*by, text).distinct().withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= most)
    return few.groupBy(*by).agg(F.array_sort(F.collect_list(text)).alias(to))


def _best_names(outputs: DataFrame, by: str, embedder: Embedder) -> DataFrame:
    """by, summary, name: of several generated pairs the medoid summary and the medoid name."""
    parsed = T.summary_name(F.coalesce("output", F.lit("")))
    o = outputs.select(by, "sample", parsed["summary"].alias("summary"), parsed["name"].alias("name"))
    best = None
    for c in ("summary", "name"):
        m = similarity.medoids(embedded(o, embedder, c), by, "sample", "vec").select(by, F.col("medoid").alias("sample"))
        m = o.join(m, [by, "sample"]).select(by, c)
        best = m if best is None else best.join(m, by)
    return best


def base_clusters(values: DataFrame, config: Config, criteria: str, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """(clusters: cluster_id, name, summary; members: cluster_id, record_id) of one facet's (record_id, value)."""
    v = scratch.table(embedded(values, config.embedder, "value"), "vectors")
    n = v.count()
    at, centres, _ = similarity.clustered(v, min(n, config.clusters(n)), "record_id", "vec", scratch, seed=config.seed)
    whole = scratch.table(v.join(at, "record_id").withColumnRenamed("cluster", "cluster_id"), "members")
    outside = _nearest_outside(whole, centres, config.outside, scratch)
    shown = _picked(whole, ["cluster_id"], "value", config.shown_members, config, "members")
    near = outside.join(whole.select("record_id", "value"), "record_id").groupBy("cluster_id").agg(F.array_sort(F.collect_set("value")).alias("outsiders"))
    rows = shown.join(near, "cluster_id", "left").withColumn("sample", F.explode(F.sequence(F.lit(0), F.lit(config.name_samples - 1))))
    mixed = F.array_sort(F.transform("members", lambda m: F.struct(F.md5(F.concat_ws(":", F.lit(str(config.seed)), F.col("sample").cast("string"), m)).alias("k"), m.alias("m"))))
    prompt = prompts.cluster_name(F.transform(mixed, lambda x: x["m"]), F.coalesce("outsiders", F.array().cast("array<string>")), F.lit(criteria))
    named = answered(rows.select("cluster_id", "sample", prompt.alias("prompt")), config.generator, scratch, config.responses)
    return scratch.table(_best_names(named, "cluster_id", config.embedder), "clusters"), whole.select("cluster_id", "record_id")


def _nearest_outside(rows: DataFrame, centres: DataFrame, k: int, scratch: Scratch) -> DataFrame:
    """cluster_id, record_id: the k rows nearest to each centre that are not its own."""
    near = similarity.cell_outsiders(rows.withColumnRenamed("cluster_id", "cluster"), centres, "record_id", "vec", k)
    return scratch.table(near.select(F.col("cluster").alias("cluster_id"), "record_id"), "outside")


def _names_in(output: Column) -> Column:
    names = F.transform(T.numbered_list(F.coalesce(output, F.lit("")), keep_open=True), T.strip_punctuation)
    return F.filter(names, lambda x: x != "")


def proposed(lists: DataFrame, config: Config, scratch: Scratch) -> DataFrame:
    """hood, sources, names: broader names for each of (hood, sources, clusters: names and summaries).

    A hood whose answer can't be parsed is asked again with its clusters in another order, config.name_tries times at
    most; then its clusters' own names are taken.
    """
    wanted = F.greatest(F.lit(1), F.floor(F.size("clusters") / 3)).cast("int")
    done, left = [], scratch.table(lists, "lists")
    for attempt in range(config.name_tries):
        order = F.array_sort(F.transform("clusters", lambda c, a=attempt: F.struct(F.md5(F.concat(F.lit(f"{config.seed}:{a}:"), c)).alias("k"), c.alias("c"))))
        asked = answered(left.select("hood", "sources", prompts.higher_names(F.transform(order, lambda x: x["c"]), wanted).alias("prompt")), config.generator, scratch, config.responses)
        got = scratch.table(asked.select("hood", "sources", _names_in(F.col("output")).alias("names")).where(F.size("names") > 0), "names")
        done.append(got)
        left = scratch.table(left.join(got.select("hood"), "hood", "left_anti"), "left")
        if not left.head(1):
            break
    else:
        own = F.transform("clusters", lambda c: T.strip_punctuation(F.substring_index(c, "\n", 1)))
        done.append(left.select("hood", "sources", F.slice(own, F.lit(1), wanted).alias("names")))
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out


def deduplicated(merged: DataFrame, config: Config, scratch: Scratch) -> DataFrame:
    """name, sources: names that mean the same made one, hood by hood of similar names.

    The model is asked for half of a hood's names (both of two); each name it gives has all sources of its hood. Where its
    answer can't be parsed, names within config.name_tau of each other are made one. A name alone stays.
    """
    v = scratch.table(embedded(merged.withColumn("id", F.xxhash64("name")), config.embedder, "name"), "merged")
    n = v.count()
    at, _, _ = similarity.clustered(v, max(1, min(n, config.clusters(n))), "id", "vec", scratch, seed=config.seed)
    placed = scratch.table(v.join(at.select("id", F.col("cluster").alias("hood")), "id"), "placed")
    hoods = placed.groupBy("hood").agg(F.array_sort(F.collect_set("name")).alias("names"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("sources")))).alias("sources"))
    size = F.size("names")
    target = F.when(size == 2, 2).otherwise(F.greatest(F.lit(1), F.floor(size / 2))).cast("int")
    asked = answered(hoods.where(size > 1).select("hood", "sources", prompts.dedup_names(F.col("names"), target).alias("prompt")), config.generator, scratch, config.responses)
    got = scratch.table(asked.select("hood", "sources", _names_in(F.col("output")).alias("names")), "deduplicated")
    alone = hoods.where(size == 1).select(F.col("names")[0].alias("name"), "sources")
    out = alone.unionByName(got.select(F.explode("names").alias("name"), "sources"))
    unparsed = got.where(size == 0).select("hood")
    if unparsed.head(1):
        rest = scratch.table(placed.join(unparsed, "hood", "left_semi"), "unparsed")
        one = similarity.embedding_dedup(rest, "id", "vec", config.name_tau, scratch, sources="sources")
        out = out.unionByName(one.join(rest.select(F.col("id").alias("representative"), "name"), "representative").select("name", "sources"))
    return scratch.table(records.merge_sources(out), "final")


def next_level(level: DataFrame, config: Config, first_id: int, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """(parents: cluster_id, name, summary; links: cluster_id, parent_id) above clusters (cluster_id, name, summary)."""
    both = level.withColumn("value", T.name_summary(F.col("name"), F.col("summary"))).withColumn("record_id", F.col("cluster_id").cast("long"))
    v = scratch.table(embedded(both, config.embedder, "value"), "names")
    n = v.count()
    at, centres, _ = similarity.clustered(v, min(n, config.clusters(n)), "record_id", "vec", scratch, seed=config.seed)
    core = v.drop("cluster_id").join(at.withColumnRenamed("cluster", "hood"), "record_id")
    near = _nearest_outside(core.select("record_id", F.col("hood").alias("cluster_id"), "vec", "cells"), centres, config.outside_neighborhood, scratch)
    hood = scratch.table(core.select("hood", "record_id", "value").unionByName(near.select(F.col("cluster_id").alias("hood"), "record_id").join(v.select("record_id", "value"), "record_id")), "hoods")
    lists = hood.groupBy("hood").agg(F.array_sort(F.collect_list("value")).alias("clusters"), F.array_sort(F.collect_list("record_id")).alias("sources"))
    names = proposed(lists, config, scratch).select("sources", F.explode("names").alias("name"))
    final = deduplicated(scratch.table(records.merge_sources(names), "proposed"), config, scratch)
    # candidates of each cluster; the choice that is nearest to the generated answer becomes its parent
    cand = final.select(T.name_key(F.col("name")).alias("key"), "name", F.explode("sources").alias("record_id"))
    choices = cand.groupBy("record_id").agg(F.array_sort(F.collect_set("name")).alias("choices"))
    asked = answered(v.join(choices, "record_id").select("record_id", "choices", prompts.assign(F.col("choices"), F.col("value")).alias("prompt")), config.generator, scratch, config.responses)
    said = asked.select("record_id", "choices", T.tag_value(F.coalesce("output", F.lit("")), "answer")["value"].alias("answer"))
    a = embedded(said.select("record_id", "answer"), config.embedder, "answer", "va").select("record_id", "va")
    b = embedded(said.select("record_id", F.explode("choices").alias("choice")), config.embedder, "choice", "vb")
    pick = a.join(b, "record_id").select("record_id", "choice", F.round(V.dot(F.col("va"), F.col("vb")), 9).alias("s"))
    pick = pick.groupBy("record_id").agg(F.min(F.struct((-F.col("s")).alias("s"), "choice")).alias("p")).select("record_id", F.col("p.choice").alias("choice"))
    links = scratch.table(pick.select(F.col("record_id").cast("int").alias("cluster_id"), T.name_key(F.col("choice")).alias("key")), "links")
    keys = links.select("key").distinct().withColumn("parent_id", (F.row_number().over(Window.orderBy("key")) + (first_id - 1)).cast("int"))  # a few names a level
    links = scratch.table(links.join(keys, "key").select("cluster_id", "parent_id"), "parents")
    kids = level.join(links, "cluster_id")
    unique = unique_children(kids)
    several = kids.join(unique.where("n > 1").select("parent_id"), "parent_id", "left_semi").withColumn("value", T.name_summary(F.col("name"), F.col("summary")))
    shown = _picked(several, ["parent_id"], "value", 10, config, "children")
    rows = shown.select("parent_id", F.explode(F.sequence(F.lit(0), F.lit(config.name_samples - 1))).alias("sample"), prompts.rename(F.col("children")).alias("prompt"))
    renamed = _best_names(answered(rows, config.generator, scratch, config.responses), "parent_id", config.embedder)
    parents = unique.where("n = 1").select("parent_id", "name", "summary").unionByName(renamed.select("parent_id", "name", "summary"))
    return scratch.table(parents.withColumnRenamed("parent_id", "cluster_id"), "level"), links


def hierarchy(base: DataFrame, config: Config, scratch: Scratch) -> DataFrame:
    """cluster_id, level (0 at the leaves), parent_id, name, summary. Ends when few are left or a level doesn't shrink."""
    level, depth, rows = base, 0, []
    n = level.count()
    first_id = n
    while n > config.least_top and depth < config.max_levels:
        parents, links = next_level(level, config, first_id, scratch)
        m = parents.count()
        if not 0 < m < n:
            break
        rows.append(level.join(links, "cluster_id", "left").withColumn("level", F.lit(depth)))
        level, depth, n, first_id = parents, depth + 1, m, first_id + m
    rows.append(level.withColumn("parent_id", F.lit(None).cast("int")).withColumn("level", F.lit(depth)))
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return scratch.table(out.select("cluster_id", "level", "parent_id", "name", "summary"), "hierarchy")


def project(vectors: DataFrame) -> DataFrame:
    """record_id, x, y by principal components."""
    v = vectors.select("record_id", array_to_vector(F.col("vec")).alias("features"))
    p = vector_to_array(F.col("p"))
    return PCA(k=2, inputCol="features", outputCol="p").fit(v).transform(v).select("record_id", F.round(p[0], 6).alias("x"), F.round(p[1], 6).alias("y"))


def run(spark: SparkSession, recs: DataFrame, facets: list[Facet], config: Config | None = None, stages: Stages | None = None) -> dict[str, DataFrame]:
    """Tables records, values, clusters (with n, the records below), members and points of records (record_id, text).

    With stages, tables of a former run are used as long as the records, the facets and the settings before them are the same.
    """
    from facetmill.operators.tree import rolled_up

    config = config or Config()
    scratch = Scratch(spark, "insight")
    settings = config.settings()

    def stage(name: str, make: Callable[[], DataFrame], after: tuple[str, ...], **more) -> tuple[DataFrame, str]:
        return stages.get(name, settings | more, make, after) if stages else (scratch.table(make(), name), name)

    read = (stages.content(recs),) if stages else ()
    key = config.dedup_key(recs) if config.dedup_key else F.sha2("text", 256)
    recs, first = stage("records", lambda: records.dedup(recs, key, "record_id") if config.dedup else recs, read)
    table = facet_table(spark, facets)
    values, second = stage("values", lambda: facet_values(recs, table, config, scratch), (first,), facets=[asdict(f) for f in facets])
    clusters = members = points = None
    for i, f in enumerate(facets):
        if f.summary_criteria is None:
            continue
        mine = values.where(F.col("facet_id") == i).select("record_id", "value")
        if not mine.head(1):
            continue

        def tree(mine=mine, f=f) -> DataFrame:
            base, inside = base_clusters(mine, config, f.summary_criteria, scratch)
            t = hierarchy(base, config, scratch)
            n = rolled_up(t.select(F.col("cluster_id").alias("node"), F.col("parent_id").alias("parent")), inside.groupBy(F.col("cluster_id").alias("node")).agg(F.count("*").alias("n")), scratch)
            t = t.join(n.withColumnRenamed("node", "cluster_id"), "cluster_id")
            # one stage for both, so that they always come from one run
            return t.withColumn("record_id", F.lit(None).cast("long")).unionByName(inside.select("cluster_id", "record_id"), allowMissingColumns=True)

        both, third = stage(f"clusters-{i}", tree, (second,), facet=i)
        t, inside = both.where("record_id IS NULL").drop("record_id"), both.where("record_id IS NOT NULL").select("cluster_id", "record_id")
        projector = config.projector or project
        xy, _ = stage(f"points-{i}", lambda mine=mine: projector(embedded(mine, config.embedder, "value")), (second,), facet=i)
        t, inside, xy = (x.withColumn("facet_id", F.lit(i)) for x in (t, inside, xy))
        clusters, members, points = (b if a is None else a.unionByName(b) for a, b in ((clusters, t), (members, inside), (points, xy)))
    return {"records": recs, "values": values, "clusters": clusters, "members": members, "points": points}
