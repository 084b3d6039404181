"""Registered queries of the engine's own operators, with their SQL."""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from facetmill.functions import text as T
from facetmill.functions import vectors as V
from facetmill.operators import explore, prompts, records, similarity, tree
from facetmill.operators.hull import hulls
from facetmill.plans import insight
from facetmill.sources import publish
from facetmill.sources.scratch import Scratch

TAU = 0.58
SQL: dict[str, str] = {}
QUERIES: dict = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- text -----------------------------------------------------------------------------------------

@query("conversation_render", """
SELECT conv_id AS record_id, string_agg(role || ':' || chr(10) || text, chr(10) ORDER BY turn) AS rendered FROM conversations GROUP BY conv_id""")
def conversation_render(spark, d):
    return records.conversations(_t(spark, d, "conversations")).select("record_id", T.render_turns(F.col("turns")).alias("rendered"))


@query("conversation_truncate", r"""
WITH l AS (SELECT conv_id, turn, role, role || ':' || chr(10) || text AS line, length(role || ':' || chr(10) || text)::BIGINT AS n FROM conversations),
u AS (SELECT *, sum(n) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS upto FROM l),
g AS (SELECT conv_id, sum(n) AS total, max(turn) FILTER (role = 'assistant' AND upto <= 2000) AS last, min(turn) FILTER (role = 'assistant') AS first,
  string_agg(line, chr(10) ORDER BY turn) AS whole FROM u GROUP BY conv_id)
SELECT g.conv_id AS record_id, CASE WHEN length(whole) < 3000 OR total < 2000 THEN 'all' WHEN last IS NOT NULL THEN 'prefix' WHEN first IS NOT NULL THEN 'cut' ELSE 'none' END AS kind,
  CASE WHEN length(whole) < 3000 OR total < 2000 THEN whole WHEN last IS NOT NULL THEN (SELECT string_agg(line, chr(10) ORDER BY turn) FROM u WHERE u.conv_id = g.conv_id AND u.turn <= g.last) WHEN first IS NULL THEN ''
  ELSE (SELECT array_to_string(list_filter(regexp_split_to_array(string_agg(line, chr(10) ORDER BY turn), '\s+'), lambda x: x <> '')[1:2000], ' ') FROM u WHERE u.conv_id = g.conv_id AND u.turn <= g.first) END AS text
FROM g""")
def conversation_truncate(spark, d):
    turns = _t(spark, d, "conversations")
    line = F.concat(F.col("role"), F.lit(":\n"), F.col("text"))
    kept = records.truncated(turns, 2000, F.length(line))
    facts = turns.select("conv_id", "role", "turn", line.alias("line")).withColumn("n", F.length("line"))
    order = Window.partitionBy("conv_id").orderBy("turn")
    facts = facts.withColumn("upto", F.sum("n").over(order)).groupBy("conv_id").agg(
        (F.sum("n") + F.count("*") - 1).alias("chars"), F.sum("n").alias("total"),
        F.max((F.col("role") == "assistant") & (F.col("upto") <= 2000)).alias("fits"), F.max(F.col("role") == "assistant").alias("any"))
    kind = F.when((F.col("chars") < 3000) | (F.col("total") < 2000), "all").when(F.col("fits"), "prefix").when(F.col("any"), "cut").otherwise("none")
    out = kept.join(facts, kept.record_id == facts.conv_id).withColumn("kind", kind)
    return out.select("record_id", "kind", "text")


@query("conversation_json", "SELECT conv_id AS record_id, to_json(list({'role': role, 'content': text} ORDER BY turn))::VARCHAR AS json FROM conversations GROUP BY conv_id")
def conversation_json(spark, d):
    return records.conversations(_t(spark, d, "conversations")).select("record_id", T.turns_json(F.col("turns")).alias("json"))


@query("strip_punctuation", r"""
WITH a AS (SELECT doc_id, regexp_replace(text || CASE doc_id % 4 WHEN 0 THEN '!.' WHEN 1 THEN '.!' WHEN 2 THEN ' ? ' ELSE '.' END, '^\s+|\s+$', '', 'g') AS s FROM documents),
b AS (SELECT doc_id, regexp_replace(regexp_replace(s, '\.$', ''), '^\s+|\s+$', '', 'g') AS s FROM a),
c AS (SELECT doc_id, regexp_replace(regexp_replace(s, '\?$', ''), '^\s+|\s+$', '', 'g') AS s FROM b)
SELECT doc_id, regexp_replace(regexp_replace(s, '!$', ''), '^\s+|\s+$', '', 'g') AS stripped FROM c""")
def strip_punctuation(spark, d):
    k = F.col("doc_id") % 4
    end = F.when(k == 0, "!.").when(k == 1, ".!").when(k == 2, " ? ").otherwise(".")
    return _t(spark, d, "documents").select("doc_id", T.strip_punctuation(F.concat("text", end)).alias("stripped"))


@query("strip_list_number", r"""
SELECT doc_id, regexp_replace(regexp_replace(doc_id || CASE WHEN doc_id % 3 = 0 THEN ' ' ELSE '. ' END || text, '^[0-9]*\.', ''), '^\s+|\s+$', '', 'g') AS item FROM documents""")
def strip_list_number(spark, d):
    gap = F.when(F.col("doc_id") % 3 == 0, " ").otherwise(". ")
    return _t(spark, d, "documents").select("doc_id", T.strip_number(F.concat(F.col("doc_id").cast("string"), gap, F.col("text"))).alias("item"))


@query("clean_trailing_tags", r"""
SELECT doc_id, regexp_replace(split_part(regexp_replace(text, '^\s+|\s+$', '', 'g') || '</name> more', '</', 1), '^\s+|\s+$', '', 'g') AS cleaned FROM documents""")
def clean_trailing_tags(spark, d):
    return _t(spark, d, "documents").select("doc_id", T.clean_trailing_tags(F.concat(T.strip(F.col("text")), F.lit("</name> more"))).alias("cleaned"))


@query("extract_tag", r"""
SELECT doc_id, doc_id % 3 <> 1 AND doc_id % 3 <> 2 AS found, regexp_replace(text, '^[\s\x0B]+|[\s\x0B]+$', '', 'g') AS value FROM documents""")
def extract_tag(spark, d):
    k = F.col("doc_id") % 3
    wrapped = F.concat(F.when(k == 1, "").otherwise("<Answer> "), F.col("text"), F.when(k == 2, "").otherwise(" </ANSWER> tail"))
    t = T.tag_value(wrapped, "answer")
    return _t(spark, d, "documents").select("doc_id", t["found"].alias("found"), t["value"].alias("value"))


@query("numbered_list_explode", r"""
WITH w AS (SELECT doc_id, unnest([substr(text, 1, length(text) // 2), 'x' || substr(text, length(text) // 2 + 1)]) AS s, unnest([1, 2])::BIGINT AS pos FROM documents WHERE text IS NOT NULL)
SELECT doc_id, pos, regexp_replace(replace(s, chr(10), ' '), '^[\s\x0B]+|[\s\x0B]+$', '', 'g') AS item FROM w""")
def numbered_list_explode(spark, d):
    half = F.floor(F.length("text") / 2).cast("int")
    line = lambda a, b: F.replace(F.substring(F.col("text"), a, b), F.lit("\n"), F.lit(" "))
    text = F.concat(F.lit("<answer>\n1. "), line(F.lit(1), half), F.lit("\n\n2. x"), line(half + 1, F.length("text")), F.lit("\n</answer>"))
    return _t(spark, d, "documents").select("doc_id", F.posexplode(T.numbered_list(text)).alias("p", "item")).select("doc_id", (F.col("p") + 1).cast("long").alias("pos"), "item")


@query("summary_name_pairs", r"""
SELECT doc_id, 'Sum of ' || doc_id AS summary, CASE WHEN doc_id % 5 = 0 THEN '<Could not extract name>' ELSE 'Name ' || lang END AS name FROM documents""")
def summary_name_pairs(spark, d):
    text = F.concat(F.lit("x <summary> Sum of "), F.col("doc_id").cast("string"), F.lit(". </summary>\n<name>"), F.when(F.col("doc_id") % 5 == 0, " . ").otherwise(F.concat(F.lit(" Name "), F.col("lang"), F.lit("!"))), F.lit("</name>"))
    s = T.summary_name(text)
    return _t(spark, d, "documents").select("doc_id", s["summary"].alias("summary"), s["name"].alias("name"))


@query("facet_value_parse", r"""SELECT doc_id, regexp_replace(text, '^[\s\x0B]+|[\s\x0B]+$', '', 'g') AS value FROM documents""")
def facet_value_parse(spark, d):
    text = F.concat("text", F.when(F.col("doc_id") % 2 == 0, "</answer> and more").otherwise("</summary>"))
    return _t(spark, d, "documents").select("doc_id", T.facet_value(text).alias("value"))


@query("duration_words", r"""
WITH s AS (SELECT o_orderkey, (o_orderkey * 7919) % 200000 AS s FROM orders),
p AS (SELECT o_orderkey, s // 86400 AS d, (s // 3600) % 24 AS h, (s // 60) % 60 AS m, s % 60 AS q FROM s)
SELECT o_orderkey, CASE WHEN d = 0 THEN '' WHEN d = 1 THEN '1 day  ' ELSE d || ' days  ' END || CASE WHEN h = 0 THEN '' WHEN h = 1 THEN '1 hour ' ELSE h || ' hours ' END ||
 CASE WHEN m = 0 THEN '' WHEN m = 1 THEN '1 minute ' ELSE m || ' minutes ' END || CASE WHEN q = 0 THEN '' WHEN q = 1 THEN '1 second ' ELSE q || ' seconds ' END AS words FROM p""")
def duration_words(spark, d):
    return _t(spark, d, "orders").select("o_orderkey", T.duration((F.col("o_orderkey") * 7919) % 200000).alias("words"))


def _template_sql(template: str, **values: str) -> str:
    """The template as SQL, with an expression for each {name}."""
    parts = re.split(r"(\{\w+\})", template)
    return " || ".join(values[x[1:-1]] if x.startswith("{") else "'" + x.replace("'", "''") + "'" for x in parts if x)


_QUESTIONS = "(VALUES (0, 'What is asked?', 'It asks'), (1, 'Which language?', '')) f(facet_id, q, p)"


@query("facet_prompts", f"SELECT c.conv_id AS record_id, f.facet_id, {_template_sql(prompts.FACET, conversation='c.r', question='f.q', prefill='f.p')} AS prompt FROM (SELECT conv_id, string_agg(role || ':' || chr(10) || text, chr(10) ORDER BY turn) AS r FROM conversations GROUP BY conv_id) c CROSS JOIN {_QUESTIONS}")
def facet_prompts(spark, d):
    facets = spark.createDataFrame([(0, "What is asked?", "It asks"), (1, "Which language?", "")], "facet_id int, question string, prefill string")
    rows = records.conversations(_t(spark, d, "conversations")).select("record_id", T.render_turns(F.col("turns")).alias("r")).crossJoin(F.broadcast(facets))  # a list of two
    return rows.select("record_id", "facet_id", prompts.facet(F.col("r"), F.col("question"), F.col("prefill")).alias("prompt"))


@query("record_prompts", f"SELECT doc_id AS record_id, {_template_sql(prompts.RECORD, record='coalesce(text, chr(0)[1:0])')} AS prompt FROM documents")
def record_prompts(spark, d):
    return _t(spark, d, "documents").select(F.col("doc_id").alias("record_id"), prompts.record(F.col("text")).alias("prompt"))


@query("cluster_prompts", f"""WITH m AS (SELECT lang, string_agg(DISTINCT source, chr(10) ORDER BY source) AS own FROM documents GROUP BY lang),
o AS (SELECT m.lang, string_agg(DISTINCT d.lang, chr(10) ORDER BY d.lang) AS others FROM m JOIN documents d ON d.lang <> m.lang GROUP BY m.lang)
SELECT lang, {_template_sql(prompts.CLUSTER, members='own', outsiders='others', criteria="'Name it.'")} AS cluster_prompt,
{_template_sql(prompts.HIGHER, clusters='own', n="'4'", low="'2'", high="'6'")} AS higher_prompt, {_template_sql(prompts.DEDUP, names='own', n="'6'")} AS dedup_prompt,
{_template_sql(prompts.ASSIGN, choices='others', cluster='lang')} AS assign_prompt, {_template_sql(prompts.RENAME, children='own')} AS rename_prompt FROM m JOIN o USING (lang)""")
def cluster_prompts(spark, d):
    docs = _t(spark, d, "documents")
    own = docs.groupBy("lang").agg(F.array_sort(F.collect_set("source")).alias("own"))
    langs = own.agg(F.array_sort(F.collect_set("lang")).alias("all"))
    rows = own.crossJoin(F.broadcast(langs)).withColumn("others", F.array_remove("all", F.col("lang")))  # one row
    n = F.lit(4)
    return rows.select(
        "lang", prompts.cluster_name(F.col("own"), F.col("others"), F.lit("Name it.")).alias("cluster_prompt"), prompts.higher_names(F.col("own"), n).alias("higher_prompt"),
        prompts.dedup_names(F.col("own"), n).alias("dedup_prompt"), prompts.assign(F.col("others"), F.col("lang")).alias("assign_prompt"), prompts.rename(F.col("own")).alias("rename_prompt"))


# --- records --------------------------------------------------------------------------------------

@query("dedup_keep_first", "SELECT doc_id, source FROM documents QUALIFY row_number() OVER (PARTITION BY text ORDER BY doc_id) = 1")
def dedup_keep_first(spark, d):
    return records.dedup(_t(spark, d, "documents"), F.sha2("text", 256), "doc_id").select("doc_id", "source")


@query("dedup_mapping", """
WITH m AS (SELECT doc_id AS old, min(doc_id) OVER (PARTITION BY text) AS survivor FROM documents)
SELECT old, survivor, dense_rank() OVER (ORDER BY survivor) - 1 AS position FROM m""")
def dedup_mapping(spark, d):
    return records.dedup_mapping(_t(spark, d, "documents"), F.sha2("text", 256), "doc_id")


@query("language_filter_all", "SELECT doc_id // 3 AS record_id FROM documents GROUP BY doc_id // 3 HAVING bool_and(lang = 'en')")
def language_filter_all(spark, d):
    turns = _t(spark, d, "documents").groupBy(F.floor(F.col("doc_id") / 3).alias("record_id")).agg(F.collect_list(F.struct(F.col("lang").alias("language"))).alias("turns"))
    return records.all_turns_in(turns, "en").select("record_id")


@query("language_facet_semi", "SELECT doc_id AS record_id, source FROM documents WHERE lower(trim(lang)) = 'fr'")
def language_facet_semi(spark, d):
    docs = _t(spark, d, "documents").withColumnRenamed("doc_id", "record_id")
    values = docs.select("record_id", F.lit("Language").alias("facet"), F.concat(F.lit(" "), F.upper("lang")).alias("value"))
    return records.facet_is(docs, values, value="fr").select("record_id", "source")


@query("clusterable_facets", "SELECT f.facet_id, f.name, count(*) AS n FROM documents CROSS JOIN (VALUES (0, 'Request'), (2, 'Task')) f(facet_id, name) WHERE (doc_id + f.facet_id) % 4 <> 1 GROUP BY 1, 2")
def clusterable_facets(spark, d):
    facets = insight.facet_table(spark, insight.MAIN_FACETS)
    values = _t(spark, d, "documents").select(F.explode(F.array(*[F.lit(i) for i in range(len(insight.MAIN_FACETS))])).alias("facet_id"), "doc_id").where((F.col("doc_id") + F.col("facet_id")) % 4 != 1)
    return insight.clusterable(values, facets).groupBy("facet_id", "name").agg(F.count("*").alias("n"))


@query("duplicate_values", "SELECT sha256(text) AS value, count(*) AS n, list_sort(list(doc_id)) AS record_ids FROM documents GROUP BY text HAVING count(*) > 1")
def duplicate_values(spark, d):
    return records.duplicate_values(_t(spark, d, "documents").select(F.sha2("text", 256).alias("value"), F.col("doc_id").alias("record_id")))


@query("duplicate_value_records", "SELECT DISTINCT lang || '/' || source AS value, count(*) OVER (PARTITION BY lang, source) AS n, doc_id AS record_id FROM documents QUALIFY count(*) OVER (PARTITION BY lang, source) > 1")
def duplicate_value_records(spark, d):
    return records.duplicate_rows(_t(spark, d, "documents").select(F.concat_ws("/", "lang", "source").alias("value"), F.col("doc_id").alias("record_id")))


@query("value_mode_tiebreak", "SELECT source, lang AS mode_value, count(*) AS n FROM documents GROUP BY source, lang QUALIFY row_number() OVER (PARTITION BY source ORDER BY count(*) DESC, lang) = 1")
def value_mode_tiebreak(spark, d):
    return records.most_common(_t(spark, d, "documents"), "source", "lang")


@query("numeric_facet_histogram", "SELECT quality AS bucket, count(*) AS n FROM labels WHERE quality IS NOT NULL GROUP BY quality")
def numeric_facet_histogram(spark, d):
    return explore.histogram(_t(spark, d, "labels").select(F.concat(F.lit(" "), F.col("quality").cast("string")).alias("v")), "v")


@query("merge_sources", "SELECT lang AS name, list_sort(list(DISTINCT x)) AS sources FROM (SELECT lang, unnest([doc_id % 50, doc_id % 13]) AS x FROM documents) GROUP BY lang")
def merge_sources(spark, d):
    return records.merge_sources(_t(spark, d, "documents").select(F.col("lang").alias("name"), F.array(F.col("doc_id") % 50, F.col("doc_id") % 13).alias("sources")))


@query("hash_sample_per_cluster", "SELECT label, vec_id FROM embeddings QUALIFY row_number() OVER (PARTITION BY label ORDER BY md5('27:' || vec_id), vec_id) <= 10")
def hash_sample_per_cluster(spark, d):
    return records.hash_sample(_t(spark, d, "embeddings"), "label", "vec_id", 10).select("label", "vec_id")


@query("distinct_values_sorted", "SELECT source, list_sort(list(DISTINCT lang)) AS langs FROM documents GROUP BY source")
def distinct_values_sorted(spark, d):
    return _t(spark, d, "documents").groupBy("source").agg(F.array_sort(F.collect_set("lang")).alias("langs"))


@query("running_tokens", "SELECT conv_id, turn, sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING)::BIGINT AS upto FROM conversations")
def running_tokens(spark, d):
    w = Window.partitionBy("conv_id").orderBy("turn")
    return _t(spark, d, "conversations").select("conv_id", "turn", F.sum(F.length("text")).over(w).cast("long").alias("upto"))


@query("flatten_nested", "SELECT lang, count(*) AS n, sum(x)::BIGINT AS total FROM (SELECT lang, unnest([doc_id, doc_id + 1, 7]) AS x FROM documents) GROUP BY lang")
def flatten_nested(spark, d):
    nested = _t(spark, d, "documents").groupBy("lang").agg(F.collect_list(F.array(F.col("doc_id"), F.col("doc_id") + 1, F.lit(7).cast("long"))).alias("v"))
    return nested.select("lang", F.explode(F.flatten("v")).alias("x")).groupBy("lang").agg(F.count("*").alias("n"), F.sum("x").alias("total"))


@query("unflatten_groups", "SELECT conv_id, list(length(text)::BIGINT ORDER BY turn) AS lengths FROM conversations GROUP BY conv_id")
def unflatten_groups(spark, d):
    t = _t(spark, d, "conversations").select("conv_id", F.struct("turn", F.length("text").cast("long").alias("n")).alias("p"))
    return t.groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list("p")), lambda p: p["n"]).alias("lengths"))


# --- vectors --------------------------------------------------------------------------------------

_UNIT = "SELECT vec_id, label, list_transform(embedding::DOUBLE[], lambda x: x / sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]))) AS u, embedding::DOUBLE[] AS v FROM embeddings"
_CENT = f"""s AS ({_UNIT}),
e AS (SELECT label, unnest(generate_series(1, 64)) AS dim, unnest(v) AS x FROM s),
m AS (SELECT label, dim, sum(x) AS x FROM e GROUP BY label, dim),
c AS (SELECT label, list(x ORDER BY dim) AS t FROM m GROUP BY label),
k AS (SELECT label, list_transform(t, lambda x: x / sqrt(list_dot_product(t, t))) AS c FROM c)"""


def _emb(spark, d):
    return _t(spark, d, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("v"))


@query("normalize_vectors", f"SELECT vec_id, round(list_sum(list_transform(u, lambda x: x * x)), 6) AS size, round(u[1], 6) AS first FROM ({_UNIT})")
def normalize_vectors(spark, d):
    u = _emb(spark, d).select("vec_id", V.normalised(F.col("v")).alias("u"))
    return u.select("vec_id", F.round(V.dot(F.col("u"), F.col("u")), 6).alias("size"), F.round(F.col("u")[0], 6).alias("first"))


@query("cosine_pairs", f"WITH s AS ({_UNIT}) SELECT a.vec_id AS a, b.vec_id AS b, round(1 - list_dot_product(a.u, b.u), 6) AS distance FROM s a JOIN s b ON a.vec_id < b.vec_id WHERE 1 - list_dot_product(a.u, b.u) <= {TAU}")
def cosine_pairs(spark, d):
    return similarity.cosine_pairs(_emb(spark, d), "vec_id", "v", TAU).select("a", "b", F.round("distance", 6).alias("distance"))


@query("closest_pair", f"WITH s AS ({_UNIT}) SELECT a.vec_id AS a, b.vec_id AS b, round(list_dot_product(a.u, b.u), 6) AS similarity FROM s a JOIN s b ON a.vec_id < b.vec_id ORDER BY round(list_dot_product(a.u, b.u), 9) DESC, a, b LIMIT 1")
def closest_pair(spark, d):
    return similarity.closest_pair(_emb(spark, d), "vec_id", "v").select("a", "b", F.round("similarity", 6).alias("similarity"))


@query("centroids", f"WITH {_CENT} SELECT label, round(c[1], 6) AS c1, round(c[64], 6) AS c64, (SELECT count(*) FROM s WHERE s.label = k.label) AS n FROM k")
def centroids(spark, d):
    return similarity.centroids(_emb(spark, d), "label", "v").select("label", F.round(F.col("centroid")[0], 6).alias("c1"), F.round(F.col("centroid")[63], 6).alias("c64"), "n")


@query("nearest_centroid", f"WITH {_CENT} SELECT vec_id, k.label, round(list_dot_product(v, c), 6) AS similarity FROM s CROSS JOIN k QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY list_dot_product(v, c) DESC, k.label) = 1")
def nearest_centroid(spark, d):
    e = _emb(spark, d)
    return similarity.nearest_centroid(e, similarity.centroids(e, "label", "v"), "vec_id", "v", "label").select("vec_id", "label", F.round("similarity", 6).alias("similarity"))


_LLOYD = f"""WITH s AS ({_UNIT}),
k0 AS (SELECT row_number() OVER (ORDER BY vec_id) - 1 AS cl, u AS c FROM s QUALIFY row_number() OVER (ORDER BY vec_id) <= 8),
a0 AS (SELECT vec_id, u, cl FROM s CROSS JOIN k0 QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY list_dot_product(u, c) DESC, cl) = 1),
e1 AS (SELECT cl, unnest(generate_series(1, 64)) AS dim, unnest(u) AS x FROM a0),
t1 AS (SELECT cl, list(x ORDER BY dim) AS t FROM (SELECT cl, dim, sum(x) AS x FROM e1 GROUP BY cl, dim) GROUP BY cl),
k1 AS (SELECT cl, list_transform(t, lambda x: x / sqrt(list_dot_product(t, t))) AS c FROM t1),
a1 AS (SELECT vec_id, u, cl, list_dot_product(u, c) AS s FROM s CROSS JOIN k1 QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY list_dot_product(u, c) DESC, cl) = 1)
SELECT cl::BIGINT AS cluster, count(*) AS n, round(sum(s), 5) AS inertia FROM a1 GROUP BY cl"""


@query("kmeans_lloyd_2", _LLOYD)
def kmeans_lloyd_2(spark, d):
    e = _emb(spark, d)
    first = np.array([r.v for r in e.orderBy("vec_id").limit(8).collect()])
    at = similarity.assign(e, similarity.spherical_kmeans(e, 8, "vec_id", "v", rounds=1, first=first), "v", "vec_id")
    return at.groupBy(F.col("cluster").cast("long").alias("cluster")).agg(F.count("*").alias("n"), F.round(F.sum("similarity"), 5).alias("inertia"))


@query("contrastive_topk", f"WITH {_CENT} SELECT k.label, vec_id, round(list_distance(v, c), 6) AS distance, row_number() OVER (PARTITION BY k.label ORDER BY list_distance(v, c), vec_id) AS rank FROM s JOIN k ON s.label <> k.label QUALIFY rank <= 10")
def contrastive_topk(spark, d):
    e = _emb(spark, d)
    return similarity.outsiders(e, similarity.centroids(e, "label", "v"), "vec_id", "v", "label", 10).select("label", "vec_id", F.round("distance", 6).alias("distance"), F.col("rank").cast("long").alias("rank"))


@query("neighborhoods", f"WITH {_CENT} SELECT label, vec_id, true AS core FROM s UNION ALL SELECT label, vec_id, false FROM (SELECT k.label, vec_id FROM s JOIN k ON s.label <> k.label QUALIFY row_number() OVER (PARTITION BY k.label ORDER BY list_distance(v, c), vec_id) <= 5)")
def neighborhoods(spark, d):
    e = _emb(spark, d)
    near = similarity.outsiders(e, similarity.centroids(e, "label", "v"), "vec_id", "v", "label", 5)
    return e.select("label", "vec_id", F.lit(True).alias("core")).unionByName(near.select("label", "vec_id", F.lit(False).alias("core")))


@query("cluster_medoid", f"""WITH s AS ({_UNIT}), p AS (SELECT a.label, a.vec_id, round(sum(1 - list_dot_product(a.u, b.u)), 9) AS t FROM s a JOIN s b ON a.label = b.label GROUP BY a.label, a.vec_id)
SELECT label, vec_id AS medoid, round(t, 6) AS total_distance FROM p QUALIFY row_number() OVER (PARTITION BY label ORDER BY t, vec_id) = 1""")
def cluster_medoid(spark, d):
    return similarity.medoids(_emb(spark, d), "label", "vec_id", "v").select("label", "medoid", F.round("total_distance", 6).alias("total_distance"))


@query("best_pair", f"""WITH s AS ({_UNIT}), a AS (SELECT * FROM s WHERE vec_id % 2 = 0), b AS (SELECT * FROM s WHERE vec_id % 2 = 1),
t AS (SELECT b.label, b.vec_id, b.u, round(sum(1 - list_dot_product(a.u, b.u)), 9) AS t FROM a JOIN b USING (label) GROUP BY b.label, b.vec_id, b.u),
m AS (SELECT * FROM t QUALIFY row_number() OVER (PARTITION BY label ORDER BY t, vec_id) = 1)
SELECT m.label, m.vec_id AS best_b, a.vec_id AS best_a FROM m JOIN a ON a.label = m.label QUALIFY row_number() OVER (PARTITION BY m.label ORDER BY round(list_dot_product(a.u, m.u), 9) DESC, a.vec_id) = 1""")
def best_pair(spark, d):
    e = _emb(spark, d)
    return similarity.best_pair(e.where("vec_id % 2 = 0"), e.where("vec_id % 2 = 1"), "label", "vec_id", "v")


_PARTS = f"""WITH RECURSIVE s AS ({_UNIT}), p AS (SELECT a.vec_id AS a, b.vec_id AS b FROM s a JOIN s b ON a.vec_id <> b.vec_id WHERE 1 - list_dot_product(a.u, b.u) <= {TAU}),
r AS (SELECT vec_id, vec_id AS c FROM s UNION SELECT r.vec_id, p.b FROM r JOIN p ON p.a = r.c), k AS (SELECT vec_id, min(c) AS component FROM r GROUP BY vec_id)"""


@query("similarity_components", f"{_PARTS} SELECT vec_id, component FROM k")
def similarity_components(spark, d):
    return similarity.similarity_components(_emb(spark, d), "vec_id", "v", TAU, Scratch(spark, "components"))


@query("embedding_dedup", f"""{_PARTS}, q AS (SELECT k.component, s.vec_id, s.u, s.label FROM k JOIN s USING (vec_id)),
t AS (SELECT a.component, a.vec_id, round(sum(1 - list_dot_product(a.u, b.u)), 9) AS t FROM q a JOIN q b ON a.component = b.component GROUP BY a.component, a.vec_id),
m AS (SELECT component, vec_id FROM t QUALIFY row_number() OVER (PARTITION BY component ORDER BY t, vec_id) = 1)
SELECT m.component, m.vec_id AS representative, count(*) AS size, list_sort(list(DISTINCT q.label)) AS sources FROM m JOIN q USING (component) GROUP BY m.component, m.vec_id""")
def embedding_dedup(spark, d):
    e = _emb(spark, d).withColumn("sources", F.array("label"))
    return similarity.embedding_dedup(e, "vec_id", "v", TAU, Scratch(spark, "dedup"), sources="sources")


@query("assign_candidates", """WITH n AS (SELECT lang || '-' || (doc_id % 3) AS name, list_sort(list(DISTINCT doc_id % 20)) AS sources FROM documents GROUP BY 1),
x AS (SELECT name, unnest(sources) AS cluster FROM n) SELECT cluster, list_sort(list(lower(trim(name)))) AS candidates FROM x GROUP BY cluster""")
def assign_candidates(spark, d):
    names = _t(spark, d, "documents").select(F.concat_ws("-", "lang", (F.col("doc_id") % 3).cast("string")).alias("name"), F.array(F.col("doc_id") % 20).alias("sources"))
    x = records.merge_sources(names).select(T.name_key(F.col("name")).alias("name"), F.explode("sources").alias("cluster"))
    return x.groupBy("cluster").agg(F.array_sort(F.collect_list("name")).alias("candidates"))


# --- trees: region > nation > customer ------------------------------------------------------------

_NODES = "n AS (SELECT r_regionkey::BIGINT AS node, NULL::BIGINT AS parent FROM region UNION ALL SELECT 100 + n_nationkey, n_regionkey FROM nation), l AS (SELECT 100 + c_nationkey AS node, count(*) AS n FROM customer GROUP BY 1)"
_COUNTS = "c AS (SELECT n.node, n.parent, coalesce(CASE WHEN n.parent IS NULL THEN (SELECT sum(l.n) FROM n m JOIN l ON l.node = m.node WHERE m.parent = n.node) ELSE (SELECT l.n FROM l WHERE l.node = n.node) END, 0)::BIGINT AS n FROM n)"
_PATHS = f"WITH {_NODES}, {_COUNTS}, o AS (SELECT *, row_number() OVER (PARTITION BY parent ORDER BY n DESC, node) - 1 AS ord FROM c), p AS (SELECT node, 0 AS level, 'f0.' || ord AS path FROM o WHERE parent IS NULL UNION ALL SELECT o.node, 1, 'f0.' || q.ord || '.' || o.ord FROM o JOIN o q ON q.node = o.parent)"


def _nodes(spark, d):
    top = _t(spark, d, "region").select(F.col("r_regionkey").cast("long").alias("node"), F.lit(None).cast("long").alias("parent"))
    return top.union(_t(spark, d, "nation").select((F.col("n_nationkey") + 100).cast("long"), F.col("n_regionkey").cast("long")))


def _members(spark, d):
    return _t(spark, d, "customer").select((F.col("c_nationkey") + 100).cast("long").alias("node"), F.col("c_custkey").alias("record_id"))


def _counts(spark, d):
    return tree.rolled_up(_nodes(spark, d), _members(spark, d).groupBy("node").agg(F.count("*").alias("n")))


@query("tree_counts", f"WITH {_NODES}, {_COUNTS} SELECT node, n FROM c")
def tree_counts(spark, d):
    return _counts(spark, d)


@query("tree_levels", f"WITH {_NODES} SELECT node, CASE WHEN parent IS NULL THEN 0 ELSE 1 END AS level FROM n")
def tree_levels(spark, d):
    return tree.levels(_nodes(spark, d)).select("node", "level")


@query("tree_members", "SELECT n_regionkey::BIGINT AS node, c_custkey AS record_id FROM customer JOIN nation ON c_nationkey = n_nationkey UNION ALL SELECT 100 + c_nationkey, c_custkey FROM customer")
def tree_members(spark, d):
    return tree.members_under(_nodes(spark, d), _members(spark, d))


@query("tree_paths", f"{_PATHS} SELECT node, level, path FROM p")
def tree_paths(spark, d):
    return tree.paths(_nodes(spark, d), _counts(spark, d))


@query("record_paths", f"{_PATHS} SELECT c_custkey AS record_id, 'f0,' || regexp_extract(path, '^f0\\.[0-9]+') || ',' || path || ',' || path || '$c,c!' || path || '!' || (row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) - 1) AS url_path FROM customer JOIN p ON p.node = 100 + c_nationkey")
def record_paths(spark, d):
    return tree.record_paths(tree.paths(_nodes(spark, d), _counts(spark, d)), _members(spark, d))


@query("record_path_codes")
def record_path_codes(spark, d):
    from facetmill.functions.codec import path_code

    return record_paths(spark, d).select("record_id", path_code(F.col("url_path")).alias("code"))


@query("hierarchy_outline", f"{_PATHS} SELECT list_aggregate(list_transform(string_split(path[2:], '.'), lambda x: lpad(x, 10, '0')), 'string_agg', '.') AS sort_key, repeat('  ', level) || 'node ' || node AS line FROM p")
def hierarchy_outline(spark, d):
    n = _nodes(spark, d)
    return tree.outline(n, _counts(spark, d), n.select("node", F.concat(F.lit("node "), F.col("node").cast("string")).alias("name")))


@query("drop_empty_parents", "SELECT r_regionkey::BIGINT AS node FROM region WHERE r_regionkey IN (SELECT n_regionkey FROM nation WHERE n_nationkey % 2 = 0)")
def drop_empty_parents(spark, d):
    n = _nodes(spark, d)
    kids = n.where("parent IS NOT NULL AND (node - 100) % 2 = 0").select(F.col("parent").alias("node"))
    return n.where("parent IS NULL").join(kids, "node", "left_semi").select("node")


@query("single_child_parents", "SELECT c_nationkey AS parent, count(DISTINCT (lower(c_mktsegment), lower(c_name[1:10]))) AS kinds, count(DISTINCT (lower(c_mktsegment), lower(c_name[1:10]))) = 1 AS single FROM customer GROUP BY c_nationkey")
def single_child_parents(spark, d):
    kids = _t(spark, d, "customer").select(F.col("c_nationkey").alias("parent_id"), F.col("c_mktsegment").alias("name"), F.substring("c_name", 1, 10).alias("summary"), F.col("c_custkey").alias("cluster_id"))
    return insight.unique_children(kids).select(F.col("parent_id").alias("parent"), F.col("n").alias("kinds"), (F.col("n") == 1).alias("single"))


_SIZES = f"WITH {_NODES}, {_COUNTS}, z AS (SELECT node, parent, 80 + CASE WHEN parent IS NULL THEN 0 ELSE n * 40 END AS size FROM c), t AS (SELECT p.node, p.size + coalesce(sum(k.size), 0) AS whole FROM z p LEFT JOIN z k ON k.parent = p.node WHERE p.parent IS NULL GROUP BY p.node, p.size)"


@query("chunk_packing", f"{_SIZES} SELECT z.node, CASE WHEN whole < 8000 THEN t.node ELSE z.node END AS file FROM z JOIN t ON t.node = coalesce(z.parent, z.node)")
def chunk_packing(spark, d):
    n = _nodes(spark, d).join(_counts(spark, d), "node")
    sized = n.select("node", "parent", (F.lit(80) + F.when(F.col("parent").isNull(), 0).otherwise(F.col("n") * 40)).alias("size"))
    return tree.files(sized, 8_000).select("node", "file")


@query("publish_filter_counts", f"WITH {_NODES}, k AS (SELECT 100 + c_nationkey AS node, count(*) AS n FROM customer WHERE c_acctbal > 0 GROUP BY 1) SELECT n.node AS cluster_id, (CASE WHEN n.parent IS NULL THEN coalesce((SELECT sum(k.n) FROM n m JOIN k ON k.node = m.node WHERE m.parent = n.node), 0) ELSE coalesce((SELECT k.n FROM k WHERE k.node = n.node), 0) END)::BIGINT AS n FROM n")
def publish_filter_counts(spark, d):
    clusters = _nodes(spark, d).select(F.col("node").alias("cluster_id"), F.col("parent").alias("parent_id"))
    kept = _t(spark, d, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("record_id"))
    return publish.recounted(clusters, publish.filtered(_members(spark, d).withColumnRenamed("node", "cluster_id"), kept)).select("cluster_id", "n")


# --- viewer ---------------------------------------------------------------------------------------

@query("box_select_page", "SELECT vec_id AS record_id, round(embedding[1]::DOUBLE, 6) AS x, round(embedding[2]::DOUBLE, 6) AS y FROM embeddings WHERE embedding[1] BETWEEN -0.1 AND 0.1 AND embedding[2] BETWEEN -0.1 AND 0.1 ORDER BY vec_id LIMIT 50 OFFSET 50")
def box_select_page(spark, d):
    points = _t(spark, d, "embeddings").select(F.col("vec_id").alias("record_id"), F.col("embedding")[0].alias("x"), F.col("embedding")[1].alias("y"))
    box = explore.box_select(points, -0.1, 0.1, -0.1, 0.1)
    return explore.page(box, 1).select("record_id", F.round(F.col("x").cast("double"), 6).alias("x"), F.round(F.col("y").cast("double"), 6).alias("y"))


@query("top_values", "SELECT text AS value, count(*) AS n FROM documents GROUP BY text ORDER BY n DESC, text LIMIT 100")
def top_values(spark, d):
    return explore.top_values(_t(spark, d, "documents").select(F.col("text").alias("value")))


@query("word_cloud", "SELECT lower(t) AS token, count(*) AS n FROM (SELECT unnest(regexp_extract_all(text, '[A-Za-z]+')) AS t FROM documents) GROUP BY 1")
def word_cloud(spark, d):
    return explore.word_cloud(_t(spark, d, "documents"), "text")


@query("selected_values", "SELECT l.quality AS value, count(*) AS n FROM embeddings e JOIN labels l ON l.doc_id = e.vec_id WHERE embedding[1] BETWEEN -0.1 AND 0.1 GROUP BY 1")
def selected_values(spark, d):
    points = _t(spark, d, "embeddings").where(F.col("embedding")[0].between(-0.1, 0.1)).select(F.col("vec_id").alias("doc_id"))
    return explore.top_values(_t(spark, d, "labels").join(points, "doc_id").select(F.col("quality").alias("value")))


# --- models (rows only) ---------------------------------------------------------------------------

@query("ml_kmeans")
def ml_kmeans(spark, d):
    e = _emb(spark, d).withColumnRenamed("vec_id", "record_id")
    centres = similarity.spherical_kmeans(e, 10, "record_id", "v")
    return similarity.assign(e, centres, "v").select("record_id", "cluster", F.round("similarity", 6).alias("similarity"))


@query("pca_projection")
def pca_projection(spark, d):
    return insight.project(_emb(spark, d).select(F.col("vec_id").alias("record_id"), F.col("v").alias("vec")))


@query("cluster_hull")
def cluster_hull(spark, d):
    points = _t(spark, d, "embeddings").select("label", F.col("vec_id").alias("record_id"), F.col("embedding")[0].cast("double").alias("x"), F.col("embedding")[1].cast("double").alias("y"))
    return hulls(points, "label")


@query("insight_pipeline")
def insight_pipeline(spark, d):
    got = insight.run(spark, insight.text_records(_t(spark, d, "documents").select(F.col("doc_id").alias("record_id"), "text")), [insight.SUMMARY])
    return got["clusters"].select("facet_id", "cluster_id", "level", "parent_id", "name", "summary", "n")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per label: size, medoid and the five nearest outsiders."""
    e = _emb(spark, sf_dir)
    c = similarity.centroids(e, "label", "v")
    near = similarity.outsiders(e, c, "vec_id", "v", "label", 5).groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "vec_id"))), lambda p: p["vec_id"]).alias("outsiders"))
    return c.select("label", F.col("n").alias("size")).join(similarity.medoids(e, "label", "vec_id", "v").select("label", F.col("medoid").alias("medoid_id")), "label").join(near, "label")


query("cluster_overview", f"""WITH {_CENT}, o AS (SELECT k.label, vec_id, row_number() OVER (PARTITION BY k.label ORDER BY list_distance(v, c), vec_id) AS rank FROM s JOIN k ON s.label <> k.label QUALIFY rank <= 5),
p AS (SELECT a.label, a.vec_id, round(sum(1 - list_dot_product(a.u, b.u)), 9) AS t FROM s a JOIN s b ON a.label = b.label GROUP BY a.label, a.vec_id),
md AS (SELECT label, vec_id FROM p QUALIFY row_number() OVER (PARTITION BY label ORDER BY t, vec_id) = 1)
SELECT md.label, (SELECT count(*) FROM s WHERE s.label = md.label) AS size, md.vec_id AS medoid_id, (SELECT list(vec_id ORDER BY rank) FROM o WHERE o.label = md.label) AS outsiders FROM md""")(flagship)


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict:
    return dict(SQL)
