"""Two writers, readers of older versions, whole shards and clashing names."""

import os

import pytest
from pyspark.sql import functions as F

from facetmill.llm import shards


def store(spark, path, **k):
    return shards.ShardStore(spark, f"file://{path}/s", **k)


def test_vacuum_spares_what_another_writer_has_not_committed(spark, tmp_path):
    a, b = store(spark, tmp_path), store(spark, tmp_path)
    a.append(spark.range(10))
    base = a.version()
    written = a._write(spark.range(10, 30), base + 1)
    b.vacuum(keep=1, grace=0.0)
    a.commit(base + 1, a.manifest(base) + written)
    assert sorted(r.id for r in b.read().collect()) == list(range(30))


def test_superseded_versions_go_after_their_grace(spark, tmp_path):
    s = store(spark, tmp_path, small=1, fan_in=2, target=1 << 20)
    for i in range(4):
        s.append(spark.range(i * 10, i * 10 + 10).coalesce(1))
    old = s.manifest()
    s.compact(keep=1)  # within the grace period all stay
    assert s.read(old).count() == 40 and s.read().count() == 40
    s.vacuum(keep=1, grace=0.0)
    assert s.read().count() == 40
    left = [f for _, _, fs in os.walk(f"{tmp_path}/s/data") for f in fs if f.endswith(".parquet")]
    assert len(left) == len(s.manifest()) == 1
    orphan = s._write(spark.range(3), 99)
    s.vacuum(keep=1, grace=0.0)
    assert s.read(orphan).count() == 3
    for x in orphan:
        os.utime(f"{tmp_path}/s/{x.file}", (0, 0))
    s.vacuum(keep=1, grace=0.0)
    assert not any(os.path.exists(f"{tmp_path}/s/{x.file}") for x in orphan) and s.read().count() == 40


def test_conflicting_commits(spark, tmp_path):
    a, b = store(spark, tmp_path), store(spark, tmp_path)
    a.append(spark.range(5))
    mine = b._write(spark.range(5, 9), 2)
    a.append(spark.range(9, 12))
    with pytest.raises(shards.Conflict):
        b.commit(2, b.manifest(1) + mine)
    b.commit(3, b.manifest() + mine)
    assert sorted(r.id for r in a.read().collect()) == list(range(12))


def test_tasks_read_whole_shards(spark, tmp_path):
    s = store(spark, tmp_path, target=1 << 20, small=1000)
    s.append(spark.range(40_000).withColumn("x", F.md5(F.col("id").cast("string"))).repartition(40))
    old = s.manifest()
    total = sum(x.bytes for x in old)
    before = spark.conf.get("spark.sql.files.openCostInBytes")
    with s._whole_shards():
        parts = s.read(old).select(F.spark_partition_id().alias("p"), F.input_file_name().alias("f")).distinct().collect()
    assert len(parts) == len(old) == 40  # no shard is in two tasks
    assert len({p.p for p in parts}) <= 2 * -(-total // s.target)
    assert spark.conf.get("spark.sql.files.openCostInBytes") == before


def test_columns_of_any_name(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet").withColumn("_metadata", F.lit("clash")).withColumn("file", F.lit("f")).withColumn("shard", F.lit(1))
    docs.write.parquet(f"{tmp_path}/in/documents.parquet")
    assert shards.op7_sharding(spark, f"{tmp_path}/in").count() == 200
    s = store(spark, tmp_path, target=200_000, small=4_000, fan_in=3)
    s.append(docs.repartition(6), arrival_rows=10)
    s.compact()
    assert s.read().columns == docs.columns and sorted(map(str, s.read().collect())) == sorted(map(str, docs.collect()))
