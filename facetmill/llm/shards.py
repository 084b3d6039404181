"""Sharding by size-tiered compaction.

A store is a folder of immutable Parquet shards and numbered manifests. An append writes its rows as
small shards, without a shuffle. Compaction sorts shards into tiers by size (tier t holds those of
FAN_IN**t times SMALL bytes and more); a tier with FAN_IN shards or more is merged into runs of up to
the target size, each run being a task that reads whole shards and writes one. A change becomes visible
by one atomic rename of its manifest, which names the shards of its version; the rename fails if
that version is there already, so of two writers one has to start again from the newer state.

Vacuum deletes what only superseded versions name, once these have been superseded for a grace period, so
readers of an older version have that long to finish. Files that no manifest names may belong to a
writer who hasn't committed yet; they are deleted only when they are older than ORPHAN_GRACE.

The driver handles file names, sizes and row counts alone, never rows. Lost executors only repeat
their tasks: what a failed try has written is in no manifest.

Edge cases: an empty append commits a version with no further shards; nulls, long texts, repeated rows and
all columns (of any names) are kept as they are; appends with other columns than the store's are an error.
"""

from __future__ import annotations

import contextlib
import json
import math
import time
import uuid
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from facetmill.sources.scratch import hadoop_path, shared_dir

SMALL = 1 << 20
FAN_IN = 4
TARGET = 64 << 20
ARRIVAL_ROWS = 2_000
KEEP_VERSIONS = 8
GRACE = 24 * 3600.0  # seconds that a superseded version stays readable
ORPHAN_GRACE = 7 * 24 * 3600.0  # seconds that a writer may take to commit its files


@dataclass(frozen=True)
class Shard:
    file: str
    bytes: int
    version: int  # that added it


class Conflict(RuntimeError):
    """Another writer has committed this version."""


class ShardStore:
    def __init__(self, spark: SparkSession, path: str, target: int = TARGET, small: int = SMALL, fan_in: int = FAN_IN):
        self.spark, self.path, self.target, self.small, self.fan_in = spark, path.rstrip("/"), target, small, fan_in

    def _status(self, folder: str) -> list[tuple[str, int, float]]:
        """Name, bytes and seconds since the epoch of each file."""
        p, fs = hadoop_path(self.spark, f"{self.path}/{folder}")
        return sorted((f.getPath().getName(), f.getLen(), f.getModificationTime() / 1000) for f in fs.listStatus(p)) if fs.exists(p) else []

    def _list(self, folder: str) -> list[tuple[str, int]]:
        return [(n, size) for n, size, _ in self._status(folder)]

    def version(self) -> int:
        """The newest committed version; 0 of an empty store."""
        return max((int(n[1:-5]) for n, _ in self._list("manifests") if n.startswith("v") and n.endswith(".json")), default=0)

    def manifest(self, version: int | None = None) -> list[Shard]:
        version = self.version() if version is None else version
        if not version:
            return []
        text = self.spark.read.text(f"{self.path}/manifests/v{version:010d}.json", wholetext=True).first()[0]
        return [Shard(**s) for s in json.loads(text)["shards"]]

    def commit(self, version: int, shards: list[Shard]) -> None:
        """Publishes a version by renaming a finished file, which fails if the version is there."""
        jvm = self.spark.sparkContext._jvm
        temp, fs = hadoop_path(self.spark, f"{self.path}/manifests/.{uuid.uuid4().hex}.tmp")
        final, _ = hadoop_path(self.spark, f"{self.path}/manifests/v{version:010d}.json")
        out = fs.create(temp, True)
        out.write(bytearray(json.dumps({"version": version, "shards": [asdict(s) for s in shards]}).encode()))
        out.close()
        none = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        try:
            context.rename(temp, final, none)
        except Exception as e:
            fs.delete(temp, False)
            if fs.exists(final):
                raise Conflict(f"version {version} is committed already") from e
            raise

    def _write(self, df: DataFrame, version: int, rows: int = 0) -> list[Shard]:
        """Writes df as shards, one or more a task, and lists them."""
        folder = f"data/{version:010d}-{uuid.uuid4().hex[:8]}"
        df.write.option("maxRecordsPerFile", rows).parquet(f"{self.path}/{folder}")
        return [Shard(f"{folder}/{n}", size, version) for n, size in self._list(folder) if n.endswith(".parquet")]

    def append(self, df: DataFrame, arrival_rows: int = ARRIVAL_ROWS) -> int:
        """Adds df as small shards of at most arrival_rows rows; returns the new version."""
        base = self.version()
        self.commit(base + 1, self.manifest(base) + self._write(df, base + 1, arrival_rows))
        return base + 1

    def tier(self, size: int) -> int:
        return max(0, math.floor(math.log(max(size, 1) / self.small, self.fan_in)))

    def plan(self, shards: list[Shard]) -> tuple[list[Shard], int] | None:
        """The lowest tier's shards to merge and into how many, or None if no tier is due."""
        tiers: dict[int, list[Shard]] = {}
        for s in shards:
            if s.bytes < self.target / 2:
                tiers.setdefault(self.tier(s.bytes), []).append(s)
        for t in sorted(tiers):
            if len(tiers[t]) >= self.fan_in:
                total = sum(s.bytes for s in tiers[t])
                runs = max(1, math.ceil(total / self.target))
                if runs < len(tiers[t]):
                    return tiers[t], runs
        return None

    def compact(self, keep: int = KEEP_VERSIONS, grace: float = GRACE) -> int:
        """Merges tiers until none is due; every merge is a version. Returns the newest."""
        while True:
            base = self.version()
            shards = self.manifest(base)
            due = self.plan(shards)
            if due is None:
                return base
            old, runs = due
            gone = {s.file for s in old}
            with self._whole_shards():
                merged = self._write(self.read(old).coalesce(runs), base + 1)  # at most runs files, however the scan is cut
            self.commit(base + 1, [s for s in shards if s.file not in gone] + merged)
            self.vacuum(keep, grace)

    @contextlib.contextmanager
    def _whole_shards(self):
        """While it holds, a scan that runs packs whole files into tasks of up to the target size, without a shuffle."""
        want = {"maxPartitionBytes": str(self.target), "openCostInBytes": "0", "minPartitionNum": "1"}
        old = {k: self.spark.conf.get(f"spark.sql.files.{k}", None) for k in want}
        for k, v in want.items():
            self.spark.conf.set(f"spark.sql.files.{k}", v)
        try:
            yield
        finally:
            for k, v in old.items():
                self.spark.conf.unset(f"spark.sql.files.{k}") if v is None else self.spark.conf.set(f"spark.sql.files.{k}", v)

    def read(self, shards: list[Shard] | None = None) -> DataFrame:
        """Rows of a version's shards."""
        shards = self.manifest() if shards is None else shards
        return self.spark.read.parquet(*[f"{self.path}/{s.file}" for s in shards])

    def vacuum(self, keep: int = KEEP_VERSIONS, grace: float = GRACE, orphan_grace: float = ORPHAN_GRACE) -> None:
        """Deletes versions older than the newest keep that have been superseded for grace seconds, the shards that only
        they name, and files of no version that are older than orphan_grace."""
        now, newest = time.time(), self.version()
        born = {int(n[1:-5]): at for n, _, at in self._status("manifests") if n.startswith("v") and n.endswith(".json")}
        # the newest manifest is read after the listing of files, so what was committed meanwhile is known
        files = [(f"data/{folder}/{n}", at) for folder, _ in self._list("data") for n, _, at in self._status(f"data/{folder}") if n.endswith(".parquet")]
        drop = {v for v in born if v <= newest - keep and now - born.get(v + 1, now) >= grace}
        born |= {int(n[1:-5]): at for n, _, at in self._status("manifests") if n.startswith("v") and n.endswith(".json")}
        kept = {s.file for v in born if v not in drop for s in self.manifest(v)}
        dropped = {s.file for v in drop for s in self.manifest(v)}
        for file, at in files:
            if file not in kept and (file in dropped or now - at >= orphan_grace):
                p, fs = hadoop_path(self.spark, f"{self.path}/{file}")
                fs.delete(p, False)
        for v in sorted(drop):
            p, fs = hadoop_path(self.spark, f"{self.path}/manifests/v{v:010d}.json")
            fs.delete(p, False)


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each document lies after it arrived in small shards and these were compacted: doc_id, shard
    (number in the manifest's order), tier, shard_bytes, version that wrote the shard."""
    store = ShardStore(spark, f"{shared_dir(spark)}/facetmill/store-{uuid.uuid4().hex[:12]}")
    store.append(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    store.compact(keep=1, grace=0.0)  # nobody else reads this store
    shards = store.manifest()
    rows = [(s.file.rsplit("/", 1)[-1], i, store.tier(s.bytes), s.bytes, s.version) for i, s in enumerate(shards)]
    names = spark.createDataFrame(rows, "file string, shard long, tier int, shard_bytes long, version int")
    placed = store.read(shards).select("doc_id", F.substring_index(F.input_file_name(), "/", -1).alias("file"))
    return placed.join(names, "file").select("doc_id", "shard", "tier", "shard_bytes", "version")
