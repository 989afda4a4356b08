"""Immutable shards with size-tiered compaction and a versioned manifest.

Every arrival becomes a run of small Parquet shards. A manifest lists the runs
that are live; version n+1 is written beside version n and takes effect by one
rename to a name that must not exist yet, so readers see all of a change or none
and of two writers one has to try again. Compaction merges runs whose sizes lie
in the same tier (a power of ``fanout``) into files of the target size.

Shard files are named by a run id and never change; files that no manifest names
are left by failed writers, or are another writer's that hasn't committed yet: ``vacuum``
drops those of an age that no writer needs. The store's folder must be on a file system
whose rename fails where the target exists (HDFS and local ones; not bare object stores).

Cases: nulls and clashing column names are stored as they are; all arrivals must
have the schema of the first; an empty arrival adds no run and no version; an empty
store reads as the empty table of its schema; repeated rows are all kept; very long texts
make a shard larger than the target where one row is.
"""

from __future__ import annotations

import json
import math
import time
import uuid
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from redactlake.llm.common import hadoop

TARGET = 128 << 20  # bytes of a full shard
FANOUT = 4  # runs of a tier that are merged at once
SMALLEST = 1 << 20  # runs up to this size share the lowest tier
AGE = 24 * 3600.0  # seconds after which a run that no manifest names is a failed writer's


class Conflict(RuntimeError):
    """Another writer has committed this version."""


class ShardStore:
    def __init__(self, spark: SparkSession, root: str, schema: T.StructType, target: int = TARGET, fanout: int = FANOUT):
        self.spark, self.root, self.schema, self.target, self.fanout = spark, root.rstrip("/"), schema, target, fanout

    # manifests

    def _manifests(self) -> list[int]:
        fs, path = hadoop(self.spark, f"{self.root}/manifests")
        if not fs.exists(path):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(path)]
        return sorted(int(n[1:-5]) for n in names if n.startswith("v") and n.endswith(".json"))

    def manifest(self, version: int | None = None) -> dict:
        """The manifest of a version, the latest by default."""
        if version is None:
            version = max(self._manifests(), default=0)
        if not version:
            return {"version": 0, "runs": []}
        fs, path = hadoop(self.spark, f"{self.root}/manifests/v{version:010d}.json")
        stream = fs.open(path)
        try:
            text = self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        return json.loads(text)

    def _commit(self, base: dict, runs: list[dict]) -> dict:
        new = {"version": base["version"] + 1, "runs": runs}
        final = f"{self.root}/manifests/v{new['version']:010d}.json"
        fs, path = hadoop(self.spark, f"{self.root}/manifests/.{uuid.uuid4().hex}")
        _, to = hadoop(self.spark, final)
        out = fs.create(path, False)
        try:
            out.write(bytearray(json.dumps(new).encode()))
        finally:
            out.close()
        if fs.exists(to) or not fs.rename(path, to):
            fs.delete(path, False)
            raise Conflict(f"version {new['version']} is there already")
        return new

    # runs

    def _write(self, df: DataFrame) -> dict | None:
        """The run that df's rows make; none without rows."""
        run = uuid.uuid4().hex
        where = f"{self.root}/runs/{run}"
        rows = Observation()
        df.observe(rows, F.count(F.lit(1)).alias("n")).write.option("compression", "zstd").parquet(where)
        fs, path = hadoop(self.spark, where)
        files = [[s.getPath().getName(), s.getLen()] for s in fs.listStatus(path) if s.getPath().getName().endswith(".parquet")]
        if not rows.get["n"]:
            fs.delete(path, True)
            return None
        return {"run": run, "files": files, "bytes": sum(n for _, n in files)}

    def append(self, df: DataFrame, tries: int = 5) -> dict:
        """Store the rows of df as one run and commit it; the manifest that holds then."""
        run = self._write(df.select(self.schema.names))
        return self._retry(lambda base: [*base["runs"], run], tries) if run else self.manifest()

    def _retry(self, change, tries: int) -> dict:
        for left in reversed(range(tries)):
            base = self.manifest()
            try:
                return self._commit(base, change(base))
            except Conflict:
                if not left:
                    raise
        raise Conflict

    def tier(self, size: int) -> int:
        return max(0, math.floor(math.log(max(size, 1) / SMALLEST, self.fanout)) + 1) if size > SMALLEST else 0

    def plan(self, base: dict) -> list[list[dict]]:
        """Groups of runs to merge: those of each tier that has enough of them."""
        tiers: dict[int, list[dict]] = {}
        for run in base["runs"]:
            tiers.setdefault(self.tier(run["bytes"]), []).append(run)
        return [runs for _, runs in sorted(tiers.items()) if len(runs) >= self.fanout]

    def compact(self) -> int:
        """Merge until no tier is full, full tiers at once; the number of merges."""
        merges = 0
        while groups := self.plan(self.manifest()):
            with ThreadPoolExecutor(len(groups)) as pool:
                merged = list(pool.map(self._merged, groups))
            for runs, new in zip(groups, merged, strict=True):
                self._replace(runs, new)
            merges += len(groups)
        return merges

    def _merged(self, runs: list[dict]) -> dict:
        count = max(1, math.ceil(sum(r["bytes"] for r in runs) / self.target))
        return self._write(self._read(runs).coalesce(count))

    def _replace(self, runs: list[dict], merged: dict) -> None:
        gone = {r["run"] for r in runs}

        def change(base: dict) -> list[dict]:
            if not gone <= {r["run"] for r in base["runs"]}:
                raise Conflict("a run that was merged is no longer live")
            return [*(r for r in base["runs"] if r["run"] not in gone), merged]

        self._retry(change, 5)

    def _read(self, runs: list[dict]) -> DataFrame:
        paths = [f"{self.root}/runs/{r['run']}/{name}" for r in runs for name, _ in r["files"]]
        if not paths:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*paths)

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of a version, the latest by default."""
        return self._read(self.manifest(version)["runs"])

    def vacuum(self, keep: int = 1, age: float = AGE) -> int:
        """Delete runs that the last ``keep`` manifests do not name: those that an older one names, and others once ``age`` seconds old; their number."""
        if keep < 1:
            raise ValueError("the last manifest's runs are the store's rows")
        versions = self._manifests()
        live = {r["run"] for v in versions[-keep:] for r in self.manifest(v)["runs"]}
        done = {r["run"] for v in versions[:-keep] for r in self.manifest(v)["runs"]}
        fs, path = hadoop(self.spark, f"{self.root}/runs")
        found = fs.listStatus(path) if fs.exists(path) else []
        before = (time.time() - age) * 1000
        dead = [s.getPath() for s in found if s.getPath().getName() not in live and (s.getPath().getName() in done or s.getModificationTime() < before)]
        for p in dead:
            fs.delete(p, True)
        return len(dead)


def arrivals(table: DataFrame, most: int = 16) -> list[DataFrame]:
    """A table as about ``most`` arrivals that together hold each of its rows once: groups of its files or, where it has fewer files, ranges of the rows' places in each."""
    spark, files = table.sparkSession, sorted(table.inputFiles())
    if len(files) >= most:
        size = math.ceil(len(files) / most)
        return [spark.read.schema(table.schema).parquet(*files[at : at + size]) for at in range(0, len(files), size)]
    parts, place = [], F.col("_metadata.row_index")
    for file in files:
        own = spark.read.schema(table.schema).parquet(file)
        rows = own.count()  # from the footer
        size = max(1, math.ceil(rows * len(files) / most))
        parts += [own.where(place.between(at, at + size - 1)) for at in range(0, rows, size)]
    return parts or [table]
