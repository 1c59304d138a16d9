"""Versioned tables with guarded publishing: snapshots, upserts, leases and receipts.

A store is a folder with one Parquet folder per table and version and a manifest that names the current ones. A version is
written whole, then published by creating the next manifest, which fails if someone else was faster; readers see one
version throughout. Publishing relies on the file system creating a file only if it isn't there.
"""

from __future__ import annotations

import hashlib
import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Conflict(Exception):
    """Another writer published first, or a batch id was used for another content."""


class Store:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path = lambda p: jvm.org.apache.hadoop.fs.Path(p)
        self._fs = self._path(self.folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._fs.mkdirs(self._path(f"{self.folder}/manifests"))

    def versions(self) -> list[int]:
        """Published versions, the newest first."""
        found = self._fs.listStatus(self._path(f"{self.folder}/manifests"))
        return sorted((int(x.getPath().getName()) for x in found if x.getPath().getName().isdigit()), reverse=True)

    def manifest(self, version: int | None = None) -> dict:
        if version is None:
            version = (self.versions() or [0])[0]
        if not version:
            return {"version": 0, "tables": {}, "receipts": {}}
        stream = self._fs.open(self._path(f"{self.folder}/manifests/{version}"))
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def read(self, table: str, version: int | None = None) -> DataFrame | None:
        """A table at a version (the current one by default), or None if it isn't there."""
        path = self.manifest(version)["tables"].get(table)
        return None if path is None else self.spark.read.parquet(f"{self.folder}/{path}")

    def publish(self, tables: dict[str, DataFrame], base: int, receipt: tuple[str, str] | None = None) -> int:
        """Write tables as the version after base; others stay as they are. receipt: (batch id, digest of its content);
        the same batch again does nothing, another content under its id raises Conflict, as does a base that is not the
        current version."""
        now = self.manifest()
        if receipt and receipt[0] in now["receipts"]:
            if now["receipts"][receipt[0]]["digest"] != receipt[1]:
                raise Conflict(f"batch {receipt[0]} was used for another content")
            return now["receipts"][receipt[0]]["version"]
        if now["version"] != base:
            raise Conflict(f"the current version is {now['version']}, not {base}")
        version = base + 1
        new = {"version": version, "tables": dict(now["tables"]), "receipts": dict(now["receipts"])}
        for name, df in tables.items():
            path = f"{name}/{version}-{uuid.uuid4().hex[:8]}"
            df.write.parquet(f"{self.folder}/{path}")
            new["tables"][name] = path
        if receipt:
            new["receipts"][receipt[0]] = {"digest": receipt[1], "version": version}
        target = self._path(f"{self.folder}/manifests/{version}")
        try:
            stream = self._fs.create(target, False)
        except Exception as e:
            raise Conflict(f"version {version} was published by another writer") from e
        try:
            stream.write(bytearray(json.dumps(new, sort_keys=True).encode()))
        finally:
            stream.close()
        return version


def digest(value: object) -> str:
    """SHA-256 of a value's canonical JSON: keys sorted, no blanks."""
    return hashlib.sha256(json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False).encode()).hexdigest()


def upserted(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """old with the rows of new added or put in place of those with the same keys."""
    return new.unionByName(old.join(new.select(*keys), keys, "left_anti"), allowMissingColumns=True)


def without(old: DataFrame, keys_gone: DataFrame, keys: list[str]) -> DataFrame:
    """old without the rows whose keys are in keys_gone."""
    return old.join(keys_gone.select(*keys), keys, "left_anti")


def inserted(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """old with those rows of new whose keys it lacks; of rows of new with equal keys the least."""
    rest = [c for c in new.columns if c not in keys]
    once = new.groupBy(*keys).agg(F.min(F.struct(*rest)).alias("_r")).select(*keys, "_r.*") if rest else new.distinct()
    return old.unionByName(once.join(old.select(*keys), keys, "left_anti"))


def expired(tasks: DataFrame, now: float) -> DataFrame:
    """tasks with running ones whose lease ended at or before now queued again, without lease and worker."""
    gone = (F.col("state") == "running") & (F.col("expires_at") <= now)
    free = lambda c: F.when(~F.coalesce(gone, F.lit(False)), F.col(c)).alias(c)
    return tasks.select(*[F.when(gone, "queued").otherwise(F.col("state")).alias("state") if c == "state" else free(c) if c in ("lease_id", "worker", "expires_at") else F.col(c) for c in tasks.columns])


def claimed(tasks: DataFrame, worker: str, now: float, seconds: float, most: int, budget: int, lease: str | None = None) -> DataFrame:
    """tasks with up to `most` (1 to 20) of those ready leased to worker, the highest priority first, then by node_id, as
    long as their estimates fit into budget; larger ones are skipped. generation counts the leases of a task."""
    from graphloom.operators.ordered import within_budget

    if not 1 <= most <= 20:
        raise ValueError("most must be from 1 to 20")
    fresh = expired(tasks, now)
    ready = fresh.where(F.col("state") == "queued").where(F.col("estimated_tokens") <= budget)
    ranked = ready.withColumn("_order", -F.col("priority"))
    chosen = within_budget(ranked.select("node_id", "_order", "estimated_tokens"), [], ["_order", "node_id"], "estimated_tokens", budget)
    chosen = chosen.orderBy("_order", "node_id").limit(most).select("node_id", F.lit(True).alias("_mine"))
    j = fresh.join(F.broadcast(chosen), "node_id", "left")
    mine = F.col("_mine").isNotNull()
    new = {"state": F.lit("running"), "lease_id": F.lit(lease or uuid.uuid4().hex), "worker": F.lit(worker), "expires_at": F.lit(now + seconds), "generation": F.col("generation") + 1}
    return j.select(*[F.when(mine, new[c]).otherwise(F.col(c)).alias(c) if c in new else F.col(c) for c in tasks.columns])


def queue(nodes: DataFrame) -> DataFrame:
    """Work for nodes (node_id, degree, suspect, n_bytes): priority and estimated_tokens."""
    priority = F.col("degree") * 10 - F.when(F.col("suspect"), 1).otherwise(0)
    estimate = F.greatest(F.lit(128), F.floor((F.col("n_bytes") + 2) / 3) + 512)
    return nodes.select("node_id", priority.cast("long").alias("priority"), estimate.cast("long").alias("estimated_tokens"))
