"""Keeping results current: manifest diffs, stale paths, replacing merges, safe generations, and a bounded cache."""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def reconcile(manifest: DataFrame, scoped: DataFrame, generation: int) -> DataFrame:
    """(path, mtime, last_changed): the manifest after scoped (path, mtime); new and changed paths get the new generation.

    Paths out of scope keep their entry. One join by path; applying it twice changes nothing.
    """
    now = scoped.select("path", F.col("mtime").alias("_now"))
    both = manifest.join(now, "path", "full_outer")
    changed = F.col("_now").isNotNull() & ~F.col("mtime").eqNullSafe(F.col("_now"))
    return both.select("path", F.coalesce("_now", "mtime").alias("mtime"), F.when(changed, F.lit(generation)).otherwise(F.col("last_changed")).cast("bigint").alias("last_changed"))


def stale(scoped: DataFrame, manifest: DataFrame, scanned: int, seen: DataFrame | None = None) -> DataFrame:
    """(path): scoped paths that the manifest lacks, that changed after the scanned generation, or that are not among seen (path)."""
    both = scoped.select("path").join(manifest.select("path", "last_changed"), "path", "left")
    late = F.col("last_changed").isNull() | (F.col("last_changed") > scanned)
    if seen is not None:
        both = both.join(seen.select("path", F.lit(True).alias("_seen")).distinct(), "path", "left")
        late = late | F.col("_seen").isNull()
    return both.where(late).select("path")


def replace_merge(existing: DataFrame, fresh: DataFrame, rescanned: DataFrame, scope: DataFrame | None = None) -> DataFrame:
    """Existing hits of paths that were not rescanned, and the fresh ones; both only of scope. A rescan without hits deletes."""
    out = existing.join(rescanned.select("path"), "path", "left_anti").unionByName(fresh)
    return out if scope is None else out.join(scope.select("path"), "path", "left_semi")


def safe_generation(failed: DataFrame, manifest: DataFrame, current: int, previous: int) -> DataFrame:
    """One row (generation): how far a scan may be acknowledged when reads of some paths failed."""
    both = failed.select("path").distinct().join(manifest.select("path", "last_changed"), "path", "left")
    return both.agg(F.least(F.lit(current).cast("bigint"), F.coalesce(F.min(F.coalesce(F.greatest(F.lit(previous).cast("bigint"), F.col("last_changed") - 1), F.lit(previous).cast("bigint"))), F.lit(current).cast("bigint"))).alias("generation"))


def hit_bytes(path: Column, heading: Column) -> Column:
    return 2 * (F.length(path) + F.length(heading)) + 32


def entry_bytes(hits: DataFrame) -> DataFrame:
    """(key, n_hits, bytes): the estimated size of each cache entry from its hits (key, path, heading)."""
    return hits.groupBy("key").agg(F.count("*").alias("n_hits"), (2 * F.length("key") + 48 + F.sum(hit_bytes(F.col("path"), F.col("heading")))).alias("bytes"))


def keep_recent(entries: DataFrame, limit: int, low_water: float = 0.9) -> DataFrame:
    """entries (key, bytes, last_access, pinned) with kept and durable.

    An entry larger than the limit alone is not durable: it is neither counted nor evicted. If the others exceed
    the limit (above 0), the oldest that are not pinned go until low_water of it is left.
    """
    rows = entries.withColumn("durable", F.col("bytes") <= limit) if limit > 0 else entries.withColumn("durable", F.lit(True))
    size = F.when(F.col("durable"), F.col("bytes")).otherwise(0)
    total = F.sum(size).over(Window.partitionBy())
    pinned = F.sum(F.when(F.col("pinned"), size).otherwise(0)).over(Window.partitionBy())
    newest = Window.orderBy(F.desc("last_access"), "key").rowsBetween(Window.unboundedPreceding, 0)
    held = F.sum(F.when(~F.col("pinned"), size).otherwise(0)).over(newest) + pinned
    over = F.lit(limit > 0) & (total > limit)
    kept = ~over | F.col("pinned") | ~F.col("durable") | (held <= limit * low_water)
    return rows.withColumn("kept", kept)


_STATE = "key string, folder string, scanned bigint, at bigint, version int, bytes bigint, pinned boolean, gone boolean"


class ResultCache:
    """Hits of past searches as Parquet tables, each of a folder with a name of its own, and a log of entries.

    A new state is written beside the old one and made current by a row of the log, so that a failed or repeated write
    never harms what readers see, and two writers never write one table; of two rows the later one counts.
    Excerpts are not stored. With limit (bytes), put() evicts the entries longest unused, and does not
    keep entries larger than that.
    """

    VERSION = 3

    def __init__(self, spark: SparkSession, root: str, limit: int = 0):
        self.spark, self.root, self.limit = spark, root.rstrip("/"), limit

    def _exists(self, path: str) -> bool:
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(p)

    def _log(self, rows: list[tuple]) -> None:
        self.spark.createDataFrame(rows, _STATE).coalesce(1).write.mode("append").parquet(f"{self.root}/log")

    def entries(self) -> DataFrame:
        """(key, folder, scanned, at, version, bytes, pinned): the current entries of this version."""
        if not self._exists(f"{self.root}/log"):
            return self.spark.createDataFrame([], _STATE).drop("gone")
        rows = self.spark.read.schema(_STATE).parquet(f"{self.root}/log").where(F.col("version") == self.VERSION)
        rest = [c for c in rows.columns if c != "key"]
        last = rows.groupBy("key").agg(F.max(F.struct("at", "folder", *[c for c in rest if c not in ("at", "folder")])).alias("x"))
        return last.select("key", *(f"x.{c}" for c in rest)).where("not gone").drop("gone")

    def find(self, keys: list[str]) -> dict[str, tuple[str, int]]:
        """(folder, scanned generation) of those of keys that are cached."""
        return {r["key"]: (r["folder"], r["scanned"]) for r in self.entries().where(F.col("key").isin(keys)).collect()}

    def hits(self, folder: str, keys: list[str]) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/hits/{folder}").where(F.col("key").isin(keys))

    def seen(self, folder: str) -> DataFrame:
        """(path): what was scanned for the entries of a folder."""
        return self.spark.read.parquet(f"{self.root}/seen/{folder}")

    def entry(self, key: str) -> tuple[DataFrame, int] | None:
        """(hits, scanned generation) of a key; None if it is not cached or of another version."""
        found = self.find([key]).get(key)
        return None if found is None else (self.hits(found[0], [key]).withColumn("excerpt", F.lit("")), found[1])

    def put(self, keys: list[str], hits: DataFrame, scanned: int, seen: DataFrame) -> DataFrame:
        """Stores the hits (key, path, ...) of keys, found by scanning the paths in seen; returns them as stored."""
        folder = uuid.uuid4().hex
        hits.drop("excerpt").write.parquet(f"{self.root}/hits/{folder}")
        seen.select("path").distinct().write.parquet(f"{self.root}/seen/{folder}")
        stored = self.hits(folder, keys)
        heading = stored if "heading" in stored.columns else stored.withColumn("heading", F.lit(""))
        sizes = {r["key"]: r["bytes"] for r in entry_bytes(heading.withColumn("heading", F.coalesce("heading", F.lit("")))).collect()}
        pinned = {r["key"] for r in self.entries().where("pinned").collect()}
        now = time.time_ns() // 1_000_000
        self._log([(k, folder, scanned, now, self.VERSION, sizes.get(k, 2 * len(k) + 48), k in pinned, bool(self.limit) and sizes.get(k, 0) > self.limit) for k in keys])
        if self.limit:
            self.evict()
        return stored

    def _again(self, rows: DataFrame, **changes: object) -> None:
        now = time.time_ns() // 1_000_000
        names = ["key", "folder", "scanned", "at", "version", "bytes", "pinned", "gone"]
        self._log([tuple({**r.asDict(), "gone": False, **changes, "at": max(now, r["at"] + 1)}[n] for n in names) for r in rows.collect()])

    def touch(self, keys: list[str]) -> None:
        """Marks entries as used now."""
        self._again(self.entries().where(F.col("key").isin(keys)))

    def pin(self, key: str, pinned: bool = True) -> None:
        self._again(self.entries().where(F.col("key") == key), pinned=pinned)

    def remove(self, keys: list[str]) -> None:
        self._again(self.entries().where(F.col("key").isin(keys)), gone=True)

    def clear(self) -> None:
        self._again(self.entries(), gone=True)

    def evict(self) -> None:
        """Removes the entries longest unused, if all together exceed the limit; pinned ones stay."""
        fates = keep_recent(self.entries().withColumnRenamed("at", "last_access"), self.limit)
        self.remove([r["key"] for r in fates.where("not kept").collect()])

    def clean(self) -> int:
        """Deletes the tables that no entry names; for when nothing else reads or writes the cache. Returns how many."""
        live = {r["folder"] for r in self.entries().select("folder").distinct().collect()}
        jvm, conf = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        n = 0
        for part in ("hits", "seen"):
            p = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{part}")
            fs = p.getFileSystem(conf)
            for status in fs.listStatus(p) if fs.exists(p) else ():
                if status.getPath().getName() not in live:
                    n += fs.delete(status.getPath(), True)
        return n


def refresh_many(
    cache: ResultCache, keys: list[str], notes: DataFrame, manifest: DataFrame, generation: int, search: Callable[[DataFrame], DataFrame], failed: DataFrame | None = None
) -> DataFrame:
    """The hits (key, path, ...) of keys over notes: those cached, with the stale paths of each key searched again.

    search(notes) -> hits of notes with a column wanted, the keys to search each for. A path that is stale for several
    keys is read once. A path is stale for a key if it changed, is new to the manifest, or was not scanned for that key
    (it has come into scope since). Paths that failed to be read are not replaced, and hold the generation back, so
    that they are tried again.
    """
    cached = cache.find(keys)
    groups: dict[tuple[str, int] | None, list[str]] = {}
    for key in keys:
        groups.setdefault(cached.get(key), []).append(key)
    plans, kept, previous = [], [], generation
    for found, own in groups.items():
        if found is None:
            todo, previous = notes.select("path"), -1
        else:
            folder, scanned = found
            todo = stale(notes, manifest, scanned, cache.seen(folder))
            previous = min(previous, scanned)
            again = todo if failed is None else todo.join(failed.select("path"), "path", "left_anti")
            kept.append(cache.hits(folder, own).join(again, "path", "left_anti").join(notes.select("path"), "path", "left_semi"))
        plans.append(todo.distinct().select("path", F.array(*map(F.lit, own)).alias("_keys")))
    wanted = reduce(DataFrame.unionByName, plans).groupBy("path").agg(F.flatten(F.collect_list("_keys")).alias("wanted"))
    fresh = search(notes.join(wanted, "path"))
    seen = notes.select("path")
    if failed is not None:
        fresh = fresh.join(failed.select("path"), "path", "left_anti")
        seen = seen.join(failed.select("path"), "path", "left_anti")
        generation = safe_generation(failed, manifest, generation, previous).first()["generation"]
    merged = reduce(lambda a, b: a.unionByName(b), [fresh.drop("excerpt"), *kept])
    return cache.put(keys, merged, generation, seen)


def refresh(cache: ResultCache, key: str, notes: DataFrame, manifest: DataFrame, generation: int, search: Callable[[DataFrame], DataFrame], failed: DataFrame | None = None) -> DataFrame:
    """refresh_many() of one key, for a search(notes) whose hits have no key."""
    return refresh_many(cache, [key], notes, manifest, generation, lambda rows: search(rows).withColumn("key", F.lit(key)), failed)


def plan_flags(plans: DataFrame) -> DataFrame:
    """One row (all_warm, any_partial) of plans (key, needed, in_scope)."""
    return plans.agg(
        F.coalesce(F.bool_and(F.col("needed") == 0), F.lit(False)).alias("all_warm"), F.coalesce(F.bool_or((F.col("needed") > 0) & (F.col("needed") < F.col("in_scope"))), F.lit(False)).alias("any_partial")
    )


def terms_by_path(plans: DataFrame) -> DataFrame:
    """(path, keys): the terms that each path must be searched for, from plans (key, path)."""
    return plans.groupBy("path").agg(F.array_sort(F.collect_set("key")).alias("keys"))
