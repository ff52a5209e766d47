"""Which notes a search reads: metadata predicates first, bodies never touched."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import normal_folder, normal_path

DAY_MS = 86_400_000


def in_folders(path: Column, include: list[str], exclude: list[str]) -> Column:
    """Excluded folders win; no included folder means all; a folder holds itself and what is below it."""
    p = normal_path(path)

    def any_of(folders: list[str]) -> Column:
        clean = F.filter(F.array(*(normal_folder(F.lit(f)) for f in folders)), lambda f: f != "")
        return F.exists(clean, lambda f: (p == f) | F.startswith(p, F.concat(f, F.lit("/"))))

    out = ~any_of(exclude) if exclude else F.lit(True)
    return out & any_of(include) if include else out


def is_recent(mtime: Column, now_ms: int, days: int) -> Column:
    return F.lit(True) if days <= 0 else mtime >= now_ms - days * DAY_MS


def workset(opens: DataFrame, size: int) -> DataFrame:
    """The most recently opened distinct paths of opens (path, ts); ties go to the smaller path."""
    last = opens.groupBy("path").agg(F.max("ts").alias("ts"))
    return last.orderBy(F.desc("ts"), "path").limit(max(0, size)).select("path")


def scoped(
    notes: DataFrame,
    now_ms: int,
    mode: str = "all",
    include: list[str] | None = None,
    exclude: list[str] | None = None,
    recent_days: int = 30,
    opened: DataFrame | None = None,
    max_bytes: int = 512_000,
    self_path: str | None = None,
) -> DataFrame:
    """notes (path, mtime, size, ...) that are in scope, with fits: size <= max_bytes. The working set is joined, not collected."""
    out = notes if self_path is None else notes.where(F.col("path") != self_path)
    out = out.where(in_folders(F.col("path"), include or [], exclude or []))
    recent = is_recent(F.col("mtime"), now_ms, recent_days)
    if mode == "recent":
        out = out.where(recent)
    elif mode == "workset":
        out = out.join(opened, "path", "left_semi")
    elif mode == "recent-workset":
        out = out.join(opened.select("path", F.lit(True).alias("_open")), "path", "left").where(recent | F.col("_open")).drop("_open")
    return out.withColumn("fits", F.col("size") <= max_bytes)


def newest(notes: DataFrame, max_files: int) -> DataFrame:
    """The newest notes that fit, ties by path: a top-k, never a full sort."""
    return notes.where("fits").orderBy(F.desc("mtime"), "path").limit(max_files)


def skip_counts(notes: DataFrame, max_files: int) -> DataFrame:
    fit = F.count_if("fits")
    return notes.agg(F.count_if(~F.col("fits")).alias("skipped_by_size"), F.greatest(fit - max_files, F.lit(0)).alias("skipped_by_limit"), F.least(fit, F.lit(max_files)).alias("kept"))


def fingerprint(mode: str, include: list[str], exclude: list[str], recent_days: int, max_files: int, max_bytes: int, extra: dict[str, int] | None = None, workset: list[str] | None = None) -> Column:
    """A canonical JSON text of the settings that decide a result, with the working set if that does; the order of folders and paths doesn't matter."""
    return F.to_json(
        F.struct(
            F.sort_array(F.array(*map(F.lit, exclude)).cast("array<string>")).alias("exclude"), F.sort_array(F.array(*map(F.lit, include)).cast("array<string>")).alias("include"),
            F.lit(max_bytes).alias("max_bytes"), F.lit(max_files).alias("max_files"), F.lit(mode).alias("mode"), F.lit(recent_days).alias("recent_days"),
            *(F.lit(v).alias(k) for k, v in sorted((extra or {}).items())),
            *([F.sort_array(F.array(*map(F.lit, workset)).cast("array<string>")).alias("workset")] if workset is not None else []),
        )
    )
