"""The change feed: create, modify, delete and rename events folded into a manifest, in batch or as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

SCHEMA = "seq bigint, op string, path string, old_path string, mtime bigint"


def as_upserts(events: DataFrame) -> DataFrame:
    """(seq, path, mtime): a rename is a deletion and a creation; a null mtime deletes. Only Markdown paths count."""
    upsert = F.struct(F.col("path").alias("path"), F.when(F.col("op") != "delete", F.col("mtime")).alias("mtime"))
    leave = F.struct(F.col("old_path").alias("path"), F.lit(None).cast("bigint").alias("mtime"))
    rows = events.select("seq", F.explode(F.when(F.col("op") == "rename", F.array(leave, upsert)).otherwise(F.array(upsert))).alias("x"))
    return rows.select("seq", "x.path", "x.mtime").where(F.col("path").endswith(".md"))


def latest(upserts: DataFrame) -> DataFrame:
    """(path, mtime, seq): the last state of each path; an aggregate with map-side combine."""
    return upserts.groupBy("path").agg(F.max_by("mtime", "seq").alias("mtime"), F.max("seq").alias("seq"))


def apply(manifest: DataFrame, events: DataFrame, generation: int) -> DataFrame:
    """The manifest (path, mtime, last_changed) after a batch; events that change nothing keep the old generation."""
    new = latest(as_upserts(events)).select("path", F.col("mtime").alias("_new"), F.lit(True).alias("_hit"))
    both = manifest.join(new, "path", "full_outer")
    gone = F.col("_hit").isNotNull() & F.col("_new").isNull()
    changed = F.col("_hit").isNotNull() & ~F.col("mtime").eqNullSafe(F.col("_new"))
    return both.where(~gone).select(
        "path", F.when(F.col("_hit"), F.col("_new")).otherwise(F.col("mtime")).alias("mtime"),
        F.when(changed, F.lit(generation)).otherwise(F.col("last_changed")).cast("bigint").alias("last_changed"),
    )


#: A block of sequence numbers, whose changes are counted together.
COUNTED = 100_000


def history(events: DataFrame) -> DataFrame:
    """(seq, path, mtime, generation): the upserts that change their path, repeats of an mtime being none, and how many there were up to each.

    Changes are counted for each block of sequence numbers, blocks are summed, and rows are numbered within theirs.
    """
    by_path = Window.partitionBy("path").orderBy("seq")
    rows = as_upserts(events).withColumn("before", F.lag("mtime").over(by_path))
    changed = rows.where(~F.col("mtime").eqNullSafe(F.col("before"))).drop("before").withColumn("_block", F.floor(F.col("seq") / COUNTED))
    blocks = changed.groupBy("_block").agg(F.count("*").alias("_n"))
    so_far = F.coalesce(F.sum("_n").over(Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row for each COUNTED events
    within = F.row_number().over(Window.partitionBy("_block").orderBy("seq", "mtime", "path"))
    out = changed.join(blocks.select("_block", so_far.alias("_before")), "_block")
    return out.select("seq", "path", "mtime", (F.col("_before") + within).cast("bigint").alias("generation"))


def follow(events: DataFrame, root: str, checkpoint: str, interval: str = "400 milliseconds") -> StreamingQuery:
    """Applies a stream of events batch after batch; the manifest of batch n is the table root/n.

    Batches run one at a time, and a repeated batch rewrites its own table from the one before it, so that a
    restart gives the same result. Tables older than the last two are not read again.
    """

    def batch(rows: DataFrame, n: int) -> None:
        spark = rows.sparkSession
        before = spark.read.parquet(f"{root}/{n - 1}") if n else spark.createDataFrame([], "path string, mtime bigint, last_changed bigint")
        apply(before, rows, n + 1).write.mode("overwrite").parquet(f"{root}/{n}")

    return events.writeStream.trigger(processingTime=interval).option("checkpointLocation", checkpoint).foreachBatch(batch).start()


def debounced(events: DataFrame, gap_ms: int, keys: list[str] | None = None) -> DataFrame:
    """events (ts_ms, ...): those after which nothing of their key comes for gap_ms; the last of each burst."""
    w = Window.partitionBy(*(keys or [])).orderBy("ts_ms")
    return events.withColumn("_next", F.lead("ts_ms").over(w)).where(F.col("_next").isNull() | (F.col("_next") - F.col("ts_ms") > gap_ms)).drop("_next")
