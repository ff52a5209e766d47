"""Interval expressions and operators over half-open [start, end)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def overlaps_any(spans: Column, start: Column, end: Column) -> Column:
    return F.exists(spans, lambda s: (start < s["end"]) & (end > s["start"]))


def merge_touching(rows: DataFrame, keys: list[str], start: str = "start", end: str = "end") -> DataFrame:
    """Unions overlapping or touching intervals of each key: gaps and islands, one sort."""
    w = Window.partitionBy(*keys).orderBy(start, end)
    reach = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    flagged = rows.withColumn("_new", F.when(F.col(start) <= reach, 0).otherwise(1))
    numbered = flagged.withColumn("_island", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(*keys, "_island").agg(F.min(start).alias(start), F.max(end).alias(end)).drop("_island")


def greedy_keep(items: Column) -> Column:
    """Greedy choice without overlap from array<struct<rank.., start, end, ..>>: items come in order of preference.

    A fold that keeps an item unless it overlaps one already kept; one array in, one array out, no shuffle.
    """
    nothing = F.filter(items, lambda x: F.lit(False))
    return F.aggregate(
        items, nothing, lambda kept, c: F.when(F.exists(kept, lambda k: (c["start"] < k["end"]) & (c["end"] > k["start"])), kept).otherwise(F.array_append(kept, c))
    )


def sweep_keep(items: Column) -> Column:
    """A sweep over items sorted by start: a mark that starts before the last kept mark ends is dropped, widgets pass."""
    nothing = F.filter(items, lambda x: F.lit(False))
    state = F.struct(nothing.alias("kept"), F.lit(-1).alias("reach"))

    def step(s: Column, c: Column) -> Column:
        mark = c["kind"] == "mark"
        drop = mark & (c["start"] < s["reach"])
        return F.struct(
            F.when(drop, s["kept"]).otherwise(F.array_append(s["kept"], c)).alias("kept"), F.when(mark & ~drop, c["end"]).otherwise(s["reach"]).alias("reach")
        )

    return F.aggregate(items, state, step, lambda s: s["kept"])
