"""Anchors: places in a source text that carry a term. Choice, lookup, stepping, and mapping through edits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.intervals import greedy_keep, sweep_keep


def without_overlap(anchors: DataFrame, keys: list[str]) -> DataFrame:
    """anchors (keys, start, end, score, stable, ...) without overlaps: score, then length, then place, then order wins."""
    rest = [c for c in anchors.columns if c not in keys]
    item = F.struct(
        (-F.col("score")).alias("p1"), (F.col("start") - F.col("end")).alias("p2"), F.col("start").alias("p3"), F.col("stable").alias("p4"), *rest
    )
    grouped = anchors.groupBy(*keys).agg(F.array_sort(F.collect_list(item)).alias("items"))
    kept = grouped.select(*keys, F.explode(greedy_keep(F.col("items"))).alias("x"))
    return kept.select(*keys, *(f"x.{c}" for c in rest))


def drawable(ranges: DataFrame, keys: list[str]) -> DataFrame:
    """ranges (keys, start, end, kind, sort_order) that can be drawn together: marks do not overlap, widgets stay."""
    item = F.struct("start", "sort_order", "end", "kind")
    grouped = ranges.groupBy(*keys).agg(F.array_sort(F.collect_list(item)).alias("items"))
    return grouped.select(*keys, F.explode(sweep_keep(F.col("items"))).alias("x")).select(*keys, "x.start", "x.end", "x.kind", "x.sort_order")


def marks_and_badges(anchors: DataFrame, keys: list[str], badges: bool = True) -> DataFrame:
    """A mark for each anchor and a badge at its end."""
    mark = F.struct(F.col("start").alias("start"), F.col("end").alias("end"), F.lit("mark").alias("kind"), F.lit(0).alias("sort_order"))
    badge = F.struct(F.col("end").alias("start"), F.col("end").alias("end"), F.lit("widget").alias("kind"), F.lit(1).alias("sort_order"))
    return anchors.select(*keys, F.explode(F.array(mark, badge) if badges else F.array(mark)).alias("x")).select(*keys, "x.*")


def at_point(points: DataFrame, anchors: DataFrame, keys: list[str]) -> DataFrame:
    """For each point (keys, at): the smallest anchor (keys, id, start, end) that holds it, ends included; ties by place and id."""
    met = points.join(anchors, keys).where((F.col("start") <= F.col("at")) & (F.col("at") <= F.col("end")))
    return met.groupBy(*keys, "at").agg(F.min_by("id", F.struct((F.col("end") - F.col("start")).alias("n"), F.col("start"), F.col("end"), F.col("id").alias("i"))).alias("id"))


def neighbours(points: DataFrame, anchors: DataFrame, keys: list[str]) -> DataFrame:
    """For each point: the next and the previous anchor in the order of the text, around the end.

    Inside an anchor they are those beside it; elsewhere the first that starts behind the point, the last
    that ends before it.
    """
    order = Window.partitionBy(*keys).orderBy("start", "end", "id")
    every = Window.partitionBy(*keys)
    placed = anchors.select(*keys, "id", "start", "end").withColumn("n", F.row_number().over(order)).withColumn("of", F.count("*").over(every))
    inside = at_point(points, anchors, keys).withColumnRenamed("id", "inside")
    rank = F.struct("start", "end", "id")
    met = points.join(placed, keys).join(inside, [*keys, "at"], "left")
    here = F.max(F.when(F.col("id") == F.col("inside"), F.col("n"))).over(Window.partitionBy(*keys, "at"))
    met = met.withColumn("here", here)
    beside = lambda step: F.max(F.when(F.col("n") == F.pmod(F.col("here") - 1 + step, F.col("of")) + 1, F.col("id")))
    behind = F.min_by("id", F.when(F.col("start") > F.col("at"), rank))
    before = F.max_by("id", F.when(F.col("end") < F.col("at"), rank))
    return met.groupBy(*keys, "at").agg(
        F.coalesce(beside(1), F.when(F.max("here").isNull(), F.coalesce(behind, F.min_by("id", rank)))).alias("next_id"),
        F.coalesce(beside(-1), F.when(F.max("here").isNull(), F.coalesce(before, F.max_by("id", rank)))).alias("previous_id"),
    )


def still_there(text: Column, start: Column, end: Column, expected: Column, case_sensitive: bool = False) -> Column:
    """The text still has the expected term at a place."""
    part = F.substring(text, start + 1, end - start)
    same = T.term_key(part, case_sensitive) == T.term_key(expected, case_sensitive)
    return (start >= 0) & (end <= F.length(text)) & (start < end) & same


def same_text(text: Column, start: Column, end: Column, expected: Column, case_sensitive: bool = False) -> Column:
    """As still_there(), letter by letter: the lengths agree and white space counts."""
    part = F.substring(text, start + 1, end - start)
    same = part == expected if case_sensitive else T.fold(part) == T.fold(expected)
    return (start >= 0) & (end <= F.length(text)) & (end - start == F.length(expected)) & same


def through_edits(anchors: DataFrame, edits: DataFrame, keys: list[str]) -> DataFrame:
    """anchors (keys, id, start, end, text) after simultaneous edits (keys, start, end, insert), untouched ones only.

    An anchor moves by what the edits before it gained; one that an edit overlaps, or into which text is put,
    has another length and is dropped. The edits of a text meet each anchor as one array, so no row is made for
    a pair, nothing is grouped by anchors, and equal anchors stay as many as they are.
    """
    edit = F.struct(F.col("start").alias("s"), F.col("end").alias("e"), (F.length("insert") - (F.col("end") - F.col("start"))).cast("bigint").alias("gain"))
    e = edits.groupBy(*keys).agg(F.collect_list(edit).alias("_edits"))
    before = lambda x: x["e"] <= F.col("start")
    hit = F.exists("_edits", lambda x: (x["s"] < F.col("end")) & (x["e"] > F.col("start")))
    by = F.aggregate("_edits", F.lit(0).cast("bigint"), lambda n, x: n + F.when(before(x), F.coalesce(x["gain"], F.lit(0))).otherwise(0))
    out = anchors.join(e, keys, "left").where(~F.coalesce(hit, F.lit(False))).withColumn("_by", F.coalesce(by, F.lit(0)))
    moved = {"start": (F.col("start") + F.col("_by")).cast("int"), "end": (F.col("end") + F.col("_by")).cast("int")}
    return out.select(*((moved[c].alias(c) if c in moved else F.col(c)) for c in anchors.columns))


def whole_replaced(edits: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, replaced): the edits (keys, start, end, length) cover a text from its start, but for one last character at most.

    One row for each text with an edit; insertions cover nothing.
    """
    w = Window.partitionBy(*keys).orderBy("start", "end")
    covers = F.col("end") > F.col("start")
    grown = edits.withColumn("_reach", F.coalesce(F.max(F.when(covers, F.col("end"))).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    gap = F.max(F.when(covers & (F.col("start") > F.col("_reach")), 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0))
    far = F.coalesce(F.max(F.when(covers & (F.col("_gap") == 0), F.col("end"))), F.lit(0))
    return grown.withColumn("_gap", gap).groupBy(*keys).agg(((F.max("length") > 0) & (far >= F.greatest(F.max("length") - 1, F.lit(1)))).alias("replaced"))


def spots(text: Column, source: Column, start: Column, end: Column, found: Column, can_link: Column) -> Column:
    """The anchors of a search: the selected place itself, or all places found if they can carry a link."""
    own = F.array(F.struct(start.alias("start"), end.alias("end"), F.substring(text, start + 1, end - start).alias("text")))
    none = F.filter(own, lambda x: F.lit(False))
    return F.when(source == "selection", own).when(can_link, found).otherwise(none)


def step(index: Column, by: int, n: Column) -> Column:
    return F.when(n > 0, F.pmod(index + by, n)).otherwise(-1)
