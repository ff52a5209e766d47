"""Result sessions: groups of candidates and anchors as one nested row, and what is asked of them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def build(groups: DataFrame, anchors: DataFrame, path: str, mode: str) -> DataFrame:
    """One row (path, mode, groups, anchors) from groups (key, query, display, can_link, candidates) and anchors
    (id, start, end, text, group_key). Groups without an anchor are left out in automatic mode."""
    if mode == "auto":
        groups = groups.join(anchors.select(F.col("group_key").alias("key")).distinct(), "key", "left_semi")
    g = groups.agg(F.array_sort(F.collect_list(F.struct("key", "query", "display", "can_link", "candidates"))).alias("groups"))
    a = anchors.agg(F.array_sort(F.collect_list(F.struct("start", "end", "id", "text", "group_key"))).alias("anchors"))
    one = g.crossJoin(a)  # one row each
    return one.select(F.lit(path).alias("path"), F.lit(mode).alias("mode"), "groups", "anchors")


def stats(hits: DataFrame, anchors: DataFrame) -> DataFrame:
    """(n_anchors, n_groups, n_groups_found, n_notes) from hits (key, path) and anchors (group_key)."""
    by = hits.agg(F.countDistinct("key").alias("n_groups_found"), F.countDistinct("path").alias("n_notes"))
    return anchors.agg(F.count("*").alias("n_anchors"), F.countDistinct("group_key").alias("n_groups")).crossJoin(by)  # one row each


def without_group(session: DataFrame, key: str) -> DataFrame:
    """A session without a group and its anchors; what is left without anchors is empty."""
    anchors = F.filter("anchors", lambda a: a["group_key"] != key)
    groups = F.filter("groups", lambda g: (g["key"] != key) & (F.size(anchors) > 0))
    return session.withColumn("groups", groups).withColumn("anchors", anchors)


def lookup(session: DataFrame, anchor_id: str, candidate: int = 0, hit: int = 0) -> DataFrame:
    """(group, candidate, hit) that an anchor leads to; indexes beyond the end mean the first."""
    anchor = F.try_element_at(F.filter("anchors", lambda a: a["id"] == anchor_id), F.lit(1))
    found = session.withColumn("anchor", anchor).withColumn("grp", F.expr("try_element_at(filter(groups, g -> g.key = anchor.group_key), 1)"))
    pick = lambda a, i: F.coalesce(F.get(a, F.lit(i)), F.get(a, F.lit(0)))
    found = found.withColumn("candidate", pick(F.col("grp.candidates"), candidate))
    return found.select(F.col("grp").alias("group"), "candidate", pick(F.col("candidate.hits"), hit).alias("hit"))
