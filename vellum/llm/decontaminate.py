"""Benchmark decontamination by a distributed positional inverted index: exact phrases and proximity.

Native throughout: joins, windows, aggregates and string functions only.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import Scratch, bitmap_of, may_contain, row_key

#: The letters folded, and what separates words.
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Slots of the broadcast filter of wanted positions: at most a 64th as many rows, whatever the input.
SLOTS = 1 << 26


def words(text: Column) -> Column:
    """The words of a text with A-Z folded; null has none. lower() is right, and far faster, where all is ASCII."""
    folded = F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))
    return F.coalesce(F.array_remove(F.split(folded, BETWEEN), ""), F.array().cast("array<string>"))


@dataclass
class Index:
    """postings (rid, pos from 1, tid) of the terms that any phrase has, heads (rid, id, row_key, n_words), and their lengths by term."""

    postings: DataFrame
    heads: DataFrame
    lengths: DataFrame
    vocabulary: DataFrame
    scratch: Scratch


def phrase_windows(items: DataFrame, id_col: str, text_col: str, n: int, scratch: Scratch) -> DataFrame:
    """Distinct windows (wid, win, len, items) of n consecutive words; a shorter item, unless wordless, is one window."""
    w = items.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("string").alias("item_id"), words(F.col(text_col)).alias("w")).where(F.size("w") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - (n - 1), F.lit(1)))
    each = w.select("item_id", F.explode(F.transform(starts, lambda i: F.slice(F.col("w"), i, n))).alias("win"))
    distinct = each.groupBy("win").agg(F.collect_set("item_id").alias("items"))
    return scratch.put(distinct.select(F.monotonically_increasing_id().alias("wid"), "win", F.size("win").alias("len"), "items"), "windows")


def build_index(docs: DataFrame, id_col: str, text_col: str, windows: DataFrame, scratch: Scratch) -> Index:
    """One pass over the texts. Position 0 of each row holds its id and length, so that no second pass is needed.

    Terms that no phrase has are dropped as they are read; the vocabulary is broadcast if Spark finds it small.
    """
    terms = windows.select(F.explode("win").alias("term")).distinct().unionByName(docs.sparkSession.range(1).select(F.lit("").alias("term")))
    vocabulary = scratch.put(terms.coalesce(1).select("term", F.monotonically_increasing_id().cast("int").alias("tid")), "vocabulary")
    rows = docs.select(F.col(id_col).alias("id"), row_key(id_col, text_col).alias("rk"), F.monotonically_increasing_id().alias("rid"), words(F.col(text_col)).alias("w"))
    tokens = rows.select("id", "rk", "rid", F.size("w").cast("bigint").alias("n_words"), F.posexplode(F.concat(F.array(F.lit("")), F.col("w"))).alias("pos", "term"))
    found = tokens.join(vocabulary, "term").select("rid", "pos", "tid", F.when(F.col("pos") == 0, F.col("id")).alias("id"), F.when(F.col("pos") == 0, F.col("rk")).alias("row_key"), F.when(F.col("pos") == 0, F.col("n_words")).alias("n_words"))
    all_ = scratch.put(found, "postings")
    postings = all_.where("pos > 0").select("rid", "pos", "tid")
    lengths = scratch.put(postings.groupBy("tid").agg(F.count("*").alias("df")), "lengths")
    return Index(postings, all_.where("pos = 0").select("rid", "id", "row_key", "n_words"), lengths, vocabulary, scratch)


def rarest_first(index: Index, windows: DataFrame) -> DataFrame:
    """(wid, len, off from 0, tid, step): the terms of each window by the length of their lists, shortest first.

    Windows with a term that no document has cannot occur and are left out.
    """
    each = windows.select("wid", "len", F.posexplode("win").alias("off", "term")).join(index.vocabulary, "term").join(index.lengths, "tid", "left")
    order = Window.partitionBy("wid").orderBy("df", "off")
    ranked = each.withColumn("step", F.row_number().over(order)).withColumn("some", F.min(F.coalesce("df", F.lit(0))).over(Window.partitionBy("wid")))
    return index.scratch.put(ranked.where("some > 0").select("wid", "len", "off", "tid", "step"), "steps")


def phrase_matches(index: Index, windows: DataFrame) -> DataFrame:
    """Every exact occurrence (rid, start from 1, wid, len) of the windows.

    The lists of the rarest terms, moved back by the terms' offsets, are the candidates; those of the next
    rarest are intersected with them, then those of all other terms together, read only at the positions
    where a surviving candidate wants one.
    """
    steps = rarest_first(index, windows)
    scratch = index.scratch
    first = steps.where("step = 1").select("tid", "wid", "len", "off")
    found = index.postings.join(first, "tid").select("rid", (F.col("pos") - F.col("off")).alias("start"), "wid", "len").where("start > 0")
    second = steps.where("step = 2").select("wid", F.col("tid").alias("tid2"), F.col("off").alias("off2"))
    wanted = found.join(second, "wid", "left").select("rid", "start", "wid", "len", "tid2", (F.col("start") + F.col("off2")).alias("pos2"))
    wanted = scratch.put(wanted, "rarest")
    lists = index.postings.join(second.select(F.col("tid2").alias("tid")).distinct(), "tid", "left_semi")
    lists = lists.select("rid", F.col("pos").alias("pos2"), F.col("tid").alias("tid2"))
    alone = wanted.where("len = 1").select("rid", "start", "wid", "len")
    both = wanted.where("len > 1").join(lists, ["rid", "pos2", "tid2"]).select("rid", "start", "wid", "len")
    both = scratch.put(both, "two-rarest")
    rest = steps.where("step > 2").select("wid", "off", F.col("tid"))
    asked = scratch.put(both.where("len > 2").join(rest, "wid").select("rid", (F.col("start") + F.col("off")).alias("pos"), "tid", "start", "wid", "len"), "asked")
    spot = F.xxhash64("rid", "pos")
    taken = bitmap_of(asked.select(spot.alias("spot")), "spot", SLOTS)
    near = may_contain(index.postings, spot, True, taken, SLOTS).where("bm_hit").drop("bm_hit")
    full = asked.join(near, ["rid", "pos", "tid"]).groupBy("rid", "start", "wid", "len").agg(F.count("*").alias("n")).where("n = len - 2")
    return alone.unionByName(both.where("len = 2")).unionByName(full.select("rid", "start", "wid", "len"))


def proximity_matches(index: Index, windows: DataFrame, slop: int) -> DataFrame:
    """(rid, anchor, wid): positions of a window's rarest term with all its other distinct terms at most slop words away.

    The range join is an equality join on cells of slop words and their neighbours.
    """
    steps = rarest_first(index, windows)
    anchors = index.postings.join(steps.where("step = 1").select("tid", "wid"), "tid").select("rid", F.col("pos").alias("anchor"), "wid", F.col("tid").alias("own"))
    anchors = anchors.distinct()
    terms = steps.select("wid", "tid").distinct()
    need = terms.groupBy("wid").agg((F.count("*") - 1).alias("need"))
    cell = F.floor(F.col("anchor") / (slop + 1)).cast("bigint")
    asked = anchors.withColumn("cell", F.explode(F.sequence(cell - 1, cell + 1))).join(terms, "wid").where("tid <> own")
    lists = index.postings.withColumn("cell", F.floor(F.col("pos") / (slop + 1)).cast("bigint"))
    met = asked.join(lists, ["rid", "tid", "cell"]).where(F.abs(F.col("pos") - F.col("anchor")) <= slop)
    got = met.groupBy("rid", "anchor", "wid").agg(F.countDistinct("tid").alias("got"))
    single = anchors.join(need.where("need = 0"), "wid").select("rid", "anchor", "wid")
    return got.join(need, "wid").where("got = need").select("rid", "anchor", "wid").unionByName(single)


def contamination(
    docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", n: int = 8, least_items: int = 2
) -> DataFrame:
    """One row for each row of docs: id, n_words, n_hit, n_items, items (sorted strings), contaminated, row_key.

    n_hit counts the words inside any occurrence of a window of n words of an item; n_items the items with an
    occurring window; contaminated means n_items >= least_items. Null or wordless texts have no words; null
    item ids are no items; repeated item ids are one item. Rows are told apart by their place, so repeated rows
    and null ids each keep their own result. Extra columns are not read. Without items, nothing is hit.
    """
    scratch = Scratch(docs.sparkSession, "index")
    windows = phrase_windows(items, item_col, item_text_col, n, scratch)
    index = build_index(docs, id_col, text_col, windows, scratch)
    matches = scratch.put(phrase_matches(index, windows), "matches")
    hit = matches.select("rid", F.explode(F.sequence("start", F.col("start") + F.col("len") - 1)).alias("pos")).distinct().groupBy("rid").agg(F.count("*").alias("n_hit"))
    named = matches.select("rid", "wid").distinct().join(windows.select("wid", F.explode("items").alias("item")), "wid")
    named = named.groupBy("rid").agg(F.sort_array(F.collect_set("item")).alias("items"))
    out = index.heads.join(hit, "rid", "left").join(named, "rid", "left")
    listed = F.coalesce("items", F.array().cast("array<string>"))
    return out.select(
        F.col("id").alias(id_col), "n_words", F.coalesce("n_hit", F.lit(0)).cast("bigint").alias("n_hit"), F.size(listed).cast("bigint").alias("n_items"),
        listed.alias("items"), (F.size(listed) >= least_items).alias("contaminated"), "row_key",
    )


ORACLE = f"""
WITH w AS (
  SELECT row_number() OVER () AS rid, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
b AS (
  SELECT item_id::VARCHAR AS item_id,
    regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark),
bw AS (
  SELECT DISTINCT item_id, least(len(w), 8) AS k, array_to_string(w[i : i + least(len(w), 8) - 1], ' ') AS win
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 7, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
ks AS (SELECT DISTINCT k FROM bw),
dw AS (
  SELECT rid, k, i, array_to_string(w[i : i + k - 1], ' ') AS win
  FROM (SELECT rid, k, w, unnest(range(1, len(w) - k + 2)) AS i FROM w, ks WHERE len(w) >= k)),
m AS (SELECT dw.rid, dw.i, dw.k, bw.item_id FROM dw JOIN bw USING (k, win)),
h AS (SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(range(i, i + k)) AS p FROM m) GROUP BY rid),
n AS (SELECT rid, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS s FROM (SELECT DISTINCT rid, item_id FROM m) GROUP BY rid)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(s, '')) AS items_sha256, coalesce(n_items, 0) >= 2 AS contaminated
FROM w LEFT JOIN h USING (rid) LEFT JOIN n USING (rid)
"""
