"""Fuzzy duplicate lines: character-shingle MinHash, exact Jaccard, one line kept for each component."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .minhash import char_shingles, text_components
from .shared import Scratch, bitmap_of, may_contain, row_key, spread_join

#: What is trimmed from the ends of a line.
BLANK = " \t\r\x0b\x0c"


def _lines(text: Column) -> Column:
    return F.split(text, "\n")


def _trimmed(line: Column) -> Column:
    return F.btrim(line, F.lit(BLANK))


def duplicate_lines(
    docs: DataFrame, scratch: Scratch, id_col: str, text_col: str, n_chars: int, share: tuple[int, int], bands: int, rows: int, min_chars: int
) -> DataFrame:
    """The lines to drop: (id, rk, drop: array of line numbers from 0), rk = row_key()."""
    base = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where("text is not null")
    each = base.select(F.explode(_lines(F.col("text"))).alias("line")).select(_trimmed(F.col("line")).alias("text"))
    each = each.where(F.length("text") >= min_chars).select(F.xxhash64("text").alias("key"), "text")
    roots = text_components(each, lambda lines: char_shingles(lines, n_chars), share, bands, rows, scratch)
    place = base.withColumn("rk", row_key("id", "text")).select("id", "rk", F.posexplode(_lines(F.col("text"))).alias("no", "line"))
    place = place.withColumn("line", _trimmed(F.col("line"))).where(F.length("line") >= min_chars)
    place = place.select("id", "rk", F.col("no"), F.xxhash64("line").alias("key"))
    place = scratch.put(place, "places")
    # Lines that occur twice or are linked; where each stands is only asked of those.
    often = place.groupBy("key").agg(F.count("*").alias("n"))
    linked = roots.withColumnRenamed("node", "key")
    some = often.join(linked, "key", "left").where("n > 1 or root is not null").select("key", F.coalesce("root", "key").alias("root"), "n")
    some = scratch.put(some, "repeated")
    maybe = may_contain(place, F.col("key"), True, bitmap_of(some, "key")).where("bm_hit").drop("bm_hit")
    maybe = spread_join(maybe, some.select("key", "root"), "key", "rk", scratch, some)
    maybe = scratch.put(maybe.select("id", "rk", "no", "root"), "repeats")
    first = F.min(F.struct(F.col("id").isNull(), F.col("id").alias("id"), "rk", "no"))
    keep = scratch.put(maybe.groupBy("root").agg(first.alias("first"), F.count("*").alias("n")), "keep")
    drop = spread_join(maybe, keep.select("root", "first"), "root", "rk", scratch, keep)
    drop = drop.where(~(F.col("first.id").eqNullSafe(F.col("id")) & (F.col("first.rk") == F.col("rk")) & (F.col("first.no") == F.col("no"))))
    return scratch.put(drop.groupBy("id", "rk").agg(F.collect_set("no").alias("drop")), "drop")


def dedup_lines(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    n_chars: int = 7,
    share: tuple[int, int] = (80, 100),
    bands: int = 10,
    rows: int = 4,
    min_chars: int = 1,
) -> DataFrame:
    """docs with duplicate lines removed from text_col, and columns n_lines and n_removed (replaced if docs has them).

    Lines, trimmed of white space, are linked when share[1] * |intersection| >= share[0] * |union| of their
    distinct shingles of n_chars characters. Of each component only one line stays: that of the smallest id
    (nulls last), first in its text. Banding misses a link at the threshold t with probability
    (1 - t^rows)^bands; every link found is verified exactly. Lines shorter than min_chars, empty ones among them, stay.

    Null texts stay null with no lines; empty texts have one empty line. Rows with equal ids and texts are one
    document and treated alike. All columns of docs are returned. Lines are told apart by 64-bit hashes.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "lines")
    drop = duplicate_lines(docs, scratch, id_col, text_col, n_chars, share, bands, rows, min_chars)
    packed = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("doc"), F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    packed = packed.withColumn("rk", row_key("id", "text"))
    marked = may_contain(packed, F.col("rk"), True, bitmap_of(drop, "rk"))
    clean = marked.where("not bm_hit").select("doc", "text", F.lit(None).cast("array<int>").alias("drop"))
    on = [marked["rk"] == drop["rk"], marked["id"].eqNullSafe(drop["id"])]
    touched = marked.where("bm_hit").join(drop, on, "left").select("doc", "text", "drop")
    out = clean.unionByName(touched)
    left = F.filter(F.transform(_lines(F.col("text")), lambda x, i: F.struct(x.alias("x"), i.alias("i"))), lambda y: ~F.array_contains(F.col("drop"), y["i"]))
    text = F.when(F.col("drop").isNull(), F.col("text")).otherwise(F.array_join(F.transform(left, lambda y: y["x"]), "\n"))
    mine = {text_col: text, "n_lines": F.coalesce(F.size(_lines(F.col("text"))), F.lit(0)), "n_removed": F.coalesce(F.array_size("drop"), F.lit(0))}
    names = [*docs.columns, *(c for c in ("n_lines", "n_removed") if c not in docs.columns)]
    return out.select(*(mine[c].alias(c) if c in mine else F.col("doc").getField(c).alias(c) for c in names))
