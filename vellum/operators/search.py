"""The substring join of note bodies with terms: every occurrence, also overlapping ones, with folding and boundaries."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import kernels as K
from ..functions import text as T
from .markdown import protected_spans

#: One search holds at most so many terms in the driver and in each worker; more are searched block by block.
TERMS_AT_ONCE = 20_000
_FOUND = "key string, start int, end int, heading string, excerpt string"


def term_table(terms: DataFrame) -> DataFrame:
    """terms (key, query, case_sensitive) with the needle; keys without text are dropped, repeated keys are one."""
    query = T.trim(F.col("query"))
    needle = F.when(F.col("case_sensitive"), query).otherwise(T.fold(query))
    rows = terms.groupBy("key").agg(F.min(F.struct("query", "case_sensitive")).alias("t")).select("key", "t.*")
    return rows.withColumn("needle", needle).where("needle <> ''")


def _blocks(terms: DataFrame) -> Iterator[K.Terms]:
    """The terms, at most TERMS_AT_ONCE at a time (on average half as many)."""
    table = term_table(terms).select("key", "needle", "case_sensitive")
    first = table.limit(TERMS_AT_ONCE + 1).collect()
    if len(first) <= TERMS_AT_ONCE:
        yield K.Terms(map(tuple, first))
        return
    blocks = 2 * -(-table.count() // TERMS_AT_ONCE)
    for b in range(blocks):
        # A block that outgrows the bound would need a skewed hash of 64 bits.
        yield K.Terms(map(tuple, table.where(F.pmod(F.xxhash64("key"), F.lit(blocks)) == b).collect()))


def occurrences(notes: DataFrame, terms: DataFrame, keep: list[str], content: str = "content") -> DataFrame:
    """(keep, key, start, end): all occurrences of all terms, in one scan of the notes for each block of terms.

    Few terms are looked for one by one, more by one automaton; offsets take linear time. Every row of notes is a
    note: rows with equal keys each give their hits. Null and empty texts give none.
    """
    out = None
    for block in _blocks(terms):
        found = K.per_note(notes, keep, [content], block.occurrences, "key string, start int, end int")
        out = found if out is None else out.unionByName(found)
    return out


def hits(notes: DataFrame, terms: DataFrame, excerpt_length: int = 160, protect: bool = True, per_note: int | None = None, wanted: str | None = None) -> DataFrame:
    """(key, path, start, end, heading, excerpt, mtime): occurrences outside protected regions, with heading and excerpt.

    One scan of notes (path, mtime, content): spans and headings are found once for each note that has an occurrence,
    and nothing is shuffled. per_note keeps the first hits of each term and note; wanted names a column
    with the keys to search the note for (all, if it is null). Rows are never mixed, even if their paths are equal.
    """
    out = None
    for block in _blocks(terms):

        def kernel(content: str | None, keys: list[str] | None = None, block: K.Terms = block) -> Iterator[tuple]:
            found = sorted(block.occurrences(content), key=lambda x: x[1:])
            if keys is not None:
                found = [x for x in found if x[0] in keys]
            if not found:
                return
            spans = protected_spans(content)
            heads = list(K.headings(content, spans))
            at, head, taken = 0, "", {}
            for key, start, end in found:
                if protect and K.covered(spans, start, end):
                    continue
                taken[key] = taken.get(key, 0) + 1
                if per_note is not None and taken[key] > per_note:
                    continue
                while at < len(heads) and heads[at][2] <= start:
                    head, at = heads[at][1], at + 1
                yield key, start, end, head, K.excerpt(content, start, end, excerpt_length)

        found = K.per_note(notes, ["path", "mtime"], ["content", *([wanted] if wanted else [])], kernel, _FOUND)
        out = found if out is None else out.unionByName(found)
    return out.select("key", "path", "start", "end", "heading", "excerpt", "mtime")


def with_excerpts(found: DataFrame, notes: DataFrame, excerpt_length: int = 160) -> DataFrame:
    """Hits with their excerpts rebuilt from notes (path, content); '' where a note is gone or too short. Of repeated paths, one row counts."""
    bodies = notes.groupBy("path").agg(F.min("content").alias("_body"))
    here = F.col("_body").isNotNull() & (F.col("start") >= 0) & (F.col("end") <= F.length("_body"))
    text = F.when(here, T.excerpt(F.col("_body"), F.col("start"), F.col("end"), excerpt_length)).otherwise("")
    return found.drop("excerpt").join(bodies, "path", "left").withColumn("excerpt", text).select("key", "path", "start", "end", "heading", "excerpt", "mtime")


def top_hits(found: DataFrame, per_note: int, keys: tuple[str, ...] = ("key", "path")) -> DataFrame:
    """The first hits of each term and note."""
    w = Window.partitionBy(*keys).orderBy("start")
    return found.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= per_note).drop("_n")


def cap_notes(found: DataFrame, notes_per_term: int) -> DataFrame:
    """All hits of the first notes, by path, of each term: a rank that Spark limits before the shuffle, so that a
    task sends at most the hits of so many notes of each term."""
    w = Window.partitionBy("key").orderBy("path")
    return found.withColumn("_n", F.dense_rank().over(w)).where(F.col("_n") <= notes_per_term).drop("_n")


def candidates(found: DataFrame, titles: DataFrame | None = None) -> DataFrame:
    """(key, path, stem, title, hits): hits of a note in order; title from titles (path, title), else the stem."""
    rows = found.groupBy("key", "path").agg(F.array_sort(F.collect_list(F.struct("start", "heading", "excerpt"))).alias("hits"))
    rows = rows.withColumn("stem", T.stem(F.col("path")))
    if titles is None:
        return rows.withColumn("title", F.col("stem"))
    named = titles.groupBy("path").agg(F.min("title").alias("title"))
    return rows.join(named, "path", "left").withColumn("title", F.coalesce(F.nullif(T.trim(F.col("title")), F.lit("")), F.col("stem")))


def in_order(found: DataFrame) -> DataFrame:
    """Hits by path, as people sort names, and offset."""
    return found.orderBy(F.collate("path", "UNICODE"), "start")
