"""Term candidates of a note: headings, emphasis, highlights, prose phrases and n-grams, merged and ranked.

All candidates of a note come from its own text, so they are found, merged and ranked where its row is: one scan, no shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import kernels as K
from ..functions import text as T
from .markdown import protected_spans

_RAW = "source string, no bigint, start int, end int, query string"


def matches(rows: DataFrame, keys: list[str], text: str, pattern: str, group: int) -> DataFrame:
    """(keys, no, start, found): the groups of all matches of a pattern, with their offsets."""

    def kernel(body: str | None) -> Iterator[tuple[int, int, str]]:
        for no, m in enumerate(regex.finditer(pattern, body or "")):
            yield no, m.start(group), m.group(group)

    return K.per_note(rows, keys, [text], kernel, "no int, start int, found string")


def _raw(notes: DataFrame, keys: list[str], content: str, source: str, found) -> DataFrame:
    def kernel(body: str | None) -> Iterator[tuple[str, int, int, int, str]]:
        for no, start, end in found(body or ""):
            place = K.usable(body, start, end, [])
            if place:
                yield source, no, *place

    return K.per_note(notes, keys, [content], kernel, _RAW)


def inline(notes: DataFrame, keys: list[str], mark: str, source: str, content: str = "content") -> DataFrame:
    """Raw candidates (keys, source, no, start, end, query) between two equal marks (**, __ or ==) on one line."""
    return _raw(notes, keys, content, source, lambda text: K.inline_terms(text, mark))


def heading_terms(notes: DataFrame, keys: list[str], content: str = "content") -> DataFrame:
    return _raw(notes, keys, content, "heading", K.heading_terms)


def prose(notes: DataFrame, keys: list[str], low: int = 3, high: int = 32, content: str = "content", per_line: int = K.PER_LINE) -> DataFrame:
    """Phrases of three, two, then one word of each line that is no heading: the first per_line of usable length.

    no is the number of the line, times per_line, and that of the phrase in its line.
    """
    return _raw(notes, keys, content, "prose", lambda text: K.prose_terms(text, low, high, per_line))


def ngrams(notes: DataFrame, keys: list[str], low: int = 2, high: int = 6, limit: int = 12, run: str = K.CJK, content: str = "content") -> DataFrame:
    """Character n-grams of the runs of a script, long ones first, at most limit of each run."""
    return _raw(notes, keys, content, "ngram", lambda text: K.gram_terms(text, low, high, limit, run))


def extract(
    notes: DataFrame, keys: list[str], focused: bool = True, phrases: bool = True, broad: bool = False, low: int = 3, high: int = 32, gram_low: int = 2, gram_high: int = 6,
    most: int = 40, span_limit: int = 12, stop: list[str] | None = None, ignored: list[str] | None = None, case_sensitive: bool = False, protect: bool = True,
) -> DataFrame:
    """(keys, key, query, display, source, score, anchors, rank): the best terms of each row of notes (keys, content).

    Candidates stand outside protected regions (all of the text without protect) and are valid queries. Those of one
    normalised text are one: the first spelling is the query, the best source the display; anchors are distinct by
    place. Stop words, ignored terms and lengths outside the bounds go (n-grams have bounds of their own). Ranked by score,
    then length, then order. Null texts have none; rows are never mixed, even if their keys are equal.
    """
    wanted = K.Candidates(focused, phrases, broad, low, high, gram_low, gram_high, most, span_limit, stop or (), ignored or (), case_sensitive)

    def kernel(body: str | None) -> Iterator[tuple]:
        if body:
            yield from wanted.ranked(body, protected_spans(body) if protect else [])

    return K.per_note(notes, keys, ["content"], kernel, "key string, query string, display string, source string, score int, anchors array<struct<start:int,end:int>>, rank int")


def distinct_terms(terms: DataFrame, case_sensitive: bool = False) -> DataFrame:
    """terms (pos, term): the first spelling of each normalised, non-empty term, in order."""
    rows = terms.withColumn("key", T.term_key(F.col("term"), case_sensitive)).where("key <> ''")
    return rows.groupBy("key").agg(F.min_by("term", "pos").alias("term"), F.min("pos").alias("pos"))


def without(terms: DataFrame, banned: DataFrame, case_sensitive: bool = False) -> DataFrame:
    """terms (term, ...) that are not, normalised, among banned (term)."""
    keys = banned.select(T.term_key(F.col("term"), case_sensitive).alias("_key")).where("_key <> ''").distinct()
    return terms.withColumn("_key", T.term_key(F.col("term"), case_sensitive)).join(keys, "_key", "left_anti").drop("_key")
