"""The engine: notes and settings in, hits, candidates, sessions and links out."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import anchors as A
from ..operators import extract as X
from ..operators import incremental as I
from ..operators import markdown as M
from ..operators import scope as S
from ..operators import search as Q
from ..operators import sessions
from .config import EngineConfig


class Engine:
    """Searches notes (path, mtime, size, content) for terms.

    Everything returns a lazy DataFrame; a search is one pass over the bodies in scope, whatever the number of
    terms. Scope is decided on metadata, and the paths in scope are joined to the bodies.
    """

    def __init__(self, spark: SparkSession, notes: DataFrame, config: EngineConfig | None = None, now_ms: int = 0, opens: DataFrame | None = None):
        self.spark, self.notes, self.config, self.now_ms, self.opens = spark, notes, config or EngineConfig(), now_ms, opens

    def scope(self, self_path: str | None = None) -> DataFrame:
        """The notes to search: (path, mtime, size, content)."""
        c = self.config
        opened = S.workset(self.opens, c.workset_size) if self.opens is not None else self.spark.createDataFrame([], "path string")
        meta = S.scoped(
            self.notes.select("path", "mtime", "size"), self.now_ms, c.scope_mode, list(c.include_folders), list(c.exclude_folders), c.recent_days, opened, c.max_file_bytes, self_path
        )
        return self.notes.join(S.newest(meta, c.max_files).select("path"), "path", "left_semi")

    def terms(self, queries: list[str]) -> DataFrame:
        """A table of usable terms; what fails validation is an error. One job, whatever their number."""
        rows = self.spark.createDataFrame([(q,) for q in queries], "query string")
        told = rows.select("query", T.term_key(F.col("query"), self.config.case_sensitive).alias("key"), T.query_error(F.col("query")).alias("error")).collect()
        for r in told:
            if r["error"]:
                raise ValueError(r["error"])
        return self.spark.createDataFrame([(r["key"], r["query"], self.config.case_sensitive) for r in told], "key string, query string, case_sensitive boolean")

    def search_many(self, queries: list[str] | DataFrame, self_path: str | None = None) -> DataFrame:
        """Hits of all terms: first hits of each note, then first notes of each term."""
        c = self.config
        terms = queries if isinstance(queries, DataFrame) else self.terms(queries)
        return Q.cap_notes(Q.hits(self.scope(self_path), terms, c.excerpt_length, per_note=c.max_hits_per_note), c.max_candidate_notes)

    def search(self, query: str, self_path: str | None = None) -> DataFrame:
        return self.search_many([query], self_path)

    def search_if_present(self, query: str, path: str) -> DataFrame:
        """As search(), for a phrase typed or pasted: it must occur in the open note, else no body is read."""
        terms = self.terms([query])
        own = self.notes.where(F.col("path") == path)
        if Q.occurrences(own, terms, ["path"]).isEmpty():
            return self.spark.createDataFrame([], "key string, path string, start int, end int, heading string, excerpt string, mtime bigint")
        return self.search_many(terms, path)

    def extract(self, path: str) -> DataFrame:
        """The ranked term candidates of a note."""
        c = self.config
        own = self.notes.where(F.col("path") == path)
        return X.extract(
            own, ["path"], c.focused_extraction, c.normal_prose_phrases, c.broad_ngram, c.auto_min_term_length, c.auto_max_term_length, c.ngram_min_length, c.ngram_max_length,
            c.max_auto_queries, c.ngram_span_limit, list(c.auto_stop_words), list(c.ignored_terms), c.case_sensitive,
        )

    def auto(self, path: str) -> DataFrame:
        """The session of a note: its terms that occur elsewhere, their candidates, and anchors without overlaps."""
        terms = self.extract(path)
        hits = self.search_many(terms.select("key", "query", F.lit(self.config.case_sensitive).alias("case_sensitive")), path)
        groups = Q.candidates(hits).groupBy("key").agg(F.array_sort(F.collect_list(F.struct("path", "stem", "title", "hits"))).alias("candidates"))
        found = terms.join(groups, "key")
        spots = found.select("key", "score", "rank", F.posexplode("anchors").alias("i", "a"), "query").select(
            F.lit(path).alias("note"), F.col("a.start").alias("start"), F.col("a.end").alias("end"), "score", (F.col("rank") * 1_000_000 + F.col("i")).alias("stable"), "query", F.col("key").alias("group_key")
        )
        kept = A.without_overlap(spots, ["note"])
        kept = kept.select(T.identity(F.col("start"), F.col("end"), F.col("group_key")).alias("id"), "start", "end", F.col("query").alias("text"), "group_key")
        return sessions.build(found.select("key", "query", "display", F.lit(True).alias("can_link"), "candidates"), kept, path, "auto")

    def cache_mark(self) -> str:
        """What of the settings decides a result, with the paths of the working set where that does (at most workset_size)."""
        c = self.config
        opened = None
        if "workset" in c.scope_mode:
            opened = [] if self.opens is None else [r["path"] for r in S.workset(self.opens, c.workset_size).collect()]
        mark = S.fingerprint(c.scope_mode, list(c.include_folders), list(c.exclude_folders), c.recent_days, c.max_files, c.max_file_bytes, workset=opened)
        return self.spark.range(1).select(mark.alias("p")).first()["p"]

    def refresh_many(self, queries: list[str], cache: I.ResultCache, manifest: DataFrame, generation: int, failed: DataFrame | None = None) -> DataFrame:
        """As search_many(), from the cache: only notes that changed or came into scope are read, each once for all terms.

        What is cached is not capped and has no excerpts; those are cut again from the notes.
        """
        c = self.config
        tail = f"\u0000{int(c.case_sensitive)}\u0000{self.cache_mark()}"
        terms = self.terms(queries).withColumn("key", F.concat("key", F.lit(tail)))
        keys = [r["key"] for r in terms.select("key").distinct().collect()]
        notes = self.scope()
        found = I.refresh_many(cache, keys, notes, manifest, generation, lambda rows: Q.hits(rows, terms, c.excerpt_length, wanted="wanted"), failed)
        found = Q.cap_notes(Q.top_hits(found, c.max_hits_per_note), c.max_candidate_notes)
        return Q.with_excerpts(found, notes, c.excerpt_length).withColumn("key", F.substring_index("key", "\u0000", 1))

    def refresh(self, query: str, cache: I.ResultCache, manifest: DataFrame, generation: int, failed: DataFrame | None = None) -> DataFrame:
        return self.refresh_many([query], cache, manifest, generation, failed)

    @contextmanager
    def tagged(self, tag: str) -> Iterator[None]:
        """What runs inside can be stopped by cancel(), from another thread."""
        self.spark.addTag(tag)
        try:
            yield
        finally:
            self.spark.removeTag(tag)

    def cancel(self, tag: str) -> list[str]:
        return self.spark.interruptTag(tag)

    def link(self, start: int, end: int, expected: str, source: DataFrame, target: DataFrame, offset: int, seen_mtime: int, wiki: bool = True) -> DataFrame:
        """(content, linked): the source note with a link over an anchor, if the anchor still stands and the target is as seen.

        The heading is that of the target's offset now. source and target are single notes.
        """
        heads = M.headings(target, ["path"]).groupBy("path").agg(F.collect_list(F.struct("start", "text")).alias("heads"))  # outside code
        goal = target.join(heads, "path", "left").select(F.col("path").alias("_to"), F.col("mtime").alias("_seen"), "heads")
        both = source.select("content").crossJoin(goal)  # one row each
        place: tuple[Column, Column] = (F.lit(start), F.lit(end))
        valid = A.still_there(F.col("content"), *place, F.lit(expected), self.config.case_sensitive) & (F.col("_seen") == seen_mtime)
        heading = M.resolve_heading(F.coalesce("heads", F.array().cast("array<struct<start:int,text:string>>")), F.lit(offset), F.lit(""))
        live = F.substring(F.col("content"), start + 1, end - start)
        text = T.splice(F.col("content"), *place, T.link_text(F.regexp_replace("_to", r"\.md$", ""), heading, live, wiki))
        return both.select(F.when(valid, text).otherwise(F.col("content")).alias("content"), valid.alias("linked"))
