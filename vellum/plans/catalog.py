"""The registered queries over the driver's tables, each with the DuckDB text that gives the same rows.

documents are the notes: the path is source/doc_id.md, the folder the source, the time an expression of doc_id.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import intervals
from ..functions.kernels import PER_LINE
from ..functions import text as T
from ..functions.tasks import dealt_by_size
from ..operators import anchors as A
from ..operators import extract as X
from ..operators import incremental as I
from ..operators import markdown as M
from ..operators import scope as S
from ..operators import search as Q
from ..operators import sessions
from ..sources.notes import documents_as_notes
from ..streaming import changes
from .config import EngineConfig
from .engine import Engine

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

NOW = 1_700_000_000_000 + 900 * 3_600_000
TERMS = ("the", "of", "and the")
#: The notes in DuckDB, and the Markdown text derived from them, as in notes() and markdown().
NOTES = """notes AS (SELECT source || '/' || doc_id::VARCHAR || '.md' AS path, 1700000000000 + doc_id * 3600000 AS mtime,
  strlen(text)::BIGINT AS size, text AS content, doc_id, source FROM documents)"""
#: What would start a protected region in a document is blanked, so that only the planted ones are protected.
MARKS = "`$[]<#~"
MD = f"""md AS (SELECT source || '/' || doc_id::VARCHAR || '.md' AS path, '# ' || source || chr(10) || chr(10) || '**' || substr(clean, 1, 12)
  || '** and ==' || substr(clean, 20, 9) || '==' || chr(10) || clean || chr(10) || '```' || chr(10) || '# the fenced' || chr(10) || 'of it' || chr(10) || '===' || chr(10) || '```' || chr(10)
  || '## Part ' || doc_id::VARCHAR || ' ##' || chr(10) || substr(clean, 1, 200) || chr(10) || '### With `the code` in ' || doc_id::VARCHAR || chr(10) || 'Lower title' || chr(10) || '---' || chr(10) || 'tail' AS content
  FROM (SELECT *, translate(text, '{MARKS}', '       ') AS clean FROM documents))"""
FOLDED = "replace(lower(content), 'ς', 'σ')"


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents_as_notes(table(spark, sf_dir, "documents"))


def markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Markdown made of the documents: headings of both kinds, emphasis, a fence and inline code around what looks like a heading or a term."""
    d = table(spark, sf_dir, "documents").withColumn("clean", F.translate("text", MARKS, " " * len(MARKS)))
    number = F.col("doc_id").cast("string")
    parts = [
        "# ", F.col("source"), "\n\n**", F.substring("clean", 1, 12), "** and ==", F.substring("clean", 20, 9), "==\n", F.col("clean"), "\n```\n# the fenced\nof it\n===\n```\n## Part ", number, " ##\n",
        F.substring("clean", 1, 200), "\n### With `the code` in ", number, "\nLower title\n---\ntail",
    ]
    body = F.concat(*(F.lit(x) if isinstance(x, str) else x for x in parts))
    return d.select(F.concat("source", F.lit("/"), number, F.lit(".md")).alias("path"), body.alias("content"))


def terms(spark: SparkSession, words: tuple[str, ...] = TERMS, case_sensitive: bool = False) -> DataFrame:
    rows = F.explode(F.array(*map(F.lit, words))).alias("query")
    return spark.range(1).select(rows).select(T.term_key(F.col("query"), case_sensitive).alias("key"), "query", F.lit(case_sensitive).alias("case_sensitive"))


def _hits_sql(words: tuple[str, ...], folded: bool = True, name: str = "hits", source: str = "notes") -> str:
    """Occurrences with ASCII boundaries, by prefix sums over the pieces between needles (none overlaps itself)."""
    hay = FOLDED if folded else "content"
    listed = ", ".join(f"'{w}'" for w in words)
    return f"""
terms AS (SELECT unnest([{listed}]) AS key),
pieces AS (SELECT path, key, hay, string_split(hay, key) AS p FROM (SELECT path, {hay} AS hay FROM {source}), terms WHERE contains(hay, key)),
spots AS (SELECT path, key, hay, list_sum(list_transform(p[1:i], lambda x: length(x)))::BIGINT + (i - 1) * length(key) AS start
  FROM (SELECT path, key, hay, p, unnest(range(1, len(p))) AS i FROM pieces)),
{name} AS (SELECT path, key, start::INTEGER AS start, (start + length(key))::INTEGER AS "end" FROM spots
  WHERE NOT regexp_matches(substr(hay, start, CASE WHEN start > 0 THEN 1 ELSE 0 END), '[A-Za-z0-9]')
    AND NOT regexp_matches(substr(hay, start + length(key) + 1, 1), '[A-Za-z0-9]'))"""


HITS = f"WITH {NOTES}, {_hits_sql(TERMS)}"


def _hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.occurrences(notes(spark, sf_dir), terms(spark), ["path"])


# ---- scans, joins and their limits


@query(f"WITH {NOTES} SELECT path, mtime, size FROM notes")
def list_notes(spark, sf_dir):
    return notes(spark, sf_dir).select("path", "mtime", "size")


@query(f"WITH {NOTES}, {_hits_sql(('the',))} SELECT path, start, \"end\" FROM hits")
def term_occurrences(spark, sf_dir):
    return Q.occurrences(notes(spark, sf_dir), terms(spark, ("the",)), ["path"]).select("path", "start", "end")


@query(f"WITH {NOTES}, {_hits_sql(('The',), False)} SELECT path, start, \"end\" FROM hits")
def term_occurrences_case_sensitive(spark, sf_dir):
    return Q.occurrences(notes(spark, sf_dir), terms(spark, ("The",), True), ["path"]).select("path", "start", "end")


@query(HITS + ' SELECT key, path, start, "end" FROM hits')
def multi_term_hits(spark, sf_dir):
    return _hits(spark, sf_dir).select("key", "path", "start", "end")


@query(HITS + ' SELECT key, path, start FROM (SELECT *, row_number() OVER (PARTITION BY key, path ORDER BY start) AS n FROM hits) WHERE n <= 8')
def hits_per_note_topn(spark, sf_dir):
    return Q.top_hits(_hits(spark, sf_dir), 8).select("key", "path", "start")


@query(HITS + " SELECT key, path, start FROM (SELECT *, dense_rank() OVER (PARTITION BY key ORDER BY path) AS n FROM hits) WHERE n <= 80")
def notes_per_term_cap(spark, sf_dir):
    return Q.cap_notes(_hits(spark, sf_dir), 80).select("key", "path", "start")


@query(
    HITS
    + """ SELECT key, path, regexp_extract(path, '([^/]*)\\.md$', 1) AS stem, count(*) AS n_hits, min(start) AS first_start, max(start) AS last_start
  FROM hits GROUP BY key, path"""
)
def hits_grouped_candidates(spark, sf_dir):
    found = _hits(spark, sf_dir).withColumn("heading", F.lit("")).withColumn("excerpt", F.lit(""))
    return Q.candidates(found).select(
        "key", "path", "stem", F.size("hits").cast("bigint").alias("n_hits"), F.element_at("hits", 1)["start"].alias("first_start"), F.element_at("hits", -1)["start"].alias("last_start")
    )


@query(
    f"""WITH {NOTES}, {_hits_sql(('the',))}, f AS (SELECT path, min(start) AS s FROM hits GROUP BY path),
x AS (SELECT path, content, s, greatest(0, s - 78) AS lo, least(length(content), s + 3 + 78) AS hi FROM f JOIN notes USING (path))
SELECT path, s AS start, CASE WHEN lo > 0 THEN '…' ELSE '' END || trim(regexp_replace(substr(content, lo + 1, hi - lo), '[ \\t\\n\\r]+', ' ', 'g')) ||
  CASE WHEN hi < length(content) THEN '…' ELSE '' END AS excerpt FROM x"""
)
def excerpt(spark, sf_dir):
    base = notes(spark, sf_dir)
    first = Q.top_hits(Q.occurrences(base, terms(spark, ("the",)), ["path"]), 1)
    return first.join(base, "path").select("path", "start", T.excerpt(F.col("content"), F.col("start"), F.col("end"), 160).alias("excerpt"))


# full_search() stands below, with the headings


# ---- scope


@query(f"WITH {NOTES} SELECT path FROM notes WHERE source IN ('src1', 'src2') ")
def scope_folder_filter(spark, sf_dir):
    return notes(spark, sf_dir).where(S.in_folders(F.col("path"), ["src1", "/src2/", "src3"], ["src3"])).select("path")


@query(f"WITH {NOTES} SELECT path FROM notes WHERE mtime >= {NOW} - 30 * 86400000::BIGINT")
def scope_recent(spark, sf_dir):
    return S.scoped(notes(spark, sf_dir), NOW, "recent").select("path")


def _opens(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    n = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("user_id"), F.concat("source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".md")).alias("path"))
    return e.join(n, "user_id").select("path", "ts")


_WORKSET = "workset AS (SELECT n.path FROM events e JOIN notes n ON e.user_id = n.doc_id GROUP BY n.path ORDER BY max(e.ts) DESC, n.path LIMIT 50)"


@query(f"WITH {NOTES}, {_WORKSET} SELECT path FROM notes WHERE path IN (SELECT path FROM workset)")
def scope_workset(spark, sf_dir):
    return S.scoped(notes(spark, sf_dir), NOW, "workset", opened=S.workset(_opens(spark, sf_dir), 50)).select("path")


@query(f"WITH {NOTES}, {_WORKSET} SELECT path FROM notes WHERE path IN (SELECT path FROM workset) OR mtime >= {NOW} - 2 * 86400000::BIGINT")
def scope_recent_workset(spark, sf_dir):
    return S.scoped(notes(spark, sf_dir), NOW, "recent-workset", recent_days=2, opened=S.workset(_opens(spark, sf_dir), 50)).select("path")


@query(
    f"""WITH {NOTES} SELECT count(*) FILTER (size > 2000) AS skipped_by_size,
  greatest(count(*) FILTER (size <= 2000) - 300, 0)::BIGINT AS skipped_by_limit, least(count(*) FILTER (size <= 2000), 300)::BIGINT AS kept FROM notes"""
)
def scope_skip_counts(spark, sf_dir):
    return S.skip_counts(S.scoped(notes(spark, sf_dir), NOW, max_bytes=2000), 300)


@query(f"WITH {NOTES} SELECT path, mtime FROM notes WHERE size <= 2000 AND path <> 'src0/0.md' ORDER BY mtime DESC, path LIMIT 300")
def scope_topk(spark, sf_dir):
    return S.newest(S.scoped(notes(spark, sf_dir), NOW, max_bytes=2000, self_path="src0/0.md"), 300).select("path", "mtime")


@query(
    """SELECT '{"exclude":[],"include":["a","b"],"max_bytes":512000,"max_files":500,"mode":"all","recent_days":30}' AS fingerprint,
  sha256('{"exclude":[],"include":["a","b"],"max_bytes":512000,"max_files":500,"mode":"all","recent_days":30}') AS digest"""
)
def scope_fingerprint(spark, sf_dir):
    return spark.range(1).select(S.fingerprint("all", ["b", "a"], [], 30, 500, 512_000).alias("fingerprint")).select("fingerprint", F.sha2("fingerprint", 256).alias("digest"))


# ---- text


@query(
    """WITH x AS (SELECT conv_id, turn, text FROM conversations UNION ALL SELECT -1, item_id, substr(text, 1, 60) FROM benchmark
  UNION ALL SELECT -2, item_id, '  [[' || substr(text, 1, 5) FROM benchmark UNION ALL SELECT -3, item_id, '  ' FROM benchmark)
SELECT conv_id, turn, CASE WHEN trim(text) = '' THEN 'empty' WHEN regexp_matches(text, '[\\r\\n]') THEN 'newline'
  WHEN regexp_matches(trim(text), '[|\\[\\]]') THEN 'link_syntax' WHEN length(trim(text)) > 256 THEN 'too_long' END AS error FROM x"""
)
def query_validation(spark, sf_dir):
    b = table(spark, sf_dir, "benchmark")
    row = lambda n, t: b.select(F.lit(n).cast("bigint").alias("conv_id"), F.col("item_id").alias("turn"), t.alias("text"))
    x = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text").unionByName(row(-1, F.substring("text", 1, 60)))
    x = x.unionByName(row(-2, F.concat(F.lit("  [["), F.substring("text", 1, 5)))).unionByName(row(-3, F.lit("  ")))
    return x.select("conv_id", "turn", T.query_error(F.col("text")).alias("error"))


@query(
    """WITH x AS (SELECT item_id, text, string_split(lower(text), 'the') AS p FROM benchmark)
SELECT item_id, (len(p) - 1)::BIGINT AS n_marked,
  list_aggregate(list_transform(range(1, len(p)), lambda i: substr(text, list_sum(list_transform(p[1:i], lambda y: length(y)))::BIGINT + (i - 1) * 3 + 1, 3)), 'string_agg', ',') AS marked,
  text AS whole FROM x"""
)
def highlight_segments(spark, sf_dir):
    b = table(spark, sf_dir, "benchmark").withColumn("s", T.highlight_segments(F.col("text"), F.lit("the")))
    marked = F.filter("s", lambda x: x["marked"])
    return b.select(
        "item_id", F.size(marked).cast("bigint").alias("n_marked"), F.when(F.size(marked) > 0, F.array_join(F.transform(marked, lambda x: x["text"]), ",")).alias("marked"),
        F.array_join(F.transform("s", lambda x: x["text"]), "").alias("whole"),
    )


@query(
    f"""WITH {NOTES}, {_hits_sql(('the',))}, f AS (SELECT path, min(start) AS s FROM hits GROUP BY path)
SELECT path, substr(content, 1, s) || '[[' || 'target/' || doc_id::VARCHAR || CASE WHEN doc_id % 2 = 0 THEN '#Part ' || doc_id::VARCHAR ELSE '' END || '|' || substr(content, s + 1, 3)
  || ']]' || substr(content, s + 4) AS linked FROM f JOIN notes USING (path)"""
)
def link_splice(spark, sf_dir):
    base = notes(spark, sf_dir).withColumn("doc_id", F.regexp_extract("path", r"/(\d+)\.md$", 1))
    first = Q.top_hits(Q.occurrences(base, terms(spark, ("the",)), ["path"]), 1).join(base, "path")
    heading = F.when(F.col("doc_id").cast("bigint") % 2 == 0, F.concat(F.lit("Part "), F.col("doc_id"))).otherwise("")
    text = T.link_text(F.concat(F.lit("target/"), F.col("doc_id")), heading, F.substring(F.col("content"), F.col("start") + 1, F.lit(3)))
    return first.select("path", T.splice(F.col("content"), F.col("start"), F.col("end"), text).alias("linked"))


@query("SELECT item_id, '[' || text || '](notes/' || item_id::VARCHAR || '.md#Part%20one)' AS link FROM benchmark")
def link_text_markdown(spark, sf_dir):
    b = table(spark, sf_dir, "benchmark")
    return b.select("item_id", T.link_text(F.concat(F.lit("notes/"), F.col("item_id").cast("string"), F.lit(".md")), F.lit("Part one"), F.col("text"), False).alias("link"))


@query("SELECT item_id, sha256(text) || '  item-' || item_id::VARCHAR AS line FROM benchmark")
def sha256_lines(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select("item_id", T.sums_line(F.col("text"), F.concat(F.lit("item-"), F.col("item_id").cast("string"))).alias("line"))


@query(
    """SELECT event_id, CASE WHEN value IS NULL OR isnan(value) OR isinf(value) THEN 30 ELSE least(greatest(floor(value), 10), 100) END::INTEGER AS clamped FROM events"""
)
def clamp_values(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", T.clamp(F.col("value"), 10, 100, 30).alias("clamped"))


# ---- Markdown

_LINES = f"""WITH {MD}, ln AS (SELECT path, i, l[i] AS line, l[i + 1] AS under, (coalesce(list_sum(list_transform(l[1:i - 1], lambda x: length(x) + 1)), 0))::INTEGER AS start
  FROM (SELECT path, l, unnest(range(1, len(l) + 1)) AS i FROM (SELECT path, string_split(content, chr(10)) AS l FROM md)))"""
_HEADS = (
    _LINES
    + r""", marked AS (SELECT *, sum(CASE WHEN line = '```' THEN 1 ELSE 0 END) OVER (PARTITION BY path ORDER BY i) % 2 = 1 OR contains(line, '`') AS hidden FROM ln),
both_ AS (SELECT *, lead(hidden) OVER (PARTITION BY path ORDER BY i) AS hidden_under FROM marked),
heads AS (SELECT path, length(regexp_extract(line, '^ {0,3}(#{1,6})[ \t]+', 1))::INTEGER AS level, trim(regexp_extract(line, '^ {0,3}#{1,6}[ \t]+(.+?)[ \t]*#*[ \t]*$', 1)) AS text, start
  FROM both_ WHERE regexp_matches(line, '^ {0,3}#{1,6}[ \t]+(.+?)[ \t]*#*[ \t]*$') AND NOT hidden
  UNION ALL SELECT path, CASE WHEN contains(under, '=') THEN 1 ELSE 2 END, trim(line), start FROM both_ WHERE regexp_matches(under, '^ {0,3}(-+|=+)[ \t]*$')
    AND regexp_matches(line, '^ {0,3}\S') AND NOT regexp_matches(line, '^ {0,3}#{1,6}[ \t]+(.+?)[ \t]*#*[ \t]*$') AND NOT hidden AND NOT hidden_under)"""
)


@query(_HEADS + " SELECT path, level, text, start FROM heads")
def headings(spark, sf_dir):
    return M.headings(markdown(spark, sf_dir), ["path"])


@query(
    _HEADS
    + """, o AS (SELECT path, unnest([0, 10, 150, 300, length(content) // 2, length(content) - 1])::INTEGER AS "at" FROM md)
SELECT path, "at", coalesce(arg_max(text, start) FILTER (start <= "at"), '') AS heading FROM heads JOIN o USING (path) GROUP BY path, "at" """
)
def heading_asof(spark, sf_dir):
    md = markdown(spark, sf_dir)
    heads = M.headings(md, ["path"]).groupBy("path").agg(F.array_sort(F.collect_list(F.struct("start", "text"))).alias("heads"))
    n = F.length("content")
    at = F.array_distinct(F.array(*(F.lit(x) for x in (0, 10, 150, 300)), F.floor(n / 2).cast("int"), n - 1))
    points = md.select("path", F.explode(at).alias("at")).join(heads, "path")
    return points.select("path", "at", M.nearest_heading(F.col("heads"), F.col("at")).alias("heading"))


@query(
    _HEADS
    + f""", {_hits_sql(TERMS, source="md")},
h AS (SELECT h.*, max(l.start) AS line_start FROM hits h JOIN both_ l ON l.path = h.path AND l.start <= h.start GROUP BY ALL),
v AS (SELECT h.* FROM h JOIN both_ l ON l.path = h.path AND l.start = h.line_start WHERE NOT l.hidden),
x AS (SELECT v.*, content, greatest(0, start - (160 - length(key)) // 2) AS lo, least(length(content), "end" + (160 - length(key)) // 2) AS hi FROM v JOIN md USING (path)),
t AS (SELECT v.path, v.key, v.start, arg_max(heads.text, heads.start) AS heading FROM v JOIN heads ON heads.path = v.path AND heads.start <= v.start GROUP BY ALL)
SELECT x.path, x.key, x.start, x."end", coalesce(t.heading, '') AS heading, CASE WHEN lo > 0 THEN '…' ELSE '' END || trim(regexp_replace(substr(content, lo + 1, hi - lo), '[ \\t\\n\\r]+', ' ', 'g')) ||
  CASE WHEN hi < length(content) THEN '…' ELSE '' END AS excerpt FROM x LEFT JOIN t ON t.path = x.path AND t.key = x.key AND t.start = x.start"""
)
def full_search(spark, sf_dir):
    """Hits with protected regions left out, headings and excerpts, over Markdown made of the documents."""
    md = markdown(spark, sf_dir).withColumn("mtime", F.lit(0).cast("bigint"))
    return Q.hits(md, terms(spark)).drop("mtime")


@query(f"WITH {MD} SELECT path, unnest(regexp_extract_all(content, '\\*\\*(.+?)\\*\\*', 1)) AS found FROM md")
def bold_extract(spark, sf_dir):
    return X.matches(markdown(spark, sf_dir), ["path"], "content", r"\*\*(.+?)\*\*", 1).select("path", "found")


@query(f"WITH {MD} SELECT path, unnest(regexp_extract_all(content, '==(.+?)==', 1)) AS found FROM md")
def highlight_extract(spark, sf_dir):
    return X.matches(markdown(spark, sf_dir), ["path"], "content", r"==(.+?)==", 1).select("path", "found")


@query(
    f"""WITH {MD} SELECT path, (instr(content, '```') - 1)::INTEGER AS start, (instr(content, '```' || chr(10) || '## Part ') + 3)::INTEGER AS "end" FROM md
UNION ALL SELECT path, (instr(content, '`the code`') - 1)::INTEGER, (instr(content, '`the code`') + 9)::INTEGER FROM md"""
)
def protected_spans(spark, sf_dir):
    return M.with_spans(markdown(spark, sf_dir)).select("path", F.explode("spans").alias("s")).select("path", "s.start", "s.end")


# ---- extraction

_WORDS = f"""WITH {NOTES}, ln AS (SELECT path, i AS line_no, l[i] AS line FROM (SELECT path, l, unnest(range(1, len(l) + 1)) AS i FROM (SELECT path, string_split(content, chr(10)) AS l FROM notes))),
w AS (SELECT path, line_no, regexp_extract_all(line, '[\\p{{L}}\\p{{M}}\\p{{N}}]+') AS w, string_split_regex(line, '[\\p{{L}}\\p{{M}}\\p{{N}}]+') AS g
  FROM ln WHERE NOT regexp_matches(line, '^\\s{{0,3}}#{{1,6}}\\s')),
win AS (SELECT path, line_no, n, i, w[i : i + n - 1] AS ws, g[i + 1 : i + n - 1] AS gs
  FROM (SELECT path, line_no, w, g, n, unnest(range(1, len(w) - n + 2)) AS i FROM w, (SELECT unnest([3, 2, 1]) AS n) WHERE len(w) >= n)),
ph AS (SELECT path, line_no, n, i, list_aggregate(list_transform(range(1, n + 1), lambda j: ws[j] || CASE WHEN j < n THEN gs[j] ELSE '' END), 'string_agg', '') AS query
  FROM win WHERE len(list_filter(gs, lambda x: NOT regexp_matches(x, '^[\\s\\x{{a0}}\\x{{3000}}]*$'))) = 0)"""


@query(
    _WORDS
    + """ SELECT path, (line_no - 1)::INTEGER AS line_no, query FROM (SELECT *, row_number() OVER (PARTITION BY path, line_no ORDER BY n DESC, i) AS k FROM ph
  WHERE length(query) BETWEEN 3 AND 32) WHERE k <= 16"""
)
def word_phrases_top16(spark, sf_dir):
    out = X.prose(notes(spark, sf_dir).select("path", "content"), ["path"])
    return out.select("path", F.floor(F.col("no") / PER_LINE).cast("int").alias("line_no"), "query")


@query(
    """WITH r AS (SELECT item_id, i AS run, r[i] AS run_text FROM (SELECT item_id, r, unnest(range(1, len(r) + 1)) AS i FROM (SELECT item_id, regexp_extract_all(text, '\\p{L}+') AS r FROM benchmark))),
g AS (SELECT item_id, run, n, i, substr(run_text, i, n) AS gram FROM (SELECT item_id, run, run_text, n, unnest(range(1, length(run_text) - n + 2)) AS i
  FROM r, (SELECT unnest([6, 5, 4, 3, 2]) AS n) WHERE length(run_text) >= n))
SELECT item_id, gram FROM (SELECT *, row_number() OVER (PARTITION BY item_id, run ORDER BY n DESC, i) AS k FROM g) WHERE k <= 12"""
)
def char_ngrams(spark, sf_dir):
    b = table(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("content"))
    return X.ngrams(b, ["item_id"], run=r"\p{L}+").select("item_id", F.col("query").alias("gram"))


_STOP = ("the", "of", "and")


@query(
    _WORDS
    + """, c AS (SELECT path, replace(lower(query), 'ς', 'σ') AS key, query, 400 + least(length(query), 80) AS score, (line_no - 1) * 16 + k - 1 AS seq
  FROM (SELECT *, row_number() OVER (PARTITION BY path, line_no ORDER BY n DESC, i) AS k FROM ph WHERE length(query) BETWEEN 3 AND 32) WHERE k <= 16),
m AS (SELECT path, key, arg_min(query, seq) AS query, max(score)::INTEGER AS score, min(seq) AS seq FROM c WHERE key NOT IN ('the', 'of', 'and') AND length(key) BETWEEN 3 AND 32 GROUP BY path, key)
SELECT path, key, query, score, rank::INTEGER AS rank FROM (SELECT *, row_number() OVER (PARTITION BY path ORDER BY score DESC, length(query) DESC, seq) AS rank FROM m) WHERE rank <= 40"""
)
def candidate_merge_rank(spark, sf_dir):
    return X.extract(notes(spark, sf_dir), ["path"], focused=False, stop=list(_STOP), protect=False).select("path", "key", "query", "score", "rank")


@query()
def extract_all_sources(spark, sf_dir):
    """All sources of derived Markdown, outside protected regions."""
    out = X.extract(markdown(spark, sf_dir), ["path"], broad=True, stop=list(_STOP))
    return out.select("path", "key", "query", "display", "source", "score", F.size("anchors").alias("n_anchors"), "rank")


@query(
    """SELECT item_id, term FROM (SELECT item_id, unnest(string_split(text, ' ')) AS term FROM benchmark)
WHERE trim(term) <> '' AND replace(lower(trim(term)), 'ς', 'σ') NOT IN ('the', 'of', 'and')"""
)
def stopword_antijoin(spark, sf_dir):
    words = table(spark, sf_dir, "benchmark").select("item_id", F.explode(F.split("text", " ")).alias("term")).where(T.trim(F.col("term")) != "")
    return X.without(words, spark.range(1).select(F.explode(F.array(*map(F.lit, ("The", " of", "AND")))).alias("term")))


@query(
    """WITH w AS (SELECT item_id * 1000 + i AS pos, t[i] AS term FROM (SELECT item_id, t, unnest(range(1, len(t) + 1)) AS i FROM (SELECT item_id, string_split(text, ' ') AS t FROM benchmark)))
SELECT replace(lower(trim(term)), 'ς', 'σ') AS key, arg_min(term, pos) AS term, min(pos) AS pos FROM w WHERE trim(term) <> '' GROUP BY 1"""
)
def distinct_terms(spark, sf_dir):
    words = table(spark, sf_dir, "benchmark").select("item_id", F.posexplode(F.split("text", " ")).alias("i", "term"))
    return X.distinct_terms(words.select((F.col("item_id") * 1000 + F.col("i") + 1).alias("pos"), "term"))


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def ignore_antijoin(spark, sf_dir):
    bad = table(spark, sf_dir, "labels").where("toxic = 1").select("doc_id")
    return table(spark, sf_dir, "documents").select("doc_id").join(bad, "doc_id", "left_anti")


# ---- intervals: lines of an order are spans over days, priced for score

_SPANS = """iv AS (SELECT l_orderkey AS k, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_shipdate, l_quantity, l_extendedprice)::INTEGER AS id, (date_diff('day', DATE '1990-01-01', l_shipdate::DATE))::INTEGER AS start,
  (date_diff('day', DATE '1990-01-01', l_shipdate::DATE) + l_quantity)::INTEGER AS "end", floor(l_extendedprice)::BIGINT % 50 AS score FROM lineitem)"""


def _intervals(spark, sf_dir):
    columns = ["l_orderkey", "l_linenumber", "l_shipdate", "l_quantity", "l_extendedprice"]
    li = dealt_by_size(table(spark, sf_dir, "lineitem").select(*columns), ["l_orderkey"])
    start = F.date_diff(F.col("l_shipdate").cast("date"), F.lit("1990-01-01").cast("date"))
    n = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_shipdate", "l_quantity", "l_extendedprice"))
    return li.select(
        F.col("l_orderkey").alias("k"), n.alias("id"), start.alias("start"), (start + F.col("l_quantity")).cast("int").alias("end"),
        (F.floor(F.col("l_extendedprice")).cast("bigint") % 50).alias("score"),
    )


@query(
    f"""WITH {_SPANS}, a AS (SELECT *, max("end") OVER (PARTITION BY k ORDER BY start, "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM iv),
b AS (SELECT *, sum(CASE WHEN start <= reach THEN 0 ELSE 1 END) OVER (PARTITION BY k ORDER BY start, "end" ROWS UNBOUNDED PRECEDING) AS island FROM a)
SELECT k, min(start) AS start, max("end") AS "end" FROM b GROUP BY k, island"""
)
def span_union(spark, sf_dir):
    return intervals.merge_touching(_intervals(spark, sf_dir).select("k", "start", "end"), ["k"])


@query(f"""WITH {_SPANS} SELECT k, id, start FROM iv a WHERE id > 1 AND NOT EXISTS (SELECT 1 FROM iv b WHERE b.k = a.k AND b.id = 1 AND a.start < b."end" AND a."end" > b.start)""")
def interval_antijoin(spark, sf_dir):
    iv = _intervals(spark, sf_dir)
    spans = iv.where("id = 1").groupBy("k").agg(F.collect_list(F.struct("start", "end")).alias("spans"))
    rows = iv.where("id > 1").join(spans, "k", "left").withColumn("spans", F.coalesce("spans", F.array().cast("array<struct<start:int,end:int>>")))
    return M.unprotected(rows).select("k", "id", "start")


@query(
    f"""WITH {_SPANS}, p AS (SELECT DISTINCT k, start + 5 AS "at" FROM iv)
SELECT k, "at", arg_min(id, (("end" - start)::BIGINT * 100000 + start)::BIGINT * 1000 + id) AS id FROM p JOIN iv USING (k) WHERE start <= "at" AND "at" <= "end" GROUP BY k, "at" """
)
def anchor_stab(spark, sf_dir):
    iv = _intervals(spark, sf_dir)
    return A.at_point(iv.select("k", (F.col("start") + 5).alias("at")).distinct(), iv, ["k"])


@query(
    f"""WITH {_SPANS}, p AS (SELECT DISTINCT k, max("end") + 1 AS "at" FROM iv WHERE id <= 2 GROUP BY k),
n AS (SELECT k, id, start, "end", row_number() OVER (PARTITION BY k ORDER BY start, "end", id) AS n, count(*) OVER (PARTITION BY k) AS c FROM iv),
s AS (SELECT k, "at", arg_min(n, ("end" - start)::BIGINT * 1000000000 + n) AS here FROM p JOIN n USING (k) WHERE start <= "at" AND "at" <= "end" GROUP BY k, "at")
SELECT k, "at",
  CASE WHEN max(here) IS NOT NULL THEN max(id) FILTER (n = here % c + 1) ELSE coalesce(arg_min(id, n) FILTER (start > "at"), arg_min(id, n)) END AS next_id,
  CASE WHEN max(here) IS NOT NULL THEN max(id) FILTER (n = (here - 2 + c) % c + 1) ELSE coalesce(arg_max(id, n) FILTER ("end" < "at"), arg_max(id, n)) END AS previous_id
FROM p JOIN n USING (k) LEFT JOIN s USING (k, "at") GROUP BY k, "at" """
)
def anchor_next_prev(spark, sf_dir):
    iv = _intervals(spark, sf_dir)
    points = iv.where("id <= 2").groupBy("k").agg((F.max("end") + 1).alias("at"))
    return A.neighbours(points, iv.select("k", "id", "start", "end"), ["k"])


def _fold_sql(order: str, clash: str) -> str:
    return f"""WITH RECURSIVE {_SPANS}, o AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY {order}) AS n FROM iv),
r AS (SELECT k, n, [{{'s': start, 'e': "end", 'id': id}}] AS kept FROM o WHERE n = 1
  UNION ALL SELECT r.k, o.n, CASE WHEN {clash} THEN r.kept ELSE list_append(r.kept, {{'s': o.start, 'e': o."end", 'id': o.id}}) END
  FROM r JOIN o ON o.k = r.k AND o.n = r.n + 1),
f AS (SELECT k, arg_max(kept, n) AS kept FROM r GROUP BY k)
SELECT k, x.id AS id, x.s AS start, x.e AS "end" FROM (SELECT k, unnest(kept) AS x FROM f)"""


@query(_fold_sql('score DESC, "end" - start DESC, start, id', 'len(list_filter(r.kept, lambda q: o.start < q.e AND o."end" > q.s)) > 0'))
def greedy_nonoverlap(spark, sf_dir):
    iv = _intervals(spark, sf_dir).withColumn("stable", F.col("id"))
    return A.without_overlap(iv, ["k"]).select("k", "id", "start", "end")


@query(_fold_sql('start, id, "end"', "o.start < r.kept[len(r.kept)].e"))
def sweep_nonoverlap(spark, sf_dir):
    iv = _intervals(spark, sf_dir).select("k", "start", "end", F.lit("mark").alias("kind"), F.col("id").alias("sort_order"))
    return A.drawable(iv, ["k"]).select("k", F.col("sort_order").alias("id"), "start", "end")


@query(
    f"""WITH {_SPANS}, a AS (SELECT k, id, start, "end", repeat('x', "end" - start) AS text FROM iv WHERE id >= 2 AND "end" > start),
ed AS (SELECT k, start AS s, start + 3 AS t, 7 - 3 AS gain FROM iv WHERE id = 1)
SELECT a.k, id, (start + CASE WHEN ed.t <= start THEN gain ELSE 0 END)::INTEGER AS start, ("end" + CASE WHEN ed.t <= start THEN gain ELSE 0 END)::INTEGER AS "end"
FROM a LEFT JOIN ed USING (k) WHERE ed.s IS NULL OR NOT (ed.s < a."end" AND ed.t > a.start)"""
)
def anchors_through_edits(spark, sf_dir):
    iv = _intervals(spark, sf_dir)
    a = iv.where('id >= 2 and end > start').select("k", "id", "start", "end", F.expr("repeat('x', end - start)").alias("text"))
    e = iv.where("id = 1").select("k", "start", (F.col("start") + 3).alias("end"), F.lit("seven!!").alias("insert"))
    return A.through_edits(a, e, ["k"]).select("k", "id", "start", "end")


@query(
    f"""WITH {_SPANS}, e AS (SELECT k, start - min(start) OVER (PARTITION BY k) AS start, "end" - min(start) OVER (PARTITION BY k) AS "end", max("end") OVER (PARTITION BY k) - min(start) OVER (PARTITION BY k) AS length FROM iv),
g AS (SELECT *, coalesce(max("end") OVER (PARTITION BY k ORDER BY start, "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS reach FROM e WHERE "end" > start)
SELECT k, count(*) FILTER (start > reach) = 0 AND max(length) > 0 AS replaced FROM g GROUP BY k"""
)
def whole_replacement(spark, sf_dir):
    w = Window.partitionBy("k")
    e = _intervals(spark, sf_dir).select("k", (F.col("start") - F.min("start").over(w)).alias("start"), (F.col("end") - F.min("start").over(w)).alias("end"), (F.max("end").over(w) - F.min("start").over(w)).alias("length"))
    out = A.whole_replaced(e, ["k"])
    return out.withColumn("replaced", F.col("replaced"))


@query(
    f"""WITH {NOTES}, {_hits_sql(('the',))} SELECT path, start, true AS valid, substr(content, start + 1, 3) = 'the' AS same FROM hits JOIN notes USING (path)"""
)
def anchor_still_valid(spark, sf_dir):
    base = notes(spark, sf_dir)
    found = Q.occurrences(base, terms(spark, ("the",)), ["path"]).join(base, "path")
    place = (F.col("content"), F.col("start"), F.col("end"))
    return found.select("path", "start", A.still_there(*place, F.lit(" THE ")).alias("valid"), A.same_text(*place, F.lit("the"), True).alias("same"))


# ---- incremental: notes seen in an older state, in which a third had another time and a fifth was missing

_OLD = """old AS (SELECT path, CASE WHEN doc_id % 3 = 0 THEN mtime - 1 ELSE mtime END AS mtime, 1 + doc_id % 4 AS last_changed FROM notes WHERE doc_id % 5 <> 0)"""


def _old(spark, sf_dir):
    n = notes(spark, sf_dir).withColumn("id", F.regexp_extract("path", r"/(\d+)\.md$", 1).cast("bigint"))
    rows = n.where("id % 5 <> 0")
    return rows.select("path", F.when(F.col("id") % 3 == 0, F.col("mtime") - 1).otherwise(F.col("mtime")).alias("mtime"), (1 + F.col("id") % 4).alias("last_changed"))


_NEW = """new AS (SELECT path, coalesce(n.mtime, old.mtime) AS mtime, CASE WHEN n.mtime IS NOT NULL AND n.mtime IS DISTINCT FROM old.mtime THEN 9 ELSE last_changed END AS last_changed
  FROM old FULL JOIN (SELECT path, mtime FROM notes WHERE doc_id % 7 <> 0) n USING (path))"""


def _scoped_now(spark, sf_dir):
    return notes(spark, sf_dir).where(F.regexp_extract("path", r"/(\d+)\.md$", 1).cast("bigint") % 7 != 0)


@query(f"WITH {NOTES}, {_OLD}, {_NEW} SELECT path, mtime, last_changed FROM new")
def manifest_diff(spark, sf_dir):
    return I.reconcile(_old(spark, sf_dir), _scoped_now(spark, sf_dir), 9)


@query(f"WITH {NOTES}, {_OLD} SELECT path FROM notes LEFT JOIN (SELECT path, last_changed FROM old) USING (path) WHERE last_changed IS NULL OR last_changed > 2")
def stale_paths(spark, sf_dir):
    return I.stale(notes(spark, sf_dir), _old(spark, sf_dir), 2)


@query(
    HITS
    + """, re AS (SELECT path FROM notes WHERE doc_id % 3 = 0) SELECT key, path, start FROM hits WHERE path NOT IN (SELECT path FROM re)
UNION ALL SELECT key, path, start + 1000 FROM hits WHERE path IN (SELECT path FROM re) AND key = 'the'"""
)
def replace_merge(spark, sf_dir):
    found = _hits(spark, sf_dir).select("key", "path", "start")
    again = notes(spark, sf_dir).where(F.regexp_extract("path", r"/(\d+)\.md$", 1).cast("bigint") % 3 == 0).select("path")
    fresh = found.where("key = 'the'").join(again, "path", "left_semi").select("key", "path", (F.col("start") + 1000).alias("start"))
    return I.replace_merge(found, fresh, again, notes(spark, sf_dir))


@query(
    f"""WITH {NOTES}, {_OLD}, f AS (SELECT path FROM notes WHERE doc_id % 11 = 0 AND doc_id % 5 <> 0)
SELECT least(9, coalesce(min(coalesce(greatest(2, last_changed - 1), 2)), 9))::BIGINT AS generation FROM f LEFT JOIN old USING (path)"""
)
def safe_generation(spark, sf_dir):
    i = F.regexp_extract("path", r"/(\d+)\.md$", 1).cast("bigint")
    return I.safe_generation(notes(spark, sf_dir).where((i % 11 == 0) & (i % 5 != 0)), _old(spark, sf_dir), 9, 2)


@query(
    """WITH e AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events)
SELECT 'n' || user_id::VARCHAR || '.md' AS path, arg_max(CASE WHEN event_type = 'error' THEN NULL ELSE event_id END, event_id) FILTER (event_type <> 'error') AS x, max(event_id) AS seq FROM e GROUP BY user_id"""
)
def change_feed_latest(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(
        F.col("event_id").alias("seq"), F.when(F.col("event_type") == "error", "delete").otherwise("modify").alias("op"), F.concat(F.lit("n"), F.col("user_id").cast("string"), F.lit(".md")).alias("path"),
        F.lit(None).cast("string").alias("old_path"), F.col("event_id").alias("mtime"),
    )
    rows = changes.as_upserts(e)
    return rows.groupBy("path").agg(F.max("mtime").alias("x"), F.max("seq").alias("seq"))


@query(
    """WITH l AS (SELECT user_id, arg_max(event_type, event_id) AS last, max(event_id) AS mtime FROM events GROUP BY user_id)
SELECT 'n' || user_id::VARCHAR || '.md' AS path, mtime, 5::BIGINT AS last_changed FROM l WHERE last <> 'error'"""
)
def change_feed_manifest(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(
        F.col("event_id").alias("seq"), F.when(F.col("event_type") == "error", "delete").otherwise("modify").alias("op"), F.concat(F.lit("n"), F.col("user_id").cast("string"), F.lit(".md")).alias("path"),
        F.lit(None).cast("string").alias("old_path"), F.col("event_id").alias("mtime"),
    )
    return changes.apply(spark.createDataFrame([], "path string, mtime bigint, last_changed bigint"), e, 5)


_ENTRIES = """e AS (SELECT user_id AS key, sum(octet_length(props::BLOB))::BIGINT * 7 AS bytes, max(event_id) AS last_access, user_id % 10 = 0 AS pinned FROM events GROUP BY user_id)"""


def _entries(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.groupBy(F.col("user_id").alias("key")).agg(
        (F.sum(F.octet_length("props")) * 7).cast("bigint").alias("bytes"), F.max("event_id").alias("last_access"), (F.max("user_id") % 10 == 0).alias("pinned")
    )


@query(
    f"""WITH {_ENTRIES}, s AS (SELECT *, CASE WHEN bytes <= 30000 THEN bytes ELSE 0 END AS size FROM e),
h AS (SELECT *, sum(size) OVER () AS total, sum(CASE WHEN pinned THEN size ELSE 0 END) OVER () + sum(CASE WHEN pinned THEN 0 ELSE size END)
  OVER (ORDER BY last_access DESC, key ROWS UNBOUNDED PRECEDING) AS held FROM s)
SELECT key, bytes <= 30000 AS durable, total <= 30000 OR pinned OR bytes > 30000 OR held <= 27000 AS kept FROM h"""
)
def cache_lru_keep(spark, sf_dir):
    return I.keep_recent(_entries(spark, sf_dir), 30_000).select("key", "durable", "kept")


@query(HITS + " SELECT key, count(*) AS n_hits, (2 * length(key) + 48 + sum(2 * (length(path) + 0) + 32))::BIGINT AS bytes FROM hits GROUP BY key")
def cache_size(spark, sf_dir):
    return I.entry_bytes(_hits(spark, sf_dir).withColumn("heading", F.lit("")))


@query(
    HITS
    + """ SELECT (SELECT count(*) FROM hits) AS n_anchors, (SELECT count(DISTINCT key) FROM hits) AS n_groups,
  count(DISTINCT key) AS n_groups_found, count(DISTINCT path) AS n_notes FROM hits"""
)
def session_stats(spark, sf_dir):
    found = _hits(spark, sf_dir)
    return sessions.stats(found, found.select(F.col("key").alias("group_key")))


@query(HITS + ", p AS (SELECT DISTINCT key, path FROM hits) SELECT path, string_agg(key, '|' ORDER BY key) AS keys FROM p GROUP BY path")
def terms_by_path(spark, sf_dir):
    return I.terms_by_path(_hits(spark, sf_dir)).select("path", F.array_join("keys", "|").alias("keys"))


@query(
    """WITH g AS (SELECT event_id, user_id, epoch_us(ts) // 1000 AS ms, lead(epoch_us(ts) // 1000) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS nx FROM events)
SELECT event_id FROM g WHERE nx IS NULL OR nx - ms > 3600000"""
)
def debounced_events(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", "user_id", F.unix_millis(F.col("ts").cast("timestamp")).alias("ts_ms"))
    return changes.debounced(e, 3_600_000, ["user_id"]).select("event_id")


# ---- incremental search: results brought up to date equal those of a fresh search

_NEWEST = f"""newest AS (SELECT * REPLACE (translate(content, '{MARKS}', '       ') AS content) FROM notes WHERE size <= 512000 AND source <> 'src3' ORDER BY mtime DESC, path LIMIT 600)"""


@query(
    f"""WITH {NOTES}, {_NEWEST}, {_hits_sql(TERMS, source="newest")},
n AS (SELECT *, row_number() OVER (PARTITION BY key, path ORDER BY start) AS n FROM hits), r AS (SELECT *, dense_rank() OVER (PARTITION BY key ORDER BY path) AS d FROM n WHERE n <= 8)
SELECT r.key, r.path, r.start, r."end" FROM r WHERE d <= 80"""
)
def refresh_equals_search(spark, sf_dir):
    """Several terms, searched in an older state of the notes and of the scope, then brought up to date."""
    now = notes(spark, sf_dir).withColumn("content", F.translate("content", MARKS, " " * len(MARKS)))
    number = F.regexp_extract("path", r"/(\d+)\.md$", 1).cast("bigint")
    old = now.where(number % 5 != 0).withColumn("mtime", F.when(number % 3 == 0, F.col("mtime") - 1).otherwise(F.col("mtime")))
    old = old.withColumn("content", F.when(number % 3 == 0, F.concat(F.lit("the old state\n"), "content")).otherwise(F.col("content")))
    folder = spark.conf.get("spark.checkpoint.dir", None) or f"file://{tempfile.mkdtemp(prefix='vellum-')}"
    cache = I.ResultCache(spark, f"{folder}/results-{uuid.uuid4().hex}")
    seen = lambda rows, generation: rows.select("path", "mtime", F.lit(generation).cast("bigint").alias("last_changed"))
    config = EngineConfig(max_files=600, exclude_folders=("src3",))
    Engine(spark, old, config).refresh_many(list(TERMS), cache, seen(old, 1), 1)
    manifest = I.reconcile(seen(old, 1), now, 2)
    return Engine(spark, now, config).refresh_many(list(TERMS), cache, manifest, 2).select("key", "path", "start", "end")
