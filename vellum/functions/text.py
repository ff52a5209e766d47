"""Text expressions: folding, trimming, boundaries, validation, excerpts, links. All are Catalyst expressions.

Offsets are code points, from 0, half-open.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The white space that trimming and collapsing mean, beyond ASCII.
SPACE = r"[\t\n\x0B\f\r \u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff]"
#: What a neighbour of a term may not be.
LATIN = "[A-Za-z0-9]"
WORD = r"[\p{L}\p{M}\p{N}_]"
NO_SPACES_SCRIPT = r"[\p{IsHiragana}\p{IsKatakana}\p{IsHan}]"
#: Scores of what a phrase was taken from.
TIERS = {"heading": 1000, "emphasis": 1200, "highlight": 1200, "prose": 400, "ngram": 100}
MAX_QUERY = 256


def trim(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, f"^{SPACE}+", ""), f"{SPACE}+$", "")


def trim_range(text: Column, start: Column, end: Column) -> Column:
    """struct(start, end, text) of a range without the white space at its ends; null if nothing is left or the range is void."""
    part = F.substring(text, start + 1, end - start)
    head = F.length(part) - F.length(F.regexp_replace(part, f"^{SPACE}+", ""))
    body = trim(part)
    valid = (start >= 0) & (end > start) & (F.length(body) > 0)
    return F.when(valid, F.struct((start + head).alias("start"), (start + head + F.length(body)).alias("end"), body.alias("text")))


def fold(text: Column) -> Column:
    """Lower case by code point; final sigma is sigma."""
    return F.translate(F.lower(text), "ς", "σ")


def term_key(text: Column, case_sensitive: bool = False) -> Column:
    return trim(text) if case_sensitive else fold(trim(text))


def quoted(needle: Column) -> Column:
    r"""A needle as a literal part of a pattern, also where it holds \E."""
    return F.concat(F.lit(r"\Q"), F.replace(needle, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E"))


def query_error(raw: Column) -> Column:
    """null for a usable query, else empty, newline, link_syntax or too_long, tested in this order."""
    body = trim(F.coalesce(raw, F.lit("")))
    return (
        F.when(F.length(body) == 0, "empty").when(raw.rlike(r"[\r\n]"), "newline").when(body.rlike(r"[|\[\]]"), "link_syntax").when(F.length(body) > MAX_QUERY, "too_long")
    )


def excerpt(text: Column, start: Column, end: Column, most: int) -> Column:
    radius = F.greatest(F.lit(20), F.floor((F.lit(most) - (end - start)) / 2).cast("int"))
    lo = F.greatest(F.lit(0), start - radius)
    hi = F.least(F.length(text), end + radius)
    hi = F.when(hi - lo > most, lo + most).otherwise(hi)
    body = trim(F.regexp_replace(F.substring(text, lo + 1, hi - lo), f"{SPACE}+", " "))
    return F.concat(F.when(lo > 0, "…").otherwise(""), body, F.when(hi < F.length(text), "…").otherwise(""))


def highlight_segments(text: Column, needle: Column, case_sensitive: bool = False) -> Column:
    """array of struct(text, marked): alternating plain and marked parts of a text, left to right, without overlap."""
    hay, key = (text, needle) if case_sensitive else (fold(text), fold(needle))
    sizes = F.transform(F.split(hay, quoted(key), -1), lambda p: F.length(p))
    n = F.length(needle)
    start = lambda i: F.aggregate(F.slice(sizes, 1, i), F.lit(0), lambda a, x: a + x) + i * n
    parts = F.flatten(
        F.transform(
            sizes,
            lambda size, i: F.array(
                F.struct(F.substring(text, start(i) + 1, size).alias("text"), F.lit(False).alias("marked")),
                F.struct(F.when(i < F.size(sizes) - 1, F.substring(text, start(i) + size + 1, n)).otherwise("").alias("text"), F.lit(True).alias("marked")),
            ),
        )
    )
    whole = F.array(F.struct(text.alias("text"), F.lit(False).alias("marked")))
    return F.when(F.length(key) == 0, F.filter(whole, lambda s: s["text"] != "")).otherwise(F.filter(parts, lambda s: s["text"] != ""))


def tier_score(source: Column, text: Column) -> Column:
    base = F.coalesce(*(F.when(source == s, F.lit(v)) for s, v in TIERS.items()))
    return base + F.when(source.isin("prose", "ngram"), F.least(F.length(text), F.lit(80))).otherwise(0)


def normal_path(path: Column) -> Column:
    return F.regexp_replace(F.replace(path, F.lit("\\"), F.lit("/")), "^/+|/+$", "")


def normal_folder(folder: Column) -> Column:
    return trim(normal_path(trim(folder)))


def folder_lines(text: Column) -> Column:
    """The normalised, non-empty lines of a text."""
    return F.filter(F.transform(F.split(text, r"\r?\n"), normal_folder), lambda x: x != "")


def stem(path: Column) -> Column:
    return F.regexp_replace(F.regexp_extract(path, r"([^/]*)$", 1), r"\.[^.]*$", "")


def link_text(path: Column, heading: Column, alias: Column, wiki: bool = True) -> Column:
    spot = F.when(F.coalesce(heading, F.lit("")) == "", "").otherwise(F.concat(F.lit("#"), heading))
    if wiki:
        return F.concat(F.lit("[["), path, spot, F.lit("|"), alias, F.lit("]]"))
    return F.concat(F.lit("["), alias, F.lit("]("), F.replace(F.concat(path, spot), F.lit(" "), F.lit("%20")), F.lit(")"))


def splice(text: Column, start: Column, end: Column, insert: Column) -> Column:
    return F.concat(F.substring(text, F.lit(1), start), insert, F.substring(text, end + 1, F.length(text)))


def unified_action(selection: Column, has_session: Column) -> Column:
    """What the one command does: search the selection, clear the marks, or search what the note offers."""
    return F.when(F.length(trim(F.coalesce(selection, F.lit("")))) > 0, "selection").when(has_session, "clear").otherwise("auto")


def identity(start: Column, end: Column, key: Column) -> Column:
    return F.concat_ws("\u0000", key, start.cast("string"), end.cast("string"))


def sums_line(content: Column, name: Column) -> Column:
    """A line of a checksum file; an empty artefact is an error."""
    return F.when(F.octet_length(content) == 0, F.raise_error(F.concat(F.lit("empty artefact: "), name))).otherwise(F.format_string("%s  %s", F.sha2(content, 256), name))


def clamp(value: Column, low: int, high: int, fallback: int) -> Column:
    """Floor and clamp; null and non-finite values fall back."""
    x = value.cast("double")
    bad = x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return F.when(bad, F.lit(fallback)).otherwise(F.least(F.greatest(F.floor(x), F.lit(low)), F.lit(high))).cast("int")
