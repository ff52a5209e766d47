"""What is asked of the text of one note: occurrences of terms, headings, excerpts, term candidates.

Offsets are running sums over the pieces of a text, which array expressions give in quadratic time only. These
kernels give them in one pass, and per_note() runs them over Arrow batches: each body is read once, and nothing is
shuffled. A row is a note; null texts are empty.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType

from .tasks import release, small_batches
from .text import LATIN, MAX_QUERY, SPACE, TIERS, WORD

try:
    import ahocorasick
except ImportError:  # terms are then looked for one by one
    ahocorasick = None

Span = tuple[int, int]
#: White space at the ends of a text, as in text.SPACE.
BLANKS = "\t\n\x0b\x0c\r \u00a0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000\ufeff"
#: More terms than this are found by one automaton.
FEW_TERMS = 16
#: Most terms of a note, phrases of a line, and words of a phrase.
HARD_CAP, PER_LINE, LONGEST_PHRASE = 200, 16, 3
CJK = r"[\p{Han}\p{Hiragana}\p{Katakana}\p{Hangul}]+"

_BLANK_RUN = re.compile(f"{SPACE}+")
_ATX = re.compile(rf" {{0,3}}(#{{1,6}}){SPACE}+([^\n\r\u2028\u2029]+?){SPACE}*#*{SPACE}*")
_UNDERLINE = re.compile(r" {0,3}(=+|-+)[ \t]*")
_SETEXT = re.compile(rf" {{0,3}}(?!{SPACE}).")
_HEADING_LINE = re.compile(rf"{SPACE}{{0,3}}#{{1,6}}{SPACE}")
_LETTERS = regex.compile(r"[\p{L}\p{M}\p{N}]+")
_UNUSABLE = re.compile(r"[\r\n|\[\]]")
_INLINE = (("**", "emphasis"), ("__", "emphasis"), ("==", "highlight"))


def per_note(notes: DataFrame, keys: list[str], columns: list[str | Column], kernel: Callable[..., Iterable[tuple]], schema: str, chunk: int = 20_000) -> DataFrame:
    """(keys, schema): the rows that kernel makes of the columns of each row, beside the row's keys.

    A worker holds Arrow batches of at most 4 MB, and at most chunk rows that are made of them, also of one note.
    """
    small_batches(notes.sparkSession)
    base = notes.select(*(F.col(f"`{k}`") for k in keys), *((F.col(c) if isinstance(c, str) else c).alias(f"_in{i}") for i, c in enumerate(columns)))
    own = StructType.fromDDL(schema)
    if clash := set(keys) & set(own.names):
        raise ValueError(f"keys may not be named as results are: {sorted(clash)}")
    types = [to_arrow_type(f.dataType) for f in own]
    names, n_in = [*keys, *own.names], len(columns)

    def made_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def packed() -> pa.RecordBatch:
            made = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)]
            return pa.RecordBatch.from_arrays([*(x.column(j).take(pa.array(at)) for j in range(len(keys))), *made], names)

        for x in batches:
            at: list[int] = []
            rows: list[tuple] = []
            for i, values in enumerate(zip(*(x.column(len(keys) + j).to_pylist() for j in range(n_in)), strict=True)):
                for row in kernel(*values):
                    at.append(i)
                    rows.append(row)
                    if len(rows) >= chunk:
                        yield packed()
                        at, rows = [], []
            if rows:
                yield packed()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from made_of(batches)
        finally:
            release()

    return base.mapInArrow(run, StructType([*base.schema.fields[: len(keys)], *own.fields]))


# ---- terms


def folded(content: str) -> tuple[str, list[int] | None]:
    """Lower case by code point, final sigma as sigma; with the source offset of each place (-1 inside a letter) if they differ."""
    if "İ" not in content:  # the only letter whose lower case is longer
        return content.lower().replace("ς", "σ"), None
    pieces = [c.lower().replace("ς", "σ") for c in content]
    source = [-1] * (sum(map(len, pieces)) + 1)
    at = 0
    for i, piece in enumerate(pieces):
        source[at] = i
        at += len(piece)
    source[at] = len(content)
    return "".join(pieces), source


def boundary(needle: str) -> Callable[[str], object] | None:
    """What may not stand next to a needle; nothing for scripts without spaces."""
    if re.search("[A-Za-z]", needle):
        return re.compile(LATIN).match
    return None if regex.search(r"[\p{Hiragana}\p{Katakana}\p{Han}]", needle) else regex.compile(WORD).match


class Terms:
    """Finds all occurrences of terms (key, needle, case_sensitive), overlapping ones too; needles are trimmed and folded."""

    def __init__(self, rows: Iterable[tuple[str, str, bool]]):
        self.groups: list[tuple[bool, dict[str, list[str]]]] = []
        rows = list(rows)
        for sensitive in (False, True):
            needles: dict[str, list[str]] = {}
            for key, needle, s in rows:
                if s == sensitive and needle:
                    needles.setdefault(needle, []).append(key)
            if needles:
                self.groups.append((sensitive, needles))
        self._finders: list | None = None

    def __getstate__(self) -> dict:
        return {"groups": self.groups, "_finders": None}

    def finders(self) -> list[tuple[bool, Callable[[str], Iterator[tuple[int, str]]], dict[str, list[str]], dict]]:
        """Made once in each worker."""
        if self._finders is None:
            self._finders = [(s, self._finder(list(needles)), needles, {n: boundary(n) for n in needles}) for s, needles in self.groups]
        return self._finders

    @staticmethod
    def _finder(needles: list[str]) -> Callable[[str], Iterator[tuple[int, str]]]:
        if len(needles) > FEW_TERMS and ahocorasick is not None:
            automaton = ahocorasick.Automaton()
            for needle in needles:
                automaton.add_word(needle, needle)
            automaton.make_automaton()
            return lambda hay: ((end + 1 - len(needle), needle) for end, needle in automaton.iter(hay))

        def one_by_one(hay: str) -> Iterator[tuple[int, str]]:
            for needle in needles:
                at = hay.find(needle)
                while at >= 0:
                    yield at, needle
                    at = hay.find(needle, at + 1)

        return one_by_one

    def occurrences(self, content: str | None) -> Iterator[tuple[str, int, int]]:
        """(key, start, end) in source offsets; boundaries are those of the source."""
        if not content:
            return
        for sensitive, find, needles, sides in self.finders():
            hay, source = (content, None) if sensitive else folded(content)
            for start, needle in find(hay):
                end = start + len(needle)
                if source is not None:
                    start, end = source[start], source[end]
                    if start < 0 or end < 0:
                        continue
                side = sides[needle]
                if side and ((start and side(content[start - 1])) or (end < len(content) and side(content[end]))):
                    continue
                for key in needles[needle]:
                    yield key, start, end


def excerpt(text: str, start: int, end: int, most: int) -> str:
    """The surroundings of a place, white space collapsed, with an ellipsis where the text goes on."""
    radius = max(20, (most - (end - start)) // 2)
    lo, hi = max(0, start - radius), min(len(text), end + radius)
    if hi - lo > most:
        hi = lo + most
    return ("…" if lo else "") + _BLANK_RUN.sub(" ", text[lo:hi]).strip(BLANKS) + ("…" if hi < len(text) else "")


# ---- structure


def covered(spans: list[Span], start: int, end: int) -> bool:
    """Whether a range overlaps any of sorted, disjoint spans."""
    i = bisect_left(spans, (end,))
    return i > 0 and spans[i - 1][1] > start


def headings(text: str, spans: list[Span]) -> Iterator[tuple[int, str, int]]:
    """(level, text, start): ATX headings, and lines underlined by = or -, whose lines touch no protected span."""
    if "#" not in text and "-" not in text and "=" not in text:
        return
    lines = text.split("\n")
    start = 0
    for i, raw in enumerate(lines):
        line = raw.removesuffix("\r")
        m = _ATX.fullmatch(line) if "#" in line[:4] else None
        if m:
            if not covered(spans, start, start + len(line)):
                yield len(m[1]), m[2].strip(BLANKS), start
        elif i + 1 < len(lines) and lines[i + 1].lstrip(" ")[:1] in ("=", "-") and _SETEXT.match(line):
            below = lines[i + 1].removesuffix("\r")
            if under := _UNDERLINE.fullmatch(below):
                next_start = start + len(raw) + 1
                if not covered(spans, start, start + len(line)) and not covered(spans, next_start, next_start + len(below)):
                    yield 1 if under[1][0] == "=" else 2, line.strip(BLANKS), start
        start += len(raw) + 1


# ---- term candidates: (source, no, start, end, query), before they are merged


def usable(text: str, start: int, end: int, spans: list[Span]) -> tuple[int, int, str] | None:
    """A range without white space at its ends, if it is a valid query outside protected spans."""
    part = text[start:end]
    query = part.strip(BLANKS)
    if not query or len(query) > MAX_QUERY or _UNUSABLE.search(query):
        return None
    start += len(part) - len(part.lstrip(BLANKS))
    end = start + len(query)
    return None if covered(spans, start, end) else (start, end, query)


def _lines(text: str) -> Iterator[tuple[int, int, str]]:
    start = 0
    for no, line in enumerate(text.split("\n")):
        yield no, start, line
        start += len(line) + 1


def heading_terms(text: str) -> Iterator[tuple[int, int, int]]:
    for no, start, line in _lines(text):
        if "#" in line[:4] and (m := _ATX.fullmatch(line.removesuffix("\r"))):
            yield no, start + m.start(2), start + m.end(2)


def inline_terms(text: str, mark: str) -> Iterator[tuple[int, int, int]]:
    """What stands between two equal marks on one line."""
    if mark in text:
        for no, m in enumerate(re.finditer(f"{re.escape(mark)}(.+?){re.escape(mark)}", text)):
            yield no, m.start(1), m.end(1)


def prose_terms(text: str, low: int, high: int, per_line: int = PER_LINE) -> Iterator[tuple[int, int, int]]:
    """Phrases of three, two, then one word of each line that is no heading: the first per_line whose length is usable.

    Words are runs of letters, marks and digits; only white space may stand between the words of a phrase. Words
    are taken from a line as phrases need them.
    """
    for no, line_start, line in _lines(text):
        if "#" in line[:9] and _HEADING_LINE.match(line):
            continue
        words: list[Span] = []
        linked: list[bool] = []  # the gap before this word is white space
        picks = 0
        last = 0
        for m in _LETTERS.finditer(line):
            words.append(m.span())
            linked.append(not line[last : words[-1][0]].strip(BLANKS))
            last = words[-1][1]
            if len(words) >= LONGEST_PHRASE and linked[-1] and linked[-2]:
                first = words[-LONGEST_PHRASE][0]
                if low <= last - first <= high:
                    yield no * per_line + picks, line_start + first, line_start + last
                    picks += 1
                    if picks == per_line:
                        break
        for n in range(LONGEST_PHRASE - 1, 0, -1):
            for i in range(len(words) - n + 1):
                if picks == per_line:
                    break
                if all(linked[i + 1 : i + n]) and low <= words[i + n - 1][1] - words[i][0] <= high:
                    yield no * per_line + picks, line_start + words[i][0], line_start + words[i + n - 1][1]
                    picks += 1


def gram_terms(text: str, low: int, high: int, limit: int, run: str = CJK) -> Iterator[tuple[int, int, int]]:
    """Character n-grams of the runs of a script, long ones first, at most limit of each run."""
    for no, m in enumerate(regex.finditer(run, text)):
        start, end = m.span()
        picks = 0
        for n in range(min(high, end - start), low - 1, -1):
            for at in range(start, min(end - n + 1, start + limit - picks)):
                yield no * limit + picks, at, at + n
                picks += 1


def score(source: str, query: str) -> int:
    return TIERS[source] + (min(len(query), 80) if source in ("prose", "ngram") else 0)


def term_key(text: str, case_sensitive: bool) -> str:
    body = text.strip(BLANKS)
    return body if case_sensitive else folded(body)[0]


class Candidates:
    """The ranked terms of a note."""

    def __init__(
        self, focused: bool = True, phrases: bool = True, broad: bool = False, low: int = 3, high: int = 32, gram_low: int = 2, gram_high: int = 6, most: int = 40, span_limit: int = 12,
        stop: Iterable[str] = (), ignored: Iterable[str] = (), case_sensitive: bool = False,
    ):
        if not (focused or phrases or broad):
            raise ValueError("no source of terms is switched on")
        self.focused, self.phrases, self.broad, self.low, self.high = focused, phrases, broad, low, high
        self.gram_low, self.gram_high, self.most, self.span_limit, self.case_sensitive = gram_low, gram_high, min(most, HARD_CAP), span_limit, case_sensitive
        self.banned = {term_key(t, case_sensitive) for t in (*stop, *ignored)}

    def raw(self, text: str) -> Iterator[tuple[str, int, int]]:
        """(source, start, end) in the order of the sources."""
        if self.focused:
            yield from (("heading", a, b) for _, a, b in heading_terms(text))
            for mark, source in _INLINE:
                yield from ((source, a, b) for _, a, b in inline_terms(text, mark))
        if self.phrases:
            yield from (("prose", a, b) for _, a, b in prose_terms(text, self.low, self.high))
        if self.broad:
            yield from (("ngram", a, b) for _, a, b in gram_terms(text, self.gram_low, self.gram_high, self.span_limit))

    def ranked(self, text: str, spans: list[Span]) -> Iterator[tuple[str, str, str, str, int, list[dict], int]]:
        """(key, query, display, source, score, anchors, rank), candidates of one normalised text being one.

        The first spelling is the query, the best source the display, the first of equal ones.
        """
        found: dict[str, list] = {}
        for source, start, end in self.raw(text):
            place = usable(text, start, end, spans)
            if place is None:
                continue
            start, end, query = place
            key = term_key(query, self.case_sensitive)
            if key in self.banned or (source != "ngram" and not self.low <= len(key) <= self.high):
                continue
            own = score(source, query)
            entry = found.get(key)
            if entry is None:
                found[key] = [query, query, source, own, {(start, end)}]
                continue
            if own > entry[3]:
                entry[1:4] = query, source, own
            entry[4].add((start, end))
        best = sorted(found.items(), key=lambda x: (-x[1][3], -len(x[1][0])))[: self.most]
        for rank, (key, (query, display, source, own, places)) in enumerate(best, 1):
            yield key, query, display, source, own, [{"start": a, "end": b} for a, b in sorted(places)], rank
