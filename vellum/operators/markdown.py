"""Markdown structure: protected regions by a scanner, and headings outside them."""

from __future__ import annotations

from collections.abc import Iterator

import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import kernels as K
from ..functions.intervals import overlaps_any

#: Bounds on the destination of a link.
DEEPEST, LONGEST = 32, 4096
_LINE = regex.compile(r"[^\n]*(?:\n|(?<=[^\n])\Z)")
_FENCE = regex.compile(r" {0,3}(?:(`{3,})[^`]*|(~{3,}).*)", regex.S)
_DOLLARS = regex.compile(r"[ \t]*\$\$[ \t]*")
_SLASHES = regex.compile(r"\\+")
_MARK = regex.compile(r"<!--|!(?=\[)|\[|`+|\$|\#")
_PAIR = regex.compile(r"<!--|-->|[\[\]]|`+")
_TAG = regex.compile(r"[\p{L}\p{N}_\-/]+")
#: Without one of these no region is protected.
_ANY = regex.compile(r"\A---\r?\n|[`~$#\[]|<!--")
_DESTINATION = regex.compile(r"[\n\r<>\"'()]")


def block_spans(text: str) -> list[tuple[int, int]]:
    """Front matter at the start, fences and display math; a fence or math block without an end runs to the end."""
    lines = [(m.start(), m.end(), m[0].removesuffix("\n").removesuffix("\r")) for m in _LINE.finditer(text)]
    spans: list[tuple[int, int]] = []
    at = 0
    if lines and lines[0][2] == "---":
        close = next((i for i in range(1, len(lines)) if lines[i][2] in ("---", "...")), None)
        if close is not None:
            spans.append((0, lines[close][1]))
            at = close + 1
    while at < len(lines):
        begin, _, content = lines[at]
        closes = None
        if m := _FENCE.fullmatch(content):
            run = m[1] or m[2]
            closes = regex.compile(rf" {{0,3}}{run[0]}{{{len(run)},}}[ \t]*").fullmatch
        elif _DOLLARS.fullmatch(content):
            closes = _DOLLARS.fullmatch
        if closes is None:
            at += 1
            continue
        close = next((i for i in range(at + 1, len(lines)) if closes(lines[i][2])), len(lines) - 1)
        last = close if close > at and closes(lines[close][2]) else None
        spans.append((begin, lines[last][1] if last is not None else len(text)))
        at = last + 1 if last is not None else len(lines)
    return spans


class Inline:
    """One pass pairs all delimiters of a segment, a second takes spans from left to right."""

    def __init__(self, text: str, start: int, end: int):
        self.text, self.start, self.end = text, start, end
        self.escaped = {m.end() for m in _SLASHES.finditer(text, 0, end) if len(m[0]) % 2}
        self.partner: dict[tuple[str, int], int] = {}
        self.pair()

    def pair(self) -> None:
        text = self.text
        comment = wiki = None
        brackets: list[int] = []
        ticks: dict[int, int] = {}
        at = self.start
        while m := _PAIR.search(text, at, self.end):
            i, token, at = m.start(), m[0], m.end()
            if token == "<!--":
                comment = i if comment is None else comment
            elif token == "-->":
                if comment is not None:
                    self.partner["comment", comment] = at
                    comment = None
            elif token[0] == "`":
                opened = ticks.pop(len(token), None)
                if opened is None:
                    ticks[len(token)] = i
                else:
                    self.partner["code", opened] = at
            elif token == "[":
                if wiki is None and text.startswith("[[", i):
                    wiki = i
                if i not in self.escaped:
                    brackets.append(i)
            elif i not in self.escaped:
                if wiki is not None and text.startswith("]]", i):
                    self.partner["wiki", wiki] = at = i + 2
                    wiki = None
                elif brackets:
                    self.partner["label", brackets.pop()] = i

    def spans(self) -> Iterator[tuple[int, int]]:
        at = self.start
        while m := _MARK.search(self.text, at, self.end):
            i = m.start()
            close = self.close(i, m[0])
            at = m.end() if close is None or close > self.end else close
            if m[0] == "<!--" and close is None:
                at = i + 1
            if close is not None and close <= self.end:
                yield i, close

    def close(self, i: int, token: str) -> int | None:
        text = self.text
        if token == "<!--":
            return self.partner.get(("comment", i))
        if token[0] == "`":
            return self.partner.get(("code", i))
        if token in "![":
            begin = i + (token == "!")
            if text.startswith("[[", begin):
                return self.partner.get(("wiki", begin))
            return None if begin in self.escaped else self.link(begin)
        if token == "$":
            return None if i in self.escaped else self.math(i)
        return self.tag(i)

    def link(self, begin: int) -> int | None:
        label = self.partner.get(("label", begin))
        if label is None:
            return None
        text, after = self.text, label + 1
        if text.startswith("[", after):
            reference = self.partner.get(("label", after))
            return None if reference is None else reference + 1
        if not text.startswith("(", after):
            return None
        depth, inside = 1, ""
        for m in _DESTINATION.finditer(text, after + 1, min(len(text), after + 1 + LONGEST)):
            c = m[0]
            if c in "\n\r":
                return None
            if m.start() in self.escaped:
                continue
            if inside:
                inside = "" if c == inside else inside
            elif c in "<\"'":
                inside = ">" if c == "<" else c
            elif c == "(":
                depth += 1
                if depth > DEEPEST:
                    return None
            elif c == ")":
                depth -= 1
                if not depth:
                    return m.end()
        return None

    def math(self, i: int) -> int | None:
        text = self.text
        double = text.startswith("$$", i)
        n = 2 if double else 1
        first = text[i + n : i + n + 1]
        if not first or (not double and (first in K.BLANKS or first in "0123456789")):
            return None
        at = i + n
        while (at := text.find("$", at)) >= 0:
            if not double and ("\n" in text[i:at] or "\r" in text[i:at]):
                return None
            if at not in self.escaped and (text[at + 1 : at + 2] == "$") == double:
                after = text[at + 1 : at + 2]
                if double or (text[at - 1] not in K.BLANKS and not (after and after in "0123456789")):
                    return at + n
            at += 1
        return None

    def tag(self, i: int) -> int | None:
        text = self.text
        before = text[i - 1] if i else ""
        if i in self.escaped or (before and (before in "#/" or _TAG.fullmatch(before))):
            return None
        line = text[text.rfind("\n", 0, i) + 1 : i]
        mark = regex.match(r"#+(.?)", text[i : i + 4096], regex.S)
        if len(line) <= 3 and not line.strip(" ") and (not mark[1] or mark[1] in K.BLANKS):
            return None
        m = _TAG.match(text, i + 1)
        return m.end() if m else None


def protected_spans(text: str) -> list[tuple[int, int]]:
    """Front matter, fences, math, code, comments, links and tags: sorted, disjoint, touching ones merged."""
    if not _ANY.search(text):
        return []
    blocks = block_spans(text)
    found = list(blocks)
    at = 0
    for begin, end in [*blocks, (len(text), len(text))]:
        if at < begin:
            found += Inline(text, at, begin).spans()
        at = end
    out: list[list[int]] = []
    for begin, end in sorted(found):
        if out and begin <= out[-1][1]:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([begin, end])
    return [(a, b) for a, b in out]


def with_spans(notes: DataFrame, content: str = "content", name: str = "spans") -> DataFrame:
    """notes, all columns, with the protected spans of each text; null texts have none."""

    def kernel(text: str | None) -> Iterator[tuple[list[dict]]]:
        yield ([{"start": a, "end": b} for a, b in protected_spans(text or "")],)

    rest = [c for c in notes.columns if c != name]
    return K.per_note(notes, rest, [F.col(content).alias("_text")], kernel, f"{name} array<struct<start:int,end:int>>")


def headings(notes: DataFrame, keys: list[str], content: str = "content") -> DataFrame:
    """(keys, level, text, start): ATX headings, and lines underlined by = or -, with at most three spaces before them.

    What touches a protected region (code, links, math, front matter, tags), with its own line or its underline, is no heading.
    """

    def kernel(text: str | None) -> Iterator[tuple[int, str, int]]:
        if text:
            yield from K.headings(text, protected_spans(text))

    return K.per_note(notes, keys, [content], kernel, "level int, text string, start int")


def unprotected(rows: DataFrame, start: str = "start", end: str = "end", spans: str = "spans") -> DataFrame:
    return rows.where(~overlaps_any(F.col(spans), F.col(start), F.col(end)))


def nearest_heading(heads: Column, offset: Column) -> Column:
    """The text of the last of an array of headings, sorted by start, that starts at or before an offset, or ''."""
    before = F.filter(heads, lambda h: h["start"] <= offset)
    return F.coalesce(F.try_element_at(before, F.lit(-1))["text"], F.lit(""))


def resolve_heading(heads: Column, offset: Column, fallback: Column) -> Column:
    """As nearest_heading() for unsorted headings, later ones winning ties; null headings mean the fallback."""
    step = lambda best, h: F.when((h["start"] <= offset) & (h["start"] >= F.coalesce(best["start"], F.lit(-1))), h).otherwise(best)
    best = F.aggregate(heads, F.try_element_at(F.filter(heads, lambda h: F.lit(False)), F.lit(1)), step)
    return F.when(heads.isNull(), fallback).otherwise(F.coalesce(best["text"], F.lit("")))
