import pytest

from vellum.operators import markdown as M


def parts(text):
    return [text[a:b] for a, b in M.protected_spans(text)]


@pytest.mark.parametrize(
    ("text", "expected"),
    [
        ("---\na: b\n---\nbody", ["---\na: b\n---\n"]),
        ("---\r\na: b\r\n...\r\nbody", ["---\r\na: b\r\n...\r\n"]),
        ("---\nno end", []),
        ("````\n```\nx\n`````\ny", ["````\n```\nx\n`````\n"]),
        ("~~~\nx", ["~~~\nx"]),
        ("``` a`b\nx", []),
        ("a `b` c ``d`e`` f", ["`b`", "``d`e``"]),
        ("a ``b` c", []),
        ("x [[note|alias]] y", ["[[note|alias]]"]),
        ("![[img.png]]!", ["![[img.png]]"]),
        (r"[a](b(c) 'x)y') z", ["[a](b(c) 'x)y')"]),
        (r"[a\]b](<c d>) z", [r"[a\]b](<c d>)"]),
        ("[a][b] [c][]", ["[a][b]", "[c][]"]),
        ("[just text]", []),
        ("<!-- x --> y", ["<!-- x -->"]),
        ("$x$ and $5 or $6 and \\$y$", ["$x$"]),
        ("$$\na\n$$\nb", ["$$\na\n$$\n"]),
        ("x $$a\nb$$ y", ["$$a\nb$$"]),
        ("see #tag/sub-a and http://x/#frag", ["#tag/sub-a"]),
        ("# Title #", []),
        ("#日本語 x", ["#日本語"]),
    ],
)
def test_protected(text, expected):
    assert parts(text) == expected


def test_malformed_links_stay_cheap():
    assert M.protected_spans("[a](" * 10_000) == []
    assert M.protected_spans("[a](" + "(" * 33 + ")" * 34) == []


def test_headings(spark):
    text = "# One #\r\ntext\nTwo\n===\n\nThree\n---\n    four\n---\n####### no\n## Five"
    rows = M.headings(spark.createDataFrame([("n", text)], "path string, content string"), ["path"]).orderBy("start").collect()
    assert [(r["level"], r["text"]) for r in rows] == [(1, "One"), (1, "Two"), (2, "Three"), (2, "Five")]
    assert all(text[r["start"] :].lstrip("# ").startswith(r["text"]) for r in rows)


def test_headings_are_outside_protected_regions(spark):
    text = "# One\n```\n# fenced\nset\n===\n```\n## With `code` in it\n## [a](b)\n---\n---\nTitle `x`\n===\nLast\n==="
    notes = spark.createDataFrame([("n", text), ("n", "# Other"), ("m", None), ("e", "")], "path string, content string")
    rows = M.headings(notes, ["path"]).collect()
    assert sorted((r["text"], r["level"]) for r in rows) == [("---", 2), ("Last", 1), ("One", 1), ("Other", 1)]
    spans = {r["path"]: r["spans"] for r in M.with_spans(notes.where("path <> 'n'")).collect()}
    assert spans == {"m": [], "e": []}
