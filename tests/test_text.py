import pytest
from pyspark.sql import functions as F

from vellum.functions import text as T


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("raw", "error"),
    [("ok phrase", None), ("  ", "empty"), (None, "empty"), ("two\nlines", "newline"), ("a|b", "link_syntax"), ("[x", "link_syntax"), ("x" * 257, "too_long"), ("x" * 256, None), ("語、句", None)],
)
def test_query_error(spark, raw, error):
    assert one(spark, T.query_error(F.lit(raw).cast("string"))) == error


def test_fold_and_trim(spark):
    assert one(spark, T.fold(F.lit("ΑΣ Straße"))) == "ασ straße"
    assert one(spark, T.trim(F.lit("\t　 x y ﻿\n"))) == "x y"
    assert one(spark, T.term_key(F.lit(" The "))) == "the"


def test_trim_range(spark):
    got = one(spark, T.trim_range(F.lit("ab  cd  ef"), F.lit(2), F.lit(8)))
    assert (got["start"], got["end"], got["text"]) == (4, 6, "cd")
    assert one(spark, T.trim_range(F.lit("a   b"), F.lit(1), F.lit(4))) is None


def test_excerpt_is_cut_and_collapsed(spark):
    text = "a " * 100 + "HIT\n\n now" + " b" * 100
    got = one(spark, T.excerpt(F.lit(text), F.lit(200), F.lit(203), 40))
    assert got.startswith("…") and got.endswith("…") and "HIT now" in got
    assert one(spark, T.excerpt(F.lit("short"), F.lit(0), F.lit(5), 160)) == "short"


def test_segments_do_not_overlap(spark):
    got = one(spark, T.highlight_segments(F.lit("aaaa b"), F.lit("AA")))
    assert [(s["text"], s["marked"]) for s in got] == [("aa", True), ("aa", True), (" b", False)]


def test_links(spark):
    assert one(spark, T.link_text(F.lit("f/n"), F.lit("Top"), F.lit("word"))) == "[[f/n#Top|word]]"
    assert one(spark, T.link_text(F.lit("f/n"), F.lit(None).cast("string"), F.lit("word"))) == "[[f/n|word]]"
    assert one(spark, T.splice(F.lit("say word now"), F.lit(4), F.lit(8), F.lit("[[w]]"))) == "say [[w]] now"


def test_paths(spark):
    assert one(spark, T.normal_folder(F.lit(" \\a\\b\\ "))) == "a/b"
    assert one(spark, T.folder_lines(F.lit("/a/\r\n\n b "))) == ["a", "b"]
    assert one(spark, T.stem(F.lit("x/y.z/name.md"))) == "name"


def test_clamp(spark):
    assert [one(spark, T.clamp(F.lit(v).cast("double"), 1, 9, 5)) for v in (None, float("nan"), float("inf"), -3.0, 4.9, 40.0)] == [5, 5, 5, 1, 4, 9]


def test_checksum_vector(spark):
    assert one(spark, T.sums_line(F.lit("abc"), F.lit("f"))) == "ba7816bf8f01cfea414140de5dae2223b00361a396177a9cb410ff61f20015ad  f"
    with pytest.raises(Exception, match="empty artefact"):
        one(spark, T.sums_line(F.lit(""), F.lit("f")))
