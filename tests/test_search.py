import random
import time

import pytest
from pyspark.sql import functions as F

from vellum.functions import kernels as K
from vellum.operators import anchors as A
from vellum.operators import extract as X
from vellum.operators import markdown as M
from vellum.operators import search as Q


def found(spark, text, query, sensitive=False):
    notes = spark.createDataFrame([("n", text)], "path string, content string")
    terms = spark.createDataFrame([("k", query, sensitive)], "key string, query string, case_sensitive boolean")
    return [(r["start"], r["end"]) for r in Q.occurrences(notes, terms, ["path"]).orderBy("start").collect()]


@pytest.mark.parametrize(
    ("text", "query", "sensitive", "starts"),
    [
        ("Hello HELLO hello", "hello", False, [0, 6, 12]),
        ("Hello HELLO hello", "hello", True, [12]),
        ("prefixWord suffix Word", "word", False, [18]),
        ("語語語", "語語", False, [0, 1]),
        ("İ target", "target", False, [2]),
        ("xi̇x İ", "İ", False, [5]),
        ("a_b b", "b", False, [2, 4]),
        ("cost 55 and 5", "5", False, [12]),
        (r"a \E b \E", r"\E", False, [2, 7]),
        ("", "x", False, []),
    ],
)
def test_occurrences(spark, text, query, sensitive, starts):
    assert [a for a, _ in found(spark, text, query, sensitive)] == starts


def test_blocks_of_terms_give_the_same(spark, monkeypatch):
    notes = spark.createDataFrame([("n", "one two three four two")], "path string, content string")
    terms = spark.createDataFrame([(w, w, False) for w in ("one", "two", "three", "five")], "key string, query string, case_sensitive boolean")
    whole = sorted(map(tuple, Q.occurrences(notes, terms, ["path"]).collect()))
    monkeypatch.setattr(Q, "TERMS_AT_ONCE", 2)
    assert sorted(map(tuple, Q.occurrences(notes, terms, ["path"]).collect())) == whole and len(whole) == 4


def test_hits_skip_code_and_carry_headings(spark):
    text = "# Top\nterm here\n```\nterm\n```\n## Sub\n`term` term"
    notes = spark.createDataFrame([("f/n.md", text, 5)], "path string, content string, mtime bigint")
    terms = spark.createDataFrame([("term", "term", False)], "key string, query string, case_sensitive boolean")
    rows = Q.hits(notes, terms).orderBy("start").collect()
    assert [r["heading"] for r in rows] == ["Top", "Sub"]
    assert [c["title"] for c in Q.candidates(Q.hits(notes, terms)).collect()] == ["n"]


def test_caps(spark):
    rows = [("k", f"n{i}", s) for i in range(4) for s in (9, 3, 6)]
    hits = spark.createDataFrame(rows, "key string, path string, start int")
    assert sorted((r["path"], r["start"]) for r in Q.cap_notes(Q.top_hits(hits, 2), 2).collect()) == [("n0", 3), ("n0", 6), ("n1", 3), ("n1", 6)]


def test_extract(spark):
    text = "# Graph theory\nThe **Graph Theory** and ==deep walk== of\n`code words here`\nplain words"
    notes = M.with_spans(spark.createDataFrame([("n", text)], "path string, content string"))
    rows = {r["key"]: r for r in X.extract(notes, ["path"], stop=["the", "and"], ignored=["plain"]).collect()}
    assert rows["graph theory"]["source"] == "emphasis" and rows["graph theory"]["query"] == "Graph theory"
    assert len(rows["graph theory"]["anchors"]) == 2
    assert rows["deep walk"]["score"] == 1200 and "code words here" not in rows and "plain" not in rows
    assert rows["plain words"]["score"] > rows["words"]["score"]
    for r in rows.values():
        for a in r["anchors"]:
            assert text[a["start"] : a["end"]].lower() == r["key"]


def test_ngrams(spark):
    notes = spark.createDataFrame([("n", "x 認知負荷 y")], "path string, content string")
    assert [r["query"] for r in X.ngrams(notes, ["path"], 2, 3).orderBy("no").collect()] == ["認知負", "知負荷", "認知", "知負", "負荷"]


def test_anchor_choice_and_steps(spark):
    rows = [("n", 0, 4, 10, 0), ("n", 2, 8, 20, 1), ("n", 8, 9, 5, 2), ("n", 3, 7, 20, 3)]
    a = spark.createDataFrame(rows, "note string, start int, end int, score int, stable int")
    assert sorted((r["start"], r["end"]) for r in A.without_overlap(a, ["note"]).collect()) == [(2, 8), (8, 9)]
    ids = spark.createDataFrame([("n", "a", 2, 4), ("n", "b", 6, 9), ("n", "c", 7, 8)], "note string, id string, start int, end int")
    points = spark.createDataFrame([("n", p) for p in (0, 3, 5, 7, 99)], "note string, at int")
    got = {r["at"]: (r["next_id"], r["previous_id"]) for r in A.neighbours(points, ids, ["note"]).collect()}
    assert got == {0: ("a", "c"), 3: ("b", "c"), 5: ("b", "a"), 7: ("a", "b"), 99: ("a", "c")}
    assert {r["at"]: r["id"] for r in A.at_point(points, ids, ["note"]).collect()} == {3: "a", 7: "c"}


def test_edits_move_anchors(spark):
    a = spark.createDataFrame([("n", "x", 10, 14, "word"), ("n", "y", 20, 24, "term")], "note string, id string, start int, end int, text string")
    e = spark.createDataFrame([("n", 0, 2, "longer"), ("n", 21, 22, "Z")], "note string, start int, end int, insert string")
    assert [(r["id"], r["start"], r["end"]) for r in A.through_edits(a, e, ["note"]).collect()] == [("x", 14, 18)]


def test_still_there(spark):
    row = spark.createDataFrame([("say Term now",)], "t string").select(
        A.still_there(F.col("t"), F.lit(4), F.lit(8), F.lit("term")).alias("a"), A.same_text(F.col("t"), F.lit(4), F.lit(8), F.lit("term"), True).alias("b"),
        A.still_there(F.col("t"), F.lit(9), F.lit(40), F.lit("now")).alias("c"),
    ).first()
    assert tuple(row) == (True, False, False)


def scans(df):
    return df._jdf.queryExecution().executedPlan().toString().count("FileScan")


def test_bodies_are_scanned_once(spark, tmp_path):
    spark.createDataFrame([("a.md", "# T\nterm two", 1)], "path string, content string, mtime bigint").write.parquet(str(tmp_path / "n"))
    notes = spark.read.parquet(str(tmp_path / "n"))
    terms = spark.createDataFrame([(w, w, False) for w in ("term", "two")], "key string, query string, case_sensitive boolean")
    for df in (Q.occurrences(notes, terms, ["path"]), Q.hits(notes, terms), Q.cap_notes(Q.hits(notes, terms, per_note=3), 5), X.extract(notes, ["path"], broad=True), M.headings(notes, ["path"]), M.with_spans(notes)):
        assert scans(df) == 1
        assert df.count() > 0


def test_offsets_take_linear_time(spark):
    notes = spark.createDataFrame([("n", "ab " * 200_000)], "path string, content string")
    terms = spark.createDataFrame([("ab", "ab", False)], "key string, query string, case_sensitive boolean")
    began = time.perf_counter()
    row = Q.occurrences(notes, terms, ["path"]).agg(F.count("*"), F.sum("start")).first()
    assert tuple(row) == (200_000, 3 * 199_999 * 100_000) and time.perf_counter() - began < 20


@pytest.mark.parametrize("automaton", [True, False])
def test_many_terms_give_what_each_gives(spark, monkeypatch, automaton):
    if not automaton:
        monkeypatch.setattr(K, "ahocorasick", None)
    rng = random.Random(4)
    words = sorted({"".join(rng.choice("abA日İ_") for _ in range(rng.randint(1, 4))) for _ in range(60)})
    text = " ".join(rng.choice(words) + rng.choice(["", "x", "-", " "]) for _ in range(400))
    rows = [(w, w, False) for w in words] + [(f"={w}", w, True) for w in words]
    terms = K.Terms([(k, q if s else K.folded(q)[0], s) for k, q, s in rows])
    want = []
    for k, q, s in rows:
        hay, needle = (text, q) if s else (K.folded(text)[0], K.folded(q)[0])
        source = list(range(len(text) + 1)) if s else K.folded(text)[1] or list(range(len(text) + 1))
        side = K.boundary(needle)
        for at in range(len(hay)):
            if hay.startswith(needle, at):
                a, b = source[at], source[at + len(needle)]
                if a >= 0 and b >= 0 and not (side and ((a and side(text[a - 1])) or (b < len(text) and side(text[b])))):
                    want.append((k, a, b))
    assert sorted(terms.occurrences(text)) == sorted(want) and len(want) > 100


def test_notes_with_one_path_do_not_mix(spark):
    notes = spark.createDataFrame([("p", "first term", 1), ("p", "another term here", 2), ("q", None, 3), ("r", "", 4)], "path string, content string, mtime bigint")
    terms = spark.createDataFrame([("term", "term", False), ("none", "  ", False)], "key string, query string, case_sensitive boolean")
    assert sorted((r["mtime"], r["excerpt"]) for r in Q.hits(notes, terms).collect()) == [(1, "first term"), (2, "another term here")]
    assert Q.occurrences(notes.where("false"), terms, ["path"]).count() == Q.occurrences(notes, terms.where("false"), ["path"]).count() == 0


def test_extracted_terms_are_valid_queries(spark):
    notes = spark.createDataFrame([("n", "**a|b** x\n# A [x] b\nplain text"), ("m", None)], "path string, content string")
    keys = {r["key"] for r in X.extract(notes, ["path"], low=1).collect()}
    assert "plain text" in keys and not any(c in k for k in keys for c in "|[]")


def test_whole_replacement_of_each_text(spark):
    rows = [("all", 0, 5, 10), ("all", 5, 9, 10), ("late", 2, 10, 10), ("gap", 0, 3, 10), ("gap", 4, 10, 10), ("put", 3, 3, 10), ("both", 4, 4, 10), ("both", 0, 10, 10)]
    e = spark.createDataFrame(rows, "k string, start int, end int, length int")
    assert {r["k"]: r["replaced"] for r in A.whole_replaced(e, ["k"]).collect()} == {"all": True, "late": False, "gap": False, "put": False, "both": True}


def test_spots_steps_and_badges(spark):
    a = spark.createDataFrame([("n", 2, 5)], "note string, start int, end int")
    assert sorted((r["kind"], r["start"], r["end"]) for r in A.marks_and_badges(a, ["note"]).collect()) == [("mark", 2, 5), ("widget", 5, 5)]
    found = F.array(F.struct(F.lit(0).alias("start"), F.lit(2).alias("end"), F.lit("xy").alias("text")))
    row = spark.range(1).select(
        A.step(F.lit(2), 1, F.lit(3)).alias("on"), A.step(F.lit(0), -1, F.lit(3)).alias("back"), A.step(F.lit(0), 1, F.lit(0)).alias("none"),
        A.spots(F.lit("abcdef"), F.lit("selection"), F.lit(1), F.lit(3), found, F.lit(True)).alias("own"), A.spots(F.lit("abcdef"), F.lit("auto"), F.lit(1), F.lit(3), found, F.lit(False)).alias("no"),
        A.spots(F.lit("abcdef"), F.lit("auto"), F.lit(1), F.lit(3), found, F.lit(True)).alias("all"),
    ).first()
    assert (row["on"], row["back"], row["none"], row["own"][0]["text"], row["no"], row["all"][0]["text"]) == (0, 2, -1, "bc", [], "xy")
