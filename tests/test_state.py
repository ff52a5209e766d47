from pyspark.sql import functions as F

from vellum.operators import incremental as I
from vellum.operators import scope as S
from vellum.operators import sessions
from vellum.plans.config import EngineConfig
from vellum.plans.engine import Engine
from vellum.sources import notes as N
from vellum.streaming import changes


def test_scope(spark):
    rows = [("a/x.md", 100, 10), ("a/b/y.md", 200, 10), ("c/z.md", 300, 10), ("ab/w.md", 400, 99)]
    n = spark.createDataFrame(rows, "path string, mtime bigint, size bigint")
    got = S.scoped(n, 500, include=["a", "c", "ab"], exclude=["a/b"], max_bytes=50, self_path="c/z.md")
    assert sorted((r["path"], r["fits"]) for r in got.collect()) == [("a/x.md", True), ("ab/w.md", False)]
    assert tuple(S.skip_counts(S.scoped(n, 500, max_bytes=50), 2).first()) == (1, 1, 2)
    assert [r["path"] for r in S.newest(S.scoped(n, 500, max_bytes=50), 2).collect()] == ["c/z.md", "a/b/y.md"]
    opened = S.workset(spark.createDataFrame([("a/x.md", 1), ("c/z.md", 2), ("a/x.md", 3)], "path string, ts bigint"), 1)
    assert [r["path"] for r in S.scoped(n, 500, "workset", opened=opened).collect()] == ["a/x.md"]


def test_cache_refresh_reads_only_what_changed(spark, tmp_path):
    cache = I.ResultCache(spark, str(tmp_path))
    read = []

    def search(notes):
        read.append(sorted(r["path"] for r in notes.select("path").collect()))
        return notes.where("content like '%term%'").select("path", F.lit(0).alias("start"), F.lit("x").alias("excerpt"))

    def state(rows):
        return spark.createDataFrame(rows, "path string, mtime bigint, content string"), spark.createDataFrame([(p, m, m) for p, m, _ in rows], "path string, mtime bigint, last_changed bigint")

    notes, manifest = state([("a", 1, "term"), ("b", 1, "none")])
    assert [r["path"] for r in I.refresh(cache, "k", notes, manifest, 1, search).collect()] == ["a"]
    notes, manifest = state([("a", 1, "term"), ("b", 2, "term")])
    assert sorted(r["path"] for r in I.refresh(cache, "k", notes, manifest, 2, search).collect()) == ["a", "b"]
    notes, manifest = state([("a", 3, "gone"), ("b", 2, "term")])
    failed = notes.where("path = 'a'").select("path")
    assert sorted(r["path"] for r in I.refresh(cache, "k", notes, manifest, 3, search, failed).collect()) == ["a", "b"]
    assert [r["path"] for r in I.refresh(cache, "k", notes, manifest, 3, search).collect()] == ["b"]
    assert read[0] == ["a", "b"] and read[1] == ["b"] and read[3] == ["a"]


def test_keep_recent(spark):
    rows = [("old", 50, 1, False), ("pin", 40, 0, True), ("new", 30, 2, False), ("huge", 500, 3, False)]
    got = I.keep_recent(spark.createDataFrame(rows, "key string, bytes bigint, last_access bigint, pinned boolean"), 100)
    assert {r["key"]: r["kept"] for r in got.collect()} == {"old": False, "pin": True, "new": True, "huge": True}


def test_changes(spark, tmp_path):
    rows = [(1, "create", "a.md", None, 10), (2, "modify", "a.md", None, 10), (3, "rename", "b.md", "a.md", 11), (4, "create", "x.txt", None, 1), (5, "delete", "c.md", None, None)]
    events = spark.createDataFrame(rows, changes.SCHEMA)
    manifest = spark.createDataFrame([("c.md", 1, 1), ("d.md", 2, 1)], "path string, mtime bigint, last_changed bigint")
    want = [("b.md", 11, 7), ("d.md", 2, 1)]
    assert sorted(map(tuple, changes.apply(manifest, events, 7).collect())) == want
    assert [r["generation"] for r in changes.history(events).orderBy("generation").collect()] == [1, 2, 3]  # create, leave, arrive; the deletion of c.md follows nothing
    source = str(tmp_path / "in")
    events.coalesce(1).write.json(source)
    q = changes.follow(spark.readStream.schema(changes.SCHEMA).json(source), str(tmp_path / "out"), str(tmp_path / "cp"))
    q.processAllAvailable()
    q.stop()
    assert [tuple(r) for r in spark.read.parquet(str(tmp_path / "out/0")).collect()] == [("b.md", 11, 1)]


def test_config():
    c = EngineConfig.load({"max_files": 3, "recent_days": 2.5, "case_sensitive": "yes", "scope_mode": "odd", "include_folders": [" /a/ ", "a", 3], "auto_min_term_length": 9, "auto_max_term_length": 5})
    assert (c.max_files, c.recent_days, c.case_sensitive, c.scope_mode, c.include_folders) == (10, 3, False, "all", ("a",))
    assert (c.auto_min_term_length, c.auto_max_term_length) == (9, 9)
    assert EngineConfig.load({"ngram_max_length": 2, "ngram_min_length": "x"}).ngram_min_length == 2
    assert EngineConfig.load(None) == EngineConfig()
    assert EngineConfig().change("auto_max_term_length", 4).change("auto_min_term_length", 12).auto_max_term_length == 12
    assert EngineConfig.load({"ignored_terms": ["A", "a", " b "]}).ignored_terms == ("A", "b")


def test_engine(spark):
    texts = {"a.md": "# Start\nGraph theory is here", "b/b.md": "# Graph\nOn graph theory again", "c.md": "nothing"}
    notes = spark.createDataFrame([(p, i, len(t), t) for i, (p, t) in enumerate(texts.items())], "path string, mtime bigint, size bigint, content string")
    engine = Engine(spark, notes)
    assert [(r["path"], r["heading"]) for r in engine.search("graph theory", "a.md").collect()] == [("b/b.md", "Graph")]
    assert engine.search_if_present("absent", "a.md").isEmpty()
    session = engine.auto("a.md").first()
    assert "graph theory" in {g["key"] for g in session["groups"]} and any(x["text"].lower() == "graph theory" for x in session["anchors"])
    stats = sessions.without_group(engine.auto("a.md"), "graph theory").first()
    assert "graph theory" not in {g["key"] for g in stats["groups"]}
    linked = engine.link(8, 20, "Graph theory", notes.where("path = 'a.md'"), notes.where("path = 'b/b.md'"), 12, 1).first()
    assert linked["linked"] and "[[b/b#Graph|Graph theory]]" in linked["content"]
    assert not engine.link(8, 20, "Graph theory", notes.where("path = 'a.md'"), notes.where("path = 'b/b.md'"), 12, 99).first()["linked"]


def test_sources(spark, tmp_path):
    (tmp_path / "v" / "s").mkdir(parents=True)
    (tmp_path / "v" / "s" / "n.md").write_text("héllo")
    (tmp_path / "v" / "x.txt").write_text("no")
    got = N.read_notes(spark, str(tmp_path / "v")).collect()
    assert [(r["content"], r["size"]) for r in got] == [("héllo", 6)]
    assert N.unread(N.list_notes(spark, str(tmp_path / "v")), N.read_notes(spark, str(tmp_path / "v"))).isEmpty()
    N.write_checksums(spark.createDataFrame([("b", "y"), ("a", "x")], "name string, content string"), str(tmp_path / "sums"))
    assert [r["value"][-3:] for r in spark.read.text(str(tmp_path / "sums")).collect()] == ["  a", "  b"]
    m = spark.createDataFrame([("1.0", "note-search")], "version string, id string")
    assert N.verify_release(m, m.select("version"), m.select("version")).first()["agrees"]


def test_refresh_equals_search(spark, tmp_path):
    cache = I.ResultCache(spark, str(tmp_path))
    make = lambda rows: spark.createDataFrame([(p, m, len(t), t) for p, m, t in rows], "path string, mtime bigint, size bigint, content string")
    opens = lambda *paths: spark.createDataFrame([(p, i) for i, p in enumerate(paths)], "path string, ts bigint")
    table = lambda df: sorted((r["key"], r["path"], r["start"], r["heading"], r["excerpt"]) for r in df.collect())
    manifest = spark.createDataFrame([], "path string, mtime bigint, last_changed bigint")
    config = EngineConfig(scope_mode="workset")
    states = [
        ([("a", 1, "# H\nterm one"), ("b", 1, "two term")], opens("a")),
        ([("a", 1, "# H\nterm one"), ("b", 1, "two term")], opens("a", "b")),  # b comes into scope, unchanged
        ([("a", 2, "one"), ("b", 1, "two term"), ("c", 2, "term two")], opens("a", "b", "c")),
        ([("b", 1, "two term"), ("c", 3, "Term, two")], opens("a", "b", "c")),
    ]
    for generation, (rows, opened) in enumerate(states, 1):
        notes = make(rows)
        manifest = spark.createDataFrame(I.reconcile(manifest, notes.select("path", "mtime"), generation).collect(), "path string, mtime bigint, last_changed bigint")
        engine = Engine(spark, notes, config, opens=opened)
        want = table(engine.search_many(["term", "two", "one"]))
        assert table(engine.refresh_many(["term", "two", "one"], cache, manifest, generation)) == want and want
        assert table(engine.refresh("two", cache, manifest, generation)) == [x for x in want if x[0] == "two"]


def test_cache_states(spark, tmp_path):
    cache = I.ResultCache(spark, str(tmp_path), limit=400)
    paths = spark.createDataFrame([("p",)], "path string")
    hits = lambda key, n: spark.createDataFrame([(key, "p", i, "h") for i in range(n)], "key string, path string, start int, heading string")
    keys = lambda: {r["key"] for r in cache.entries().collect()}
    for key in ("one", "two", "new"):
        cache.put([key], hits(key, 3), 1, paths)
        if key == "one":
            cache.pin("one")
    assert keys() == {"one", "new"} or keys() == {"one", "two", "new"}
    cache.put(["more"], hits("more", 3), 1, paths)
    assert "one" in keys() and "more" in keys() and len(keys()) < 4  # the oldest that is not pinned goes
    cache.put(["huge"], hits("huge", 50), 1, paths)
    assert "huge" not in keys() and "one" in keys()
    assert cache.entry("one")[0].count() == 3 and cache.entry("absent") is None
    assert cache.clean() > 0 and cache.entry("one")[0].count() == 3
    cache.remove(["one"])
    assert "one" not in keys()
    cache.clear()
    assert keys() == set()


def test_engine_can_be_cancelled_and_links_outside_code(spark):
    notes = spark.createDataFrame([("a.md", 1, 9, "some term"), ("b.md", 1, 9, "# Real\n```\n# not a heading\n```\nterm")], "path string, mtime bigint, size bigint, content string")
    engine = Engine(spark, notes)
    with engine.tagged("search"):
        assert engine.search("term").count() == 2
    assert engine.cancel("search") == [] or engine.cancel("search") is not None
    done = engine.link(5, 9, "term", notes.where("path = 'a.md'"), notes.where("path = 'b.md'"), 32, 1).first()
    assert done["content"] == "some [[b#Real|term]]"


def test_sessions_lookup(spark):
    groups = spark.createDataFrame([("k", "q", "q", True, [("p", [(3, "x")])])], "key string, query string, display string, can_link boolean, candidates array<struct<path:string,hits:array<struct<start:int,heading:string>>>>")
    anchors = spark.createDataFrame([("i", 0, 1, "q", "k")], "id string, start int, end int, text string, group_key string")
    row = sessions.lookup(sessions.build(groups, anchors, "n", "auto"), "i", 5, 7).first()
    assert row["group"]["key"] == "k" and row["candidate"]["path"] == "p" and row["hit"]["start"] == 3
    flags = I.plan_flags(spark.createDataFrame([("a", 0, 3), ("b", 1, 3)], "key string, needed int, in_scope int")).first()
    assert (flags["all_warm"], flags["any_partial"]) == (False, True)
