"""Archives, toxicity, search, decontamination, chats, mixing and token counts."""

import base64
import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from vellum.llm import chat, decontaminate, mixing, token_counts, toxicity, warc
from vellum.llm.ann import nearest, perturbations
from vellum.llm.shared import Scratch


def b32(s):
    return base64.b32encode(hashlib.sha1(s.encode()).digest()).decode()


def test_warc_round_trip(spark):
    rows = [(3, "http://a/ü?x=1\r\nEvil: 1", "same"), (1, "http://b", "same"), (2, None, None), (5, "http://c", ""), (6, "u", "é\r\n\r\nWARC/1.1\r\n"), (7, "u", "x" * 300_000), (None, "u", "same")]
    got = {r["page_id"]: r for r in warc.archive_round_trip(spark.createDataFrame([(*r, "d") for r in rows], "page_id bigint, url string, html string, digest string")).collect()}
    assert len(got) == len(rows)
    for i, _, html in rows:
        r = got[i]
        assert (r["payload_bytes"], r["payload_digest"]) == (len((html or "").encode()), b32(html or ""))
    assert {i: got[i]["refers_to"] for i in got if got[i]["record_type"] == "revisit"} == {3: 1, None: 1, 5: 2}
    assert all(r["digest_ok"] for r in got.values() if r["record_type"] == "response")
    assert warc.archive_round_trip(spark.createDataFrame([], "page_id bigint, url string, html string")).count() == 0


def test_warc_filters_skip_payloads(spark):
    scratch = Scratch(spark, "w")
    path = scratch.path("a")
    rows = [(i, f"http://h{i % 2}/{i}", "same" if i < 4 else f"p{i}") for i in range(8)]
    warc.write_warc(spark.createDataFrame(rows, "page_id bigint, url string, html string"), path, scratch)
    heads = warc.read_warc(spark, path, "record_id string, record_type string, target_uri string, content_length bigint")
    assert heads.where("record_type = 'revisit'").count() == 3
    assert heads.where("record_type in ('response') and target_uri like 'http://h1%' and content_length >= 1").count() == 2
    plan = heads.where("record_type = 'revisit'")._jdf.queryExecution().toString()
    assert "record_type" in plan
    bodies = warc.read_warc(spark, path, "target_uri string, payload binary").where("target_uri = 'http://h1/5'").collect()
    assert [bytes(r["payload"]) for r in bodies] == [b"p5"]


def test_marginals_match_enumeration():
    rng = np.random.default_rng(0)
    e, trans = rng.normal(size=(3, 5)), rng.normal(size=(2, 2))
    lengths = np.array([5, 3, 1])
    p, moves = toxicity.marginals(e, lengths, trans)
    want, total = np.zeros((3, 5)), np.zeros((2, 2))
    for c, n in enumerate(lengths):
        z, paths = 0.0, []
        for code in range(2**n):
            y = [(code >> t) & 1 for t in range(n)]
            w = math.exp(sum(e[c, t] * y[t] for t in range(n)) + sum(trans[y[t - 1], y[t]] for t in range(1, n)))
            z += w
            paths.append((w, y))
        for w, y in paths:
            want[c, :n] += w / z * np.array(y)
            for t in range(1, n):
                total[y[t - 1], y[t]] += w / z
    assert np.allclose(p, want) and np.allclose(moves, total)


def test_toxicity_held_out(spark):
    rng = random.Random(1)
    plain = ["".join(rng.choice("abcdef") for _ in range(5)) for _ in range(300)]
    rows, labels = [], []
    for i in range(600):
        w = [rng.choice(plain) for _ in range(60)]
        bad = i % 4 == 0
        if bad:
            for k in rng.sample(range(60), 4):
                w[k] = rng.choice(["vilest", "rotten", "loathson", "loathsim", "loathser"])
        rows.append((i, " ".join(w), "l"))
        labels.append((i, int(bad)))
    rows += [(9001, None, "l"), (9002, "", "l"), (None, "vilest rotten vilest", "l"), (9003, "x " * 50_000, "l")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, spans string")
    out = toxicity.score_toxicity(docs, spark.createDataFrame([*labels, (3, None), (None, 1)], "doc_id bigint, toxic int"))
    got = {r["doc_id"]: r for r in out.collect()}
    held = [i for i, _ in labels if got[i]["held_out"]]
    assert 60 < len(held) < 180 and sum(got[i]["predicted"] == y for i, y in labels if i in set(held)) >= 0.98 * len(held)
    assert got[9001]["score"] == got[9002]["score"] < 0.5 and got[9003]["predicted"] == 0 and got[None]["predicted"] == 1
    texts = {i: t for i, t, _ in rows}
    marked = [texts[0][s["start"] : s["end"]] for s in got[0]["spans"]]
    assert len(marked) == 4 and all(m in ("vilest", "rotten") or m.startswith("loath") for m in marked)
    kept = toxicity.without_toxic(docs, spark.createDataFrame(labels, "doc_id bigint, toxic int"))
    assert kept.columns == docs.columns and kept.count() < len(rows) - 140
    assert toxicity.score_toxicity(docs, spark.createDataFrame([], "doc_id bigint, toxic int")).where("predicted = 1").count() == 0


def test_nearest_has_recall_and_ties(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(20, 16))
    x = (centres[rng.integers(0, 20, 1500)] + rng.normal(size=(1500, 16)) * 0.4) * rng.uniform(0.5, 2, size=(1500, 1))
    rows = [(i, v.tolist()) for i, v in enumerate(x.astype(np.float32))]
    rows += [(2000 + i, rows[0][1]) for i in range(30)] + [(5000, None), (5020, [0.0] * 16), (5040, [float("nan")] + [1.0] * 15), (5060, [None] + [1.0] * 15), (5080, [1.0, 2.0])]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")
    got = nearest(df, F.col("vec_id") % 20 == 0, block=512).collect()
    ids = np.array([i for i, v in rows if i < 5000])
    v = np.array([v for i, v in rows if i < 5000], np.float32).astype(float)
    by = {}
    for r in got:
        by.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    assert set(by) == {i for i in ids if i % 20 == 0}
    recall = []
    for q, found in by.items():
        s = (v * v[ids == q][0]).sum(1)
        s[ids == q] = -np.inf
        top = ids[np.lexsort((ids, -s))[:20]]
        found.sort()
        assert [r for r, _, _ in found] == list(range(1, 21)) and [(-b, a) for _, a, b in found] == sorted((-b, a) for _, a, b in found)
        recall.append(len(set(top) & {a for _, a, _ in found}) / 20)
    assert np.mean(recall) >= 0.9
    few = nearest(df.where("vec_id in (0, 1, 2)"), F.col("vec_id") == 0).collect()
    assert sorted(r["vec_id"] for r in few) == [1, 2]
    assert nearest(df.where("vec_id >= 5000"), F.lit(True)).count() == 0


def test_nearest_has_recall_with_uneven_norms(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(2000, 64))
    x = x / np.linalg.norm(x, axis=1, keepdims=True) * rng.lognormal(sigma=0.5, size=(2000, 1))
    x[7] *= 10
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id bigint, embedding array<double>")
    found = {}
    for r in nearest(df, F.col("vec_id") % 20 == 0).collect():
        found.setdefault(r["query_id"], set()).add(r["vec_id"])
    recall = []
    for q in range(0, 2000, 20):
        s = x @ x[q]
        s[q] = -np.inf
        recall.append(len(found[q] & set(np.argsort(-s)[:20].tolist())) / 20)
    assert np.mean(recall) >= 0.9, np.mean(recall)


def test_probes_come_in_order_of_cost():
    at = np.array([0.1, 0.7, 0.45])
    cost = [sum(at[j] ** 2 if s < 0 else (1 - at[j]) ** 2 for j, s in p) for p in perturbations(at, 27)]
    assert cost == sorted(cost) and len(cost) == 27


def _words(t):
    import regex

    return regex.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate({c: c + 32 for c in range(65, 91)}))


def test_contamination(spark):
    rng = random.Random(4)
    vocab = [f"w{i}" for i in range(60)] + ["Été", "été"]
    items = [(i, " ".join(rng.choice(vocab) for _ in range(rng.choice([1, 3, 8, 12, 30])))) for i in range(30)] + [(40, None), (41, "!!"), (None, "w1 w2"), (7, "w3 w3 w3")]
    docs = []
    for i in range(80):
        w = [rng.choice(vocab) for _ in range(40)]
        if i % 3 == 0:
            w[10:10] = rng.choice(items[:30])[1].upper().split()
        docs.append((i, ", ".join(w)))
    docs += [(100, None), (101, ""), (102, "?!"), (5, docs[0][1]), (None, docs[3][1]), (103, "w1 " * 30_000)]
    got = sorted((-1 if r["doc_id"] is None else r["doc_id"], r["n_words"], r["n_hit"], tuple(r["items"]), r["contaminated"]) for r in decontaminate.contamination(
        spark.createDataFrame([(*d, "x", 1) for d in docs], "doc_id bigint, text string, term string, pos int"), spark.createDataFrame(items, "item_id bigint, text string")).collect())
    windows = {}
    for i, t in items:
        w = _words(t)
        if w and i is not None:
            for k in range(max(1, len(w) - 7)):
                windows.setdefault(tuple(w[k : k + 8]), set()).add(str(i))
    want = []
    for i, t in docs:
        w, hit, found = _words(t), set(), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if (own := windows.get(tuple(w[k : k + n]))) is not None:
                    hit |= set(range(k, k + n))
                    found |= own
        want.append((-1 if i is None else i, len(w), len(hit), tuple(sorted(found)), len(found) >= 2))
    assert got == sorted(want)
    assert decontaminate.contamination(spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame([], "item_id bigint, text string")).where("n_hit > 0").count() == 0


def test_proximity(spark):
    scratch = Scratch(spark, "p")
    docs = spark.createDataFrame([(1, "beta x alpha x x gamma"), (2, "alpha x x x x x x x beta gamma"), (3, "alpha beta")], "doc_id bigint, text string")
    w = decontaminate.phrase_windows(spark.createDataFrame([(1, "alpha beta gamma")], "item_id bigint, text string"), "item_id", "text", 8, scratch)
    index = decontaminate.build_index(docs, "doc_id", "text", w, scratch)
    near = decontaminate.proximity_matches(index, w, 5).join(index.heads, "rid")
    assert [r["id"] for r in near.select("id").distinct().collect()] == [1]


def test_chat_trees(spark):
    hard = r"<|im_end|>\<|im_start|>assistant \| <\|"
    rows = [("t", "a", None, "user", hard, 1.0), ("t", "b", "a", "assistant", "short", 1.0), ("t", "c", "a", "assistant", hard + "\n", 9.0), ("t", "d", "c", "ro le\n", None, 0.0),
            ("u", "x", "gone", "assistant", "", None), ("cyc", "p", "q", "user", "1", 1.0), ("cyc", "q", "p", "user", "2", 1.0), (None, "n", None, None, "hi", 1.0)]
    nodes = spark.createDataFrame(rows, "tree string, node string, parent string, role string, text string, score double")
    out = chat.format_trees(nodes)
    said, loss = chat.read_back(F.col("formatted"), F.col("loss_spans"))
    got = {(r["tree"], r["leaf"]): r for r in out.withColumn("said", said).withColumn("loss", loss).collect()}
    assert set(got) == {("t", "b"), ("t", "d"), ("u", "x"), (None, "n")}
    assert [(x["role"], x["text"]) for x in got["t", "d"]["said"]] == [("user", hard), ("assistant", hard + "\n"), ("ro le\n", "")]
    assert got["t", "d"]["loss"] == hard + "\n" and got["t", "d"]["rank"] == 1 and got["t", "b"]["rank"] == 2 and got["u", "x"]["loss"] == ""
    assert [r["leaf"] for r in chat.format_trees(nodes.where("tree = 't'"), best=1).collect()] == ["d"]
    assert chat.format_trees(nodes.where("false")).count() == 0


def test_chat_of_a_repeated_node(spark):
    rows = [(1, "b", None, "user", "top", 1.0, "x"), (1, "a", None, "user", "zzz", 1.0, "x"), (1, "a", "b", "system", "aaa", 1.0, "x"), (1, "a", "b", "system", "aaa", 1.0, "x")]
    nodes = spark.createDataFrame(rows, "tree bigint, node string, parent string, role string, text string, score double, formatted string")
    got = chat.format_trees(nodes).withColumn("said", chat.read_back(F.col("formatted"), F.col("loss_spans"))[0]).collect()
    assert [[(t["role"], t["text"]) for t in r["said"]] for r in got] == [[("user", "top"), ("system", "aaa")]]


def test_chat_of_a_deep_tree(spark):
    rows = [(1, i, i - 1 if i else None, "assistant", f"m{i}", 1.0) for i in range(70)]
    out = chat.format_trees(spark.createDataFrame(rows, "tree bigint, node bigint, parent bigint, role string, text string, score double"))
    r = out.withColumn("loss", chat.read_back(F.col("formatted"), F.col("loss_spans"))[1]).collect()
    assert len(r) == 1 and r[0]["loss"] == "".join(f"m{i}" for i in range(70))


def test_mixing_meets_targets(spark):
    rng = random.Random(6)
    kinds = {"a": ["apple", "pear", "plum"], "b": ["stone", "sand", "clay"], "c": ["red", "blue", "green"]}
    rows, labels = [], []
    for i in range(300):
        k = "aaaabbc"[i % 7]
        rows.append((i, " ".join(rng.choice(kinds[k] + ["the", "of"]) for _ in range(rng.randint(5, 60))), "p"))
        labels.append((i, k if i % 2 else None))
    rows += [(900, None, "p"), (901, "", "p"), (None, "apple pear", "p")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, p string")
    out = mixing.mix(docs, spark.createDataFrame([*labels, (5, "zzz")], "doc_id bigint, domain string"), {"a": 1, "b": 1, "c": 2}, 0.4).collect()
    p, t, r = np.array([x["p"] for x in out]), np.array([x["n_tokens"] for x in out]), np.array([x["rate"] for x in out])
    assert len(out) == len(rows) and (r >= 0).all() and np.allclose(p.sum(1), 1)
    got = (p * (t * r)[:, None]).sum(0)
    assert np.allclose(got, t.sum() * 0.4 * np.array([0.25, 0.25, 0.5]), rtol=1e-4)
    pure = mixing.mix(docs, spark.createDataFrame(labels, "doc_id bigint, domain string"), {"a": 0, "b": 0, "c": 1}, 0.4).collect()
    assert min(x["rate"] for x in pure) == 0.0
    # Where the steps end before the targets are met, that is said.
    with pytest.warns(UserWarning, match="targets missed"):
        hard = mixing.mix(docs, spark.createDataFrame(labels, "doc_id bigint, domain string"), {"a": 0, "b": 0, "c": 1}, 0.4, steps=0)
    ends = {r["domain"]: (r["target"], r["expected"]) for r in mixing.expected(hard, {"a": 0, "b": 0, "c": 1}, 0.4).collect()}
    assert np.isclose(ends["c"][0], t.sum() * 0.4) and ends["a"][0] == 0 and ends["a"][1] > 0
    # Without labels all domains are alike, and every rate is what is asked of the corpus.
    flat = mixing.mix(docs, spark.createDataFrame([], "doc_id bigint, domain string"), {"a": 1, "b": 1}, 0.4).collect()
    assert np.allclose([x["rate"] for x in flat], 0.4)
    assert mixing.mix(docs.where("false"), spark.createDataFrame(labels, "doc_id bigint, domain string"), {"a": 1}).count() == 0


def test_accelerated_steps(spark):
    rng = np.random.default_rng(4)
    p = rng.dirichlet([1, 1, 1], 50)
    history = [(push, rng.normal(size=3).tolist()) for push in (0.0, 0.3, 0.6, 0.0)]
    docs = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(p)], "id bigint, p array<double>")
    got = docs.select("id", mixing.stepped(F.lit(0.5), F.lit(0.4), F.col("p"), history).alias("r")).select("id", "r.*").orderBy("id").collect()
    now, before = np.full(50, 0.5), np.full(50, 0.4)
    for push, g in history:
        now, before = np.maximum(0, now + push * (now - before) - p @ np.array(g)), now
    assert np.allclose([r["now"] for r in got], now) and np.allclose([r["before"] for r in got], before)


def test_tokens_after_edits_equal_a_full_count(spark):
    counter = token_counts.Counter(token_counts.read_ranks(token_counts.DEFAULT))
    rng = random.Random(8)
    parts = ["a", "the ", "  ", " \n", "9 ", "'s", "!", "é", "   ", "\n\n", "x1", " word"]
    for size in (0, 1, 30, 700):
        for _ in range(40):
            text = "".join(rng.choice(parts) for _ in range(size))
            tree = token_counts.build(text, counter)
            for _ in range(4):
                a = rng.randint(0, len(text))
                text, again = token_counts.edit(text, tree, a, a + rng.choice([0, 1, 6, 90]), "".join(rng.choice(parts) for _ in range(rng.choice([0, 2, 40]))), counter)
                assert tree.total == len(counter.encode(text)) and sum(tree.chars) == len(text) and again <= len(text)
    text = "some words here " * 4000
    _, again = token_counts.edit(text, token_counts.build(text, counter), 30_000, 30_004, "x", counter)
    assert again < 1500
    docs = spark.createDataFrame([(1, "a b c", 5), (2, None, 5), (3, "", 5), (None, "tail", 5)], "doc_id bigint, text string, n_tokens int")
    edits = spark.createDataFrame([(1, 2, 0, 1, "first "), (1, 1, 99, 120, " end"), (3, 1, 0, 0, "new"), (2, 1, 0, 0, None)], "doc_id bigint, seq int, start int, end int, insert string")
    got = {r["doc_id"]: r for r in token_counts.recount(token_counts.collect_edits(docs, edits), "edits").collect()}
    assert got[1]["text_after"] == "first  b c end" and got[3]["text_after"] == "new" and got[None]["text_after"] == "tail" and got[2]["n_tokens"] == 0
    assert all(r["n_tokens_after"] == len(counter.encode(r["text_after"] or "")) for r in got.values())


def test_kept_trees_encode_only_what_edits_touch(spark):
    counter = token_counts.Counter(token_counts.read_ranks(token_counts.DEFAULT))
    long = "some words here " * 4000
    docs = spark.createDataFrame([(1, long), (2, None), (3, ""), (None, "a tail"), (1, long)], "doc_id bigint, text string")
    none = F.array().cast("array<struct<start:bigint,end:bigint,insert:string>>")
    kept = token_counts.recount(docs.withColumn("edits", none), "edits")
    assert all(r["built"] and r["n_tokens"] == r["n_tokens_after"] == len(counter.encode(r["text_after"] or "")) for r in kept.collect())
    text = long
    for k in range(3):
        change = F.array(F.struct(F.lit(30_000 + k).cast("bigint").alias("start"), F.lit(30_004).cast("bigint").alias("end"), F.lit(f"x{k} " * 500).alias("insert")))
        again = kept.select("doc_id", F.col("text_after").alias("text"), "tree").withColumn("edits", F.when(F.col("doc_id") == 1, change))
        kept = token_counts.recount(again, "edits", tree_col="tree")
        text = text[: 30_000 + k] + f"x{k} " * 500 + text[max(30_004, 30_000 + k) :]
        rows = kept.collect()
        assert len(rows) == 5 and not any(r["built"] for r in rows)
        for r in rows:
            assert r["n_tokens_after"] == len(counter.encode(r["text_after"] or "")) == sum(r["tree"]["tokens"])
            assert r["doc_id"] != 1 or (r["text_after"] == text and 0 < r["recoded_chars"] < 4000)
        assert max(len(counter.pattern.findall(text)) / r["n_leaves"] for r in rows if r["doc_id"] == 1) <= 2 * token_counts.LEAF
    # A tree of another text is not believed.
    other = kept.select("doc_id", F.concat("text_after", F.lit(" more")).alias("text"), "tree").withColumn("edits", none)
    assert all(r["built"] == (r["text_after"] is not None) and r["n_tokens"] == len(counter.encode(r["text_after"] or "")) for r in token_counts.recount(other, "edits", tree_col="tree").collect())
    assert token_counts.recount(again.where("false"), "edits", tree_col="tree").count() == 0


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(3)
    line = lambda: " ".join("".join(rng.choice("abcdefg") for _ in range(6)) for _ in range(25))
    leak = line()
    rows = [(i, f"{line()}\n{line()}", "en", "s", 0) for i in range(60)]
    rows += [(100 + i, f"{line()} vilest rotten foul vilest rotten foul", "en", "s", 0) for i in range(40)]
    rows += [(200, rows[0][1], "en", "s", 0), (201, f"{line()}\n{leak}", "en", "s", 0), (202, None, "en", "s", None)]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, leak)], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(r[0], 1, int(r[0] >= 100)) for r in rows[:100]], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r["doc_id"] for r in out} == {*range(60), 202}


@pytest.mark.parametrize("stage", ["toxicity", "line_dedup", "near_dedup", "decontamination"])
def test_stages_take_empty_tables(spark, tmp_path, stage):
    import corpus_pipeline

    spark.createDataFrame([], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.createDataFrame([], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    out = dict(corpus_pipeline.STAGES)[stage](spark, docs, str(tmp_path))
    assert out.columns == docs.columns and out.count() == 0
