"""Near duplicates, lines and passages against brute force."""

import random
import re
from itertools import combinations

import numpy as np
import pytest

from vellum.llm import minhash
from vellum.llm.graph import components
from vellum.llm.line_dedup import dedup_lines
from vellum.llm.near_dedup import near_duplicates
from vellum.llm.minhash import flat_shingles, shingles
from vellum.llm.passage_dedup import repeated_passages, word_tables
from vellum.llm.shared import Scratch

SCHEMA = "doc_id bigint, text string, key string, sig string"


def words(rng, n):
    return ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7))) for _ in range(n)]


def corpus(seed=5):
    """Copies, edited copies, a large group around a hub that its members resemble more than each other, and odd rows."""
    rng = random.Random(seed)
    rows = []
    hub = words(rng, 120)
    for i in range(60):
        text = list(hub)
        for _ in range(rng.choice([0, 1, 2, 3])):
            text[rng.randrange(len(text))] = "edit"
        rows.append((i, " ".join(text)))
    for i in range(60, 110):
        base = words(rng, rng.choice([1, 2, 3, 4, 40]))
        rows += [(2 * i, " ".join(base)), (2 * i + 1, " ".join(base).upper() if i % 2 else " ".join([*base, "more"]))]
    rows += [(900, None), (901, ""), (902, " \n\t"), (903, "x" * 50_000), (None, "alone here now ok"), (904, rows[0][1]), (904, rows[0][1]), (905, "Éa éa b c"), (906, "éa éa b c")]
    return rows


def roots(ids, links):
    up = {i: i for i in ids}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


@pytest.mark.parametrize(("n", "share"), [(3, (85, 100)), (5, (80, 100))])
def test_near_duplicates(spark, n, share):
    rows = corpus()
    df = spark.createDataFrame([(i, t, "k", "s") for i, t in rows], SCHEMA)
    got = near_duplicates(df, n_words=n, share=share).collect()
    sets = {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} or ({tuple(w)} if w else set())
    ids = [i for i in sets if i is not None]
    want = roots(ids, [(a, b) for a, b in combinations(ids, 2) if sets[a] and share[1] * len(sets[a] & sets[b]) >= share[0] * len(sets[a] | sets[b])])
    assert len(got) == len(rows)
    for r in got:
        assert r["n_shingles"] == len(sets[r["doc_id"]])
        if r["doc_id"] is not None:
            assert (r["component_id"], r["kept"]) == (want[r["doc_id"]], want[r["doc_id"]] == r["doc_id"])


def test_what_is_alike_alone_is_moved(spark):
    """Where nothing is small enough to be broadcast, the signatures of texts unlike all others are shuffled once."""
    rng = random.Random(41)
    rows = [(i, " ".join(words(rng, 30))) for i in range(2000)]
    rows += [(5000 + i, rows[i][1] + " more") for i in range(20)] + [(None, rows[30][1] + " more"), (30, rows[30][1]), (7, rows[7][1])]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    sc = spark.sparkContext._jsc.sc()

    def moved():
        sc.listenerBus().waitUntilEmpty()
        told = sc.statusStore().executorList(True)
        return sum(told.apply(i).totalShuffleWrite() for i in range(told.size()))

    names = ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold")
    try:
        for name in names:
            spark.conf.set(name, "-1")
        before = moved()
        got = near_duplicates(df, n_words=3, share=(85, 100)).collect()
        after = moved()
    finally:
        for name in names:
            spark.conf.unset(name)
    assert len(got) == len(rows)
    want = {**{i: i for i in range(2000)}, **{5000 + i: i for i in range(20)}, None: 30}
    assert {r["doc_id"]: r["component_id"] for r in got} == want
    assert after - before < 3 * len(rows) * 125 * 4


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id bigint, text string")
    assert near_duplicates(none).count() == dedup_lines(none).count() == repeated_passages(none).count() == 0


def test_lines(spark):
    rng = random.Random(2)
    base = [" ".join(words(rng, 14)) for _ in range(12)]
    rows = []
    for i in range(30):
        lines = [rng.choice(base) for _ in range(4)]
        lines[1] = lines[1][:-1] + rng.choice("xyz")
        rows.append((i, "\n".join([*lines, "", "own line %d here" % (i * 7919), "  " + lines[0] + " "])))
    rows += [(100, None), (101, ""), (102, "ab"), (103, "ab\nab"), (None, base[0])]
    got = {r["doc_id"]: r for r in dedup_lines(spark.createDataFrame([(i, t, i, "z") for i, t in rows], "doc_id bigint, text string, n_lines int, lines string")).collect()}
    at = [(1 if i is None else 0, i or 0, no, line.strip(" \t\r\x0b\x0c"), i) for i, t in rows if t is not None for no, line in enumerate(t.split("\n"))]
    at = sorted(x for x in at if x[3])
    sets = {x[3]: {x[3][k : k + 7] for k in range(max(1, len(x[3]) - 6))} for x in at}
    comp = roots(sets, [(a, b) for a, b in combinations(sorted(sets), 2) if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])])
    kept, seen = set(), set()
    for x in at:
        if comp[x[3]] not in seen:
            seen.add(comp[x[3]])
            kept.add((x[4], x[2]))
    for i, t in rows:
        if t is None:
            assert got[i]["text"] is None and got[i]["n_lines"] == 0
        else:
            assert got[i]["text"] == "\n".join(line for no, line in enumerate(t.split("\n")) if not line.strip() or (i, no) in kept)
            assert got[i]["n_removed"] == sum(bool(line.strip()) and (i, no) not in kept for no, line in enumerate(t.split("\n")))
    assert got[0]["lines"] == "z"


def test_passages_inside_other_text(spark):
    rng = random.Random(9)
    passage = " ".join(words(rng, 60))
    rows = [(i, " ".join(words(rng, 30 + i)) + " " + passage + " " + " ".join(words(rng, 25))) for i in range(4)]
    near = words(rng, 60)
    rows += [(10, "first\n" + " ".join(near)), (11, "second\n" + " ".join([*near[:59], "edit"]))]
    rows += [(20 + i, " ".join(words(rng, 80))) for i in range(5)] + [(30, None), (31, ""), (None, passage)]
    got = repeated_passages(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    texts = dict(rows)
    assert {r["doc_id"] for r in got} == {0, 1, 2, 3, 10, 11}
    assert {r["doc_id"] for r in got if not r["removed"]} == {0, 10}
    assert {r["component_id"] for r in got} == {0, 10}
    for r in got:
        part = texts[r["doc_id"]][r["start"] : r["end"]]
        assert part in (passage if r["doc_id"] < 10 else texts[r["doc_id"]]) and len(part.split()) >= 17


def test_passages_are_covered_whole(spark):
    rng = random.Random(33)
    rows, planted = [], {}
    for j in range(25):
        passage = words(rng, 60) if j < 20 else (words(rng, 1 + j % 5) * 60)[:60]
        for i in (2 * j, 2 * j + 1):
            before = [f"a{i}x{k}" for k in range(20 + j)]
            rows.append((i, " ".join([*before, *passage, *(f"b{i}x{k}" for k in range(15 + j))])))
            at = len(" ".join(before)) + 1
            planted[i] = (at, at + len(" ".join(passage)), i % 2 == 1)
    # 100 and 101 share 60 words, of which those from the 20th to the 57th stand in 99 as well.
    part = [f"p{k}" for k in range(60)]
    rows += [(99, " ".join([*(f"c{k}" for k in range(20)), *part[20:58], *(f"d{k}" for k in range(20))]))]
    rows += [(i, " ".join([*(f"e{i}x{k}" for k in range(20)), *part, *(f"f{i}x{k}" for k in range(20))])) for i in (100, 101)]
    got = {}
    for r in repeated_passages(spark.createDataFrame(rows, "doc_id bigint, text string")).collect():
        got.setdefault(r["doc_id"], []).append((r["start"], r["end"], r["removed"]))
    assert {i: got[i] for i in planted} == {i: [span] for i, span in planted.items()}
    assert [dict(rows)[101][a:b] for a, b, removed in got[101]] == [" ".join(part)]


def test_passages_far_inside_long_texts(spark):
    """Places beyond 2 bytes, beside a short text; a window in many documents; white space of all kinds, beyond the BMP."""
    rng = random.Random(29)
    passage = words(rng, 70)
    rows = [(1, " ".join(passage)), (2, " ".join([*words(rng, 16_000), *passage, "z1"])), (3, "\U0001f600\t \x0b" + " ".join(["y", *passage]) + "\f\r")]
    rows += [(i, " ".join([f"a{i}", *passage, f"b{i}"])) for i in range(10, 400)]
    texts = dict(rows)
    assert texts[2].index(" ".join(passage)) > 1 << 16
    whole = {i: (t.index(" ".join(passage)), t.index(" ".join(passage)) + len(" ".join(passage))) for i, t in texts.items()}
    got = repeated_passages(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert [(r["start"], r["end"]) for r in got if r["doc_id"] == 2] == [whole[2]]
    # the others are near copies as lines, too
    covered = {(r["doc_id"], r["removed"]) for r in got if r["start"] <= whole[r["doc_id"]][0] and r["end"] >= whole[r["doc_id"]][1]}
    assert covered == {(i, i > 1) for i in texts}


def test_words_of_many_texts_as_of_each():
    texts = ["a b  c", "", " \t", "x\u00a0y z", "\x00b c\n", "\U0001f600 " * 3 + "end"]
    start, end, h, first = word_tables(texts)
    for i, text in enumerate(texts):
        own = slice(first[i], first[i + 1])
        want = [(m.start(), m.end()) for m in re.finditer("[^ \t-\r]+", text)]
        assert list(zip(start[own].tolist(), end[own].tolist(), strict=True)) == want
        _, _, alone, _ = word_tables([text])
        assert h[own].tolist() == alone.tolist()
    sizes = np.diff(first)
    hashes, counts = flat_shingles(h, sizes, 3)
    each = [shingles(h[first[i] : first[i + 1]], 3) for i in range(len(texts))]
    assert hashes.tolist() == np.concatenate(each).tolist() and counts.tolist() == [len(s) for s in each]


def test_short_lines_are_paragraphs(spark):
    rng = random.Random(21)
    six, twelve, four = (" ".join(words(rng, n)) for n in (6, 12, 4))
    fuzzy = words(rng, 18)
    rows = [(i, "\n".join([f"head {i}", six, f"own {i} " + " ".join(words(rng, 9)), twelve, four, "", " \t"])) for i in range(3)]
    rows += [(10, " ".join(fuzzy)), (11, " ".join([*fuzzy[:17], "edit"]))]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    texts = dict(rows)
    got = {(r["doc_id"], texts[r["doc_id"]][r["start"] : r["end"]], r["removed"]) for r in repeated_passages(df).collect()}
    want = {(i, line, i > 0) for i in range(3) for line in (six, twelve)} | {(10, texts[10], False), (11, texts[11], True)}
    assert got == want
    assert repeated_passages(df, least_words=20).count() == 0
    every = {(r["doc_id"], texts[r["doc_id"]][r["start"] : r["end"]]) for r in repeated_passages(df, least_words=1).collect()}
    assert all((i, twelve + "\n" + four) in every for i in range(3))


def test_components_of_a_long_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(100)] + [(1000, 1000 + i) for i in range(1, 300)] + [(5, 5), (7, 6)]
    got = components(spark.createDataFrame(edges, "a bigint, b bigint"), Scratch(spark, "t")).collect()
    assert {r["node"]: r["root"] for r in got} == {**{i: 0 for i in range(101)}, **{1000 + i: 1000 for i in range(300)}}


@pytest.mark.parametrize("chunk", [7, 1 << 19])
def test_components_in_ascending_order(spark, chunk):
    edges = [(i, i + 1) for i in range(1000)] + [(5000, 5000 + i) for i in range(1, 3000)] + [(None, 3), (3, None)]
    got = components(spark.createDataFrame(edges, "a bigint, b bigint").repartition(8), Scratch(spark, "t"), chunk=chunk).collect()
    assert {r["node"]: r["root"] for r in got} == {**{i: 0 for i in range(1001)}, **{5000 + i: 5000 for i in range(3000)}} and len(got) == 4001


def test_pairs_are_compared_exactly():
    rng = np.random.default_rng(5)
    sets = [rng.integers(0, 2**63, rng.integers(1, 60)).astype(np.uint64) for _ in range(30)]
    sets += [np.concatenate([s[: max(1, len(s) * 9 // 10)], rng.integers(0, 2**63, 2).astype(np.uint64)]) for s in sets] + [np.repeat(sets[0], 2)]
    flat, counts = minhash.distinct_runs(np.concatenate(sets), np.array([len(s) for s in sets]))
    a, b = np.triu_indices(len(sets), 1)
    want = [100 * len(set(sets[x]) & set(sets[y])) >= 80 * len(set(sets[x]) | set(sets[y])) for x, y in zip(a.tolist(), b.tolist(), strict=True)]
    assert sum(want) > 5
    assert minhash.pairs_agree(flat, counts, a, b, (80, 100)).tolist() == want
    assert minhash.blocks_agree(flat, counts, a, b, np.zeros(len(a), int), (80, 100)).tolist() == want
    assert minhash.group_agrees(flat, counts, np.arange(len(sets)), a, b, (80, 100), room=200).tolist() == want


def test_signatures_do_not_depend_on_stretches():
    rng = np.random.default_rng(6)
    counts = np.array([3, 500, 1, 40, 7])
    hashes = rng.integers(0, 2**63, counts.sum()).astype(np.uint64)
    assert (minhash.flat_signatures(hashes, counts, 12) == minhash.flat_signatures(hashes, counts, 12, stretch=64)).all()


def test_pruning_bounds():
    least = minhash.fewest_matches(0.85, 1e-9, 125, 25)
    assert list(least) == [25, 50, 75, 100, 125] and sorted(least.values()) == list(least.values())
    rng = np.random.default_rng(1)
    a = rng.integers(0, 2**32, (2000, 125), dtype=np.uint32)
    b = np.where(rng.random(a.shape) < 0.85, a, a + np.uint32(1))
    assert len(minhash.still_likely(a, b, least)) == 2000
    c = np.where(rng.random(a.shape) < 0.4, a, a + np.uint32(1))
    assert len(minhash.still_likely(a, c, least)) == 0


def test_signature_estimates_jaccard():
    rng = np.random.default_rng(2)
    x = rng.integers(0, 2**63, 400).astype(np.uint64)
    sig = minhash.signatures([x[:300], x[100:], x[:300][::-1].copy(), x[:5]], 512)
    assert (sig[0] == sig[2]).all() and abs((sig[0] == sig[1]).mean() - 0.5) < 0.1
    one = minhash.char_shingles(["abcdefgh", "ab", "abcdefgh"], 5)
    assert one[1].tolist() == [4, 1, 4] and (one[0][:4] == one[0][5:]).all()
