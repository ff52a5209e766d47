"""Toxic spans by a linear-chain conditional random field, and document scores from its marginals."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .minhash import sliced
from .shared import release, small_batches

WORD = re.compile(r"[^\W\d_]+")
#: Tokens in one chain at most; a longer line is several chains.
CHAIN = 64
LENGTHS = (4, 5, 6)


def features(word: str) -> list[str]:
    """What the field sees of a token: the word, and its beginnings."""
    return [word, *(f"{word[:n]}*" for n in LENGTHS if len(word) >= n)]


def marginals(emission: np.ndarray, lengths: np.ndarray, trans: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Forward-backward over padded chains (chains x longest): P(state 1) of each token, and the expected
    number of each of the four transitions.

    emission: log potential of state 1, that of state 0 being 0; trans[i, j]: log potential of j after i.
    """
    n, longest = emission.shape
    inside = np.arange(longest)[None, :] < lengths[:, None]
    a0, a1 = np.zeros((n, longest)), np.zeros((n, longest))
    a1[:, 0] = emission[:, 0]
    for t in range(1, longest):
        x0 = np.logaddexp(a0[:, t - 1] + trans[0, 0], a1[:, t - 1] + trans[1, 0])
        x1 = np.logaddexp(a0[:, t - 1] + trans[0, 1], a1[:, t - 1] + trans[1, 1]) + emission[:, t]
        a0[:, t] = np.where(inside[:, t], x0, a0[:, t - 1])
        a1[:, t] = np.where(inside[:, t], x1, a1[:, t - 1])
    log_z = np.logaddexp(a0[:, -1], a1[:, -1])
    b0, b1 = np.zeros((n, longest)), np.zeros((n, longest))
    for t in range(longest - 2, -1, -1):
        next0, next1 = b0[:, t + 1], b1[:, t + 1] + emission[:, t + 1]
        b0[:, t] = np.where(inside[:, t + 1], np.logaddexp(trans[0, 0] + next0, trans[0, 1] + next1), 0)
        b1[:, t] = np.where(inside[:, t + 1], np.logaddexp(trans[1, 0] + next0, trans[1, 1] + next1), 0)
    p = np.where(inside, np.exp(np.minimum(a1 + b1 - log_z[:, None], 0)), 0)
    moves = np.zeros((2, 2))
    for t in range(longest - 1):
        on = inside[:, t + 1]
        for i, a in ((0, a0), (1, a1)):
            for j, b in ((0, b0[:, t + 1]), (1, b1[:, t + 1] + emission[:, t + 1])):
                moves[i, j] += np.exp(np.minimum(a[on, t] + trans[i, j] + b[on] - log_z[on], 0)).sum()
    return p, moves


def chains(text: str) -> Iterator[list[str]]:
    for line in text.lower().split("\n"):
        words = WORD.findall(line)
        for at in range(0, len(words), CHAIN):
            yield words[at : at + CHAIN]


@dataclass
class Model:
    weights: dict[str, float]
    bias: float
    trans: np.ndarray
    calibration: np.ndarray
    cache: dict[str, float] = field(default_factory=dict)

    def emission(self, word: str) -> float:
        e = self.cache.get(word)
        if e is None:
            if len(self.cache) >= 150_000:
                self.cache.clear()
            e = self.cache[word] = self.bias + sum(self.weights.get(f, 0.0) for f in features(word))
        return e

    def expected(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, dict[int, list[tuple[int, np.ndarray]]]]:
        """Of each text: expected number of toxic tokens over that of featureless text as long, number of tokens, and
        marginals of the chains with any evidence.

        A chain none of whose tokens has a feature with a weight has marginals that depend on its length only.
        """
        total, tokens = np.zeros(len(texts)), np.zeros(len(texts))
        plain = self.plain()
        owner, rows, at = [], [], []
        for i, text in enumerate(texts):
            start = 0
            for words in chains(text or ""):
                e = np.fromiter(map(self.emission, words), float, len(words))
                tokens[i] += len(e)
                if not (e == self.bias).all():
                    owner.append(i)
                    rows.append(e)
                    at.append(start)
                start += len(e)
        found: dict[int, list[tuple[int, np.ndarray]]] = {}
        for k in range(0, len(rows), 4096):
            part = rows[k : k + 4096]
            lengths = np.array([len(e) for e in part])
            padded = np.zeros((len(part), lengths.max()))
            for r, e in enumerate(part):
                padded[r, : len(e)] = e
            p, _ = marginals(padded, lengths, self.trans)
            for r, n in enumerate(lengths):
                i = owner[k + r]
                total[i] += max(0.0, p[r, :n].sum() - plain[n])
                found.setdefault(i, []).append((at[k + r], p[r, :n]))
        return total, tokens, found

    def plain(self) -> np.ndarray:
        if getattr(self, "_plain", None) is None:
            lengths = np.arange(1, CHAIN + 1)
            p, _ = marginals(np.full((CHAIN, CHAIN), self.bias), lengths, self.trans)
            self._plain = np.concatenate([[0.0], p.sum(axis=1)])
        return self._plain

    def score(self, total: np.ndarray, tokens: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(evidence(total, tokens) @ self.calibration, -30, 30)))


def evidence(total: np.ndarray, tokens: np.ndarray) -> np.ndarray:
    return np.stack([np.ones(len(total)), np.log1p(total), total / np.sqrt(1 + tokens)], axis=1)


def ratio(counts: list[Counter], n0: int, n1: int, least_g: float) -> dict[str, float]:
    """Likelihood ratio statistics of the features that label 1 has over four times as often as label 0."""
    out = {}
    for f, k1 in counts[1].items():
        k0 = counts[0][f]
        p, p1, p0 = (k0 + k1) / (n0 + n1), k1 / n1, k0 / n0
        if p1 > 4 * p0:
            g = 2 * sum(k * np.log(q / p) for k, q in ((k1, p1), (k0, p0)) if k)
            g += 2 * sum((n - k) * np.log((1 - q) / (1 - p)) for n, k, q in ((n1, k1, p1), (n0, k0, p0)) if q < 1 and p < 1)
            if g >= least_g:
                out[f] = g
    return out


def fit(texts: list[str], labels: np.ndarray, least_g: float = 20.0, most: int = 50_000, steps: int = 60, seed: int = 3) -> Model:
    """Learns the field and the calibration from texts and their labels.

    Documents are labelled, tokens aren't: a token of a toxic document counts as toxic if one of its features
    is tied to label 1 with a likelihood ratio statistic of at least least_g, both by the lines that have it and
    by the surroundings it is seen in. Lines count once however often they are copied, with the smallest label
    that any copy has. The field then learns the
    weights of those features, a bias and the transitions by gradient ascent on the likelihood of the chains.
    """
    lines: dict[str, int] = {}
    for text, y in zip(texts, labels, strict=True):
        for line in (text or "").lower().split("\n"):
            lines[line] = min(lines.get(line, 1), int(y))
    in_lines = [Counter(), Counter()]
    for line, y in lines.items():
        in_lines[y].update({f for w in set(WORD.findall(line)) for f in features(w)})
    n1 = sum(lines.values())
    tied = ratio(in_lines, max(1, len(lines) - n1), max(1, n1), least_g)
    # Edited copies repeat a word in the same surroundings, so candidates are counted again, once for each pair of neighbours.
    around: list[dict[str, set[int]]] = [{}, {}]
    tokens = [0, 0]
    for line, y in lines.items():
        words = ["", *WORD.findall(line), ""]
        tokens[y] += len(words) - 2
        for before, w, after in zip(words, words[1:-1], words[2:], strict=False):
            for f in features(w):
                if f in tied:
                    around[y].setdefault(f, set()).add(hash((before, after)))
    in_context = [Counter({f: len(x) for f, x in side.items()}) for side in around]
    strong = ratio(in_context, max(1, tokens[0]), max(1, tokens[1]), least_g)
    names = sorted(strong, key=lambda f: (-strong[f], f))[:most]
    index = {f: i for i, f in enumerate(names)}
    rng = np.random.default_rng(seed)
    seqs: list[tuple[list[list[int]], np.ndarray]] = []
    for line, y in lines.items():
        for words in chains(line):
            hits = [[index[f] for f in features(w) if f in index] for w in words]
            if any(hits) or rng.random() < 0.02:
                seqs.append((hits, np.array([bool(h) and y == 1 for h in hits], float)))
    w, bias, trans = np.zeros(len(names)), -3.0, np.zeros((2, 2))
    if seqs:
        lengths = np.array([len(y) for _, y in seqs])
        longest = lengths.max()
        gold = np.zeros((len(seqs), longest))
        row, col, feat = [], [], []
        for r, (hits, y) in enumerate(seqs):
            gold[r, : len(y)] = y
            for c, h in enumerate(hits):
                row += [r] * len(h)
                col += [c] * len(h)
                feat += h
        row, col, feat = (np.array(x, int) for x in (row, col, feat))
        inside = np.arange(longest)[None, :] < lengths[:, None]
        pairs = inside[:, 1:]
        tokens = inside.sum()
        seen = np.array([[((gold[:, :-1] == i) & (gold[:, 1:] == j) & pairs).sum() for j in (0, 1)] for i in (0, 1)], float)
        m = [np.zeros(len(names)), 0.0, np.zeros((2, 2))]
        v = [np.zeros(len(names)), 0.0, np.zeros((2, 2))]
        for step in range(1, steps + 1):
            e = np.full((len(seqs), longest), bias)
            np.add.at(e, (row, col), w[feat])
            p, both = marginals(e, lengths, trans)
            gap = np.where(inside, gold - p, 0)
            grads = [np.bincount(feat, gap[row, col], len(names)) - 0.01 * w, gap.sum(), seen - both - 0.01 * trans]
            new = []
            for i, (x, g) in enumerate(zip((w, bias, trans), grads, strict=True)):
                g = g / (1 if i == 0 else max(1, tokens / 1000))
                m[i] = 0.9 * m[i] + 0.1 * g
                v[i] = 0.99 * v[i] + 0.01 * g * g
                new.append(x + 0.3 * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.99**step)) + 1e-8))
            w, bias, trans = new
    model = Model(dict(zip(names, map(float, w), strict=True)), float(bias), trans, np.zeros(3))
    total, tokens, _ = model.expected(list(texts))
    if not len(labels):
        model.calibration = np.array([-4.0, 0.0, 0.0])
        return model
    x, beta = evidence(total, tokens), np.zeros(3)
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + 1e-2 * np.eye(3)
        beta = beta + np.linalg.solve(h, x.T @ (labels - p) - 1e-2 * beta)
    model.calibration = beta
    return model


def training_rows(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, per_label: int, max_chars: int) -> tuple[list[str], np.ndarray]:
    """At most per_label rows of each label, by the hash of the id; rows held out or longer than max_chars are not among them."""
    one = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isin(0, 1)).groupBy(id_col).agg(F.max(label_col).cast("int").alias("y"))
    one = one.where(F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(5)) != 0)
    picked = None
    for y in (0, 1):
        some = one.where(F.col("y") == y).orderBy(F.xxhash64(id_col), id_col).limit(per_label)
        picked = some if picked is None else picked.unionByName(some)
    rows = docs.select(F.col(id_col), F.col(text_col).alias("t")).where(F.length("t") <= max_chars).join(F.broadcast(picked), id_col).select("t", "y")
    got = rows.toArrow()
    return got.column("t").to_pylist(), np.array(got.column("y").to_pylist(), int)


def score_toxicity(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", per_label: int = 4000, max_chars: int = 20_000
) -> DataFrame:
    """One row for each row of docs: id, held_out, score, predicted, n_tokens, spans (start, end, p) of toxic tokens.

    The field is fitted on at most per_label labelled texts of each label, of at most max_chars each, whose
    crc32(id) mod 5 is not 0; every whole text is scored. Null or wordless texts get the score of no evidence, and
    so does every text where nothing was learnt. A null id is not held out. Several labels of an id count as
    their maximum; labels other than 0 and 1 are not used. Extra columns are not read.
    """
    small_batches(docs.sparkSession)
    texts, y = training_rows(docs, labels, id_col, text_col, label_col, per_label, max_chars)
    model = fit(texts, y)
    model.cache = {}
    shared = docs.sparkSession.sparkContext.broadcast(model)
    base = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = base.schema["id"].dataType.simpleString()
    spans_type = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("p", pa.float64())]))

    def spans(text: str, found: list[tuple[int, np.ndarray]]) -> list[dict]:
        p = {at + j: float(x) for at, part in found for j, x in enumerate(part) if x >= 0.5}
        if not p:
            return []
        lower, out = text.lower(), []
        if len(lower) != len(text):  # a letter that lower() makes longer: offsets are those of the text as it was
            lower = "".join(c if len(c.lower()) > 1 else c.lower() for c in text)
        # one token of each line follows the other, as in chains()
        for k, m in enumerate(WORD.finditer(lower)):
            if k in p:
                out.append({"start": m.start(), "end": m.end(), "p": p[k]})
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for x in sliced(batches, "text"):
            texts = [t or "" for t in x.column("text").to_pylist()]
            total, tokens, found = model.expected(texts)
            marks = [spans(t, found[i]) if i in found else [] for i, t in enumerate(texts)]
            yield pa.RecordBatch.from_arrays(
                [x.column("id"), pa.array(model.score(total, tokens)), pa.array(tokens.astype(np.int64)), pa.array(marks, spans_type)], ["id", "score", "n_tokens", "spans"]
            )
        model.cache.clear()  # the worker that holds the broadcast goes on to other work
        release()

    out = base.mapInArrow(run, f"id {kind}, score double, n_tokens bigint, spans array<struct<start:bigint,end:bigint,p:double>>")
    held = F.coalesce(F.pmod(F.crc32(F.col("id").cast("string").cast("binary")), F.lit(5)) == 0, F.lit(False))
    return out.select(F.col("id").alias(id_col), held.alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"), "n_tokens", "spans")


def without_toxic(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", threshold: float = 0.5, per_label: int = 4000, max_chars: int = 20_000
) -> DataFrame:
    """docs, all columns, without the rows that score threshold or more; see score_toxicity()."""
    small_batches(docs.sparkSession)
    texts, y = training_rows(docs, labels, id_col, text_col, label_col, per_label, max_chars)
    model = fit(texts, y)
    model.cache = {}
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for x in sliced(batches, text_col):
            total, tokens, _ = model.expected([t or "" for t in x.column(text_col).to_pylist()])
            yield x.filter(pa.array(model.score(total, tokens) < threshold))
        model.cache.clear()
        release()

    return docs.mapInArrow(run, docs.schema)
