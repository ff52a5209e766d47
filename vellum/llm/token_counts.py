"""Edit-aware token counts: a segment tree of each text's pre-tokens; edits re-encode only what they touch."""

from __future__ import annotations

import base64
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
import regex
import tiktoken
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .minhash import sliced

#: Fixed value: the public pattern that cuts text to pre-tokens for this vocabulary.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
DEFAULT = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Pre-tokens in a leaf.
LEAF = 64
#: Characters beyond its end that the pattern may look at to end a match.
LOOK = 2
#: A kept tree, and the columns of recount().
TREE = "struct<chars:array<int>,tokens:array<int>,stamp:bigint>"
KINDS = {c: pa.int64() for c in ("n_tokens", "n_tokens_after", "n_leaves", "n_edits", "recoded_chars")} | {
    "built": pa.bool_(),
    "text_after": pa.string(),
    "tree": pa.struct([("chars", pa.list_(pa.int32())), ("tokens", pa.list_(pa.int32())), ("stamp", pa.int64())]),
}


class Counter(dict):
    """pre-token -> number of tokens, remembered up to a bound."""

    def __init__(self, ranks: dict[bytes, int], pattern: str = PATTERN):
        super().__init__()
        self.encode = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.pattern = regex.compile(pattern)

    def __missing__(self, piece: str) -> int:
        if len(self) >= 150_000:
            self.clear()
        n = self[piece] = len(self.encode(piece))
        return n


class Tree:
    """Leaves of consecutive pre-tokens: their characters and tokens; sums[1] is the whole, node i has children 2i, 2i + 1."""

    def __init__(self, chars: list[int], tokens: list[int]):
        self.chars, self.size = chars, 1
        while self.size < len(chars):
            self.size *= 2
        self.sums = [0] * self.size + tokens + [0] * (self.size - len(tokens))
        for i in range(self.size - 1, 0, -1):
            self.sums[i] = self.sums[2 * i] + self.sums[2 * i + 1]

    @property
    def total(self) -> int:
        return self.sums[1]

    @property
    def tokens(self) -> list[int]:
        return self.sums[self.size : self.size + len(self.chars)]

    def put(self, leaf: int, chars: int, tokens: int) -> None:
        """Sets a leaf and updates the sums above it."""
        self.chars[leaf] = chars
        i = self.size + leaf
        gain = tokens - self.sums[i]
        while i:
            self.sums[i] += gain
            i //= 2


def build(text: str, counter: Counter) -> Tree:
    pieces = counter.pattern.findall(text)
    sizes, counts = list(map(len, pieces)), list(map(counter.__getitem__, pieces))
    at = range(0, len(pieces), LEAF)
    return Tree([sum(sizes[i : i + LEAF]) for i in at] or [0], [sum(counts[i : i + LEAF]) for i in at] or [0])


def edit(text: str, tree: Tree, start: int, end: int, insert: str, counter: Counter) -> tuple[str, int]:
    """Replaces [start, end) and updates the tree; returns the new text and the characters that were encoded again.

    A match of the pattern depends on nothing before it and on LOOK characters after it. So matching restarts at
    the first leaf that the edit or its context touches, and ends at the first old leaf boundary after the edit
    where the new matches meet it: from there on they are the old ones.
    """
    start = max(0, min(start, len(text)))
    end = max(start, min(end, len(text)))
    new = text[:start] + insert + text[end:]
    shift = len(new) - len(text)
    begins = [0]
    for n in tree.chars:
        begins.append(begins[-1] + n)
    first = max(0, min(bisect_right(begins, max(0, start - LOOK)) - 1, len(tree.chars) - 1))
    while first and tree.chars[first] == 0:
        first -= 1
    ends = {begins[j] + shift: j for j in range(len(begins) - 1, first, -1) if begins[j] >= end}  # equal begins: the first leaf
    pieces: list[str] = []
    at, last = begins[first], len(tree.chars)
    for m in counter.pattern.finditer(new, at):
        if m.start() in ends:
            last = ends[m.start()]
            break
        pieces.append(m[0])
    else:
        last = len(tree.chars)
    slots = last - first
    each = -(-len(pieces) // slots) if slots else 0
    if each > 2 * LEAF or (slots > 1 and each < LEAF // 2):
        # Kept trees see many edits: leaves that would grow long, or many that would be left short, are dealt anew.
        part = [pieces[i : i + LEAF] for i in range(0, len(pieces), LEAF)]
        chars = tree.chars[:first] + [sum(map(len, x)) for x in part] + tree.chars[last:]
        tokens = tree.tokens
        tokens[first:last] = [sum(map(counter.__getitem__, x)) for x in part]
        tree.__init__(chars or [0], tokens or [0])
        return new, sum(map(len, pieces))
    for s in range(slots):
        part = pieces[s * each : (s + 1) * each]
        tree.put(first + s, sum(map(len, part)), sum(map(counter.__getitem__, part)))
    return new, sum(map(len, pieces))


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def stamp(text: str, seed: int) -> int:
    """Ties a kept tree to its text and, by seed, to the vocabulary and the pattern."""
    return xxhash.xxh3_64_intdigest(text.encode("utf-8", "surrogatepass"), seed) - 2**63


def recount(
    docs: DataFrame, edits_col: str, vocabulary: str = DEFAULT, id_col: str = "doc_id", text_col: str = "text", tree_col: str | None = None
) -> DataFrame:
    """Counts tokens before and after edits: id, n_tokens, n_tokens_after, n_leaves, n_edits, recoded_chars, text_after, tree.

    tree is the segment tree of text_after, to be kept: a struct of its leaves' characters and tokens and of a
    stamp. Where tree_col names such a column of docs, a text starts from its tree and only what edits touch is
    encoded; a tree that is null, or whose stamp is not that of this text, vocabulary and pattern, is built anew.
    recoded_chars counts what edits made to be encoded, built trees left aside; built says if the tree was.

    edits_col is an array of structs (start, end, insert) in code points; each edit applies to the text as the
    ones before it left it. Null edits, and null structs among them, change nothing; a null insert deletes; bounds
    beyond the text are moved to it. Null texts count as empty for the counts, and stay null unless edited.
    Repeated rows and null ids each give their row; extra columns are not read; an empty table gives no rows.
    """
    # Read once on the driver; its size is that of the file, whatever the input.
    table = read_ranks(vocabulary)
    ranks = docs.sparkSession.sparkContext.broadcast(table)
    seed = xxhash.xxh3_64_intdigest(PATTERN.encode() + b"".join(b"%d %d " % (len(x), n) + x for x, n in table.items()))
    tree = F.lit(None).cast(TREE) if tree_col is None else F.col(tree_col).cast(TREE)
    base = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(edits_col).alias("edits"), tree.alias("tree"))
    kind = base.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(ranks.value)
        for x in sliced(batches, "text"):
            out: dict[str, list] = {c: [] for c in KINDS}
            for text, edits, kept in zip(x.column("text").to_pylist(), x.column("edits").to_pylist(), x.column("tree").to_pylist(), strict=True):
                now, recoded, done = text, 0, 0
                fits = kept is not None and kept["chars"] is not None and kept["tokens"] is not None and kept["stamp"] == stamp(text or "", seed)
                tree = Tree(kept["chars"], kept["tokens"]) if fits else build(text or "", counter)
                before = tree.total
                for e in edits or []:
                    if e is not None:
                        now, n = edit(now or "", tree, e["start"] or 0, e["end"] or 0, e["insert"] or "", counter)
                        recoded, done = recoded + n, done + 1
                leaves = {"chars": tree.chars, "tokens": tree.tokens, "stamp": stamp(now or "", seed)}
                for c, v in zip(KINDS, (before, tree.total, len(tree.chars), done, recoded, not fits, now, leaves), strict=True):
                    out[c].append(v)
            yield pa.RecordBatch.from_arrays([x.column("id"), *(pa.array(v, KINDS[c]) for c, v in out.items())], ["id", *out])

    done = base.mapInArrow(
        run,
        f"id {kind}, n_tokens bigint, n_tokens_after bigint, n_leaves bigint, n_edits bigint, recoded_chars bigint, built boolean, text_after string, tree {TREE}",
    )
    return done.withColumnRenamed("id", id_col)


def collect_edits(docs: DataFrame, edits: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """docs with an array column edits, from a table of edits (id, seq, start, end, insert) applied in the order of seq."""
    each = F.struct("seq", F.col("start").cast("bigint").alias("start"), F.col("end").cast("bigint").alias("end"), "insert")
    grouped = edits.groupBy(F.col(id_col).alias("_edited")).agg(F.array_sort(F.collect_list(each)).alias("edits"))
    grouped = grouped.select("_edited", F.transform("edits", lambda e: F.struct(e["start"].alias("start"), e["end"].alias("end"), e["insert"].alias("insert"))).alias("edits"))
    return docs.join(grouped, docs[id_col] == grouped["_edited"], "left").drop("_edited")
