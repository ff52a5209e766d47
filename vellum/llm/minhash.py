"""MinHash kernels (numpy, a batch at a time) and the engine that turns band collisions into exact links."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache
from math import comb

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .graph import components, local_forests
from .shared import Scratch, bitmap_of, may_contain, release, spread_join

U64 = np.uint64
#: Band rows that a task holds before it passes them on, about.
MET = 200_000
#: Slots of the bitmaps of buckets.
BUCKET_BITS = 1 << 26
#: Pairs that are compared at once, as a number of bits and of pairs.
PAIR_BITS = 12
PAIRS = 1 << PAIR_BITS


def mix64(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


@lru_cache(maxsize=8)
def multipliers(n: int, seed: int = 7) -> np.ndarray:
    return mix64(np.arange(1, n + 1, dtype=U64) * U64(0x9E3779B97F4A7C15) + U64(seed)) | U64(1)


class WordHashes(dict):
    """word -> 64-bit hash, remembered up to a bound."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= 200_000:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def word_hashes(words: list[bytes], cache: WordHashes) -> np.ndarray:
    return np.fromiter(map(cache.__getitem__, words), U64, len(words))


def shingles(units: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of n units (not distinct); of fewer units, one hash of the whole; of none, none."""
    m = len(units)
    if m == 0:
        return np.empty(0, U64)
    k = min(m, n)
    out = np.full(m - k + 1, k, U64)
    for j, by in enumerate(multipliers(n)[:k]):
        out += units[j : m - k + 1 + j] * by
    return mix64(out)


def flat_shingles(units: np.ndarray, sizes: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, counts): the shingles() of consecutive runs of units, of so many units each."""
    h = np.concatenate([units, np.zeros(n, U64)])
    runs, by = np.zeros(len(units), U64), multipliers(n)
    for j in range(n):
        runs += h[j : len(runs) + j] * by[j]
    counts = np.where(sizes > 0, np.maximum(sizes - n + 1, 1), 0)
    at = np.repeat(np.cumsum(sizes) - sizes - (np.cumsum(counts) - counts), counts) + np.arange(int(counts.sum()))
    out, whole = runs[at] + U64(n), np.repeat(np.minimum(sizes, n), counts)
    short = np.flatnonzero(whole < n)
    if len(short):
        out[short] = whole[short].astype(U64)
        for j in range(n - 1):
            out[short] += np.where(j < whole[short], h[at[short] + j], U64(0)) * by[j]
    return mix64(out), counts


def signatures(sets: list[np.ndarray], k: int, seed: int = 1) -> np.ndarray:
    """A row of k uint32 minima for each non-empty array of 64-bit hashes."""
    counts = np.array([len(s) for s in sets])
    return flat_signatures(np.concatenate(sets) if len(sets) else np.empty(0, U64), counts, k, seed)


def flat_signatures(hashes: np.ndarray, counts: np.ndarray, k: int, seed: int = 1, stretch: int = 1 << 16) -> np.ndarray:
    """signatures() of consecutive, non-empty runs of hashes, a stretch of runs that fits a core's cache at a time.

    A longer run is taken in parts; the minima of its parts are merged.
    """
    out = np.empty((len(counts), k), np.uint32)
    by = (multipliers(2 * k, seed) >> U64(32)).astype(np.uint32)
    a, b = by[:k] | np.uint32(1), by[k:]
    x = (hashes >> U64(32)).astype(np.uint32)
    ends = np.cumsum(counts)
    buffer = np.empty(min(stretch, len(x)), np.uint32)
    at = 0
    while at < len(counts):
        first = ends[at] - counts[at]
        end = max(int(np.searchsorted(ends, first + stretch, "right")), at + 1)
        offsets = ends[at:end] - counts[at:end] - first
        for lo in range(first, ends[end - 1], stretch):
            part = x[lo : min(lo + stretch, ends[end - 1])]
            space = buffer[: len(part)]
            for i in range(k):
                np.multiply(part, a[i], out=space)
                np.add(space, b[i], out=space)
                least = np.minimum.reduceat(space, offsets)
                out[at:end, i] = least if lo == first else np.minimum(out[at:end, i], least)
        at = end
    return out


def char_shingles(texts: list[str], n: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, counts): the hashes, not distinct, of the runs of n characters of each text, one after the other; of a
    text of fewer characters, one hash of the whole. All texts are hashed at once, runs by joining shorter ones."""
    joined = ("\0" * n).join(texts) + "\0" * n
    code = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32).astype(U64)
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    by = multipliers(n + 1)
    runs, width = code * by[n], 1
    while width < n:
        step = min(width, n - width)
        runs = runs[:-step] * by[width - 1] + runs[step:]
        width += step
    counts = np.maximum(sizes - n + 1, 1)
    # Between the runs of two texts lie those that begin in a text's last characters or in the gap.
    skipped = sizes + n - counts
    behind = np.cumsum(sizes + n) - skipped
    keep = np.ones(len(code), bool)
    keep[np.repeat(behind - (np.cumsum(skipped) - skipped), skipped) + np.arange(int(skipped.sum()))] = False
    return mix64(runs[keep[: len(runs)]] + np.repeat(np.minimum(sizes, n).astype(U64), counts)), counts


def band_keys(signature: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """int64 keys, one for each band of each signature."""
    x = signature[:, : bands * rows].astype(U64).reshape(len(signature), bands, rows)
    keys = (x * multipliers(rows, 11)).sum(axis=2, dtype=U64) + np.arange(bands, dtype=U64) * U64(0xD1B54A32D192ED03)
    return mix64(keys).view(np.int64)


@lru_cache(maxsize=16)
def fewest_matches(threshold: float, miss: float, k: int, batch: int) -> dict[int, int]:
    """After n compared hashes, the fewest matches at which P(similarity >= threshold) is still at least miss.

    With a uniform prior, the posterior after m of n is Beta(m+1, n-m+1), and P(>= t) = P(Binomial(n+1, t) <= m).
    """
    out = {}
    for n in sorted({*range(batch, k + 1, batch), k}):
        total, m = 0.0, -1
        while total < miss:
            m += 1
            total += comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
        out[n] = m
    return out


def still_likely(a: np.ndarray, b: np.ndarray, least: dict[int, int]) -> np.ndarray:
    """Indices of the pairs that sequential comparison, batch after batch, does not prune."""
    alive, matched, done = np.arange(len(a)), np.zeros(len(a), np.int32), 0
    for n, m in least.items():
        matched = matched + (a[alive, done:n] == b[alive, done:n]).sum(axis=1)
        keep = matched >= m
        alive, matched, done = alive[keep], matched[keep], n
    return alive


def as_matrix(column: pa.Array | list, k: int) -> np.ndarray:
    values = column if isinstance(column, list) else column.to_pylist()
    return np.frombuffer(b"".join(values), np.uint32).reshape(len(values), k)


def sliced(batches: Iterator[pa.RecordBatch], column: str, chars: int = 1_000_000) -> Iterator[pa.RecordBatch]:
    """The batches, cut so that no piece holds much more than so many bytes of column (a single value may)."""
    for batch in batches:
        col = batch.column(column)
        sizes = np.asarray(pc.fill_null(pc.binary_length(col), 0))
        at, total = 0, 0
        for i, n in enumerate(sizes):
            if total and total + n > chars:
                yield batch.slice(at, i - at)
                at, total = i, 0
            total += n
        if at < len(sizes):
            yield batch.slice(at)


def gathered(flat: np.ndarray, counts: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The runs of flat that which names, one after the other, and their lengths."""
    some = counts[which]
    begin = np.cumsum(counts) - counts
    return flat[np.repeat(begin[which] - (np.cumsum(some) - some), some) + np.arange(int(some.sum()))], some


def parts(sizes: np.ndarray, most: int = 1 << 18) -> Iterator[slice]:
    """Slices of at most PAIRS items, whose sizes sum to about most."""
    ends, at = np.cumsum(sizes), 0
    while at < len(sizes):
        so_far = ends[at - 1] if at else 0
        end = min(max(int(np.searchsorted(ends, so_far + most, "right")), at + 1), at + PAIRS)
        yield slice(at, end)
        at = end


def _tagged(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    return hashes | np.repeat(np.arange(len(counts), dtype=U64) << U64(64 - PAIR_BITS), counts)


def distinct_runs(flat: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each run's distinct hashes in order, of 64 - PAIR_BITS bits each, so that one sort serves many runs."""
    out, sizes = [np.empty(0, U64)], [np.empty(0, np.int64)]
    ends = np.cumsum(counts)
    for at in parts(counts):
        own = _tagged(flat[ends[at.start] - counts[at.start] : ends[at.stop - 1]] >> U64(PAIR_BITS), counts[at])
        own.sort()
        own = own[np.concatenate([[True], own[1:] != own[:-1]])] if len(own) else own
        sizes.append(np.bincount((own >> U64(64 - PAIR_BITS)).astype(np.int64), minlength=at.stop - at.start))
        out.append(own & U64((1 << (64 - PAIR_BITS)) - 1))
    return np.concatenate(out), np.concatenate(sizes)


def pairs_agree(flat: np.ndarray, counts: np.ndarray, a: np.ndarray, b: np.ndarray, share: tuple[int, int]) -> np.ndarray:
    """Of each pair of distinct_runs(): share[1] * |intersection| >= share[0] * |union|."""
    out = np.zeros(len(a), bool)
    fit = np.flatnonzero(share[1] * np.minimum(counts[a], counts[b]) >= share[0] * np.maximum(counts[a], counts[b]))
    for at in parts(counts[a[fit]] + counts[b[fit]]):
        x, y = a[fit[at]], b[fit[at]]
        own = np.concatenate([_tagged(*gathered(flat, counts, x)), _tagged(*gathered(flat, counts, y))])
        own.sort()
        both = np.bincount((own[1:][own[1:] == own[:-1]] >> U64(64 - PAIR_BITS)).astype(np.int64), minlength=len(x))
        out[fit[at]] = share[1] * both >= share[0] * (counts[x] + counts[y] - both)
    return out


def group_agrees(flat: np.ndarray, counts: np.ndarray, members: np.ndarray, a: np.ndarray, b: np.ndarray, share: tuple[int, int], room: int = 1 << 21) -> np.ndarray:
    """pairs_agree() of many pairs (a, b: indices into members) of less than PAIRS runs: products of a matrix of members and hashes, a part at a time."""
    hashes, sizes = gathered(flat, counts, members)
    own = hashes << U64(PAIR_BITS) | np.repeat(np.arange(len(members), dtype=U64), sizes)
    own.sort()
    row, value = (own & U64(PAIRS - 1)).astype(np.int64), own >> U64(PAIR_BITS)
    column = np.cumsum(np.concatenate([[False], value[1:] != value[:-1]]))
    both, step = np.zeros((len(members), len(members))), max(1, room // len(members))
    for lo in range(0, int(column[-1]) + 1, step):
        first, last = np.searchsorted(column, [lo, lo + step])
        matrix = np.zeros((len(members), min(step, int(column[-1]) + 1 - lo)), np.float32)
        matrix[row[first:last], column[first:last] - lo] = 1
        both += matrix @ matrix.T
    met, size = both[a, b], counts[members]
    return share[1] * met >= share[0] * (size[a] + size[b] - met)


def blocks_agree(flat: np.ndarray, counts: np.ndarray, a: np.ndarray, b: np.ndarray, of: np.ndarray, share: tuple[int, int]) -> np.ndarray:
    """pairs_agree() of pairs in blocks (of: rising numbers): those of a block with more pairs than members are compared together."""
    out = np.empty(len(a), bool)
    cuts = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1], [True]])) if len(a) else np.zeros(1, int)
    rest = []
    for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        if hi - lo > 2:
            members, at = np.unique(np.concatenate([a[lo:hi], b[lo:hi]]), return_inverse=True)
            if hi - lo > len(members):
                out[lo:hi] = group_agrees(flat, counts, members, at[: hi - lo], at[hi - lo :], share)
                continue
        rest.append(np.arange(lo, hi))
    if rest:
        some = np.concatenate(rest)
        out[some] = pairs_agree(flat, counts, a[some], b[some], share)
    return out


def whole_groups(batches: Iterator[pa.RecordBatch], by: list[str], text: str, chars: int = 2_000_000) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """(rows, bounds) of a stream that is sorted by bigint columns: rows of whole groups, each between two bounds.

    Groups are passed on as soon as they hold so many bytes of text; the last group read waits for its end.
    """
    held: list[pa.RecordBatch] = []
    size = 0

    def cut(last: bool) -> tuple[pa.Table, np.ndarray, pa.Table]:
        rows = pa.Table.from_batches(held).combine_chunks()
        changed = np.zeros(max(rows.num_rows - 1, 0), bool)
        for c in by:
            values = np.asarray(rows.column(c))
            changed |= values[1:] != values[:-1]
        bounds = np.concatenate([[0], np.flatnonzero(changed) + 1, [rows.num_rows]])
        if not last:
            bounds = bounds[:-1]
        return rows.slice(0, bounds[-1]), bounds, rows.slice(bounds[-1])

    for x in sliced(batches, text, chars):
        if not x.num_rows:
            continue
        held.append(x)
        size += x.column(text).nbytes
        if size >= chars:
            rows, bounds, rest = cut(False)
            if rows.num_rows:
                yield rows, bounds
            held, size = rest.to_batches(), rest.column(text).nbytes if rest.num_rows else 0
    if held:
        rows, bounds, _ = cut(True)
        yield rows, bounds


def near_components(
    buckets: DataFrame,
    texts_of: Callable[[DataFrame], DataFrame],
    sets_of: Callable[[list[str]], tuple[np.ndarray, np.ndarray]],
    share: tuple[int, int],
    scratch: Scratch,
    sig: DataFrame | None = None,
    k: int = 0,
    bands: tuple[int, int] = (0, 0),
    least: dict[int, int] | None = None,
    block: int = 512,
) -> DataFrame:
    """(node, root) of the members of buckets (bucket, key) that a verified link joins to another: the components of all links.

    share = (p, q): a link has q * intersection >= p * union of the exact sets. texts_of(keys) gives (key, text)
    for a table of keys; sets_of gives the hashes of texts one after the other, and how many each has. With sig
    (key, sig: k uint32) candidates are first compared hash by hash and pruned at the bounds in least.

    1. In each bucket, every member is paired with one hub, the member that shares most buckets: linear, never
       all pairs. The links found are contracted to components.
    2. A bucket whose members are then all in one component needs nothing more. In the others, members of
       different components are compared in blocks of bounded size, so that a hub that is unlike some
       members loses no link; signatures prune, and each block returns a forest of verified links, never all pairs.
    3. The components of these links are those of the first ones' roots.
    """
    kind = dict(buckets.dtypes)["key"]
    sizes = scratch.put(buckets.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1"), "sizes")
    if sig is not None:  # few bands of whole texts are met twice: the others need not be moved
        buckets = may_contain(buckets, F.col("bucket"), True, bitmap_of(sizes, "bucket", BUCKET_BITS), BUCKET_BITS).where("bm_hit").select("bucket", "key")
    members = scratch.put(buckets.join(sizes, "bucket").select("bucket", "key", "n"), "members")
    if sig is not None:  # nor the signatures of those that no bucket joins to another
        sig = scratch.put(may_contain(sig, F.col("key"), False, bitmap_of(members, "key")).where("bm_hit").select("key", "sig"), "signatures")
    central = members.groupBy("key").agg(F.sum("n").alias("score"))
    hubs = members.join(central, "key").groupBy("bucket").agg(F.max(F.struct("score", "key")).alias("m")).select("bucket", F.col("m.key").alias("hub"))
    star = members.join(hubs, "bucket").where("key <> hub").select(F.col("hub").alias("a"), F.col("key").alias("b")).distinct()
    schema = f"a {kind}, b {kind}"

    def prune(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            ok = still_likely(as_matrix(x.column("sa"), k), as_matrix(x.column("sb"), k), least) if x.num_rows else []
            yield pa.RecordBatch.from_arrays([x.column(c).take(pa.array(ok, pa.int64())) for c in ("a", "b")], ["a", "b"])
        release()

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in sliced(sliced(batches, "tb", 500_000), "ta", 500_000):
            if not x.num_rows:
                continue
            place: dict[str, int] = {}  # a hub has many pairs
            a = np.array([place.setdefault(t, len(place)) for t in x.column("ta").to_pylist()])
            flat, counts = distinct_runs(*sets_of([*place, *x.column("tb").to_pylist()]))
            ok = pairs_agree(flat, counts, a, len(place) + np.arange(x.num_rows), share)
            yield pa.RecordBatch.from_arrays([x.column(c).filter(pa.array(ok)) for c in ("a", "b")], ["a", "b"])
        release()

    if sig is not None:
        star = scratch.put(star, "star")
        with_b = star.join(sig.select(F.col("key").alias("b"), F.col("sig").alias("sb")), "b")
        with_a = spread_join(with_b, sig.select(F.col("key").alias("a"), F.col("sig").alias("sa")), "a", "b", scratch, star.groupBy("a").agg(F.count("*").alias("n")))
        star = with_a.select("a", "b", "sa", "sb").mapInArrow(prune, schema)
    pairs = scratch.put(star, "pairs")
    texts = texts_of(scratch.put(pairs.select(F.col("a").alias("key")).union(pairs.select(F.col("b").alias("key"))).distinct(), "keys"))
    texts = texts if sig is None else scratch.put(texts, "texts")
    with_b = pairs.join(texts.select(F.col("key").alias("b"), F.col("text").alias("tb")), "b")
    both = spread_join(with_b, texts.select(F.col("key").alias("a"), F.col("text").alias("ta")), "a", "b", scratch, pairs.groupBy("a").agg(F.count("*").alias("n")))
    roots = components(both.select("a", "b", "ta", "tb").mapInArrow(exact, schema), scratch)

    placed = members.where("n > 2").join(roots.withColumnRenamed("node", "key"), "key", "left").select(
        "bucket", "key", "n", F.coalesce("root", "key").alias("root")
    )
    placed = scratch.put(placed, "placed")
    # Members of one component in a bucket stand for each other's links; count components before moving anything.
    open_ = placed.groupBy("bucket").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("bucket")
    todo = placed.join(open_, "bucket").withColumn("blocks", F.ceil(F.col("n") / block).cast("int"))
    todo = todo.withColumn("mine", F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int"))
    todo = todo.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    todo = todo.select("bucket", F.least("mine", "other").cast("bigint").alias("i"), F.greatest("mine", "other").cast("bigint").alias("j"), "mine", "key", "root")
    todo = scratch.put(todo, "todo")
    if todo.isEmpty():
        return roots
    n_bands, n_rows = bands
    with_sig = sig is not None

    def likely(rows: pa.Table, bounds: np.ndarray, s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The pairs (x, y) of members of different components in a block, whose signatures s do not rule a link out."""
        mine, i, j, here = (np.asarray(rows.column(c)) for c in ("mine", "i", "j", "bucket"))
        root, own = numbered(rows.column("root")), band_keys(s, n_bands, n_rows)
        band = (own == here[:, None]).argmax(axis=1)
        xs, ys, size = [], [], 0
        out = [np.empty((2, 0), np.int64)]

        def pruned() -> np.ndarray:
            x, y = np.concatenate(xs), np.concatenate(ys)
            kept = [np.empty((2, 0), np.int64)]
            for at in range(0, len(x), 1 << 14):
                u, v = x[at : at + (1 << 14)], y[at : at + (1 << 14)]
                first = (own[u] == own[v]).argmax(axis=1) == band[u]  # a pair counts in the first band it shares
                u, v = u[first], v[first]
                alive = still_likely(s[u], s[v], least)
                kept.append(np.stack([u[alive], v[alive]]))
            return np.concatenate(kept, axis=1)

        for lo, hi in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            x, y = np.triu_indices(hi - lo, 1)
            fit = root[lo + x] != root[lo + y]
            if i[lo] != j[lo]:
                fit &= mine[lo + x] != mine[lo + y]
            xs.append(lo + x[fit])
            ys.append(lo + y[fit])
            size += len(xs[-1])
            if size >= 1 << 18:
                out.append(pruned())
                xs, ys, size = [], [], 0
        if xs:
            out.append(pruned())
        x, y = np.concatenate(out, axis=1)
        return x, y

    def numbered(column: pa.ChunkedArray) -> np.ndarray:
        return np.asarray(column.combine_chunks().dictionary_encode().indices).astype(np.int64)

    def involved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The members that any candidate pair of a block has."""
        for rows, bounds in whole_groups(batches, by, "sig"):
            at = np.union1d(*likely(rows, bounds, as_matrix(rows.column("sig"), k)))
            yield from rows.select([*by, "key"]).take(pa.array(at)).combine_chunks().to_batches()
        release()

    def forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Verified links between the roots of members, at most one fewer than a block has components."""
        for rows, bounds in whole_groups(batches, by, "text"):
            flat, counts = sets_of(rows.column("text").to_pylist())
            a, b = likely(rows, bounds, as_matrix(rows.column("sig"), k) if with_sig else flat_signatures(flat, counts, k))
            ok = blocks_agree(*distinct_runs(flat, counts), a, b, np.searchsorted(bounds, a, "right"), share)
            keys = rows.column("root")
            found = pa.RecordBatch.from_arrays([keys.take(pa.array(z[ok])).combine_chunks() for z in (a, b)], ["a", "b"])
            yield from local_forests(iter([found]), ("a", "b"), False)
        release()

    by = ["bucket", "i", "j"]
    if with_sig:
        kinds = f"bucket bigint, i bigint, j bigint, key {kind}"
        told = scratch.put(todo.join(sig.select("key", "sig"), "key").repartition(*by).sortWithinPartitions(*by).mapInArrow(involved, kinds), "involved")
        todo = todo.join(told, [*by, "key"]).join(sig.select("key", "sig"), "key")
        keys = told.select("key").distinct()
    else:
        keys = todo.select("key").distinct()
    texts = texts_of(scratch.put(keys, "keys-cross"))
    more = todo.join(texts, "key").repartition(*by).sortWithinPartitions(*by).mapInArrow(forest, schema)
    joined = components(more, scratch)
    above = joined.select(F.col("node").alias("root"), F.col("root").alias("top"))
    whole = roots.join(above, "root", "left").select("node", F.coalesce("top", "root").alias("root"))
    return scratch.put(whole.unionByName(joined.join(roots, "node", "left_anti")), "roots")


def text_components(
    each: DataFrame, shingle: Callable[[list[str]], tuple[np.ndarray, np.ndarray]], share: tuple[int, int], bands: int, rows: int, scratch: Scratch, miss: float = 1e-7
) -> DataFrame:
    """(node, root) of the linked keys of each (key: 64-bit hash of text, text), a row for each occurrence.

    For many short texts: signatures are not kept, only their bands, and those of one occurrence in each task.
    shingle gives the hashes of texts one after the other, and how many each has.
    """
    k = bands * rows
    least = fewest_matches(share[0] / share[1], miss, k, max(8, k // 3))

    def banded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row (deal, bucket, key, hub) for each band of each text, of about MET bands at a time.

        hub is the first text in the bucket among these, null for that text itself: the map-side combine that
        leaves the shuffle at most one row without hub for each bucket and that many bands. deal is where a row
        goes: the bucket if it has no hub, else a number of its own, so that no bucket is large after the exchange.
        """
        seen: set[int] = set()
        found: list[np.ndarray] = []
        owners: list[np.ndarray] = []

        def flush() -> pa.RecordBatch:
            bucket, owner = np.concatenate(found), np.concatenate(owners)
            found.clear()
            owners.clear()
            order = np.argsort(bucket, kind="stable")
            bucket, owner = bucket[order], owner[order]
            first = np.concatenate([[True], bucket[1:] != bucket[:-1]])
            hub = owner[np.maximum.accumulate(np.where(first, np.arange(len(first)), 0))]
            again = ~first & (owner == hub)
            bucket, owner, hub, first = bucket[~again], owner[~again], hub[~again], first[~again]
            deal = np.where(first, bucket, mix64(bucket.view(U64) ^ mix64(owner.view(U64))).view(np.int64))
            return pa.RecordBatch.from_arrays([pa.array(deal), pa.array(bucket), pa.array(owner), pa.array(hub, mask=first)], ["deal", "bucket", "key", "hub"])

        for x in sliced(batches, "text", 500_000):
            keys = x.column("key").to_pylist()
            new = [i for i, key in enumerate(keys) if key not in seen and not seen.add(key)]
            if not new:
                continue
            if len(seen) > 200_000:
                seen.clear()
            at = pa.array(new)
            signed = flat_signatures(*shingle(x.column("text").take(at).to_pylist()), k)
            found.append(band_keys(signed, bands, rows).ravel())
            owners.append(np.repeat(np.asarray(x.column("key").take(at)), bands))
            if sum(map(len, found)) >= MET:
                yield flush()
        if found:
            yield flush()
        seen.clear()
        release()

    # Sorted by one number, which Spark does by radix.
    w = Window.partitionBy("deal")
    met = each.mapInArrow(banded, "deal bigint, bucket bigint, key bigint, hub bigint").withColumn("lo", F.min("key").over(w)).withColumn("hi", F.max("key").over(w))
    joined = met.where("hub is not null or lo <> hi").select("bucket", "key", F.coalesce("hub", "lo").alias("hub"))
    joined = scratch.put(joined, "met")
    buckets = scratch.put(joined.select("bucket", "key").unionByName(joined.select("bucket", F.col("hub").alias("key"))).distinct(), "buckets")
    # One more pass for the texts of all bucket members. Joins after may_contain() are inner: a semi-join would be
    # pushed below it, and shuffle every text.
    keys = scratch.put(buckets.select("key").distinct(), "keys")
    some = may_contain(each, F.col("key"), True, bitmap_of(keys, "key", 1 << 26), 1 << 26).where("bm_hit").select("key", "text")
    texts = scratch.put(some.dropDuplicates(["key"]).join(keys, "key"), "texts")
    return near_components(buckets, lambda keys: texts.join(keys, "key"), shingle, share, scratch, k=k, bands=(bands, rows), least=least)
