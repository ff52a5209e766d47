"""Repeated passages: paragraph MinHash for fuzzy copies, content-anchored windows for passages inside other text."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .minhash import U64, flat_shingles, mix64, multipliers, shingles, sliced, text_components
from .shared import Scratch, bitmap_of, may_contain, release, row_key


#: Code points that are hashed at once, about.
STRETCH = 1 << 18


def word_table(code: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, hash) of the words of a code point array: runs without ASCII white space."""
    solid = (code != 32) & (code - np.uint32(9) > 4)
    edge = np.flatnonzero(np.diff(solid, prepend=False, append=False))
    start, end = edge[::2], edge[1::2]
    if not len(start):
        return start, end, np.empty(0, U64)
    sizes = end - start
    begin = np.cumsum(sizes) - sizes
    place = np.arange(begin[-1] + sizes[-1]) - np.repeat(begin, sizes)
    value = mix64(code[solid].astype(U64) + place.astype(U64) * U64(0x9E3779B97F4A7C15))
    return start, end, np.add.reduceat(value, begin)


def word_tables(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, hash) of the words of texts, one after the other, places counted from the beginning of each text; and
    which word is the first of each text, with the number of all at the end."""
    code = np.frombuffer(" ".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    start, end, h = word_table(code)
    sizes = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
    begin = np.cumsum(sizes) - sizes
    first = np.append(np.searchsorted(start, begin), len(start))
    behind = np.repeat(begin, np.diff(first))
    return (start - behind).astype(np.int32), (end - behind).astype(np.int32), h, first


def anchors(words: np.ndarray, n: int = 5, radius: int = 6) -> np.ndarray:
    """Positions p whose n-word shingle is the least of those within radius on either side, the first of equal ones.

    Where the whole window of p is periodic, equal ones are all chosen: the first may lie outside it. Whether p is one
    depends on the words p - radius to p + radius + n - 1 only, which are the window of p, so equal windows are
    chosen alike wherever they stand.
    """
    s = shingles(words, n) if len(words) >= n else np.empty(0, U64)
    if len(s) < 2 * radius + 1:
        return np.empty(0, int)
    core = s[radius : len(s) - radius]
    ok, tied = np.ones(len(core), bool), np.zeros(len(core), bool)
    for d in range(1, radius + 1):
        left = s[radius - d : len(s) - radius - d]
        ok &= (core <= left) & (core <= s[radius + d : len(s) - radius + d])
        tied |= core == left
    tied = np.flatnonzero(ok & tied)
    ok[tied] = False
    for d in range(1, radius + 1) if len(tied) else ():
        same = np.concatenate([[0], np.cumsum(s[d:] == s[:-d])])
        ok[tied[same[tied + 2 * radius + 1 - d] - same[tied] == 2 * radius + 1 - d]] = True
    return np.flatnonzero(ok) + radius


def chains(key: np.ndarray, chk: np.ndarray, p: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(first, last): indices into the windows p of a text, of the ends of each chain of equal windows that overlap one
    another, as in periodic text. A window that overlaps no equal one is a chain by itself."""
    order = np.lexsort((p, chk, key))
    k, c, q = key[order], chk[order], p[order]
    new = np.concatenate([[True], (k[1:] != k[:-1]) | (c[1:] != c[:-1]) | (q[1:] - q[:-1] >= width)])
    first, last = order[new], order[np.append(new[1:], True)]
    by = np.argsort(first)
    return first[by], last[by]


def reach(units: list[tuple[int, int]], total: int, width: int, told: dict[int, dict]) -> Iterator[tuple[dict, int, int, int, int]]:
    """(unit, first, last, lo, hi) for the repeated units of a text: the words [lo, first) and [last + width, hi) may be compared.

    units are the chains of windows of a text of so many words, by position; told the repeated ones. Words up to the far
    end of the next unit do if that one is not repeated, as it cannot be part of the same run. If it stands at the same
    distance from the same kept text it carries the run on by itself, from its beginning; in the kept text, units
    that are kept do, to their end. Otherwise the one after it is asked.
    """
    at = [told.get(first) for first, _ in units]

    def carries(w: dict, other: dict, chain: bool) -> bool:
        if chain or other["kept"] != w["kept"]:
            return False
        return other["away"] == w["away"] if w["removed"] else not other["removed"]

    for i, w in enumerate(at):
        if w is None:
            continue
        first, last = units[i]
        lo, hi = 0, total
        for j in range(i - 1, -1, -1):
            if at[j] is None or carries(w, at[j], units[j][0] != units[j][1]):
                lo = units[j][1] + width if at[j] is not None and w["removed"] else units[j][0]
                break
        for j in range(i + 1, len(at)):
            if at[j] is None or carries(w, at[j], units[j][0] != units[j][1]):
                hi = units[j][0] if at[j] is not None and w["removed"] else units[j][1] + width
                break
        lo, hi = min(lo, first), max(hi, last + width)
        if lo < first or hi > last + width or not w["removed"]:
            yield w, first, last, lo, hi


def common(left: list[bytes], right: list[bytes]) -> np.ndarray:
    """For each pair of packed 64-bit hashes, how many agree from the beginning."""
    sizes = np.array([min(len(a), len(b)) // 8 for a, b in zip(left, right, strict=True)], int)
    a = np.frombuffer(b"".join(x[: 8 * n] for x, n in zip(left, sizes.tolist(), strict=True)), U64)
    b = np.frombuffer(b"".join(x[: 8 * n] for x, n in zip(right, sizes.tolist(), strict=True)), U64)
    begin = np.cumsum(sizes) - sizes
    differ = np.append(np.flatnonzero(a != b), len(a))
    return np.minimum(differ[np.searchsorted(differ, begin)] - begin, sizes)


def repeated_passages(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    n_words: int = 5,
    share: tuple[int, int] = (80, 100),
    bands: int = 10,
    rows: int = 4,
    least_words: int | None = None,
    radius: int = 6,
) -> DataFrame:
    """Passages that stand in several documents: one row (id, start, end, removed, component_id, n_units) for each span.

    Two kinds of units are compared. A paragraph is a line of at least n_words words, the length of a shingle, or of
    least_words where the caller asks for another floor (1: every line with a word); paragraphs are banded
    by MinHash of their n_words-word shingles, and linked when share[1] * |intersection| >= share[0] * |union|
    exactly. A window is a run of 2 * radius + n_words words around an anchor chosen by its content, so that a
    passage is found wherever it is embedded; windows are linked when equal (96 hashed bits). Components with
    units in at least two ids count. Their unit with the smallest id, first in its text, is kept, the
    others are removed; equal windows that overlap, in periodic text, are one unit. Each removed window is extended to the
    whole run of words (64 hashed bits) that its text shares with the kept one around it, and the kept one by as much; so
    a kept span may overlap a removed one, of which a smaller id has the kept copy. Touching spans of the same
    fate are one row, whose component_id is the smallest id of its units' components; n_units counts its windows
    and paragraphs. start and end are code points, half-open.

    Null and short texts have no units, rows with null ids take no part. Rows with equal ids and texts are one
    document. Extra columns are not read; an empty table gives no rows.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "passages")
    base = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where("text is not null and id is not null")
    id_type = base.schema["id"].dataType.simpleString()
    base = base.withColumn("rk", row_key("id", "text"))
    width = 2 * radius + n_words

    def keyed(h: np.ndarray, p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        out = np.zeros((2, len(p)), U64)
        for j in range(width):
            out += h[p + j] * multipliers(2 * width, 31).reshape(2, width)[:, j : j + 1]
        return mix64(out[0]).view(np.int64), (mix64(out[1]) >> U64(33)).astype(np.int32)

    def units_of(h: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, ...]:
        """(of, key, chk, first, last) of the chains of equal windows of texts: of is the text, first and last are words.

        Whether a window stands at p depends on its own words only, so all texts are looked at together, and
        those windows taken that lie in one text.
        """
        p = anchors(h, n_words, radius) - radius
        of = np.searchsorted(begin, p, "right") - 1
        inside = p + width <= begin[of + 1]
        p, of = p[inside], of[inside]
        key, chk = keyed(h, p)
        first, last = chains(key, chk, p, width) if len(p) else (p, p)
        return of[first], key[first], chk[first], p[first], p[last]

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in sliced(batches, "text", STRETCH):
            start, end, h, begin = word_tables(x.column("text").to_pylist())
            of, key, chk, first, last = units_of(h, begin)
            if len(of):
                at = pa.array(of)
                found = (key, chk, start[first], end[last + width - 1], (first - begin[of]).astype(np.int32))
                yield pa.RecordBatch.from_arrays([x.column("id").take(at), x.column("rk").take(at), *map(pa.array, found)], ["id", "rk", "key", "chk", "start", "end", "pos"])
        release()

    kinds = f"id {id_type}, rk bigint, key bigint, chk int, start int, end int, pos int"
    placed = scratch.put(base.select("id", "rk", "text").mapInArrow(windows, kinds), "windows")

    def spread(units: DataFrame, by: list[str]) -> DataFrame:
        """The fate of units (id, rk, pos, ...) whose component (by) has several ids: the first of it stays.

        Counting needs numbers only; where the units stand is asked of the repeated ones alone.
        """
        several = units.groupBy(*by).agg(F.min("id").alias("least_id"), F.max("id").alias("last_id")).where("least_id <> last_id")
        several = scratch.put(several.select(*by, "least_id"), "several")
        some = may_contain(units, F.col(by[0]), True, bitmap_of(several, by[0], 1 << 26), 1 << 26).where("bm_hit").drop("bm_hit").join(several, by)
        some = scratch.put(some, "repeats")
        first = some.where("id = least_id").groupBy(*by).agg(F.min(F.struct("rk", "pos")).alias("first"))
        own = (F.col("id") == F.col("least_id")) & (F.col("first.rk") == F.col("rk")) & (F.col("first.pos") == F.col("pos"))
        return some.join(scratch.put(first, "firsts"), by).select(*units.columns, "first", (~own).alias("removed"), F.col("least_id").alias("component_id"))

    by_window = scratch.put(spread(placed, ["key", "chk"]).distinct(), "fates")
    scratch.drop(placed)
    # The words around repeated windows, asked of their texts alone.
    kept = F.xxhash64("component_id", "first.rk")
    told = by_window.groupBy("id", "rk").agg(F.collect_list(F.struct("pos", "key", "chk", "removed", kept.alias("kept"), (F.col("pos") - F.col("first.pos")).alias("away"))).alias("told"))
    told = scratch.put(told, "told")
    around = may_contain(base, F.col("rk"), True, bitmap_of(told, "rk")).where("bm_hit").select("id", "rk", "text").dropDuplicates(["id", "rk"]).join(told, ["id", "rk"])

    def contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["key", "chk", "removed", "start", "end", "before", "before_at", "after", "after_at"]
        for x in sliced(batches, "text", STRETCH):
            of, rows_ = [], []
            starts, ends, hashes, begin = word_tables(x.column("text").to_pylist())
            text_of, _, _, first, last = units_of(hashes, begin)
            cuts = np.searchsorted(text_of, np.arange(x.num_rows + 1))
            for i, repeated in enumerate(x.column("told").to_pylist()):
                own, at = slice(begin[i], begin[i + 1]), slice(cuts[i], cuts[i + 1])
                start, end, h = starts[own], ends[own], hashes[own]
                if end[-1] < 1 << 16:  # two bytes a place instead of four
                    start, end = start.astype(np.uint16), end.astype(np.uint16)
                units = list(zip((first[at] - begin[i]).tolist(), (last[at] - begin[i]).tolist(), strict=True))
                for w, a, b, lo, hi in reach(units, len(h), width, {w["pos"]: w for w in repeated}):
                    b += width
                    of.append(i)
                    rows_.append(
                        (w["key"], w["chk"], w["removed"], int(start[a]), int(end[b - 1]), h[lo:a][::-1].tobytes(), start[lo:a][::-1].tobytes(), h[b:hi].tobytes(), end[b:hi].tobytes())
                    )
            if of:
                at = pa.array(of)
                types = [pa.int64(), pa.int32(), pa.bool_(), pa.int32(), pa.int32(), *[pa.binary()] * 4]
                yield pa.RecordBatch.from_arrays([x.column("id").take(at), x.column("rk").take(at), *map(pa.array, zip(*rows_, strict=True), types)], ["id", "rk", *names])
        release()

    kinds = f"id {id_type}, rk bigint, key bigint, chk int, removed boolean, start int, end int, before binary, before_at binary, after binary, after_at binary"
    context = scratch.put(around.mapInArrow(contexts, kinds), "contexts")
    scratch.drop(told)

    def moved(at: list[int], places: list[bytes], hashes: list[bytes], agree: list[int]) -> list[int]:
        """Where the last word stands that agrees, in 2 or 4 bytes a word; at, if none does."""
        out = []
        for here, v, h, n in zip(at, places, hashes, agree, strict=True):
            size = 8 * len(v) // len(h) if n else 0
            out.append(int.from_bytes(v[size * n - size : size * n], "little") if n else here)
        return out

    def extended(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            if not x.num_rows:
                continue
            column = {c: x.column(c).to_pylist() for c in x.schema.names if c not in ("id", "k_id")}
            left, right = common(column["before"], column["k_before"]).tolist(), common(column["after"], column["k_after"]).tolist()
            at = pa.array([i for i, (m, n) in enumerate(zip(left, right, strict=True)) if m or n], pa.int64())
            for side, removed in (("", True), ("k_", False)):
                starts, ends = (moved(*(column[side + c] for c in cs), n) for cs, n in ((("start", "before_at", "before"), left), (("end", "after_at", "after"), right)))
                out = [x.column(f"{side}id"), x.column(f"{side}rk"), pa.array(starts, pa.int32()), pa.array(ends, pa.int32()), pa.array([removed] * len(left)), x.column("k_id")]
                yield pa.RecordBatch.from_arrays([c.take(at) for c in out], ["id", "rk", "start", "end", "removed", "component_id"])

    of_kept = context.where("not removed").drop("removed")
    of_kept = of_kept.select("key", "chk", *(F.col(c).alias(f"k_{c}") for c in of_kept.columns if c not in ("key", "chk")))
    both = context.where("removed").drop("removed").join(of_kept, ["key", "chk"]).drop("key", "chk")
    runs = scratch.put(both.mapInArrow(extended, f"id {id_type}, rk bigint, start int, end int, removed boolean, component_id {id_type}").distinct(), "runs")
    scratch.drop(context)

    lines = F.split(F.col("text"), "\n")
    para = base.select("id", "rk", F.posexplode(lines).alias("no", "text"))
    floor = max(1, n_words if least_words is None else least_words)
    blank, word = r"[ \t\x0b\x0c\r]", r"[^ \t\x0b\x0c\r]"
    long_ = F.col("text").rlike(f"^{blank}*+(?:{word}++{blank}++){{{min(floor, 50) - 1}}}{word}")  # reads no further than it must
    if floor > 50:
        long_ &= F.size(F.split(F.btrim("text", F.lit(" \t\r\x0b\x0c")), f"{blank}+")) >= floor
    occurrences = para.where(long_).select("id", "rk", "no", F.xxhash64("text").alias("key"), "text")

    def shingled(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        _, _, h, begin = word_tables(texts)
        return flat_shingles(h, np.diff(begin), n_words)

    roots = text_components(occurrences.select("key", "text"), shingled, share, bands, rows, scratch)
    # Where lines begin, only for the texts that hold one of a repeated component.
    spots = occurrences.select("id", "rk", "no", "key").join(roots.withColumnRenamed("node", "key"), "key", "left").withColumn("root", F.coalesce("root", "key"))
    spots = scratch.put(spots.select("id", "rk", "root", F.col("no").alias("pos")), "spots")
    fate = spread(spots, ["root"])
    fate = scratch.put(fate.groupBy("id", "rk").agg(F.collect_set(F.struct(F.col("pos").alias("no"), "removed", "component_id")).alias("units")), "lines")
    texts = may_contain(base, F.col("rk"), True, bitmap_of(fate, "rk")).where("bm_hit").select("id", "rk", F.transform(lines, lambda x: F.length(x)).alias("sizes"))
    texts = texts.dropDuplicates(["id", "rk"]).join(fate, ["id", "rk"])
    numbered = texts.select("id", "rk", "units", F.posexplode("sizes").alias("no", "size"))
    before = Window.partitionBy("id", "rk").orderBy("no").rowsBetween(Window.unboundedPreceding, -1)
    numbered = numbered.withColumn("start", F.coalesce(F.sum(F.col("size") + 1).over(before), F.lit(0)).cast("int")).withColumn(
        "unit", F.expr("try_element_at(filter(units, u -> u.no = no), 1)")
    )
    by_line = numbered.where("unit is not null").select("id", "rk", "start", (F.col("start") + F.col("size")).cast("int").alias("end"), "unit.removed", "unit.component_id")

    spans = ["id", "rk", "start", "end", "removed", "component_id"]
    units = by_window.select(*spans).unionByName(by_line).distinct().withColumn("n", F.lit(1)).unionByName(runs.withColumn("n", F.lit(0)))
    order = Window.partitionBy("id", "rk", "removed").orderBy("start", "end")
    so_far = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    islands = units.withColumn("new", F.when(F.col("start") <= so_far + 1, 0).otherwise(1))
    islands = islands.withColumn("island", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    out = islands.groupBy("id", "rk", "removed", "island").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.min("component_id").alias("component_id"), F.sum("n").alias("n_units"))
    return out.select(F.col("id").alias(id_col), "start", "end", "removed", "component_id", "n_units")
