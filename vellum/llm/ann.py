"""Approximate nearest neighbours: multiprobe p-stable hashing with exact reranking."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .minhash import mix64, multipliers
from .shared import Scratch

#: Fixed value: the largest norm of a band, divided by its least.
BAND = 1.25


def usable(vector: Column) -> Column:
    """Not null, not empty, without null or non-finite components, and not zero."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vector.isNotNull() & ~F.coalesce(bad, F.lit(True)) & F.coalesce(F.exists(vector, lambda x: x != 0), F.lit(False))


def perturbations(offset: np.ndarray, probes: int) -> list[list[tuple[int, int]]]:
    """Sets of (projection, -1 or 1), likeliest bucket first, for a query at these offsets (0 to 1) in its own bucket.

    The cost of a step is the squared distance to the boundary it crosses; sets come off a heap in order of
    their summed cost, each grown from a cheaper one by shifting or extending it.
    """
    m = len(offset)
    steps = sorted([(offset[j] ** 2, j, -1) for j in range(m)] + [((1 - offset[j]) ** 2, j, 1) for j in range(m)])
    out: list[list[tuple[int, int]]] = [[]]
    heap = [(steps[0][0], (0,))]
    while heap and len(out) < probes:
        cost, chosen = heapq.heappop(heap)
        if len({steps[i][1] for i in chosen}) == len(chosen):
            out.append([steps[i][1:] for i in chosen])
        last = chosen[-1]
        if last + 1 < len(steps):
            heapq.heappush(heap, (cost + steps[last + 1][0], (*chosen, last + 1)))
            heapq.heappush(heap, (cost + steps[last + 1][0] - steps[last][0], (*chosen[:-1], last + 1)))
    return out


class Hashes:
    """tables x m Gaussian projections, cut into cells of a width. Inner product search becomes search by distance:
    vectors are divided by the largest norm of their band and get one more component that makes them unit vectors.
    A band holds norms within a factor of BAND, counted down from the largest; queries are the same for all bands."""

    def __init__(self, dim: int, largest: float, tables: int, m: int, width: float, seed: int):
        rng = np.random.default_rng(seed)
        self.a = rng.normal(size=(tables, dim + 1, m))
        self.b = rng.uniform(0, width, size=(tables, 1, m))
        self.largest, self.width, self.tables, self.m = largest, width, tables, m

    def positions(self, x: np.ndarray, is_query: bool) -> np.ndarray:
        """(tables, vectors, m), in cells."""
        norm = np.linalg.norm(x, axis=1, keepdims=True)
        if is_query:
            x = np.hstack([x / norm, np.zeros((len(x), 1))])
        else:
            scale = self.largest / BAND ** np.floor(np.log(self.largest / norm) / np.log(BAND))
            x = np.hstack([x / scale, np.sqrt(np.maximum(0, 1 - (norm / scale) ** 2))])
        return (x @ self.a + self.b) / self.width

    def buckets(self, cells: np.ndarray) -> np.ndarray:
        """int64 for each row of m cells; the table is mixed in by the caller."""
        by = multipliers(self.m, 23)
        return mix64((cells.astype(np.int64).view(np.uint64) * by).sum(axis=-1, dtype=np.uint64)).view(np.int64)


def _vectors(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def nearest(
    vectors: DataFrame,
    is_query: Column,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    k: int = 20,
    tables: int = 4,
    m: int = 6,
    width: float = 1.8,
    probes: int = 100,
    block: int = 16384,
    seed: int = 5,
    recall: float = 0.9,
    checked: int = 100,
) -> DataFrame:
    """The k nearest by inner product found for each query: query_id, rank, vec_id, score.

    Every usable vector is entered in one bucket of each table; a query visits, in each table, its own bucket
    and the likeliest perturbed ones. Buckets are dealt to groups of about block vectors, larger ones are
    split, and each piece returns its k best for each query after exact scoring in double precision; ties go to
    the smaller id. The recall of at most so many checked queries is measured against all vectors; while it is not above
    recall by two standard errors, probes are doubled, and where all neighbouring buckets are not enough every query is
    compared with all vectors. So are queries that met fewer than k vectors. Vectors of a length
    other than the commonest (the longer on a tie), unusable ones and null ids take no part. Repeated ids: each row is
    a candidate, and an id that is its own candidate is left out. No usable vectors: no rows.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark, "ann")
    base = vectors.select(F.col(id_col).cast("bigint").alias("id"), F.col(vector_col).cast("array<double>").alias("v"), is_query.alias("is_query"))
    base = base.where(F.col("id").isNotNull() & usable(F.col("v"))).withColumn("dim", F.size("v"))
    commonest = base.groupBy("dim").agg(F.count("*").alias("n"), F.max(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)).alias("sq")).orderBy(F.desc("n"), F.desc("dim")).limit(1).collect()
    result = "query_id bigint, rank int, vec_id bigint, score double"
    if not commonest:
        return spark.createDataFrame([], result)
    dim, count, largest = commonest[0]["dim"], commonest[0]["n"], float(np.sqrt(commonest[0]["sq"])) * (1 + 1e-12)
    base = base.where(F.col("dim") == dim)
    groups = max(1, -(-count // block))
    hashes = Hashes(dim, largest, tables, m, width, seed)

    def enter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            if not x.num_rows:
                continue
            cells = np.floor(hashes.positions(_vectors(x.column("v")), False))
            for t in range(tables):
                bucket = hashes.buckets(cells[t])
                group = t * groups + (bucket.view(np.uint64) % np.uint64(groups)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(group), pa.array(bucket), x.column("id"), x.column("v")], ["grp", "bucket", "id", "v"])

    def visit(batches: Iterator[pa.RecordBatch], probes: int) -> Iterator[pa.RecordBatch]:
        for x in batches:
            if not x.num_rows:
                continue
            at = hashes.positions(_vectors(x.column("v")), True)
            cells = np.floor(at)
            part, row, found = [], [], []
            for i in range(x.num_rows):
                for t in range(tables):
                    tries = perturbations(at[t, i] - cells[t, i], probes)
                    moved = np.repeat(cells[t, i][None], len(tries), 0)
                    for r, steps in enumerate(tries):
                        for j, by in steps:
                            moved[r, j] += by
                    bucket = hashes.buckets(moved)
                    group = t * groups + (bucket.view(np.uint64) % np.uint64(groups)).astype(np.int64)
                    for g in np.unique(group):
                        part.append(g)
                        row.append(i)
                        found.append(bucket[group == g])
            row = pa.array(row, pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.int64()), x.column("id").take(row), x.column("v").take(row), pa.array(found, pa.list_(pa.int64()))], ["grp", "id", "v", "buckets"])

    entered = scratch.put(base.select("id", "v").mapInArrow(enter, "grp bigint, bucket bigint, id bigint, v array<double>"), "entered")
    queries = base.where("is_query").select("id", "v")

    def best_of(visits: DataFrame, entered: DataFrame, label: str) -> DataFrame:
        sizes = entered.groupBy("grp").agg(F.ceil(F.count("*") / block).cast("int").alias("pieces"))
        asked = visits.groupBy("grp").agg(F.ceil(F.count("*") / block).cast("int").alias("askers"))
        plan = scratch.put(sizes.join(asked, "grp"), f"plan-{label}")
        left = entered.join(plan, "grp").withColumn("piece", F.pmod(F.xxhash64("id"), F.col("pieces"))).withColumn("asker", F.explode(F.sequence(F.lit(0), F.col("askers") - 1)))
        right = visits.join(plan, "grp").withColumn("asker", F.pmod(F.xxhash64("id"), F.col("askers"))).withColumn("piece", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)))
        left = left.select("grp", F.col("piece").cast("int").alias("piece"), F.col("asker").cast("int").alias("asker"), "bucket", "id", "v")
        right = right.select("grp", F.col("piece").cast("int").alias("piece"), F.col("asker").cast("int").alias("asker"), "id", "v", "buckets")

        def rank(here: pa.Table, asking: pa.Table) -> pa.Table:
            query, other, scores = [], [], []
            if here.num_rows and asking.num_rows:
                bucket = here.column("bucket").to_numpy()
                order = np.argsort(bucket, kind="stable")
                bucket, ids, v = bucket[order], here.column("id").to_numpy()[order], _vectors(here.column("v"))[order]
                wanted, q_ids, q = asking.column("buckets").to_pylist(), asking.column("id").to_numpy(), _vectors(asking.column("v"))
                for i in range(len(q)):
                    if wanted[i] is None:
                        at = np.arange(len(ids))
                    else:
                        b = np.array(wanted[i])
                        lo, hi = np.searchsorted(bucket, b, "left"), np.searchsorted(bucket, b, "right")
                        at = np.concatenate([np.arange(x, y) for x, y in zip(lo, hi, strict=True) if x < y] or [np.empty(0, int)])
                    at = at[ids[at] != q_ids[i]]
                    if len(at) > k:
                        rough = v[at] @ q[i]
                        at = at[rough >= np.partition(rough, len(at) - k)[len(at) - k] - 1e-9]
                    score = (v[at] * q[i]).sum(axis=1)
                    first = np.lexsort((ids[at], -score))[:k]
                    query += [q_ids[i]] * len(first)
                    other.append(ids[at][first])
                    scores.append(score[first])
            none = np.empty(0)
            return pa.table({"query_id": pa.array(query, pa.int64()), "vec_id": pa.array(np.concatenate(other or [none]).astype(np.int64)), "score": pa.array(np.concatenate(scores or [none]))})

        keys = ["grp", "piece", "asker"]
        best = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(rank, "query_id bigint, vec_id bigint, score double")
        best = best.distinct()
        order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
        return scratch.put(best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score"), f"best-{label}")

    first_table = F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(groups - 1).cast("bigint")))

    def exact(asking: DataFrame, label: str) -> DataFrame:
        everywhere = asking.withColumn("grp", first_table).select("grp", "id", "v", F.lit(None).cast("array<bigint>").alias("buckets"))
        return best_of(everywhere, entered.where(F.col("grp") < groups), label)

    def probed(n: int) -> DataFrame:
        kinds = "grp bigint, id bigint, v array<double>, buckets array<bigint>"
        return best_of(scratch.put(queries.mapInArrow(lambda batches: visit(batches, n), kinds), "visits"), entered, "probed")

    best = probed(probes)
    sample = scratch.put(queries.select("id").distinct().orderBy(F.xxhash64("id"), "id").limit(checked), "sample")
    truth = exact(queries.join(sample, "id"), "truth").select("query_id", "vec_id")

    def enough(found: DataFrame) -> bool:
        both = truth.join(found.select("query_id", "vec_id", F.lit(1.0).alias("hit")).distinct(), ["query_id", "vec_id"], "left")
        each = both.groupBy("query_id").agg(F.avg(F.coalesce("hit", F.lit(0.0))).alias("r"))
        got = each.agg(F.avg("r").alias("mean"), F.stddev_pop("r").alias("sd"), F.count("*").alias("n")).collect()[0]
        return not got["n"] or got["mean"] - 2 * got["sd"] / got["n"] ** 0.5 >= recall

    most = 3**m  # the buckets within one step in each projection
    while not enough(best):
        if probes >= most:
            return exact(queries, "all")
        probes = min(most, 2 * probes)
        best = probed(probes)
    short = best.groupBy("query_id").agg(F.count("*").alias("n")).where(F.col("n") >= min(k, count - 1)).select(F.col("query_id").alias("id"))
    short = scratch.put(queries.join(short, "id", "left_anti"), "short")
    if short.isEmpty() or count == 1:
        return best
    rest = exact(short, "all")
    done = best.join(short.select(F.col("id").alias("query_id")).distinct(), "query_id", "left_anti")
    return done.select("query_id", "rank", "vec_id", "score").unionByName(rest)
