"""Connected components by repeated contraction: distributed union-find without a driver-side graph."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import Scratch, release

#: Edges that one union-find holds at a time.
CHUNK = 1 << 19
#: Rounds that prefer small nodes; later ones prefer nodes in an order of their hashes.
BY_VALUE = 3


def local_forests(batches: Iterator[pa.RecordBatch], names: tuple[str, str], centres: bool, chunk: int = CHUNK, seed: int = 0) -> Iterator[pa.RecordBatch]:
    """The components of each chunk of edges (a, b), as stars: a row for each node, with the first node of its component.

    First is the smallest, or with a seed that with the smallest hash. With centres, that node has a row of its own.
    """
    held: list[pa.RecordBatch] = []

    def stars() -> pa.RecordBatch:
        edges = pa.Table.from_batches(held)
        held.clear()
        n = edges.num_rows
        coded = pa.concat_arrays([*edges.column("a").chunks, *edges.column("b").chunks]).dictionary_encode()
        nodes = coded.dictionary
        if seed:
            order = np.argsort(np.array([xxhash.xxh3_64_intdigest(v if isinstance(v, bytes) else str(v), seed) for v in nodes.to_pylist()], np.uint64))
        else:
            order = np.asarray(pc.sort_indices(nodes)).astype(np.int64)
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        code = place[np.asarray(coded.indices)]
        a, b, up = code[:n], code[n:], np.arange(len(order))
        while True:
            a, b = up[a], up[b]
            apart = a != b
            if not apart.any():
                break
            a, b = a[apart], b[apart]
            np.minimum.at(up, np.maximum(a, b), np.minimum(a, b))
            while (up[up] != up).any():
                up = up[up]
        at = np.arange(len(up)) if centres else np.flatnonzero(up != np.arange(len(up)))
        return pa.RecordBatch.from_arrays([nodes.take(pa.array(order[at])), nodes.take(pa.array(order[up[at]]))], list(names))

    for x in batches:
        if x.num_rows:
            held.append(x)
            if sum(y.num_rows for y in held) >= chunk:
                yield stars()
    if held:
        yield stars()


def components(edges: DataFrame, scratch: Scratch, max_rounds: int = 100, chunk: int = CHUNK) -> DataFrame:
    """(node, root) for every node of edges (a, b); root is the smallest node of its component.

    In each round, every chunk of edges is contracted to stars by a union-find in its task; a node that is in the stars
    of several chunks goes to the smallest of its centres, and links that one to the others: those links are the edges
    of the next round. Its nodes are centres only. A centre is the first of its chunk's component in an order
    that (after the first rounds, for the sake of chains in ascending order) is random, so that even of edges
    that lie all apart at least about a third of the nodes go, and rounds grow with the logarithm of the size; what is
    left fits one chunk soon. A hub has one row for each chunk. Null ends and self-loops carry no link.
    The result is a table in the shared folder.
    """
    live = scratch.put(edges.where("a <> b").select("a", "b"), "edges")  # what makes the edges has workers of its own
    kind = dict(live.dtypes)["a"]
    order = Window.partitionBy("node").orderBy("up")
    steps: list[DataFrame] = []
    while True:
        seed = max(0, len(steps) + 1 - BY_VALUE)

        def stars(batches: Iterator[pa.RecordBatch], seed: int = seed) -> Iterator[pa.RecordBatch]:
            yield from local_forests(batches, ("node", "up"), True, chunk, seed)
            release()

        told = live.mapInArrow(stars, f"node {kind}, up {kind}").withColumn("first", F.first("up").over(order)).withColumn("no", F.row_number().over(order))
        told = scratch.put(told, "stars")
        steps.append(told.where("no = 1").select("node", F.col("up").alias("root")))
        live = told.where("up <> first").select(F.col("first").alias("a"), F.col("up").alias("b"))
        if live.isEmpty():
            break
        if len(steps) == max_rounds:
            raise RuntimeError("components did not converge")
    out = steps[-1]
    for step in reversed(steps[:-1]):
        later = out.select(F.col("node").alias("root"), F.col("root").alias("top"))
        out = step.join(later, "root", "left").select("node", F.coalesce("top", "root").alias("root"))
    if len(steps) > BY_VALUE:
        least = out.groupBy("root").agg(F.min("node").alias("least"))
        out = out.join(least, "root").select("node", F.col("least").alias("root"))
    return scratch.put(out, "components") if len(steps) > 1 else out
