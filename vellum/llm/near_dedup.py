"""MinHash near-duplicates with sequential Bayesian verification."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .minhash import WordHashes, band_keys, fewest_matches, near_components, shingles, signatures, sliced, word_hashes
from .shared import Scratch, bitmap_of, may_contain, release, row_key, spread_join


def text_set(text: str, n: int, cache: WordHashes) -> np.ndarray:
    """Sorted distinct hashes of the n-word shingles; A-Z count as a-z; words are split at ASCII white space."""
    return np.unique(shingles(word_hashes(text.encode("utf-8", "surrogatepass").lower().split(), cache), n))


def near_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    n_words: int = 5,
    share: tuple[int, int] = (80, 100),
    bands: int = 25,
    rows: int = 5,
    miss: float = 1e-9,
    batch: int = 25,
) -> DataFrame:
    """One row for each row of docs: id, n_shingles, component_id (smallest linked id, its own included), kept, row_key.

    Documents are linked when share[1] * |intersection| >= share[0] * |union| of their distinct n-word
    shingles. Texts with equal sets are one class; classes are banded, candidates are compared signature
    batch by signature batch, pruned once the posterior probability of a link falls under miss, and survivors
    are verified on full sets. The chance that banding misses a link at the threshold t is (1 - t^rows)^bands.

    Null or wordless texts have an empty set and no links. Null ids are ignored in minima: a component with
    no other id has a null component_id. Rows with equal ids are kept or dropped alike. Extra columns of docs,
    whatever their names, are not read. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "near")
    k = bands * rows
    least = fewest_matches(share[0] / share[1], miss, k, batch)
    base = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    id_type = base.schema["id"].dataType.simpleString()

    def prepare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = WordHashes()
        for x in sliced(batches, "text"):
            sets = [text_set(t or "", n_words, cache) for t in x.column("text").to_pylist()]
            full = [i for i, s in enumerate(sets) if len(s)]
            sigs = signatures([sets[i] for i in full], k) if full else np.empty((0, k), np.uint32)
            fp: list = [None] * len(sets)
            sig: list = [None] * len(sets)
            for i, row in zip(full, sigs, strict=True):
                fp[i], sig[i] = xxhash.xxh3_128_digest(sets[i].tobytes()), row.tobytes()
            yield pa.RecordBatch.from_arrays(
                [x.column("id"), x.column("rk"), pa.array([len(s) for s in sets], pa.int64()), pa.array(fp, pa.binary()), pa.array(sig, pa.binary())],
                ["id", "rk", "n", "fp", "sig"],
            )
        cache.clear()
        release()

    signed = scratch.put(
        base.select("id", row_key("id", "text").alias("rk"), "text").mapInArrow(prepare, f"id {id_type}, rk bigint, n bigint, fp binary, sig binary"),
        "signed",
    )
    # One class for each distinct set; the row with the smallest id, nulls last, stands for it.
    classes = scratch.put(
        signed.where("fp is not null").groupBy("fp")
        .agg(F.min(F.struct(F.col("id").isNull(), F.col("id").alias("id"), "rk", "sig")).alias("m"))
        .select(F.col("fp").alias("key"), "m.id", "m.rk", "m.sig"), "classes",
    )
    rows_ = scratch.put(signed.drop("sig"), "rows")
    scratch.drop(signed)

    def keys_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            sig = np.frombuffer(b"".join(x.column("sig").to_pylist()), np.uint32).reshape(x.num_rows, k)
            at = np.repeat(np.arange(x.num_rows), bands)
            yield pa.RecordBatch.from_arrays([pa.array(band_keys(sig, bands, rows).ravel()), x.column("key").take(pa.array(at))], ["bucket", "key"])

    buckets = classes.select("key", "sig").mapInArrow(keys_of, "bucket bigint, key binary")

    def texts_of(keys: DataFrame) -> DataFrame:
        wanted = classes.select("key", "id", "rk").join(keys, "key")
        wanted = scratch.put(wanted, "wanted")
        here = base.where("text is not null").withColumn("rk", row_key("id", "text"))
        some = may_contain(here, F.col("rk"), True, bitmap_of(wanted, "rk")).where("bm_hit")
        # One column to join by, equal for equal nulls, too, and of one type (rk is never null): the exchange that
        # drops repeated rows serves the join.
        own = wanted.select("key", F.struct(F.coalesce("rk", F.lit(0)).alias("rk"), "id").alias("row"))
        return some.select(F.struct("rk", "id").alias("row"), "text").dropDuplicates(["row"]).join(own, "row").select("key", "text")

    cache = WordHashes()

    def sets_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        found = [text_set(t, n_words, cache) for t in texts]
        return np.concatenate(found), np.array([len(s) for s in found])

    roots = near_components(buckets, texts_of, sets_of, share, scratch, sig=classes.select("key", "sig"), k=k, bands=(bands, rows), least=least)
    grouped = classes.select("key", "id").join(roots.withColumnRenamed("node", "key"), "key", "left")
    grouped = scratch.put(grouped.select("key", "id", "root"), "grouped")
    linked = grouped.where("root is not null")
    first = scratch.put(linked.groupBy("root").agg(F.min("id").alias("cid"), F.count("*").alias("n")), "first")
    ids = spread_join(linked.select("key", "root"), first.select("root", "cid"), "root", "key", scratch, first).select(F.col("key").alias("fp"), "cid")
    ids = ids.unionByName(grouped.where("root is null").select(F.col("key").alias("fp"), F.col("id").alias("cid")))
    ids = scratch.put(ids, "ids")
    out = rows_.select("id", "rk", "n", "fp").join(ids, "fp", "left")
    component = F.when(F.col("fp").isNull(), F.col("id")).otherwise(F.col("cid"))
    return out.select(
        F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("id").eqNullSafe(component).alias("kept"),
        F.col("rk").alias("row_key"),
    )
