"""What the operators of this package share: scratch tables, fixed-size filters, packed rows."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.tasks import release, small_batches  # noqa: F401


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir; one of our own where that is unset and all run in one process."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    option = spark.sparkContext._jsc.sc().getCheckpointDir()
    if option.isDefined():
        return option.get().rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    own = f"file://{tempfile.mkdtemp(prefix='vellum-')}"
    spark.sparkContext.setCheckpointDir(own)
    return spark.sparkContext._jsc.sc().getCheckpointDir().get().rstrip("/")


class Scratch:
    """Tables written to the shared folder: they cut lineage, survive the loss of executors, and are compact."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        small_batches(spark)
        self.root = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
        self._n = 0

    def path(self, label: str) -> str:
        self._n += 1
        return f"{self.root}/{self._n:03d}-{label}"

    def put(self, df: DataFrame, label: str) -> DataFrame:
        path = self.path(label)
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        return out

    def drop(self, df: DataFrame) -> None:
        """Deletes a table that no later step reads."""
        self.remove(df._scratch_path)

    def remove(self, path: str) -> None:
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


#: A key is hot that has more than one in so many rows: there are fewer hot keys than this.
HOT_SHARE = 1000


def spread_join(big: DataFrame, small: DataFrame, key: str, by: str, scratch: Scratch, counts: DataFrame | None = None) -> DataFrame:
    """big joined with small (one row for each key), hot keys of big being dealt out by column by to several tasks.

    For each hot key (more than one row of HOT_SHARE; so the broadcast table of them has less than HOT_SHARE rows,
    whatever the size) small's row is repeated, once for each HOT_SHARE-th of all rows that the key has: less
    than 2 * HOT_SHARE more rows. counts (key, n) are those of big, which is counted if they are not at hand.
    """
    counts = big.groupBy(key).agg(F.count("*").alias("n")) if counts is None else counts
    counts = scratch.put(counts.select(key, "n"), "counts")
    floor = (counts.agg(F.sum("n")).first()[0] or 0) // HOT_SHARE + 1
    hot = scratch.put(counts.where(F.col("n") > floor).select(key, F.ceil(F.col("n") / floor).cast("int").alias("_parts")), "hot")
    parts = F.coalesce("_parts", F.lit(1))
    left = big.join(F.broadcast(hot), key, "left").withColumn("_part", F.pmod(F.xxhash64(by), parts).cast("int")).drop("_parts")
    right = small.join(F.broadcast(hot), key, "left").withColumn("_part", F.explode(F.sequence(F.lit(0), parts - 1))).drop("_parts")
    return left.join(right, [key, "_part"]).drop("_part")


def list_files(spark: SparkSession, path: str) -> list[tuple[str, int]]:
    """(uri, bytes) of the data files in a folder of any Hadoop file system."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found = [(s.getPath().toString(), s.getLen(), s.getPath().getName()) for s in fs.listStatus(p)]
    return sorted((uri, n) for uri, n, name in found if not name.startswith(("_", ".")))


def _slot(key: Column, is_long: bool, bits: int) -> Column:
    return F.pmod(key if is_long else F.xxhash64(key), F.lit(bits))


def bitmap_of(keys: DataFrame, key: str, bits: int = 1 << 24) -> DataFrame:
    """The slots that the hashes of key take, 64 to a row: at most bits / 64 rows of 16 bytes, whatever the input."""
    slot = _slot(F.col(key), dict(keys.dtypes)[key] == "bigint", bits)
    rows = keys.select(F.shiftright(slot, 6).alias("bm_no"), F.pmod(slot, F.lit(64)).cast("int").alias("at"))
    return rows.groupBy("bm_no").agg(F.bit_or(F.expr("shiftleft(1L, at)")).alias("bm_bits"))


def may_contain(df: DataFrame, key: Column, is_long: bool, bitmap: DataFrame, bits: int = 1 << 24) -> DataFrame:
    """df with a boolean bm_hit: false where key certainly isn't among those of bitmap_of() with as many bits."""
    joined = df.withColumn("bm_slot", _slot(key, is_long, bits)).withColumn("bm_no", F.shiftright("bm_slot", 6)).join(F.broadcast(bitmap), "bm_no", "left")
    hit = F.coalesce(F.bit_get("bm_bits", F.pmod("bm_slot", F.lit(64)).cast("int")) == 1, F.lit(False))
    return joined.withColumn("bm_hit", hit).drop("bm_slot", "bm_no", "bm_bits")


def row_key(id_col: str, text_col: str) -> Column:
    """With the id, tells rows apart; repeated rows (same id and text) are one document."""
    return F.xxhash64(F.col(id_col), F.col(text_col))


def without_rows(docs: DataFrame, drop: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """docs, all columns, without the rows whose id and row_key() are in drop (id, row_key). Rows that cannot be
    meant (by a bitmap of fixed size) are not shuffled."""
    gone = drop.select(F.col("id").alias("_gone_id"), F.col("row_key").alias("_gone_key"))
    packed = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_doc"), F.col(id_col).alias("_id"), row_key(id_col, text_col).alias("_key"))
    marked = may_contain(packed, F.col("_key"), True, bitmap_of(gone, "_gone_key"))
    gone = gone.distinct().withColumn("_gone", F.lit(True))
    on = (F.col("_key") == F.col("_gone_key")) & F.col("_id").eqNullSafe(F.col("_gone_id"))
    checked = marked.where("bm_hit").join(gone, on, "left").where("_gone is null")  # an anti-join would be pushed below the filter
    both = marked.where("not bm_hit").select("_doc").unionByName(checked.select("_doc"))
    return both.select(*(F.col("_doc").getField(c).alias(c) for c in docs.columns))
