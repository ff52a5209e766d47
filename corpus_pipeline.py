"""A corpus pipeline of five operators: what is toxic, repeated, copied or leaked goes, and the rest gets sampling rates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.llm.decontaminate import contamination
from vellum.llm.line_dedup import dedup_lines
from vellum.llm.mixing import label_domains, mix
from vellum.llm.near_dedup import near_duplicates
from vellum.llm.queries import TARGETS, TOKENS
from vellum.llm.shared import Scratch, without_rows
from vellum.llm.toxicity import without_toxic


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the field scores 0.5 or more go."""
    return without_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One line of each component stays; a document that loses all its lines goes, as nothing of it is left."""
    out = dedup_lines(docs)
    kept = out.where(~((F.col("n_removed") > 0) & (F.btrim("text", F.lit(" \t\r\n\x0b\x0c")) == "")))
    return kept.withColumn("n_chars", F.length("text").cast("bigint")).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component stays: that with the smallest id."""
    found = near_duplicates(docs)
    gone = found.where("not kept").select(F.col("doc_id").alias("id"), "row_key")
    return without_rows(docs, gone, "doc_id", "text")


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a window of eight words of any benchmark item go."""
    found = contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), least_items=1)
    gone = found.where("contaminated").select(F.col("doc_id").alias("id"), "row_key")
    return without_rows(docs, gone, "doc_id", "text")


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rate at which to draw each document."""
    return mix(docs, label_domains(spark.read.parquet(f"{sf_dir}/labels.parquet")), TARGETS, TOKENS)


STAGES = [
    ("toxicity", toxicity),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("mixing", mixing),
]
#: A trained field, MinHash and projected gradients are not SQL; tests hold a planted corpus and the operators.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to the documents, each written to the shared folder for the next."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = scratch.put(docs, name)
    return docs
