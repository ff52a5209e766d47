"""Note sources and checksum sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import sums_line


def list_notes(spark: SparkSession, folder: str) -> DataFrame:
    """(path, mtime, size) of the Markdown files below a folder; bodies are not read, as the column is pruned."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.md").option("recursiveFileLookup", "true").load(folder)
    return files.select("path", F.unix_millis("modificationTime").alias("mtime"), F.col("length").alias("size"))


def read_notes(spark: SparkSession, folder: str, max_chars: int | None = None) -> DataFrame:
    """(path, mtime, size, content); files that vanish or cannot be read are left out (see unread())."""
    files = (
        spark.read.format("binaryFile").option("pathGlobFilter", "*.md").option("recursiveFileLookup", "true")
        .option("ignoreCorruptFiles", "true").option("ignoreMissingFiles", "true").load(folder)
    )
    body = F.decode("content", "UTF-8")
    return files.select(
        "path", F.unix_millis("modificationTime").alias("mtime"), F.col("length").alias("size"), (body if max_chars is None else F.substring(body, 1, max_chars)).alias("content")
    )


def unread(listed: DataFrame, read: DataFrame) -> DataFrame:
    """The listed paths whose bodies could not be read."""
    return listed.join(read.select("path"), "path", "left_anti").select("path")


def documents_as_notes(documents: DataFrame) -> DataFrame:
    """The documents table as notes (path, mtime, size, content); the source is the folder."""
    return documents.select(
        F.concat("source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".md")).alias("path"), (F.lit(1_700_000_000_000) + F.col("doc_id") * 3_600_000).alias("mtime"),
        F.octet_length("text").cast("bigint").alias("size"), F.col("text").alias("content"),
    )


def write_checksums(artefacts: DataFrame, path: str) -> None:
    """Writes '<sha256>  <name>' lines of artefacts (name, content) in the order of names; an empty one fails the job."""
    artefacts.orderBy("name").select(sums_line(F.col("content"), F.col("name")).alias("value")).write.mode("overwrite").text(path)


def verify_release(manifest: DataFrame, package: DataFrame, versions: DataFrame) -> DataFrame:
    """One row (version, agrees): the version of manifest and package is the same and among versions (version)."""
    both = manifest.select("version", "id").crossJoin(package.select(F.col("version").alias("package_version")))  # one row each
    known = versions.select("version", F.lit(True).alias("known")).distinct()
    ok = (F.col("version") == F.col("package_version")) & F.coalesce("known", F.lit(False)) & F.col("id").rlike("^[a-z0-9-]+$")
    return both.join(known, "version", "left").select("version", ok.alias("agrees"))
