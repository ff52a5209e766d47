"""WARC archives: a writer made of native expressions, and a Python data source that reads headers first."""

from __future__ import annotations

import gzip
import io
import json
import sys
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, GreaterThanOrEqual, In, InputPartition, StringStartsWith

from .shared import Scratch, bitmap_of, list_files, may_contain

CRLF = "\r\n"
PREFIX = "urn:page:"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: The base32 alphabet.
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def base32_sha1(payload: Column) -> Column:
    """Bare upper-case base32 of the SHA-1, native: eight groups of 20 bits, four characters each."""
    hexed = F.sha1(payload)
    groups = [F.conv(F.substring(hexed, 5 * g + 1, 5), 16, 10).cast("int") for g in range(8)]
    letters = [F.substring(F.lit(BASE32), F.shiftright(v, s).bitwiseAND(F.lit(31)) + 1, F.lit(1)) for v in groups for s in (15, 10, 5, 0)]
    return F.concat(*letters)


def _header(value: Column) -> Column:
    """A header value on one line: control characters are percent-encoded."""
    out = value
    for c, e in (("\r", "%0D"), ("\n", "%0A")):
        out = F.replace(out, F.lit(c), F.lit(e))
    return out


def write_warc(pages: DataFrame, path: str, scratch: Scratch, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", min_bytes: int = 0) -> None:
    """Writes one record for each row; of equal payloads of at least min_bytes, the smallest id is the response.

    The others are revisit records that refer to it. Rows that share the smallest id, and rows with a null id
    where no id is known, are all responses. Null payloads are empty; a null url has no target header. Payloads
    are told apart by their SHA-1. Only rows whose digest may repeat (by a bitmap of fixed size) are
    shuffled; the rest stream to their files. The text sink ends each value with CRLF CRLF, as a record must.
    """
    payload = F.coalesce(F.col(payload_col).cast("string"), F.lit(""))
    base = pages.select(F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url"), payload.alias("payload"))
    base = base.withColumn("digest", base32_sha1(F.col("payload")))
    repeated = scratch.put(
        base.where(F.octet_length("payload") >= min_bytes).groupBy("digest").agg(F.min("id").alias("first"), F.count("*").alias("n"))
        .where("n > 1 and first is not null").select("digest", "first"), "repeated",
    )
    marked = may_contain(base, F.col("digest"), False, bitmap_of(repeated, "digest"))
    alone = marked.where("not bm_hit").select("id", "url", "payload", "digest", F.lit(None).cast(base.schema["id"].dataType).alias("first"))
    shared = marked.where("bm_hit").join(repeated.hint("shuffle_hash"), "digest", "left").select("id", "url", "payload", "digest", "first")
    revisit = F.coalesce(~F.col("first").eqNullSafe(F.col("id")) & F.col("first").isNotNull(), F.lit(False))
    urn = lambda c: F.concat(F.lit(f"<{PREFIX}"), F.coalesce(F.url_encode(F.col(c).cast("string")), F.lit("")), F.lit(">"))
    http = F.concat(
        F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "), F.octet_length("payload").cast("string"), F.lit(CRLF * 2)
    )
    block = F.when(revisit, http).otherwise(F.concat(http, F.col("payload")))
    record = F.concat(
        F.lit(f"WARC/1.1{CRLF}WARC-Type: "), F.when(revisit, "revisit").otherwise("response"),
        F.lit(f"{CRLF}WARC-Record-ID: "), urn("id"), F.lit(f"{CRLF}WARC-Date: 1970-01-01T00:00:00Z"),
        F.coalesce(F.concat(F.lit(f"{CRLF}WARC-Target-URI: "), _header(F.col("url"))), F.lit("")),
        F.lit(f"{CRLF}WARC-Payload-Digest: sha1:"), F.col("digest"),
        F.when(revisit, F.concat(F.lit(f"{CRLF}WARC-Refers-To: "), urn("first"), F.lit(f"{CRLF}WARC-Profile: {PROFILE}"))).otherwise(F.lit("")),
        F.lit(f"{CRLF}Content-Type: application/http; msgtype=response{CRLF}Content-Length: "),
        (F.octet_length(http) + F.when(revisit, 0).otherwise(F.octet_length("payload"))).cast("string"), F.lit(CRLF * 2), block,
    )
    alone.unionByName(shared).select(record.alias("value")).write.option("lineSep", CRLF * 2).text(path)


SCHEMA = (
    "record_id string, record_type string, target_uri string, warc_date string, refers_to string, payload_digest string, "
    "content_length bigint, http_length bigint, headers map<string,string>, payload binary"
)
_BY_HEADER = {"record_id": "warc-record-id", "record_type": "warc-type", "target_uri": "warc-target-uri", "warc_date": "warc-date", "refers_to": "warc-refers-to", "payload_digest": "warc-payload-digest"}


@dataclass
class Files(InputPartition):
    files: list[str]


def open_uri(uri: str):
    """A readable binary file of a local path or of any store that pyarrow knows."""
    if uri.startswith("file:") or uri.startswith("/"):
        raw = open("/" + uri.removeprefix("file:").lstrip("/"), "rb", buffering=1 << 20)  # noqa: SIM115
    else:
        from pyarrow import fs

        store, path = fs.FileSystem.from_uri(uri)
        raw = io.BufferedReader(store.open_input_file(path), 1 << 20)
    return gzip.open(raw, "rb") if uri.endswith(".gz") else raw


def _fields(f) -> dict[str, str]:
    out: dict[str, str] = {}
    last = None
    while (line := f.readline()) not in (b"\r\n", b"\n", b""):
        text = line.rstrip(b"\r\n").decode("utf-8", "replace")
        if text[:1] in (" ", "\t") and last:
            out[last] += " " + text.strip()
        else:
            name, _, value = text.partition(":")
            last = name.strip().lower()
            out[last] = value.strip()
    return out


def parse(f, accept, want_payload: bool) -> Iterator[tuple[dict[str, str], int | None, bytes | None]]:
    """(headers, length that the HTTP header names, payload) of the accepted records; others are skipped unread."""
    while line := f.readline():
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"not a WARC record: {line[:40]!r}")
        headers = _fields(f)
        left = int(headers.get("content-length") or 0)
        http, payload = None, None
        if accept(headers):
            if headers.get("content-type", "").startswith("application/http"):
                before = f.tell()
                f.readline()
                named = _fields(f)
                http = int(named["content-length"]) if named.get("content-length", "").isdigit() else None
                left -= f.tell() - before
            if want_payload:
                payload = f.read(left)
                left -= len(payload)
                if left:
                    raise ValueError("a WARC record ends early")
            if left:
                f.seek(left, 1)
            yield headers, http, payload
        elif left:
            f.seek(left, 1)


class WarcReader(DataSourceReader):
    def __init__(self, options, schema):
        self.files = json.loads(options["files"])
        self.target = int(options.get("partitionbytes", 16 << 20))
        self.names = [x.name for x in schema.fields]
        self.filters: list = []

    def pushFilters(self, filters):
        for x in filters:
            column = x.attribute[0] if getattr(x, "attribute", None) and len(x.attribute) == 1 else ""
            known = column in _BY_HEADER and isinstance(x, EqualTo | In | StringStartsWith)
            if known or column == "content_length" and isinstance(x, EqualTo | GreaterThanOrEqual):
                self.filters.append((column, type(x).__name__, list(x.value) if isinstance(x, In) else x.value))
            else:
                yield x

    def partitions(self):
        packed: list[Files] = []
        size = self.target
        for uri, n in self.files:
            if size + n > self.target:
                packed.append(Files([]))
                size = 0
            packed[-1].files.append(uri)
            size += n
        return packed or [Files([])]

    def accepts(self, headers: dict[str, str]) -> bool:
        for column, kind, value in self.filters:
            got = int(headers.get("content-length") or 0) if column == "content_length" else headers.get(_BY_HEADER[column])
            if got is None:
                return False
            if not {"EqualTo": lambda: got == value, "In": lambda: got in value, "StringStartsWith": lambda: got.startswith(value), "GreaterThanOrEqual": lambda: got >= value}[kind]():
                return False
        return True

    def read(self, partition):
        want = "payload" in self.names
        kinds = {"content_length": pa.int64(), "http_length": pa.int64(), "headers": pa.map_(pa.string(), pa.string()), "payload": pa.binary()}

        def batch(rows):
            return pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], kinds.get(c, pa.string())) for c in self.names], self.names)

        rows, size = [], 0
        for uri in partition.files:
            with open_uri(uri) as f:
                for headers, http, payload in parse(f, self.accepts, want):
                    row = {c: headers.get(h) for c, h in _BY_HEADER.items()}
                    row |= {"content_length": int(headers.get("content-length") or 0), "http_length": http, "headers": list(headers.items()), "payload": payload}
                    rows.append(row)
                    size += 500 + len(payload or b"")
                    if size > 4 << 20:
                        yield batch(rows)
                        rows, size = [], 0
        if rows:
            yield batch(rows)


class WarcSource(DataSource):
    """format("warc"): partitions are groups of files; filters on header columns are evaluated before a payload is read."""

    @classmethod
    def name(cls):
        return "warc"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return WarcReader(self.options, schema)


def read_warc(spark: SparkSession, path: str, columns: str = SCHEMA, partition_bytes: int = 16 << 20) -> DataFrame:
    """The records of the archives in a folder. Leave payload out of columns to skip payloads without decoding them."""
    cloudpickle.register_pickle_by_value(sys.modules[__name__])  # the planning worker need not have this package
    spark.dataSource.register(WarcSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    files = [x for x in list_files(spark, path) if x[1]]
    return spark.read.format("warc").schema(columns).option("files", json.dumps(files)).option("partitionbytes", partition_bytes).load()


def record_key(column: Column, kind: str) -> Column:
    """The id in <urn:page:...>; null where it is empty."""
    found = F.regexp_extract(column, f"^<{PREFIX}(.*)>$", 1)
    return F.when(found != "", F.url_decode(found)).cast(kind)


def archive_round_trip(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", min_bytes: int = 0) -> DataFrame:
    """Writes pages to archives in the shared folder and reads them back: one row for each record.

    Columns: id, payload_bytes and payload_digest of the full payload, record_type, refers_to, url, digest_ok (the
    payload read has the digest in its header; revisits have none to test). Empty tables give no rows; extra
    columns are not read; see write_warc() for nulls, ties and repeated rows.
    """
    spark = pages.sparkSession
    scratch = Scratch(spark, "warc")
    path = scratch.path("archives")
    write_warc(pages, path, scratch, id_col, url_col, payload_col, min_bytes)
    kind = pages.schema[id_col].dataType.simpleString()
    back = read_warc(spark, path, "record_id string, record_type string, target_uri string, refers_to string, payload_digest string, http_length bigint, payload binary")
    response = F.col("record_type") == "response"
    digest = F.regexp_replace("payload_digest", "^sha1:", "")
    return back.select(
        record_key(F.col("record_id"), kind).alias(id_col),
        F.when(response, F.octet_length("payload").cast("bigint")).otherwise(F.col("http_length")).alias("payload_bytes"),
        digest.alias("payload_digest"), "record_type", record_key(F.col("refers_to"), kind).alias("refers_to"),
        F.col("target_uri").alias("url"), F.when(response, base32_sha1(F.col("payload")) == digest).alias("digest_ok"),
    )


ORACLE = f"""
WITH p AS (SELECT page_id, url, coalesce(html, '') AS h FROM pages),
d AS (SELECT page_id, url, strlen(h)::BIGINT AS payload_bytes, sha1(h) AS hx FROM p),
f AS (SELECT *, min(page_id) OVER (PARTITION BY hx) AS first_id FROM d)
SELECT page_id, payload_bytes,
  list_aggregate(list_transform(range(0, 32), lambda i: substr('{BASE32}',
    (((('0x' || substr(hx, (i // 4) * 5 + 1, 5))::BIGINT >> (15 - 5 * (i % 4))) & 31) + 1)::BIGINT, 1)), 'string_agg', '') AS payload_digest,
  CASE WHEN page_id <> first_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id <> first_id THEN first_id END AS refers_to, url,
  CASE WHEN page_id <> first_id THEN NULL ELSE true END AS digest_ok
FROM f
"""
