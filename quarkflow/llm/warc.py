"""WARC archives: writing, reading and revisit resolution.

Headers (id, address, payload digest and length) are grouped by payload digest with a map-side maximum, so a payload
that a third of the pages share costs one row per task; the join back is a plain equi-join that adaptive execution can
split. Archives are written by Spark's own text writer (a record, then the two CRLF that end it, gzip members), so task
retries and any Hadoop file system are covered by the commit protocol; they are read back by Content-Length.

Defined results: a null payload is an empty one; a null url writes an empty address; control characters in
an address are replaced by spaces. All rows that carry a group's largest id are responses (repeated rows stay repeated);
a row with a null id in a group with ids is a revisit, and in a group of nulls only, a response. Extra columns are ignored.
"""

from __future__ import annotations

import gzip
import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarkflow.llm.common import materialise, shared_path

MIN_REVISIT_BYTES = 1000
CRLF = "\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_READ = "record_id string, warc_type string, target_uri string, warc_date string, payload_digest string, computed_digest string, payload_bytes long, refers_to_id string, payload binary"


def headers(df: DataFrame, id_col: str, url_col: str, payload_col: str) -> DataFrame:
    """(rec_id, url, payload, payload_bytes, payload_digest) of every row."""
    payload = F.coalesce(F.col(payload_col).cast("string"), F.lit(""))
    return df.select(
        F.col(id_col).cast("long").alias("rec_id"),
        F.regexp_replace(F.coalesce(F.col(url_col).cast("string"), F.lit("")), r"[\x00-\x1F\x7F]", " ").alias("url"),
        payload.alias("payload"),
        F.octet_length(payload).cast("long").alias("payload_bytes"),
        F.sha1(payload.cast("binary")).alias("payload_digest"),
    )


def resolve_revisits(heads: DataFrame, min_bytes: int = MIN_REVISIT_BYTES) -> DataFrame:
    """Adds record_type, refers_to (id of the original) and refers_to_url to headers."""
    # Written before the join, so that both sides are exchanged and adaptive execution can split a hot digest.
    originals = materialise(
        heads.where(F.col("payload_bytes") >= min_bytes)
        .groupBy("payload_digest", "payload_bytes")
        .agg(F.max(F.struct("rec_id", "url")).alias("_orig"), F.count(F.lit(1)).alias("_n"))
        .where((F.col("_n") > 1) & F.col("_orig.rec_id").isNotNull())
        .select("payload_digest", "payload_bytes", F.col("_orig.rec_id").alias("_orig_id"), F.col("_orig.url").alias("_orig_url")),
        "originals",
    )
    revisit = F.col("_orig_id").isNotNull() & ~F.col("rec_id").eqNullSafe(F.col("_orig_id"))
    return heads.join(originals, ["payload_digest", "payload_bytes"], "left").select(
        *heads.columns,
        F.when(revisit, "revisit").otherwise("response").alias("record_type"),
        F.when(revisit, F.col("_orig_id")).alias("refers_to"),
        F.when(revisit, F.col("_orig_url")).alias("refers_to_url"),
    )


def _urn(rec_id: Column) -> Column:
    return F.concat(F.lit("<urn:quarkflow:record:"), F.coalesce(rec_id.cast("string"), F.lit("none")), F.lit(">"))


def record_text(date: str) -> Column:
    """A WARC/1.1 record, without the two CRLF after it, from resolve_revisits()' columns."""
    revisit = F.col("record_type") == "revisit"
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "), F.col("payload_bytes").cast("string"), F.lit(CRLF * 2))
    block = F.concat(http, F.when(revisit, "").otherwise(F.col("payload")))
    about = F.when(
        revisit,
        F.concat(
            F.lit(f"WARC-Profile: {PROFILE}{CRLF}WARC-Refers-To: "), _urn(F.col("refers_to")), F.lit(f"{CRLF}WARC-Refers-To-Target-URI: "), F.col("refers_to_url"),
            F.lit(f"{CRLF}WARC-Refers-To-Date: {date}{CRLF}"),
        ),
    ).otherwise("")
    return F.concat(
        F.lit(f"WARC/1.1{CRLF}WARC-Type: "), F.col("record_type"), F.lit(f"{CRLF}WARC-Record-ID: "), _urn(F.col("rec_id")),
        F.lit(f"{CRLF}WARC-Target-URI: "), F.col("url"), F.lit(f"{CRLF}WARC-Date: {date}{CRLF}WARC-Payload-Digest: sha1:"), F.col("payload_digest"), F.lit(CRLF), about,
        F.lit(f"Content-Type: application/http; msgtype=response{CRLF}Content-Length: "), F.octet_length(block).cast("string"), F.lit(CRLF * 2), block,
    )


def write_archives(resolved: DataFrame, path: str, date: str = "2024-01-01T00:00:00Z", records_per_file: int = 4000) -> None:
    """Gzip archives below path; fresh headers throughout."""
    resolved.select(record_text(date).alias("value")).write.option("lineSep", CRLF * 2).option("compression", "gzip").option("maxRecordsPerFile", records_per_file).text(path)


_FIELD = re.compile(rb"([^:\r\n]+):[ \t]*([^\r\n]*)\r\n")


def parse_archive(data: bytes, with_payload: bool) -> Iterator[tuple]:
    """The records of one archive, as tuples in the order of the read schema."""
    data = gzip.decompress(data) if data[:2] == b"\x1f\x8b" else data
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        if not data.startswith(b"WARC/", at):
            raise ValueError(f"no WARC record at byte {at}")
        head = {k.strip().lower(): v.decode() for k, v in _FIELD.findall(data[at : end + 2])}
        n = int(head[b"content-length"])
        block = data[end + 4 : end + 4 + n]
        if len(block) < n:
            raise ValueError("an archive ends within a record")
        at = end + 4 + n + 4
        payload = block.partition(b"\r\n\r\n")[2] if head.get(b"content-type", "").startswith("application/http") else block
        full = head[b"warc-type"] != "revisit"
        yield (
            head.get(b"warc-record-id"), head[b"warc-type"], head.get(b"warc-target-uri"), head.get(b"warc-date"), head.get(b"warc-payload-digest"),
            hashlib.sha1(payload).hexdigest() if full else None, len(payload) if full else None, head.get(b"warc-refers-to"), payload if with_payload and full else None,
        )


def read_archives(spark: SparkSession, path: str, with_payload: bool = False) -> DataFrame:
    """One row per record of the archives below path. A revisit has no payload of its own."""
    schema = _READ if with_payload else _READ.removesuffix(", payload binary")
    types = pa.schema([(n, {"long": pa.int64(), "binary": pa.binary()}.get(t, pa.string())) for n, t in (x.split() for x in schema.split(", "))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column("content"):
                rows: list[tuple] = []
                held = 0
                for record in parse_archive(content.as_py(), with_payload):
                    rows.append(record[: len(types)])
                    held += 200 + (record[6] or 0) * with_payload
                    if held > 8 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows), types)], schema=types)
                        rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows), types)], schema=types)

    return spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content").mapInArrow(run, schema)


def _id_of(urn: Column) -> Column:
    return F.regexp_extract(urn, r"record:(-?\d+)>", 1).try_cast("long")


def resolve_payloads(records: DataFrame) -> DataFrame:
    """Join revisits to the responses they name: rec_id, payload_bytes, payload_digest, record_type, refers_to.

    A revisit whose original is missing keeps the digest of its own header and a null length.
    """
    base = materialise(records.select(
        _id_of(F.col("record_id")).alias("rec_id"), "warc_type", "target_uri", F.col("payload_bytes").alias("_bytes"), F.col("computed_digest").alias("_computed"),
        F.regexp_replace("payload_digest", "^sha1:", "").alias("_stated"), _id_of(F.col("refers_to_id")).alias("_refers"),
    ), "headers")
    revisits = base.where(F.col("warc_type") == "revisit")
    named = base.where((F.col("warc_type") == "response") & (F.col("_bytes") > 0)).groupBy(F.col("rec_id").alias("_refers"), F.col("_computed").alias("_stated")).agg(F.max("_bytes").alias("_full"))
    named = materialise(named.join(revisits.select("_refers", "_stated").distinct(), ["_refers", "_stated"], "left_semi"), "named")
    first = base.where(F.col("warc_type") != "revisit").select("rec_id", F.col("_bytes").alias("payload_bytes"), F.col("_computed").alias("payload_digest"), F.col("warc_type").alias("record_type"), F.lit(None).cast("long").alias("refers_to"))
    second = revisits.join(named, ["_refers", "_stated"], "left").select("rec_id", F.col("_full").alias("payload_bytes"), F.col("_stated").alias("payload_digest"), F.col("warc_type").alias("record_type"), F.col("_refers").alias("refers_to"))
    return first.unionByName(second)


def dedup_archives(df: DataFrame, id_col: str, url_col: str, payload_col: str, path: str | None = None, min_bytes: int = MIN_REVISIT_BYTES) -> DataFrame:
    """Write deduplicated archives of df (below path, or in the shared folder) and return what reading them gives."""
    spark = df.sparkSession
    path = path or shared_path(spark, "warc")
    write_archives(resolve_revisits(headers(df, id_col, url_col, payload_col), min_bytes), path)
    return resolve_payloads(read_archives(spark, path)).withColumnRenamed("rec_id", id_col)


ORACLE = """
    WITH h AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS b, sha1(coalesce(html, '')) AS g FROM pages),
    o AS (SELECT g, max(page_id) AS orig FROM h WHERE b >= 1000 GROUP BY g)
    SELECT h.page_id, CAST(h.b AS BIGINT) AS payload_bytes, h.g AS payload_digest,
      CASE WHEN o.orig IS NOT NULL AND o.orig <> h.page_id THEN 'revisit' ELSE 'response' END AS record_type,
      CASE WHEN o.orig <> h.page_id THEN o.orig END AS refers_to
    FROM h LEFT JOIN o ON o.g = h.g AND h.b >= 1000"""
