"""Content-addressed WARC archive.

An archive is two tables in one folder: `payloads` holds the bytes of each payload once, under its
SHA-256 digest; `headers` holds every record's exact header block (WARC/1.1, CRLF lines) with the
digest as key. A record's bytes are its header, its block and two line ends; a `response` has the
payload as its block, a `revisit` has none and names the record that has it. Original records are
rebuilt by a join on the digest, after the stored bytes were hashed again and found equal.

Of records with equal payloads of at least REVISIT_BYTES bytes, the one with the smallest page_id is
the response; the others revisit it. The smallest id of a digest is found in two steps, by (digest,
salt) and by digest, so that a payload shared by a third of all pages meets no single task; payload
bytes are shuffled once, by (digest, page_id).

Defined results: null html is an empty payload, null url no WARC-Target-URI line; line ends and
control characters in a url are percent-encoded; rows that repeat the smallest page_id with the same
payload are all responses; a row with a null page_id is the response only where all ids of its
digest are null; an empty table makes an empty archive; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window as W
from pyspark.sql import functions as F

REVISIT_BYTES = 100
SALTS = 32
#: Capture date of records whose page has none.
CAPTURED = "2024-01-01T00:00:00Z"
CRLF = "\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

HEADER_FIELDS = {"type": "WARC-Type", "id": "WARC-Record-ID", "digest": "WARC-Payload-Digest",
                 "refers_to": "WARC-Refers-To", "payload_bytes": "X-Payload-Length", "length": "Content-Length"}


def record_id(page_id: Column) -> Column:
    return F.concat(F.lit("<urn:page:"), F.coalesce(page_id.cast("string"), F.lit("null")), F.lit(">"))


def _safe_uri(url: Column) -> Column:
    out = url
    for c in (*range(0x21), 0x7F):
        out = F.replace(out, F.lit(chr(c)), F.lit(f"%{c:02X}"))
    return F.when(url.rlike(r"[\x00-\x20\x7F]"), out).otherwise(url)


def digests(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    payload = F.coalesce(F.col(html_col), F.lit("")).cast("binary")
    return pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), payload.alias("payload")) \
        .withColumns({"digest": F.sha2("payload", 256), "bytes": F.octet_length("payload").cast("long")})


def first_ids(digested: DataFrame) -> DataFrame:
    """(digest, salt, first): the smallest page_id of each digest, once for each salt its rows have."""
    salted = digested.select("digest", F.pmod(F.xxhash64("page_id"), F.lit(SALTS)).alias("salt"), "page_id")
    return (salted.groupBy("digest", "salt").agg(F.min("page_id").alias("low"))
            .select("digest", "salt", F.min("low").over(W.partitionBy("digest")).alias("first")))


def header_block(record_type: Column, page_id: Column, url: Column, digest: Column, payload_bytes: Column,
                 refers_to: Column, captured: str = CAPTURED) -> Column:
    """The exact header, with the empty line that ends it."""
    revisit = record_type == "revisit"
    line = lambda name, value: F.concat(F.lit(name + ": "), value, F.lit(CRLF))
    return F.concat(
        F.lit("WARC/1.1" + CRLF), line("WARC-Type", record_type), line("WARC-Record-ID", record_id(page_id)),
        line("WARC-Date", F.lit(captured)), F.coalesce(line("WARC-Target-URI", _safe_uri(url)), F.lit("")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), digest)), line("X-Payload-Length", payload_bytes.cast("string")),
        F.when(revisit, F.concat(line("WARC-Refers-To", record_id(refers_to)), line("WARC-Profile", F.lit(PROFILE)))).otherwise(""),
        line("Content-Type", F.lit("text/html; charset=utf-8")),
        line("Content-Length", F.when(revisit, F.lit("0")).otherwise(payload_bytes.cast("string"))), F.lit(CRLF))


def write_archive(pages: DataFrame, path: str, revisit_bytes: int = REVISIT_BYTES, captured: str = CAPTURED, **cols) -> None:
    """Writes the archive of a pages table to a folder all executors share; a rerun replaces it."""
    rows = digests(pages, **cols)
    firsts = first_ids(rows)
    keyed = rows.select("page_id", "url", "digest", "bytes", F.pmod(F.xxhash64("page_id"), F.lit(SALTS)).alias("salt"))
    revisit = (F.col("bytes") >= revisit_bytes) & ~F.col("page_id").eqNullSafe(F.col("first"))
    headers = (keyed.join(firsts, ["digest", "salt"])
               .withColumn("type", F.when(revisit, "revisit").otherwise("response"))
               .select("page_id", "digest", header_block(F.col("type"), F.col("page_id"), F.col("url"), F.col("digest"),
                                                         F.col("bytes"), F.col("first"), captured).alias("header")))
    headers.write.mode("overwrite").option("compression", "zstd").parquet(f"{path}/headers")
    # the key is never null, so the join's partitioning also serves the aggregate that drops repeated rows
    key = F.coalesce(F.col("page_id").cast("string"), F.lit("")).alias("key")
    owner = firsts.groupBy("digest").agg(F.first("first").alias("page_id")).select("digest", key)
    kept = (rows.select("digest", key, "payload").join(owner, ["digest", "key"])
            .groupBy("digest", "key").agg(F.first("payload").alias("payload")))
    kept.select("digest", "payload").write.mode("overwrite").option("compression", "zstd").parquet(f"{path}/payloads")


def payloads(spark: SparkSession, path: str) -> DataFrame:
    """Stored payloads with the digest of the bytes as read; a payload whose digest is not its key fails the job."""
    stored = spark.read.schema("digest string, payload binary").parquet(f"{path}/payloads")
    read = stored.withColumns({"__digest": F.sha2("payload", 256), "payload_bytes": F.octet_length("payload").cast("long")})
    checked = F.when(F.col("__digest") == F.col("digest"), F.col("digest")).otherwise(
        F.raise_error(F.concat(F.lit("payload does not match its digest "), F.col("digest"))))
    return read.select(checked.alias("digest"), "payload", "payload_bytes")


def header_field(header: Column, name: str) -> Column:
    """Value of a header line, or null."""
    value = F.regexp_extract(header, rf"(?:^|\r\n){name}: ([^\r\n]*)\r\n", 1)
    return F.when(value != "", value)


def _referred(uri: Column) -> Column:
    return F.regexp_extract(uri, r"^<urn:page:(.*)>$", 1)


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """Records of an archive: page_id, record_type, refers_to, payload_digest, payload_bytes, header and payload.

    Type, ids and digest are parsed from the header block; the payload and its length are those of the
    verified bytes. Without the payload column only digests and lengths are joined."""
    heads = spark.read.schema("page_id bigint, digest string, header string").parquet(f"{path}/headers")
    field = lambda k: header_field(F.col("header"), HEADER_FIELDS[k])
    parsed = heads.select(
        F.when(_referred(field("id")) != "null", _referred(field("id"))).cast("long").alias("page_id"),
        field("type").alias("record_type"),
        F.when(_referred(field("refers_to")) != "null", _referred(field("refers_to"))).cast("long").alias("refers_to"),
        F.regexp_extract(field("digest"), r"^sha256:([0-9a-f]{64})$", 1).alias("payload_digest"), "header")
    return parsed.join(payloads(spark, path), F.col("payload_digest") == F.col("digest")).drop("digest")


def original_records(spark: SparkSession, path: str) -> DataFrame:
    """(page_id, record): the exact bytes of every record as a WARC file holds it."""
    rows = read_archive(spark, path)
    block = F.when(F.col("record_type") == "response", F.col("payload")).otherwise(F.lit(b""))
    return rows.select("page_id", F.concat(F.col("header").cast("binary"), block, F.lit(b"\r\n\r\n")).alias("record"))


def write_warc_files(spark: SparkSession, path: str, out: str) -> None:
    """The archive as plain WARC files: each line of the text writer is a record, the line end is the two
    CRLFs that end one."""
    rows = read_archive(spark, path)
    block = F.when(F.col("record_type") == "response", F.col("payload").cast("string")).otherwise("")
    rows.select(F.concat("header", block).alias("value")).write.mode("overwrite").option("lineSep", CRLF * 2).text(out)


def read_warc_files(spark: SparkSession, path: str) -> DataFrame:
    """(header, block) of every record of WARC files; a file is read by one task, record by record."""
    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column(0):
                view, at, heads, blocks, held = memoryview(data.as_buffer()), 0, [], [], 0
                while at < len(view):
                    end = _find(view, b"\r\n\r\n", at) + 4
                    head = bytes(view[at:end])
                    size = next(int(x.split(b":", 1)[1]) for x in head.split(b"\r\n") if x.lower().startswith(b"content-length:"))
                    heads.append(head.decode())
                    blocks.append(bytes(view[end:end + size]))
                    at, held = end + size + 4, held + size
                    if held > 8 << 20:
                        yield pa.record_batch([pa.array(heads), pa.array(blocks, pa.binary())], ["header", "block"])
                        heads, blocks, held = [], [], 0
                yield pa.record_batch([pa.array(heads, pa.string()), pa.array(blocks, pa.binary())], ["header", "block"])
    return (spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)
            .select("content").mapInArrow(parse, "header string, block binary"))


def _find(view: memoryview, what: bytes, at: int) -> int:
    step = 1 << 14
    while True:
        got = bytes(view[at:at + step]).find(what)
        if got >= 0:
            return at + got
        if at + step >= len(view):
            raise ValueError("a record's header has no end")
        at += step - len(what)
