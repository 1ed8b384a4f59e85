"""WARC archives: write captures, read records, assemble transactions.

Each capture is three records: the response (or a revisit of an earlier equal
payload), and the request and metadata records that name it in
WARC-Concurrent-To. Archives are gzip files that Spark's text writer makes: a
row is a record, the line separator the two line ends that close a record.
"""

from __future__ import annotations

import gzip
import io
from collections.abc import Iterator

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vintage.llm import common

LEAST_SHARED = 100
RECORDS_PER_FILE = 6_000
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORD_SCHEMA = "warc_type string, record_id string, concurrent_to string, refers_to string, target_uri string, fields map<string,string>, payload_bytes long, payload_digest string"


def _record_id(kind: str, *parts: Column) -> Column:
    md5 = F.md5(F.concat_ws("|", F.lit(kind), *(F.coalesce(p.cast("string"), F.lit("")) for p in parts)))
    cut = [F.substring(md5, at, n) for at, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *cut), F.lit(">"))


def _record(headers: list[tuple[str, Column]], block: Column) -> Column:
    """A record without its closing line ends; headers whose value is null are left out."""
    lines = [F.lit("WARC/1.1")]
    lines += [F.when(v.isNotNull(), F.concat(F.lit(f"{k}: "), v)) for k, v in [*headers, ("Content-Length", F.length(block).cast("string"))]]
    return F.concat(F.concat(F.concat_ws("\r\n", *lines), F.lit("\r\n\r\n")).cast("binary"), block)


def captures_of(pages: DataFrame, least: int = LEAST_SHARED) -> DataFrame:
    """pages with payload, digest and, for a revisit, the first equal capture (smallest page_id, then url)."""
    own = pages.select("page_id", "url", F.coalesce(F.encode("html", "UTF-8"), F.lit(b"")).alias("payload"))
    own = own.withColumn("digest", F.sha2("payload", 256)).withColumn("size", F.length("payload").cast("long"))
    keys = own.where(F.col("size") >= least).groupBy("digest")
    # Nulls sort last: the smallest id that is known comes first.
    first = F.min(F.struct(F.col("page_id").isNull().alias("unknown"), "page_id", "url"))
    shared = keys.agg(first.alias("first"), F.count("*").alias("copies")).where("copies > 1").select(F.col("digest").alias("shared"), "first")
    joined = own.join(shared, own["digest"] == shared["shared"], "left")
    again = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first.page_id"))
    return joined.select("page_id", "url", "payload", "digest", "size", F.when(again, F.col("first")).alias("first"))


def write(pages: DataFrame, path: str, least: int = LEAST_SHARED) -> None:
    """Write the captures of pages (page_id, url, html) as gzip archives below path."""
    rows = captures_of(pages, least)
    uri = F.regexp_replace("url", r"[\r\n]", "")
    main = _record_id("response", F.col("page_id"), F.col("url"), F.col("digest"))
    first = F.col("first")
    revisit = first.isNotNull()
    ids = {kind: _record_id(kind, F.col("page_id"), F.col("url"), F.col("digest")) for kind in ("request", "metadata")}
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("size").cast("string"), F.lit("\r\n\r\n")).cast("binary")
    digest = F.concat(F.lit("sha256:"), F.col("digest"))
    response = _record(
        [
            ("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
            ("WARC-Record-ID", main),
            ("WARC-Date", F.lit(DATE)),
            ("WARC-Target-URI", uri),
            ("WARC-Payload-Digest", digest),
            ("WARC-Refers-To", F.when(revisit, _record_id("response", first["page_id"], first["url"], F.col("digest")))),
            ("WARC-Profile", F.when(revisit, PROFILE)),
            ("Content-Type", F.lit("application/http;msgtype=response")),
        ],
        F.when(revisit, http).otherwise(F.concat(http, F.col("payload"))),
    )
    common_headers = lambda kind, content: [("WARC-Type", F.lit(kind)), ("WARC-Record-ID", ids[kind]), ("WARC-Date", F.lit(DATE)), ("WARC-Target-URI", uri), ("WARC-Concurrent-To", main), ("Content-Type", F.lit(content))]
    host, target = F.coalesce(F.parse_url("clean", F.lit("HOST")), F.lit("")), F.coalesce(F.parse_url("clean", F.lit("FILE")), F.lit("/"))
    request = _record(common_headers("request", "application/http;msgtype=request"), F.concat(F.lit("GET "), F.when(target == "", "/").otherwise(target), F.lit(" HTTP/1.1\r\nHost: "), host, F.lit("\r\n\r\n")).cast("binary"))
    about = F.when(F.col("page_id").isNotNull(), F.concat(F.lit("page-id: "), F.col("page_id").cast("string"), F.lit("\r\n"))).otherwise("")
    metadata = _record(common_headers("metadata", "application/warc-fields"), about.cast("binary"))
    # A url that is no URL has neither host nor path.
    rows = rows.withColumn("clean", F.regexp_extract(F.coalesce(uri, F.lit("")), r"^[a-z]+://[A-Za-z0-9.:/?&=%_~+,;-]+$", 0))
    records = rows.select(F.explode(F.array(request, response, metadata)).alias("record"))
    records.select(F.col("record").cast("string").alias("value")).write.option("lineSep", "\r\n\r\n").option("compression", "gzip").option("maxRecordsPerFile", RECORDS_PER_FILE).text(path)


def parse(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers by lower-case name, block) of each record of an archive, plain or gzip."""
    stream = gzip.GzipFile(fileobj=io.BytesIO(data)) if data[:2] == b"\x1f\x8b" else io.BytesIO(data)
    while line := stream.readline():
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"not a record: {line[:40]!r}")
        headers: dict[str, str] = {}
        while (line := stream.readline()).strip():
            name, _, value = line.decode("utf-8", "replace").partition(":")
            headers[name.strip().lower()] = value.strip()
        size = int(headers["content-length"])
        block = stream.read(size)
        if len(block) < size:
            raise ValueError("a record is cut short")
        yield headers, block


def _http(block: bytes) -> tuple[dict[str, str], bytes]:
    head, _, payload = block.partition(b"\r\n\r\n")
    fields = (x.decode("utf-8", "replace").partition(":") for x in head.split(b"\r\n")[1:])
    return {n.strip().lower(): v.strip() for n, _, v in fields}, payload


def read(spark: SparkSession, path: str, with_payload: bool = False) -> DataFrame:
    """The records of the archives below path: RECORD_SCHEMA (and payload).

    fields holds the HTTP headers, or a metadata record's own fields. Digest
    and size of a response are those of the payload that was read; of a
    revisit, which has none, those its headers state.
    """
    schema = RECORD_SCHEMA + ", payload binary" * with_payload
    names = [x.split(" ")[0] for x in schema.replace("map<string,string>", "map").split(", ")]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.string()] * 5 + [pa.map_(pa.string(), pa.string()), pa.int64(), pa.string(), pa.binary()]
        for batch in batches:
            for content in batch.column(0):
                found, held = [], 0
                for headers, block in parse(content.as_py()):
                    kind, size, digest, payload = headers.get("warc-type"), None, None, None
                    if kind == "metadata":
                        fields = dict(x.split(": ", 1) for x in block.decode("utf-8", "replace").split("\r\n") if ": " in x)
                    else:
                        fields, payload = _http(block)
                    if kind == "response":
                        size, digest = len(payload), hashlib.sha256(payload).hexdigest()
                        if headers.get("warc-payload-digest", f"sha256:{digest}") != f"sha256:{digest}":
                            raise ValueError(f"{headers.get('warc-record-id')}: its payload isn't what was archived")
                    elif kind == "revisit":
                        size, digest, payload = int(fields.get("content-length", 0)), headers.get("warc-payload-digest", "").removeprefix("sha256:"), None
                    row = (kind, headers.get("warc-record-id"), headers.get("warc-concurrent-to"), headers.get("warc-refers-to"), headers.get("warc-target-uri"), list(fields.items()), size, digest, payload)
                    found.append(row[: len(names)])
                    held += len(block)
                    if held > 8 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found), kinds)], names)
                        found, held = [], 0
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found), kinds)], names)

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(rows, schema)


def assemble(records: DataFrame) -> DataFrame:
    """One nested row a capture: record_id, response, request, metadata, joined through concurrent-to identifiers.

    Equal captures written several times keep a row each. A capture without
    one of its companions has null there; companions without a response or
    revisit give no row.
    """
    of = lambda kind, *cols: F.max(F.when(F.col("warc_type") == kind, F.struct(*cols)))
    main = F.col("warc_type").isin("response", "revisit")
    request = F.struct("record_id", "target_uri")
    grouped = records.withColumn("capture", F.coalesce("concurrent_to", "record_id")).groupBy("capture").agg(
        F.max(F.when(main, F.struct("warc_type", "target_uri", "refers_to", "payload_bytes", "payload_digest"))).alias("response"),
        F.max(F.when(F.col("warc_type") == "request", request)).alias("request"),
        of("metadata", "record_id", F.col("fields").getItem("page-id").cast("long").alias("page_id")).alias("metadata"),
        F.count(F.when(main, 1)).alias("copies"),
    )
    once = grouped.where("response IS NOT NULL")
    return once.select(F.col("capture").alias("record_id"), "response", "request", "metadata", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy")).drop("copy")


def warc_round_trip(pages: DataFrame, least: int = LEAST_SHARED) -> DataFrame:
    """Write pages as archives in the shared folder, read them back, assemble: one row a page.

    page_id, payload_bytes, payload_digest, record_type, refers_to (a
    revisit's response). Null html is an empty payload; payloads under least
    bytes are all responses; among equal ones the smallest page_id responds
    and every row of that id does; null ids come last. Extra columns are ignored.
    """
    spark = pages.sparkSession
    path = common.scratch_path(spark, "warc")
    write(pages, path, least)
    found = common.written(assemble(read(spark, path)), "captures")
    names = found.where("response.warc_type = 'response'").groupBy("record_id").agg(F.max("metadata.page_id").alias("refers_to"))
    names = names.withColumnRenamed("record_id", "named")
    joined = found.join(names, found["response.refers_to"] == names["named"], "left")
    return joined.select(F.col("metadata.page_id").alias("page_id"), "response.payload_bytes", "response.payload_digest", F.col("response.warc_type").alias("record_type"), "refers_to")
